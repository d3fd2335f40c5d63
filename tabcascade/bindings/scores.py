"""Votes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import EVENTS_SQL, LABEL, PREDICTED, Tables, query
from tabcascade.operators.metrics import accuracy, class_scores, confusion, error_rate, f1_binary, f1_macro, f1_micro, roc_auc
from tabcascade.operators.voting import vote_rows, with_vote

VOTES = 15
VOTE_COLUMNS = [f"CAST((event_id * {k} + {k * k}) % (5 + {k % 3}) % 5 AS INT) AS m{k}" for k in range(1, VOTES + 1)]
LONG_SQL = " UNION ALL ".join(f"SELECT event_id, {c.rsplit(' AS ', 1)[0]} AS vote FROM events" for c in VOTE_COLUMNS)


def winner_sql(shift: int) -> str:
    return f"""SELECT event_id, CAST(vote + {shift} AS INT) AS vote FROM
      (SELECT event_id, vote, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, vote) AS r FROM
        (SELECT event_id, vote, COUNT(*) AS n FROM ({LONG_SQL}) GROUP BY 1, 2)) WHERE r = 1"""


NAMES = [f"m{k}" for k in range(1, VOTES + 1)]


def ballots(t: Tables):
    return t.events.selectExpr("event_id", *VOTE_COLUMNS)


@query("V1_vote_columns", winner_sql(0))
def columns_vote(t: Tables):
    return with_vote(ballots(t), NAMES, range(5), "vote").select("event_id", "vote")


@query("V1_vote_rows", winner_sql(0))
def rows_vote(t: Tables):
    long = ballots(t).select("event_id", F.explode(F.array(*NAMES)).alias("vote"))
    return vote_rows(long, "event_id", "vote")


@query("V2_vote_shifted", winner_sql(1))
def shifted_vote(t: Tables):
    return with_vote(ballots(t), NAMES, range(5), "vote", shift=1).select("event_id", "vote")


# ---- scores ----------------------------------------------------------------------------------

PREDICTIONS = f"(SELECT event_id, {LABEL} AS label, {PREDICTED} AS prediction FROM events)"


def predictions(t: Tables):
    return t.events.selectExpr("event_id", f"{LABEL} AS label", f"{PREDICTED} AS prediction")


HITS = "AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)"
CLASS_SQL = f"""(SELECT c AS class, SUM(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS p,
  SUM(CASE WHEN label = c THEN 1 ELSE 0 END) AS a FROM {PREDICTIONS}, (SELECT DISTINCT label AS c FROM {EVENTS_SQL}) GROUP BY c)"""


@query("E1_accuracy", f"SELECT round({HITS}, 6) AS accuracy FROM {PREDICTIONS}")
def accuracies(t: Tables):
    return accuracy(predictions(t), "label", "prediction").select(F.round("accuracy", 6).alias("accuracy"))


@query("E2_f1_binary", f"SELECT round(2.0 * tp / (p + a), 6) AS f1 FROM {CLASS_SQL} WHERE class = 1")
def binary_f1(t: Tables):
    return f1_binary(confusion(predictions(t), "label", "prediction")).select(F.round("f1", 6).alias("f1"))


@query("E3_f1_macro", f"SELECT round(AVG(2.0 * tp / (p + a)), 6) AS f1_macro FROM {CLASS_SQL}")
def macro_f1(t: Tables):
    return f1_macro(confusion(predictions(t), "label", "prediction")).select(F.round("f1_macro", 6).alias("f1_macro"))


@query("E4_f1_micro", f"SELECT round({HITS}, 6) AS f1_micro FROM {PREDICTIONS}")
def micro_f1(t: Tables):
    return f1_micro(confusion(predictions(t), "label", "prediction")).select(F.round("f1_micro", 6).alias("f1_micro"))


@query("E5_error", f"SELECT round(1 - {HITS}, 6) AS error FROM {PREDICTIONS}")
def error(t: Tables):
    return error_rate(predictions(t), "label", "prediction").select(F.round("error", 6).alias("error"))


@query(
    "E6_roc_auc",
    f"""SELECT round((SUM(CASE WHEN y = 1 THEN r ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * SUM(1 - y)), 6) AS auc FROM
    (SELECT y, rank() OVER (ORDER BY value) + (COUNT(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM
      (SELECT CASE WHEN {LABEL} > 0 THEN 1 ELSE 0 END AS y, value FROM events))""",
)
def auc(t: Tables):
    rows = t.events.selectExpr(f"CASE WHEN {LABEL} > 0 THEN 1 ELSE 0 END AS y", "value")
    return t.spark.createDataFrame([(round(roc_auc(rows, "y", "value"), 6),)], "auc double")


@query("E7_confusion", f"SELECT label, prediction, COUNT(*) AS n FROM {PREDICTIONS} GROUP BY label, prediction")
def confusions(t: Tables):
    return confusion(predictions(t), "label", "prediction")


@query(
    "E7_class_scores",
    f"""SELECT class, round(CAST(tp AS DOUBLE) / p, 6) AS "precision", round(CAST(tp AS DOUBLE) / a, 6) AS recall, round(2.0 * tp / (p + a), 6) AS f1, CAST(a AS BIGINT) AS support
    FROM {CLASS_SQL}""",
)
def per_class(t: Tables):
    scores = class_scores(confusion(predictions(t), "label", "prediction"))
    return scores.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
