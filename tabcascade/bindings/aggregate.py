"""Audits, means, modes, distinct values, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import EVENTS_SQL, LABEL, ORDERS_SQL, Tables, events, orders, query
from tabcascade.operators.aggregates import (
    best_by_mean,
    city_population,
    confidence_histogram,
    modes,
    null_audit,
    rounded_mean,
    row_confidence,
    spread,
    top_k,
    total_nulls,
    value_counts,
)

AUDITED = ["price", "visits", "priority", "status"]


@query(
    "A1_null_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null, COUNT(*) AS n_rows FROM {ORDERS_SQL}" for c in AUDITED
    ),
)
def audit(t: Tables):
    return null_audit(orders(t), AUDITED)


@query(
    "A2_total_nulls",
    f"SELECT CAST(SUM({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in AUDITED)}) AS BIGINT) AS n_null FROM {ORDERS_SQL}",
)
def nulls(t: Tables):
    return total_nulls(orders(t), AUDITED)


@query(
    "A3_conditional_mean",
    """SELECT round_even(AVG(CASE WHEN p_size < 15 THEN p_retailprice END), 0) AS small,
       round_even(AVG(CASE WHEN p_size >= 15 AND p_size < 35 THEN p_retailprice END), 0) AS middle,
       round_even(AVG(CASE WHEN p_size >= 35 THEN p_retailprice END), 0) AS large FROM part""",
)
def conditional_mean(t: Tables):
    size = F.col("p_size")
    return t.part.agg(
        rounded_mean("p_retailprice", size < 15).alias("small"),
        rounded_mean("p_retailprice", (size >= 15) & (size < 35)).alias("middle"),
        rounded_mean("p_retailprice", size >= 35).alias("large"),
    )


@query("A4_mean", f"SELECT round(AVG(price), 4) AS mean_price, round_even(AVG(visits), 0) AS mean_visits FROM {ORDERS_SQL}")
def mean(t: Tables):
    return orders(t).agg(F.round(F.avg("price"), 4).alias("mean_price"), rounded_mean("visits").alias("mean_visits"))


def mode_sql(column: str, kind: str = "VARCHAR") -> str:
    return (
        f"(SELECT '{column}' AS column_name, CAST({column} AS {kind}) AS mode_value, COUNT(*) AS n FROM {ORDERS_SQL} "
        f"WHERE {column} IS NOT NULL GROUP BY 2 ORDER BY n DESC, mode_value ASC LIMIT 1)"
    )


@query("A5_mode_text", f"SELECT * FROM {mode_sql('priority')} UNION ALL SELECT * FROM {mode_sql('status')}")
def mode_text(t: Tables):
    return modes(orders(t), texts=["priority", "status"]).select("column_name", F.col("text").alias("mode_value"), "n")


@query("A5_mode_number", f"SELECT * FROM {mode_sql('visits', 'DOUBLE')} UNION ALL SELECT * FROM {mode_sql('is_train', 'DOUBLE')}")
def mode_number(t: Tables):
    return modes(orders(t), ["visits", "is_train"]).select("column_name", F.col("number").alias("mode_value"), "n")


@query(
    "A6_spread",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(AVG({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_value, "
        f"MIN({c}) AS min_value, MAX({c}) AS max_value FROM {ORDERS_SQL}"
        for c in ("price", "visits")
    ),
)
def spreads(t: Tables):
    df = spread(orders(t), ["price", "visits"])
    return df.withColumns({c: F.round(c, 4) for c in ("mean_value", "std_value")})


@query("A7_distinct_pairs", f"SELECT DISTINCT priority, status FROM {ORDERS_SQL}")
def pairs(t: Tables):
    return orders(t).select("priority", "status").distinct()


@query(
    "A7_distinct_count",
    f"SELECT COUNT(DISTINCT priority) AS priorities, COUNT(DISTINCT o_custkey) AS customers FROM {ORDERS_SQL}",
)
def distinct_count(t: Tables):
    return orders(t).agg(F.countDistinct("priority").alias("priorities"), F.countDistinct("o_custkey").alias("customers"))


@query("A8_class_counts", f"SELECT label, COUNT(*) AS n FROM {EVENTS_SQL} GROUP BY label")
def counts(t: Tables):
    return value_counts(events(t), "label")


# City = nation (missing for some customers), zip code = customer, people = balance.
PLACES = [
    "CASE WHEN c_custkey % 17 = 2 THEN NULL ELSE CONCAT('CITY_', c_nationkey) END AS city",
    "CASE WHEN c_custkey % 12 = 5 THEN NULL WHEN c_nationkey = 7 THEN -1 ELSE c_custkey - c_custkey % 2 END AS zip",
]
PEOPLE = ["c_custkey AS zip", "CAST(round(c_acctbal) AS BIGINT) AS people"]
CITY_SQL = f"""
  WITH pair AS (SELECT DISTINCT city, zip FROM (SELECT {', '.join(PLACES)} FROM customer) WHERE city IS NOT NULL),
  pop AS (SELECT {', '.join(PEOPLE)} FROM customer WHERE c_custkey % 10 <> 6),
  per AS (SELECT city, COALESCE(SUM(people), 0) AS people, COUNT(people) AS zips FROM pair LEFT JOIN pop ON pair.zip = pop.zip GROUP BY city)
"""
CITY_MEAN = "round_even(CASE WHEN zips > 0 THEN CAST(people AS DOUBLE) / zips ELSE 0.0 END, 0)"
POOLED = "round_even(CAST(SUM(people) AS DOUBLE) / SUM(zips), 0)"


@query(
    "A9_city_population",
    f"{CITY_SQL} SELECT city, CAST({CITY_MEAN} AS DOUBLE) AS mean_population FROM per UNION ALL SELECT NULL, CAST({POOLED} AS DOUBLE) FROM per",
)
def city_means(t: Tables):
    places = t.customer.selectExpr(*PLACES)
    people = t.customer.filter("c_custkey % 10 <> 6").selectExpr(*PEOPLE)
    return city_population(places, people, "city", "zip", "people")


@query(
    "A10_mean_fold_score",
    f"SELECT setting, round(AVG(score), 6) AS mean_score FROM (SELECT event_id % 7 AS setting, event_id % 5 AS fold, AVG(value) AS score FROM events GROUP BY 1, 2) GROUP BY setting",
)
def fold_means(t: Tables):
    scores = t.events.groupBy((F.col("event_id") % 7).alias("setting"), (F.col("event_id") % 5).alias("fold")).agg(F.avg("value").alias("score"))
    return scores.groupBy("setting").agg(F.round(F.avg("score"), 6).alias("mean_score"))


P0, P1 = "(event_id * 37 % 1000) / 1000.0", "(1000 - event_id * 37 % 1000) / 1000.0"


@query(
    "A11_row_confidence",
    f"SELECT event_id, CAST(GREATEST({P0}, {P1}) AS DOUBLE) AS confidence FROM events",
)
def confidences(t: Tables):
    df = t.events.selectExpr("event_id", f"CAST({P0} AS DOUBLE) AS p0", f"CAST({P1} AS DOUBLE) AS p1")
    return df.select("event_id", row_confidence(["p0", "p1"]).alias("confidence"))


CONFIDENCE = "CAST(0.5 + ((event_id * 37) % 997) / 1994.0 AS DOUBLE)"


@query(
    "A12_confidence_histogram",
    f"""SELECT fold, correct, bin, COUNT(*) AS n FROM (
      SELECT event_id % 5 AS fold, {LABEL} = (event_id * 7) % 6 AS correct, CAST(floor((conf - 0.5) * 49 / 0.5) + 1 AS INT) AS bin
      FROM (SELECT event_id, {CONFIDENCE} AS conf FROM events) WHERE conf < 0.9) GROUP BY 1, 2, 3""",
)
def histogram(t: Tables):
    df = t.events.selectExpr("event_id % 5 AS fold", f"{LABEL} AS label", "(event_id * 7) % 6 AS prediction", f"{CONFIDENCE} AS conf")
    return confidence_histogram(df, "fold", "label", "prediction", "conf")


@query(
    "A13_top_k",
    "SELECT c_name AS name, round(c_acctbal, 2) AS score FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20",
)
def best_customers(t: Tables):
    scores = t.customer.selectExpr("c_name AS name", "c_acctbal AS score")
    return top_k(scores, "score", "name", 20).select("name", F.round("score", 2).alias("score"))


@query(
    "A15_best_setting",
    """SELECT setting, round(AVG(score), 6) AS mean_score FROM
    (SELECT o_custkey % 9 AS setting, o_orderkey % 5 AS fold, AVG(o_totalprice) AS score FROM orders GROUP BY 1, 2)
    GROUP BY setting ORDER BY AVG(score) DESC, setting LIMIT 1""",
)
def best_setting(t: Tables):
    scores = t.orders.groupBy((F.col("o_custkey") % 9).alias("setting"), (F.col("o_orderkey") % 5).alias("fold")).agg(
        F.avg("o_totalprice").alias("score")
    )
    return best_by_mean(scores, "setting", "score").select("setting", F.round("mean_score", 6).alias("mean_score"))
