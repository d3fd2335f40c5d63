"""Class balancing and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import EVENTS_SQL, Tables, events, query, seeded_sql, sub
from tabcascade.operators.folds import group_folds, stratified_folds
from tabcascade.operators.sampling import (
    balanced_bag,
    class_weight_table,
    keep_exactly,
    over_sample,
    stratified_fraction,
    top_up,
    under_then_over,
    under_then_top_up,
    with_class_weight,
)

SEED = 326
# The scale path (refining by hash prefix, ranking by bucket) on test-sized data.
SMALL_LEAF = 200


def ranked_sql(source: str, seed: int = SEED) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded_sql(seed, 'event_id')}, event_id) - 1 AS pos FROM {source})"


def draws_sql(source: str, draws: str, seed: int = SEED) -> str:
    """Rows drawn with replacement; ``draws`` gives (label, n_draws) per class."""
    code = f"md5(concat_ws(':', '{seed}', CAST(label AS VARCHAR), CAST(d AS VARCHAR)))"
    return f"""(SELECT r.event_id, r.label FROM
      (SELECT w.label, ('0x' || substr({code}, 1, 15))::BIGINT % size AS pos FROM
        (SELECT q.label, size, unnest(range(0, CAST(n_draws AS BIGINT))) AS d FROM {draws} q
         JOIN (SELECT label, COUNT(*) AS size FROM {source} GROUP BY label) z ON q.label = z.label) w) k
      JOIN {ranked_sql(source, seed)} r ON r.label = k.label AND r.pos = k.pos)"""


def copies_sql(rows: str) -> str:
    return f"SELECT event_id, label, COUNT(*) AS copies FROM {rows} GROUP BY event_id, label"


def copies(df):
    return df.groupBy("event_id", "label").agg(F.count("*").alias("copies"))


def top_up_draws(source: str) -> str:
    return f"""(SELECT label, GREATEST(0, trunc((SELECT COUNT(*) FROM {source} WHERE label = 0) /
      (SELECT COUNT(DISTINCT label) - 1 FROM {source}) - COUNT(*))) AS n_draws FROM {source} WHERE label <> 0 GROUP BY label)"""


def top_up_sql(source: str) -> str:
    return copies_sql(f"(SELECT event_id, label FROM {source} UNION ALL SELECT * FROM {draws_sql(source, top_up_draws(source))})")


def under_sql(source: str, label: int, n: int) -> str:
    return f"(SELECT event_id, label FROM {ranked_sql(source)} WHERE label <> {label} OR pos < {n})"


def over_sql(source: str) -> str:
    draws = f"""(SELECT label, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY label)) - COUNT(*) AS n_draws
      FROM {source} GROUP BY label)"""
    return copies_sql(f"(SELECT event_id, label FROM {source} UNION ALL SELECT * FROM {draws_sql(source, draws)})")


SMALL = "(SELECT event_id, label FROM " + EVENTS_SQL + ")"


def pairs(t: Tables):
    return events(t).select("event_id", "label")


@query("H1_top_up", top_up_sql(SMALL))
def topped_up(t: Tables):
    return copies(top_up(pairs(t), "event_id", "label", SEED))


@query("H2_under_then_top_up", top_up_sql(under_sql(SMALL, 0, 500)))
def under_topped_up(t: Tables):
    return copies(under_then_top_up(pairs(t), "event_id", "label", 500, SEED))


@query("H2_under_sample", under_sql(SMALL, 0, 500)[1:-1])
def under(t: Tables):
    return keep_exactly(pairs(t), "event_id", "label", {0: 500}, SEED)


@query("H2_under_sample_refined", under_sql(SMALL, 0, 500)[1:-1])
def under_refined(t: Tables):
    return keep_exactly(pairs(t), "event_id", "label", {0: 500}, SEED, leaf_rows=20)


@query(
    "H3_balanced_bag",
    copies_sql(
        f"(SELECT event_id, label FROM {under_sql(SMALL, 0, 600)} WHERE label = 0 UNION ALL SELECT * FROM "
        f"{draws_sql(SMALL, '(SELECT DISTINCT label, 120 AS n_draws FROM ' + EVENTS_SQL + ' WHERE label <> 0)')})"
    ),
)
def bag(t: Tables):
    return copies(balanced_bag(pairs(t), "event_id", "label", 600, 120, SEED))


REASONS = f"(SELECT event_id, label - 1 AS label FROM {EVENTS_SQL} WHERE label > 0)"


def reasons(t: Tables):
    return events(t).filter("label > 0").selectExpr("event_id", "label - 1 AS label")


@query("H4_over_sample", over_sql(REASONS))
def over(t: Tables):
    return copies(over_sample(reasons(t), "event_id", "label", SEED))


@query("H4_over_sample_bucketed", over_sql(REASONS))
def over_bucketed(t: Tables):
    return copies(over_sample(reasons(t), "event_id", "label", SEED, leaf_rows=SMALL_LEAF))


@query("H5_under_then_over", over_sql(under_sql(REASONS, 0, 300)))
def under_over(t: Tables):
    return copies(under_then_over(reasons(t), "event_id", "label", {0: 300}, SEED))


@query(
    "H8_stratified_fraction",
    f"SELECT event_id, r.label FROM {ranked_sql(SMALL)} r JOIN (SELECT label, COUNT(*) AS n FROM {SMALL} GROUP BY label) z ON r.label = z.label WHERE pos < ceil(n / 3)",
)
def third(t: Tables):
    return stratified_fraction(pairs(t), "event_id", "label", 3, SEED)


@query(
    "H9_class_weight",
    f"""SELECT event_id, e.label, round(total / (k * n), 6) AS weight FROM {SMALL} e
    JOIN (SELECT label, COUNT(*) AS n FROM {SMALL} GROUP BY label) z ON e.label = z.label,
    (SELECT CAST(COUNT(*) AS DOUBLE) AS total, COUNT(DISTINCT label) AS k FROM {SMALL})""",
)
def weights(t: Tables):
    df = pairs(t)
    return with_class_weight(df, "label", class_weight_table(df, "label")).withColumn("weight", F.round("weight", 6))


# ---- folds --------------------------------------------------------------------------------------


def folds_sql(order: str, k: int = 5) -> str:
    """Rows of class c take the fold whose stretch of the class their rank lies in."""
    return f"""WITH e AS {SMALL}, z AS (SELECT label, n, SUM(n) OVER (ORDER BY label) - n AS s FROM (SELECT label, COUNT(*) AS n FROM e GROUP BY label)),
    share AS (SELECT label, i, floor((s + n - i + {k - 1}) / {k}) - floor((s - i + {k - 1}) / {k}) AS m FROM z, (SELECT unnest(range({k})) AS i)),
    ends AS (SELECT label, i, SUM(m) OVER (PARTITION BY label ORDER BY i) AS upto FROM share),
    r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {order}) - 1 AS pos FROM e)
    SELECT event_id, r.label, CAST(SUM(CASE WHEN pos >= upto THEN 1 ELSE 0 END) AS INT) AS fold
    FROM r JOIN ends ON r.label = ends.label GROUP BY event_id, r.label"""


@query("K1_stratified_folds", folds_sql("event_id"))
def folds_in_order(t: Tables):
    return stratified_folds(pairs(t), "event_id", "label", 5)


@query("K1_stratified_folds_refined", folds_sql("event_id"))
def folds_in_order_refined(t: Tables):
    return stratified_folds(pairs(t), "event_id", "label", 5, leaf_rows=SMALL_LEAF)


@query("K2_shuffled_folds", folds_sql(f"{seeded_sql(1126, 'event_id')}, event_id"))
def folds_shuffled(t: Tables):
    return stratified_folds(pairs(t), "event_id", "label", 5, seed=1126)


def group_folds_sql(rows: str, group: str, k: int = 5) -> str:
    """Heaviest groups first, groups of one weight dealt in turn from the emptiest fold on, class by class."""
    code = seeded_sql(0, group)
    turn = f"coalesce(('0x' || substr(md5(CAST(label AS VARCHAR)), 1, 8))::BIGINT % {k}, 0)"
    deal = (
        f"list_transform(list_sort(list_transform(range({k}), lambda i: {{'load': loads[i + 1], 'turn': (i - turn + {k}) % {k}, 'i': i}})), lambda x: x.i)"
    )
    return f"""WITH RECURSIVE e AS {rows},
    g AS (SELECT {code} AS code, arg_min(label, (-n, label)) AS label, SUM(n) AS w FROM (SELECT {group}, label, COUNT(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
    h AS (SELECT label, w, COUNT(*) AS c, row_number() OVER (PARTITION BY label ORDER BY w DESC) AS step FROM g GROUP BY label, w),
    d AS (
      SELECT DISTINCT label, CAST(0 AS BIGINT) AS step, CAST(0 AS HUGEINT) AS w, list_transform(range({k}), lambda i: CAST(0 AS HUGEINT)) AS loads, CAST([] AS BIGINT[]) AS deal, {turn} AS turn FROM h
      UNION ALL
      SELECT label, step, w, list_transform(range({k}), lambda i: loads[i + 1] + (c // {k}) * w + CASE WHEN list_position(deal, i) <= c % {k} THEN w ELSE 0 END) AS loads, deal, turn
      FROM (SELECT d.label, h.step, CAST(h.w AS HUGEINT) AS w, h.c, d.loads, {deal} AS deal, d.turn FROM d JOIN h ON h.label IS NOT DISTINCT FROM d.label AND h.step = d.step + 1)
    ),
    r AS (SELECT code, label, w, row_number() OVER (PARTITION BY label, w ORDER BY code) - 1 AS pos FROM g),
    f AS (SELECT r.code, CAST(d.deal[r.pos % {k} + 1] AS INT) AS fold FROM r JOIN d ON d.label IS NOT DISTINCT FROM r.label AND d.w = r.w)"""


def folded_sql(rows: str, group: str, columns: str, by: str = "") -> str:
    return f"{group_folds_sql(rows, group)} SELECT {columns} FROM e JOIN f ON f.code = {seeded_sql(0, 'e.' + group)} {by}"


COPIED = f"(SELECT event_id, label FROM {REASONS} UNION ALL SELECT * FROM " + draws_sql(
    REASONS,
    f"""(SELECT label, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {REASONS} GROUP BY label)) - COUNT(*) AS n_draws FROM {REASONS} GROUP BY label)""",
) + ")"


@query(
    "H6_copies_share_fold",
    folded_sql(COPIED, "event_id", "e.event_id, e.label, fold, COUNT(*) AS copies", "GROUP BY 1, 2, 3"),
)
def copies_in_folds(t: Tables):
    drawn = over_sample(reasons(t), "event_id", "label", SEED)
    folded = group_folds(drawn, "event_id", "label", 5)
    return folded.groupBy("event_id", "label", "fold").agg(F.count("*").alias("copies"))


ORDER_ROWS = "(SELECT o_orderkey, o_custkey, CAST(o_custkey % 3 AS INT) AS label FROM orders)"


@query(
    "K3_group_folds",
    folded_sql(ORDER_ROWS, "o_custkey", "e.o_orderkey, e.label, fold"),
)
def grouped_folds(t: Tables):
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "CAST(o_custkey % 3 AS INT) AS label")
    return group_folds(rows, "o_custkey", "label", 5).select("o_orderkey", "label", "fold")


MIXED_ROWS = "(SELECT o_orderkey, o_custkey, CAST(o_orderkey % 3 AS INT) AS label FROM orders)"


@query(
    "K3_group_folds_mixed_labels",
    folded_sql(MIXED_ROWS, "o_custkey", "e.o_orderkey, e.label, fold"),
)
def mixed_folds(t: Tables):
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "CAST(o_orderkey % 3 AS INT) AS label")
    return group_folds(rows, "o_custkey", "label", 5, leaf_rows=SMALL_LEAF).select("o_orderkey", "label", "fold")


HOT_ROWS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS grp",
    "CAST(CASE WHEN o_custkey % 5 < 2 THEN NULL ELSE o_orderkey % 2 END AS INT) AS label",
]


@query("K3_group_folds_hot_group", folded_sql(sub("orders", HOT_ROWS), "grp", "e.o_orderkey, e.grp, e.label, fold"))
def hot_group(t: Tables):
    """A group with a third of all rows, and many rows and groups without a label."""
    return group_folds(t.orders.selectExpr(*HOT_ROWS), "grp", "label", 5)


MANY = ["event_id", "CAST(event_id % 997 AS INT) AS label"]


@query("H8_fraction_of_many_classes", f"SELECT event_id, label FROM {ranked_sql(sub('events', MANY))} QUALIFY pos < ceil(COUNT(*) OVER (PARTITION BY label) / 3)")
def third_of_many(t: Tables):
    """A class for every 997th row: the plan is a table, not a list of cases."""
    return stratified_fraction(t.events.selectExpr(*MANY), "event_id", "label", 3, SEED)
