"""Fill, one-hot and scaling queries, fitted on the training orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import ORDERS_SQL, Tables, orders, query
from tabcascade.operators.prepare import (
    FillSpec,
    apply_fill,
    apply_one_hot,
    apply_scaling,
    fit_fill,
    encode_levels,
    fit_level_table,
    fit_levels,
    fit_min_max,
    fit_standard,
    polynomial,
)
from tabcascade.operators.relational import enrich

TRAIN = "is_train = 1"


def filled_sql(*columns: tuple[str, str]) -> str:
    """Each column filled with a value that a scalar subquery finds in the training rows."""
    parts = ", ".join(f"COALESCE({c}, (SELECT {stat} FROM {ORDERS_SQL} WHERE {TRAIN})) AS {c}" for c, stat in columns)
    return f"SELECT o_orderkey, {parts} FROM {ORDERS_SQL}"


def mode_of(column: str) -> str:
    return f"""(SELECT {column} FROM (SELECT {column}, COUNT(*) AS n FROM {ORDERS_SQL} WHERE {TRAIN} AND {column} IS NOT NULL GROUP BY 1)
    ORDER BY n DESC, {column} ASC LIMIT 1)"""


def fill(t: Tables, spec: FillSpec):
    df = orders(t)
    return apply_fill(df, fit_fill(df.filter(TRAIN), spec))


@query("F1_rounded_mean_fill", filled_sql(("visits", "round_even(AVG(visits), 0)")))
def rounded_fill(t: Tables):
    return fill(t, FillSpec(rounded_mean=["visits"])).select("o_orderkey", "visits")


@query("F2_mean_fill", f"SELECT o_orderkey, round(price, 4) AS price FROM ({filled_sql(('price', 'AVG(price)'))})")
def mean_fill(t: Tables):
    return fill(t, FillSpec(mean=["price"])).select("o_orderkey", F.round("price", 4).alias("price"))


@query("F3_zero_fill", f"SELECT o_orderkey, COALESCE(price, 0) AS price FROM {ORDERS_SQL}")
def zero_fill(t: Tables):
    return fill(t, FillSpec(zero=["price"])).select("o_orderkey", "price")


@query("F4_mode_fill_number", f"SELECT o_orderkey, COALESCE(visits, {mode_of('visits')}) AS visits FROM {ORDERS_SQL}")
def mode_fill_number(t: Tables):
    return fill(t, FillSpec(mode=["visits"])).select("o_orderkey", "visits")


@query(
    "F5_mode_fill_text",
    f"SELECT o_orderkey, COALESCE(priority, {mode_of('priority')}) AS priority, COALESCE(status, {mode_of('status')}) AS status FROM {ORDERS_SQL}",
)
def mode_fill_text(t: Tables):
    return fill(t, FillSpec(mode_text=["priority", "status"])).select("o_orderkey", "priority", "status")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
ONE_HOT_SQL = ", ".join(
    f"CAST(COALESCE({c} = '{v}', FALSE) AS INT) AS \"{c}_{v}\"" for c, vs in (("priority", PRIORITIES), ("status", STATUSES)) for v in vs
)


@query("F6_one_hot", f"SELECT o_orderkey, {ONE_HOT_SQL} FROM {ORDERS_SQL}")
def one_hot(t: Tables):
    df = orders(t)
    levels = fit_levels(df.filter(TRAIN), ["priority", "status"])
    return apply_one_hot(df, levels).drop("o_custkey", "price", "visits", "is_train")


WIDE = "(SELECT *, CAST(o_custkey AS VARCHAR) AS buyer FROM " + ORDERS_SQL + ")"


@query(
    "F6_sparse_levels",
    f"""SELECT priority, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN known THEN buyer ELSE '' END) AS n_codes,
      CAST(sum(CASE WHEN priority IS NULL THEN 0 ELSE 1 END + CASE WHEN known THEN 1 ELSE 0 END) AS BIGINT) AS n_set
    FROM (SELECT *, buyer IN (SELECT buyer FROM {WIDE} WHERE {TRAIN}) AS known FROM {WIDE}) GROUP BY priority""",
)
def sparse_levels(t: Tables):
    """A column with a level for each buyer beside a narrow one: distinct codes and set places per priority."""
    df = orders(t).withColumn("buyer", F.col("o_custkey").cast("string"))
    levels = fit_level_table(df.filter(TRAIN), ["priority", "buyer"], leaf_rows=50)
    coded = encode_levels(df.select("o_orderkey", "priority", "buyer"), levels, row_key="o_orderkey").withColumn("flags", F.unwrap_udt("encoded"))
    ones = F.aggregate("flags.values", F.lit(0.0), lambda a, x: a + x)  # of the set places alone
    return coded.groupBy("priority").agg(F.count("*").alias("n"), F.countDistinct("flags").alias("n_codes"), F.sum(ones.cast("long")).alias("n_set"))


@query(
    "F7_z_score",
    f"""SELECT o_orderkey, round((price - m1) / s1, 6) AS price, round((visits - m2) / s2, 6) AS visits FROM {ORDERS_SQL},
    (SELECT AVG(price) AS m1, stddev_samp(price) AS s1, AVG(visits) AS m2, stddev_samp(visits) AS s2 FROM {ORDERS_SQL} WHERE {TRAIN})""",
)
def z_score(t: Tables):
    df = orders(t)
    scaled = apply_scaling(df, fit_standard(df.filter(TRAIN), ["price", "visits"]))
    return scaled.select("o_orderkey", F.round("price", 6).alias("price"), F.round("visits", 6).alias("visits"))


@query(
    "F8_min_max",
    f"""SELECT o_orderkey, round((price - l1) / (h1 - l1), 6) AS price, round((visits - l2) / (h2 - l2), 6) AS visits FROM {ORDERS_SQL},
    (SELECT MIN(price) AS l1, MAX(price) AS h1, MIN(visits) AS l2, MAX(visits) AS h2 FROM {ORDERS_SQL} WHERE {TRAIN})""",
)
def min_max(t: Tables):
    df = orders(t)
    scaled = apply_scaling(df, fit_min_max(df.filter(TRAIN), ["price", "visits"]))
    return scaled.select("o_orderkey", F.round("price", 6).alias("price"), F.round("visits", 6).alias("visits"))


@query(
    "F9_polynomial",
    """SELECT p_partkey, size, price, size * size AS "size^2", size * price AS "size price", price * price AS "price^2" FROM
    (SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS size, floor(p_retailprice) / 8 AS price FROM part)""",
)
def polynomial_terms(t: Tables):
    df = t.part.selectExpr("p_partkey", "CAST(p_size AS DOUBLE) / 4 AS size", "CAST(floor(p_retailprice) AS DOUBLE) / 8 AS price")
    return polynomial(df, ["size", "price"])


# ---- everything together ---------------------------------------------------------------------

CLEAN_SQL = f"""WITH d AS (SELECT o.*, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 8 = 5 THEN NULL ELSE c_acctbal END AS balance, n_regionkey AS region
    FROM {ORDERS_SQL} o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT AVG(price) AS price, AVG(balance) AS balance, round_even(AVG(visits), 0) AS visits FROM d WHERE {TRAIN}),
  seg AS (SELECT segment FROM (SELECT segment, COUNT(*) AS n FROM d WHERE {TRAIN} AND segment IS NOT NULL GROUP BY 1) ORDER BY n DESC, segment LIMIT 1),
  pri AS (SELECT priority FROM (SELECT priority, COUNT(*) AS n FROM d WHERE {TRAIN} AND priority IS NOT NULL GROUP BY 1) ORDER BY n DESC, priority LIMIT 1),
  f AS (SELECT o_orderkey, is_train, region, COALESCE(d.price, m.price) AS price, COALESCE(d.balance, m.balance) AS balance, COALESCE(d.visits, m.visits) AS visits,
    COALESCE(d.segment, seg.segment) AS segment, COALESCE(d.priority, pri.priority) AS priority FROM d, m, seg, pri),
  s AS (SELECT AVG(price) AS mp, stddev_samp(price) AS sp, AVG(balance) AS mb, stddev_samp(balance) AS sb, AVG(visits) AS mv, stddev_samp(visits) AS sv
    FROM f WHERE {TRAIN})
  SELECT o_orderkey, region, segment, priority, round((price - mp) / sp, 5) AS price, round((balance - mb) / sb, 5) AS balance, round((visits - mv) / sv, 5) AS visits
  FROM f, s"""


@query("L1_assemble_fill_scale", CLEAN_SQL)
def clean(t: Tables):
    """Assemble, fill and scale, all statistics from the training rows."""
    people = t.customer.selectExpr(
        "c_custkey AS o_custkey",
        "c_nationkey",
        "CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE c_mktsegment END AS segment",
        "CASE WHEN c_custkey % 8 = 5 THEN NULL ELSE c_acctbal END AS balance",
    )
    places = t.nation.selectExpr("n_nationkey AS c_nationkey", "n_regionkey AS region")
    df = enrich(enrich(orders(t), people, "o_custkey"), places, "c_nationkey")
    train = df.filter(TRAIN)
    spec = FillSpec(rounded_mean=["visits"], mean=["price", "balance"], mode_text=["segment", "priority"])
    values = fit_fill(train, spec)
    filled = apply_fill(df, values)
    numbers = ["price", "balance", "visits"]
    scaled = apply_scaling(filled, fit_standard(filled.filter(TRAIN), numbers))
    return scaled.select("o_orderkey", "region", "segment", "priority", *[F.round(c, 5).alias(c) for c in numbers])
