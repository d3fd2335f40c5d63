"""Projection, filter, join and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import (
    EVENTS_SQL,
    LABEL,
    ORDERS_SQL,
    PREDICTED,
    Tables,
    events,
    orders,
    query,
    seeded_sql,
)
from tabcascade.functions import (
    binary_label,
    code_label,
    decode_label,
    nan_to_null,
    seeded_code,
    shift_label,
    tokens_to_null,
)
from tabcascade.operators.relational import (
    append_rows,
    assemble,
    attach_label,
    cascade_columns,
    cascade_merge,
    enrich,
    fill_from_lookup,
    label_last,
    last_value_lookup,
    predictors,
    routed,
    split_by_label,
    with_suffix,
)

REGION_CODES = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3}


@query(
    "S2_drop_columns",
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
)
def drop_at_load(t: Tables):
    return t.customer.drop("c_name", "c_mktsegment")


@query("P1_predictors", f"SELECT user_id, event_type, value FROM {EVENTS_SQL}")
def predictor_columns(t: Tables):
    df = events(t)
    return df.select(*predictors(df, ["event_id", "label"]))


@query("P2_drop_redundant", f"SELECT o_orderkey, price, visits, status FROM {ORDERS_SQL}")
def drop_redundant(t: Tables):
    return orders(t).drop("o_custkey", "priority", "is_train")


@query("P3_label_last", f"SELECT event_id, label, user_id, event_type, value FROM {EVENTS_SQL}")
def move_label(t: Tables):
    return label_last(events(t).select("label", "event_id", "user_id", "event_type", "value"), "label")


@query(
    "P4_row_filter",
    f"SELECT o_orderkey, price, status FROM {ORDERS_SQL} WHERE price < 250000 AND visits >= 10 AND status <> 'P' AND is_train = 1",
)
def row_filter(t: Tables):
    df = orders(t)
    keep = (F.col("price") < 250000) & (F.col("visits") >= 10) & (F.col("status") != "P") & (F.col("is_train") == 1)
    return df.filter(keep).select("o_orderkey", "price", "status")


UNKNOWN = f"CAST(CASE WHEN event_id % 9 = 4 THEN -1 ELSE {LABEL} END AS INT) AS known"


@query(
    "P5_split_labelled",
    f"""SELECT CASE WHEN known = -1 THEN 'unlabelled' ELSE 'labelled' END AS part, COUNT(*) AS n, round(SUM(value), 4) AS total
    FROM (SELECT value, {UNKNOWN} FROM events) GROUP BY 1""",
)
def split_labelled(t: Tables):
    labelled, unlabelled = split_by_label(t.events.selectExpr("value", UNKNOWN), "known")
    both = append_rows(labelled.withColumn("part", F.lit("labelled")), unlabelled.withColumn("part", F.lit("unlabelled")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("P6_binary_label", f"SELECT event_id, CAST(CASE WHEN label = 0 THEN 0 ELSE 1 END AS INT) AS happened FROM {EVENTS_SQL}")
def binary(t: Tables):
    return events(t).select("event_id", binary_label("label").alias("happened"))


@query(
    "P7_code_label",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 6 = 2 THEN -1 WHEN r_name = 'AFRICA' THEN 0 WHEN r_name = 'AMERICA' THEN 1
       WHEN r_name = 'ASIA' THEN 2 WHEN r_name = 'EUROPE' THEN 3 END AS INT) AS code,
       CASE WHEN c_custkey % 6 <> 2 AND r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN r_name END AS name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def coded(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    df = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.withColumn("r_name", F.when(F.col("c_custkey") % 6 != 2, F.col("r_name")))
    code = code_label("r_name", REGION_CODES)
    return df.select("c_custkey", code.alias("code"), decode_label(code, REGION_CODES).alias("name"))


@query(
    "P8_shift_label",
    f"SELECT event_id, CAST(label - 1 AS INT) AS reason, CAST(label - 1 + 1 AS INT) AS back FROM {EVENTS_SQL} WHERE label > 0",
)
def shifted(t: Tables):
    reasons = events(t).filter("label > 0").select("event_id", shift_label("label", -1).alias("reason"))
    return reasons.withColumn("back", shift_label("reason", 1))


@query("P9_integer_label", f"SELECT event_id, CAST(CAST(label AS DOUBLE) AS INT) AS label FROM {EVENTS_SQL}")
def integer_label(t: Tables):
    return events(t).select("event_id", F.col("label").cast("double").cast("int").alias("label"))


@query("P10_group_id", f"SELECT event_id, {seeded_sql(0, 'event_id')} AS group_id FROM events")
def group_id(t: Tables):
    return t.events.select("event_id", seeded_code(0, "event_id").alias("group_id"))


@query("P13_fixed_projection", f"SELECT o_orderkey, price, status, priority FROM {ORDERS_SQL}")
def fixed_projection(t: Tables):
    return orders(t).select("o_orderkey", "price", "status", "priority")


@query(
    "S1_missing_tokens",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN NULL WHEN p_partkey % 4 = 2 THEN 'None' ELSE p_type END AS kind,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part""",
)
def missing_tokens(t: Tables):
    k = F.col("p_partkey") % 4
    raw = t.part.select(
        "p_partkey",
        F.when(k == 0, "NA").when(k == 1, " n/a ").when(k == 2, "None").otherwise(F.col("p_type")).alias("kind"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price"),
    )
    return nan_to_null(raw).withColumn("kind", tokens_to_null("kind"))


# ---- joins ---------------------------------------------------------------------------------

FACTS = "(SELECT o_custkey AS c_custkey, COUNT(*) AS n_orders, round(SUM(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey)"


@query(
    "J1_left_join_chain",
    f"""SELECT i.c_custkey, d.c_mktsegment, p.c_nationkey, f.n_orders, f.spent
    FROM (SELECT c_custkey FROM customer) i
    LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 8 <> 3) d ON d.c_custkey = i.c_custkey
    LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 9 <> 4) p ON p.c_custkey = i.c_custkey
    LEFT JOIN {FACTS} f ON f.c_custkey = i.c_custkey""",
)
def left_chain(t: Tables):
    who = t.customer.filter("c_custkey % 8 <> 3").select("c_custkey", "c_mktsegment")
    where = t.customer.filter("c_custkey % 9 <> 4").select("c_custkey", "c_nationkey")
    facts = (
        t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    return assemble(t.customer.select("c_custkey"), [who, where, facts], "c_custkey")


@query(
    "J2_enrich",
    """SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 1) ON o_custkey = c_custkey""",
)
def enrichment(t: Tables):
    lookup = t.customer.filter("c_custkey % 3 <> 1").selectExpr("c_custkey AS o_custkey", "c_acctbal", "c_mktsegment")
    return enrich(t.orders, lookup, "o_custkey").select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment")


@query(
    "J2_enrich_beyond_broadcast",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey, c_acctbal
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey FROM orders) o
    LEFT JOIN customer ON o.o_custkey = c_custkey""",
)
def enrichment_shuffled(t: Tables):
    """Half of the rows share one key and the lookup counts as too big to broadcast."""
    facts = t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey"
    )
    lookup = t.customer.selectExpr("c_custkey AS o_custkey", "c_acctbal")
    return enrich(facts, lookup, "o_custkey", broadcast_limit=0)


LOOKUP_SQL = """(SELECT o_custkey, arg_max(clerk, first_seen) AS clerk FROM
    (SELECT o_custkey, o_orderpriority AS clerk, MIN(o_orderkey) AS first_seen FROM orders GROUP BY 1, 2) GROUP BY 1)"""


@query("J3_last_value_lookup", f"SELECT o_custkey, clerk FROM {LOOKUP_SQL}")
def dictionary(t: Tables):
    return last_value_lookup(t.orders.withColumnRenamed("o_orderpriority", "clerk"), "o_custkey", "clerk", "o_orderkey")


@query(
    "J3_fill_from_lookup",
    f"""SELECT o.o_orderkey, COALESCE(o.priority, l.clerk) AS priority FROM {ORDERS_SQL} o
    LEFT JOIN {LOOKUP_SQL.replace('FROM orders', 'FROM orders WHERE o_orderkey % 11 <> 5')} l ON o.o_custkey = l.o_custkey""",
)
def dictionary_fill(t: Tables):
    df = orders(t)
    lookup = last_value_lookup(df, "o_custkey", "priority", "o_orderkey")
    return fill_from_lookup(df, lookup, "o_custkey", "priority").select("o_orderkey", "priority")


FIRST = f"CAST(CASE WHEN (event_id * 7) % 10 < 7 THEN 0 ELSE 1 END AS INT)"
SECOND = "CAST(1 + (event_id * 3) % 5 AS INT)"


@query(
    "J5_cascade_merge",
    f"""SELECT event_id, CAST(CASE WHEN {FIRST} = 1 THEN {SECOND} ELSE {FIRST} END AS INT) AS label FROM events""",
)
def cascade(t: Tables):
    first = t.events.selectExpr("event_id", f"{FIRST} AS label")
    second = routed(first, "label").selectExpr("event_id", f"{SECOND} AS label")
    return cascade_merge(first, second, "event_id", "label")


@query(
    "J6_cascade_columns",
    f"SELECT event_id, {FIRST} AS s1, CASE WHEN {FIRST} = 1 THEN {SECOND} END AS s2, CASE WHEN {FIRST} = 1 THEN {SECOND} ELSE 0 END AS label FROM events",
)
def cascade_two_columns(t: Tables):
    df = t.events.selectExpr("event_id", f"{FIRST} AS s1", f"CASE WHEN {FIRST} = 1 THEN {SECOND} END AS s2")
    return cascade_columns(df, "s1", "s2", "label")


@query(
    "J7_attach_label",
    "SELECT d.doc_id, d.lang, d.n_chars, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def attach(t: Tables):
    return attach_label(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id", "quality", "label")


@query(
    "J8_suffix",
    f"""SELECT e.event_id, e.label, p.label AS label_2 FROM {EVENTS_SQL} e
    LEFT JOIN (SELECT event_id, {PREDICTED} AS label FROM events WHERE event_id % 3 = 0) p ON e.event_id = p.event_id""",
)
def suffixes(t: Tables):
    other = t.events.filter("event_id % 3 = 0").selectExpr("event_id", f"{PREDICTED} AS label")
    return events(t).select("event_id", "label").join(with_suffix(other, ["event_id"], "_2"), "event_id", "left")


@query("J9_routed_rows", f"SELECT event_id, value FROM events WHERE {FIRST} = 1")
def routed_rows(t: Tables):
    return routed(t.events.selectExpr("event_id", "value", f"{FIRST} AS label"), "label").select("event_id", "value")


@query(
    "A14_append",
    "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def append(t: Tables):
    return append_rows(
        t.customer.selectExpr("c_custkey AS id", "c_acctbal AS balance"),
        t.supplier.selectExpr("s_acctbal AS balance", "s_suppkey AS id"),
    )
