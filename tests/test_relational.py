import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcascade.functions import code_label, decode_label, half_even, nan_to_null, order_code, quotient, tokens_to_null
from tabcascade.operators.aggregates import city_population, modes, null_audit
from tabcascade.operators.relational import assemble, cascade_merge, enrich, fill_from_lookup, hot_lookup_keys, last_value_lookup, measured, predictors
from tabcascade.sources.files import read_csv, save_bucketed


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def skewed(spark):
    """A third of the rows on one key, a third without a key, copies among both."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).cast("int").alias("k"),
        (F.col("id") % 4).cast("int").alias("v"),
    )


def test_enrich_paths_agree(spark):
    facts = skewed(spark)
    lookup = spark.createDataFrame([(i, f"n{i}") for i in range(0, 50, 2)] + [(7, "seven"), (None, "none")], "k int, name string")
    small = enrich(facts, lookup, "k")
    large = enrich(facts, lookup, "k", broadcast_limit=0)
    cold = enrich(facts, lookup, "k", broadcast_limit=0, hot_keys=0)
    few = enrich(facts, lookup, "k", broadcast_limit=0, hot_keys=3)
    names = {i: f"n{i}" for i in range(0, 50, 2)} | {7: "seven"}
    want = sorted(((r.k, r.v, names.get(r.k)) for r in facts.collect()), key=repr)
    for df in (small, large, cold, few):
        assert df.columns == ["k", "v", "name"]
        assert rows(df, "k", "v", "name") == want


def test_enrich_needed_only(spark):
    facts = skewed(spark)
    lookup = spark.createDataFrame([(i, i * 10) for i in range(50)], "k int, ten int")
    needed = F.col("v") == 1
    want = sorted(((r.k, r.v, r.k * 10 if r.k is not None and r.v == 1 else None) for r in facts.collect()), key=repr)
    for limit in (10**9, 0):
        assert rows(enrich(facts, lookup, "k", needed, broadcast_limit=limit), "k", "v", "ten") == want


def test_spread_of_unmatched_rows(spark):
    """Copies of one row without a key do not pile up in one task of the shuffled join."""
    facts = spark.range(0, 4000, numPartitions=8).select(F.lit(None).cast("int").alias("k"), F.lit(1).alias("v"))
    lookup = spark.createDataFrame([(1, 2)], "k int, w int")
    joined = enrich(facts, lookup, "k", broadcast_limit=0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 4000


def test_last_pair_wins(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, None, 3), (None, "c", 4), (3, "d", 5)], "k int, v string, o int")
    # The pair (1, a) counts at its first row, so b is the later pair.
    assert rows(last_value_lookup(df, "k", "v", "o"), "k", "v") == [(1, "b"), (3, "d")]


def test_fill_never_overwrites(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, None), (None, None)], "k int, v string")
    lookup = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(fill_from_lookup(df, lookup, "k", "v"), "k", "v") == [(1, "a"), (1, "x"), (2, None), (None, None)]


def test_assemble_keeps_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    one = spark.createDataFrame([("a", 1), ("z", 9)], "id string, x int")
    two = spark.createDataFrame([("b", 2)], "id string, y int")
    assert rows(assemble(ids, [one, two], "id"), "id", "x", "y") == [("a", 1, None), ("b", None, 2)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("ids", "people", "bills"):
        save_bucketed(spark.range(100).withColumn(name, F.col("id") % 7), f"bucketed_{name}", "id", 4)
    ids, people, bills = [spark.table(f"bucketed_{name}") for name in ("ids", "people", "bills")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = assemble(ids, [people, bills], "id")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("ids", "people", "bills"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_cascade_merge(spark):
    first = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, y int")
    second = spark.createDataFrame([("c", 4), ("b", 2)], "id string, y int")
    assert rows(cascade_merge(first, second, "id", "y"), "id", "y") == [("a", 0), ("b", 2), ("c", 4)]


def test_city_population(spark):
    places = spark.createDataFrame(
        [("A", 1), ("A", 1), ("A", 2), ("B", 2), ("B", 3), ("C", 9), ("D", None), (None, 3)], "city string, zip int"
    )
    people = spark.createDataFrame([(1, 10), (2, 15), (3, 30)], "zip int, people int")
    got = dict(rows(city_population(places, people, "city", "zip", "people"), "city", "mean_population"))
    # 12.5 and 22.5 round to even; zip 2 counts in both cities; 70 / 4 overall.
    assert got == {"A": 12.0, "B": 22.0, "C": 0.0, "D": 0.0, None: 18.0}


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([(2.0, "b"), (2.0, "b"), (1.0, "a"), (1.0, "a"), (None, None), (10.0, "c")], "n double, t string")
    assert rows(modes(df, ["n"], ["t"]), "column_name", "number", "text", "n") == [("n", 1.0, None, 2), ("t", None, "a", 2)]
    tens = spark.createDataFrame([(9,), (10,)], "n int")
    assert modes(tens, ["n"]).first()["number"] == 9.0 and modes(tens, texts=["n"]).first()["text"] == "10"
    assert rows(null_audit(df), "column_name", "n_null", "n_rows") == [("n", 1, 6), ("t", 1, 6)]


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (float("nan"),), (None,)], "x double")
    clean = nan_to_null(df)
    assert [r[0] for r in clean.select(half_even("x")).collect()] == [2.0, 4.0, None, None]
    assert [r[0] for r in df.limit(1).select(quotient("x", F.lit(0))).collect()] == [None]
    text = spark.createDataFrame([("NA",), (" nan ",), ("None",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in text.select(tokens_to_null("t")).collect()] == [None, None, "None", None, "x", None]
    codes = {"No": 0, "Yes": 1}
    labels = spark.createDataFrame([("No",), ("Yes",), (None,), ("?",)], "t string").select(code_label("t", codes).alias("c"))
    assert [r[0] for r in labels.collect()] == [0, 1, -1, None]
    assert [r[0] for r in labels.select(decode_label("c", codes)).collect()] == ["No", "Yes", None, None]
    assert predictors(df.withColumn("y", F.lit(1)), ["y"]) == ["x"]


def test_order_code_sorts_like_the_value(spark):
    numbers = [-(2**40), -1, 0, 1, 9, 10, 2**40]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    codes = [r[0] for r in df.select(order_code(df, "n")).collect()]
    assert codes == sorted(codes)
    words = spark.createDataFrame([("b",), ("a",), ("aa",), ("B",)], "w string")
    by_code = [r[0] for r in words.orderBy(order_code(words, "w")).collect()]
    assert by_code == ["B", "a", "aa", "b"]


def test_repeated_lookup_key_is_refused(spark):
    facts = spark.range(10).select(F.col("id").cast("int").alias("k"))
    lookup = spark.createDataFrame([(1, 2), (1, 3), (None, 1), (None, 2)], "k int, w int")
    with pytest.raises(ValueError, match="k=1 is 2 times"):
        enrich(facts, lookup, "k")
    assert enrich(facts, lookup.dropDuplicates(["k"]), "k").count() == 10


def test_shuffled_lookup_reads_two_columns(spark, data):
    """The salt needs the row key alone, so that no other column of the facts is read."""
    facts = spark.read.parquet(f"{data}/orders.parquet")
    lookup = spark.read.parquet(f"{data}/customer.parquet").selectExpr("c_custkey AS o_custkey", "c_acctbal")
    joined = enrich(facts, lookup, "o_custkey", broadcast_limit=0, row_key="o_orderkey").select("o_orderkey", "c_acctbal")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line and "orders.parquet" in line]
    assert schemas and all(s.startswith("struct<o_orderkey:bigint,o_custkey:bigint>") for s in schemas), schemas
    assert joined.count() == facts.count()


def test_hot_keys_fit_their_bytes(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 4 == 1, 2).otherwise(F.col("id")).cast("int").alias("k"), "id")
    lookup = measured(spark.createDataFrame([(1, "x" * 100), (2, "y" * 100)] + [(i, "z") for i in range(3, 50)], "k int, w string"), "k")
    true = F.lit(True)
    assert hot_lookup_keys(facts, lookup, true, 10, 10**6) == [1, 2]
    assert hot_lookup_keys(facts, lookup, true, 10, 200) == [1]
    assert hot_lookup_keys(facts, lookup, true, 0, 10**6) == [] == hot_lookup_keys(facts.limit(0), lookup, true, 10, 10**6)


def test_csv_headers_and_line_breaks(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    (tmp_path / "a.csv").write_text('t,more,k\n"two\nlines",x,1\nNA,y,2\n')
    got = read_csv(spark, str(tmp_path / "a.csv"), schema, multi_line=True)
    assert rows(got, "k", "t") == [(1, "two\nlines"), (2, None)]
    (tmp_path / "b.csv").write_text("k\n1\n")
    with pytest.raises(ValueError, match="no \\['t'\\]"):
        read_csv(spark, str(tmp_path / "b.csv"), schema)
    assert read_csv(spark, str(tmp_path / "b.csv"), schema, drop=["t"]).columns == ["k"]
