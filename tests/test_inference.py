import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabcascade.operators.billing import PASSES, BillingColumns, solve_identities
from tabcascade.operators.inference import (
    PlaceColumns,
    ServiceColumns,
    apply_band_means,
    apply_flagged_mean,
    apply_places,
    extras_without_internet,
    fit_band_means,
    fit_flagged_mean,
    fit_places,
    service_rules,
    split_coordinates,
)
from tabcascade.operators.prepare import (
    FillSpec,
    apply_fill,
    apply_one_hot,
    apply_scaling,
    fit_fill,
    fit_levels,
    fit_min_max,
    fit_standard,
    polynomial,
)

NAMES = "tenure charges monthly distance distance_avg refunds extra revenue".split()
BILL = BillingColumns(*NAMES)
SCHEMA = ", ".join(f"{n} double" for n in NAMES)
# Needs per rule: target, known columns, divisor; in the order of a pass.
NEEDS = [
    ("tenure", ("charges", "monthly"), "monthly"),
    ("charges", ("tenure", "monthly"), None),
    ("monthly", ("tenure", "charges"), "tenure"),
    ("tenure", ("distance", "distance_avg"), "distance_avg"),
    ("distance", ("tenure", "distance_avg"), None),
    ("distance_avg", ("tenure", "distance"), "tenure"),
    ("revenue", ("charges", "refunds", "extra", "distance"), None),
    ("charges", ("revenue", "refunds", "extra", "distance"), None),
    ("refunds", ("charges", "extra", "distance", "revenue"), None),
    ("extra", ("revenue", "charges", "refunds", "distance"), None),
    ("distance", ("revenue", "charges", "refunds", "extra"), None),
]


def spread(known, zeros, rules):
    for i in rules:
        target, needs, divisor = NEEDS[i]
        if set(needs) <= known and divisor not in zeros:
            known = known | {target}
    return known


def test_passes_reach_the_fixpoint_from_every_pattern():
    for size in range(9):
        for pattern in itertools.combinations(NAMES, size):
            for flags in itertools.product([False, True], repeat=3):
                zeros = {n for n, f in zip(("tenure", "monthly", "distance_avg"), flags) if f}
                short = frozenset(pattern)
                for active in PASSES:
                    short = spread(short, zeros, active)
                full, before = frozenset(pattern), None
                while full != before:
                    before, full = full, spread(full, zeros, range(11))
                assert short == full


def brute(row):
    """The rules one by one until nothing changes."""
    r = dict(zip(NAMES, row))

    def ratio(a, b):
        return None if b == 0 else a / b

    def put(target, needs, value):
        if r[target] is None and all(r[n] is not None for n in needs):
            r[target] = value(*[r[n] for n in needs])

    def ceil(a, b):
        q = ratio(a, b)
        return None if q is None else float(-((-q) // 1))

    while True:
        before = dict(r)
        put("tenure", ("charges", "monthly"), ceil)
        put("charges", ("tenure", "monthly"), lambda t, m: t * m)
        put("monthly", ("charges", "tenure"), ratio)
        put("tenure", ("distance", "distance_avg"), ceil)
        put("distance", ("tenure", "distance_avg"), lambda t, m: t * m)
        put("distance_avg", ("distance", "tenure"), ratio)
        put("revenue", ("charges", "refunds", "extra", "distance"), lambda c, x, e, d: c - x + e + d)
        put("charges", ("revenue", "refunds", "extra", "distance"), lambda v, x, e, d: v + x - e - d)
        put("refunds", ("charges", "extra", "distance", "revenue"), lambda c, e, d, v: c + e + d - v)
        put("extra", ("revenue", "charges", "refunds", "distance"), lambda v, c, x, d: v - c + x - d)
        put("distance", ("revenue", "charges", "refunds", "extra"), lambda v, c, x, e: v - c + x - e)
        if r == before:
            return tuple(r[n] for n in NAMES)


amount = st.one_of(st.none(), st.integers(0, 40).map(lambda n: n / 4))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[amount] * 8), min_size=30, max_size=60))
def test_identities_against_row_by_row(spark, table):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(table)], f"id int, {SCHEMA}")
    once = solve_identities(df, BILL)
    got = {r["id"]: tuple(r)[1:] for r in once.collect()}
    for i, row in enumerate(table):
        assert got[i] == pytest.approx(brute(row)), row
        assert all(a is None or a == b for a, b in zip(row, got[i]))
    again = {r["id"]: tuple(r)[1:] for r in solve_identities(once, BILL).collect()}
    assert again == got


def test_band_means_come_from_training_rows(spark):
    train = spark.createDataFrame([(20.0,), (25.0,), (40.0,), (70.0,), (71.0,), (None,)], "age double")
    means = fit_band_means(train, "age")
    assert (means.young, means.middle, means.senior) == (22.0, 40.0, 70.0)
    df = spark.createDataFrame(
        [(50.0, "Yes", "No"), (None, "Yes", None), (None, None, "Yes"), (None, "No", "No"), (None, "No", None), (None, None, None)],
        "age double, young string, senior string",
    )
    got = [r["age"] for r in apply_band_means(df, means, "age", "young", "senior").collect()]
    assert got == [50.0, 22.0, 70.0, 40.0, None, None]


def test_flagged_mean(spark):
    train = spark.createDataFrame([(2.0, "Yes"), (3.0, "Yes"), (9.0, "No"), (None, "Yes")], "n double, f string")
    mean = fit_flagged_mean(train, "n", "f")
    assert mean == 2.0
    df = spark.createDataFrame([(7.0, "No"), (None, "Yes"), (None, "No"), (None, None)], "n double, f string")
    assert [r["n"] for r in apply_flagged_mean(df, mean, "n", "f").collect()] == [7.0, 2.0, 0.0, None]


PLACE = PlaceColumns("lat", "lon", "text", "zip", "city", "people")
PLACES = "id int, lat double, lon double, text string, zip double, city string"


def test_places(spark):
    df = spark.createDataFrame(
        [
            (1, 34.5, -118.0, "34.5, -118.0", 90001.0, "LA"),
            (2, 34.5, None, None, None, "LA"),
            (3, None, -118.0, None, None, "LA"),
            (4, None, None, None, None, None),
            (5, None, None, "40.25, -120.5", 96000.0, "X"),
            (6, 40.25, None, None, None, "X"),
            (7, 33.0, None, None, None, "Y"),
        ],
        PLACES,
    )
    done = apply_places(df, fit_places(df, PLACE, "id"))
    got = {r["id"]: (r["lat"], r["lon"], r["text"], r["zip"]) for r in done.collect()}
    assert got[2] == got[3] == (34.5, -118.0, "34.5, -118.0", 90001.0)
    assert got[4] == (None, None, None, None)
    assert got[5] == (40.25, -120.5, "40.25, -120.5", 96000.0)
    # The only row with both numbers of that latitude has them in its text alone.
    assert got[6] == (40.25, None, None, None)
    assert got[7] == (33.0, None, None, None)
    lost = split_coordinates(df, PLACE, keep_known=False)
    assert {r["id"]: r["lat"] for r in lost.collect()}[7] is None
    people = spark.createDataFrame([(90001.0, 100), (96000.0, 7)], "zip double, people int")
    model = fit_places(df, PLACE, "id", people)
    filled = {r["id"]: r["people"] for r in apply_places(df, model).collect()}
    assert filled == {1: 100.0, 2: 100.0, 3: 100.0, 4: 54.0, 5: 7.0, 6: 7.0, 7: 0.0}
    shuffled = apply_places(df, fit_places(df, PLACE, "id", people, broadcast_limit=0), broadcast_limit=0)
    assert {r["id"]: r["people"] for r in shuffled.collect()} == filled


SERVICE = ServiceColumns("phone", "lines", "internet", "kind", "gb", ["a", "b"])
SERVICES = "phone string, lines string, internet string, kind string, gb double, a string, b string"


@pytest.mark.parametrize(
    "before, after",
    [
        ((None, "Yes", None, None, None, None, None), ("Yes", "Yes", None, None, None, None, None)),
        (("No", None, None, None, None, None, None), ("No", "No", None, None, None, None, None)),
        ((None, None, None, "DSL", None, None, None), (None, None, "Yes", "DSL", None, None, None)),
        ((None, None, None, "None", 0.0, "No", None), (None, None, None, "None", 0.0, "No", None)),
        ((None, None, None, None, 3.0, None, None), (None, None, "Yes", None, 3.0, None, None)),
        ((None, None, None, None, None, None, "Yes"), (None, None, "Yes", None, None, None, "Yes")),
        ((None, None, "No", None, None, None, "Yes"), (None, None, "No", "None", 0.0, "No", "Yes")),
    ],
)
def test_service_rules(spark, before, after):
    df = spark.createDataFrame([before], SERVICES)
    assert tuple(service_rules(df, SERVICE).first()) == after


def test_extras_compat(spark):
    df = spark.createDataFrame(
        [(None, None, i, None, None, a, b) for i, a, b in [("No", None, None), ("No", "Yes", None), ("Yes", None, "No"), ("No", "No", None)]], SERVICES
    )
    got = [r["internet"] for r in extras_without_internet(df, SERVICE, compat=True).collect()]
    assert got == ["No", None, "No", "No"]


def test_fill_encode_scale(spark):
    train = spark.createDataFrame([(2.0, 1.0, "b"), (3.0, 2.0, "a"), (None, None, "a"), (None, 3.0, None)], "x double, y double, t string")
    values = fit_fill(train, FillSpec(rounded_mean=["x"], mean=["y"], mode_text=["t"]))
    assert values == {"x": 2.0, "y": 2.0, "t": "a"}
    test = spark.createDataFrame([(None, None, None), (9.0, 9.0, "new")], "x double, y double, t string")
    filled = apply_fill(test, values)
    assert [tuple(r) for r in filled.collect()] == [(2.0, 2.0, "a"), (9.0, 9.0, "new")]
    levels = fit_levels(train, ["t"])
    hot = apply_one_hot(test, levels)
    assert hot.columns == ["x", "y", "t_a", "t_b"]
    assert [tuple(r)[2:] for r in hot.collect()] == [(0, 0), (0, 0)]
    scaled = apply_scaling(filled, fit_standard(train, ["y"]))
    assert [r["y"] for r in scaled.collect()] == [0.0, 7.0]
    assert [r["y"] for r in apply_scaling(filled, fit_min_max(train, ["y"])).collect()] == [0.5, 4.0]
    flat = train.withColumn("x", F.lit(1.0))
    assert apply_scaling(flat, fit_standard(flat, ["x"])).first()["x"] is None
    assert polynomial(train.select("x", "y"), ["x", "y"]).columns == ["x", "y", "x^2", "x y", "y^2"]


def test_a_million_levels(spark):
    """Wide categories become one sparse vector; narrow ones the same flags as named columns."""
    from pyspark.ml.functions import vector_to_array

    from tabcascade.operators.prepare import encode_levels, fit_level_table

    train = spark.range(1_000_000).select(F.col("id").cast("string").alias("wide"), (F.col("id") % 3).cast("string").alias("t"))
    levels = fit_level_table(train, ["wide", "t"])
    assert levels.sizes == {"wide": 1_000_000, "t": 3}
    told = levels.rows.where("column_name = 'wide'").agg(F.min("index"), F.max("index"), F.countDistinct("index")).first()
    assert tuple(told) == (0, 999_999, 1_000_000)
    some = spark.createDataFrame([("5", "1"), ("999999", None), ("new", "2"), (None, "x")], "wide string, t string")
    got = [r.encoded for r in encode_levels(some, levels).orderBy(F.col("wide").asc_nulls_first()).collect()]
    assert [v.size for v in got] == [1_000_003] * 4 and [v.numNonzeros() for v in got] == [0, 2, 1, 1]
    with pytest.raises(ValueError, match="wide"):
        fit_levels(train, ["wide", "t"])
    narrow = fit_level_table(train.limit(100), ["t"])
    flags = encode_levels(train.limit(50), narrow).withColumn("f", vector_to_array("encoded"))
    named = apply_one_hot(flags, {"t": ["0", "1", "2"]})
    at = {r["value"]: r["index"] for r in narrow.rows.collect()}
    for r in named.collect():
        assert [r.f[at[v]] for v in "012"] == [r[f"t_{v}"] for v in "012"]


def test_levels_of_nothing(spark):
    from tabcascade.operators.prepare import encode_levels, fit_level_table

    train = spark.createDataFrame([(None,)], "t string")
    assert encode_levels(train, fit_level_table(train, ["t"])).first().encoded.size == 0
