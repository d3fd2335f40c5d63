import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabcascade.functions import seeded_code
from tabcascade.operators import sampling
from tabcascade.operators.aggregates import class_table
from tabcascade.operators.folds import fold_shares, group_folds, stratified_folds
from tabcascade.operators.sampling import (
    balanced_bag,
    class_weight_table,
    class_weights,
    extra_draws,
    keep_exactly,
    over_sample,
    stratified_fraction,
    top_up,
    under_then_over,
    under_then_top_up,
    with_class_weight,
)
from tabcascade.operators.selection import cut_table, find_cuts, items_of, positions
from tabcascade.plans.tuning import fold_numbers, fold_split


@pytest.fixture(scope="module")
def rows(spark):
    """700 / 150 / 100 / 40 / 9 / 1 rows of six classes with unique keys."""
    label = (
        "CASE WHEN id < 700 THEN 0 WHEN id < 850 THEN 1 WHEN id < 950 THEN 2 WHEN id < 990 THEN 3 WHEN id < 999 THEN 4 ELSE 5 END"
    )
    return spark.range(1000).selectExpr("id", f"CAST({label} AS INT) AS label", "id * 2 AS payload").cache()


def sizes(df):
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_top_up(rows):
    df = top_up(rows, "id", "label", 1)
    # Share 140: class 1 is above it and stays.
    assert sizes(df) == {0: 700, 1: 150, 2: 140, 3: 140, 4: 140, 5: 140}
    assert set(bag(rows)) == set(bag(df))
    assert all(r["payload"] == 2 * r["id"] for r in df.collect())


def test_counts_of_all_schemes(rows):
    assert sizes(under_then_top_up(rows, "id", "label", 300, 1)) == {0: 300, 1: 150, 2: 100, 3: 60, 4: 60, 5: 60}
    assert sizes(balanced_bag(rows, "id", "label", 60, 12, 1)) == {0: 60, 1: 12, 2: 12, 3: 12, 4: 12, 5: 12}
    assert sizes(over_sample(rows, "id", "label", 1)) == {c: 700 for c in range(6)}
    assert sizes(under_then_over(rows, "id", "label", {0: 120}, 1)) == {c: 150 for c in range(6)}
    assert sizes(stratified_fraction(rows, "id", "label", 3, 1)) == {0: 234, 1: 50, 2: 34, 3: 14, 4: 3, 5: 1}
    assert sizes(keep_exactly(rows, "id", "label", {0: 0, 4: 50}, 1)) == {1: 150, 2: 100, 3: 40, 4: 9, 5: 1}
    weights = class_weights(rows, "label")
    assert weights[0] == pytest.approx(1000 / (6 * 700))


def test_seed_decides_and_partitioning_does_not(rows):
    one = bag(over_sample(rows, "id", "label", 1))
    assert bag(over_sample(rows.repartition(7, "payload"), "id", "label", 1)) == one
    assert bag(over_sample(rows, "id", "label", 2)) != one


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_scale_paths_agree_with_plain_ones(rows, leaf):
    for scheme in (
        lambda **how: keep_exactly(rows, "id", "label", {0: 123, 1: 77, 3: 1}, 3, **how),
        lambda **how: over_sample(rows.filter("label > 0"), "id", "label", 3, **how),
    ):
        assert bag(scheme(leaf_rows=leaf)) == bag(scheme())


def test_often_drawn_row_is_split(rows, monkeypatch):
    want = bag(extra_draws(rows, "id", "label", {5: 500, 4: 90}, 1))
    monkeypatch.setattr(sampling, "COPIES_PER_TASK_ROW", 7)
    got = bag(extra_draws(rows, "id", "label", {5: 500, 4: 90}, 1))
    assert got == want and sum(got.values()) == 590


def test_find_cuts_with_weights_against_brute_force(spark):
    data = [(c, f"{(i * 7919 + c) % 65536:04x}", i % 5 + 1) for c in (0, 1) for i in range(400)]
    df = spark.createDataFrame(data, "l int, c string, w long")
    items = df.select(*items_of(F.col("l"), F.col("c"), F.col("w")))
    targets = {0: [1, 300, 600.5, 1200], 1: [0, 77, 78, 79]}
    want = {}
    for label, wanted in targets.items():
        mine = sorted((c, w) for l, c, w in data if l == label)
        want[label] = []
        for t in wanted:
            total, cut = 0, None
            for c, w in mine if t > 0 else ():
                total += w
                if total >= t:
                    cut = c
                    break
            want[label].append(cut)
    for leaf in (1, 10, 1000):
        assert find_cuts(items, targets, {0: 400, 1: 400}, leaf) == want


def test_find_cuts_with_a_third_of_rows_equal(spark):
    data = [(0, "aaaa") if i % 3 == 0 else (0, f"{i:04x}") for i in range(900)]
    df = spark.createDataFrame(data, "l int, c string")
    items = df.select(*items_of(F.col("l"), F.col("c")))
    codes = sorted(c for _, c in data)
    for leaf in (1, 50):
        for even in (True, False):
            assert find_cuts(items, {0: [450, 700]}, {0: 900}, leaf, even) == {0: [codes[449], codes[699]]}


def test_fold_shares():
    shares = fold_shares({0: 7, 1: 4, 2: 1}, 5)
    assert {c: sum(s) for c, s in shares.items()} == {0: 7, 1: 4, 2: 1}
    per_fold = [sum(s[i] for s in shares.values()) for i in range(5)]
    assert max(per_fold) - min(per_fold) <= 1
    assert all(max(s) - min(s) <= 1 for s in shares.values())


@pytest.mark.parametrize("seed", [None, 1126])
def test_stratified_folds(rows, seed):
    df = stratified_folds(rows, "id", "label", 5, seed)
    per = defaultdict(Counter)
    for r in df.collect():
        per[r["label"]][r["fold"]] += 1
    for label, counts in per.items():
        n = sum(counts.values())
        assert set(counts) <= set(range(5))
        assert max(counts.values()) - min(counts.get(i, 0) for i in range(5)) <= 1, (label, n)
    assert bag(stratified_folds(rows, "id", "label", 5, seed, leaf_rows=3)) == bag(df)
    assert df.columns == ["id", "label", "payload", "fold"]


def test_folds_by_string_key(rows):
    df = rows.select(F.format_string("Customer#%05d", "id").alias("name"), "label")
    assert bag(stratified_folds(df, "name", "label", 4, leaf_rows=10)) == bag(stratified_folds(df, "name", "label", 4))


def test_group_folds_of_mixed_groups(spark):
    rows = [(int(n % 7 < 2), f"g{(n * n) % 23}") for n in range(180)]
    got = group_folds(spark.createDataFrame(rows, "y int, g string"), "g", "y", 4).collect()
    assert sorted((r["y"], r["g"]) for r in got) == sorted(rows)
    folds = defaultdict(set)
    for r in got:
        folds[r["g"]].add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    largest = max(Counter(g for _, g in rows).values())
    for label in (0, 1):
        counts = Counter(r["fold"] for r in got if r["y"] == label)
        total = sum(y == label for y, _ in rows)
        assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) <= total / 4 + largest


def test_copies_share_a_fold(rows):
    df = group_folds(over_sample(rows.filter("label > 0"), "id", "label", 1), "id", "label", 5)
    spread = df.groupBy("id").agg(F.countDistinct("fold").alias("n"), F.max(F.col("fold").isNull()).alias("none"))
    assert spread.filter("n <> 1 OR none").count() == 0
    counts = {(r["label"], r["fold"]): r["n"] for r in df.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    # Class 5 is one row, copied; every larger class reaches each fold.
    assert all(counts.get((c, f), 0) > 0 for c in (1, 2, 3, 4) for f in range(5))


def test_group_with_a_third_of_the_rows(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 300 END AS g", "CAST(id % 2 AS INT) AS y")
    for limit in (10**9, 0):
        folded = group_folds(df, "g", "y", 5, broadcast_limit=limit)
        assert folded.count() == 3000
        per_group = folded.groupBy("g").agg(F.countDistinct("fold").alias("n"))
        assert per_group.filter("n <> 1").count() == 0
        assert folded.select("fold").distinct().count() == 5


def test_rows_without_a_fold_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1)], "id long, fold int")
    assert fold_numbers(rows, "fold") == [0, 1]
    for held_out in (0, 1):
        train, validation = fold_split(rows, "fold", held_out)
        assert 3 not in [r.id for r in train.union(validation).collect()]


# ---- many classes -------------------------------------------------------------------------


def test_twenty_thousand_classes(spark):
    """Sizes, cuts, draws and folds of classes that no driver dictionary was made for."""
    n = 60_000
    rows = spark.range(n).selectExpr("id", "CAST(id % 20000 AS INT) AS label").cache()
    third = stratified_fraction(rows, "id", "label", 3, 1)
    assert third.count() == 20_000 and third.select("label").distinct().count() == 20_000
    kept = keep_exactly(rows, "id", "label", {5: 1, 7: 0}, 1)
    assert kept.count() == n - 5 and kept.filter("label IN (5, 7)").count() == 1
    some = rows.filter("id < 20000 OR id % 2 = 0")
    drawn = over_sample(some, "id", "label", 2)
    assert drawn.groupBy("label").count().filter("count <> 3").count() == 0
    weights = with_class_weight(rows, "label", class_weight_table(rows, "label"))
    assert weights.filter("abs(weight - 1) > 1e-12 OR weight IS NULL").count() == 0
    folds = stratified_folds(rows, "id", "label", 3, 9)
    assert {r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {20_000}
    assert folds.groupBy("label").agg(F.countDistinct("fold").alias("f")).filter("f <> 3").count() == 0


def windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "windowspecdefinition" in line]


def test_no_window_over_all_buckets_of_a_class(rows):
    items = rows.select(F.col("label"), seeded_code(1, "id").alias("code"))
    for line in windows(positions(items, 700, 1)):
        spec = line[line.index("windowspecdefinition(") :]
        # running sums: over coarse buckets of a class, and over buckets of a coarse one
        assert spec.count("label#") and ("coarse#" in spec or "bucket#" in spec), line
    cuts = cut_table(items.withColumn("weight", F.lit(1)), rows.select("label").distinct().select("label", F.lit(0).alias("idx"), F.lit(1).alias("need")), class_table(rows, "label"), 4)
    assert all("prefix#" in line for line in windows(cuts)) and cuts.count() == 6


def test_group_folds_by_brute_force(spark):
    """Heaviest first, equal weights in turn, unlabelled groups and rows without a group included."""
    rng = random.Random(4)
    rows = []
    for g in range(120):
        size = rng.choice([1, 1, 1, 2, 2, 3, 5, 40])
        label = rng.choice([0, 0, 1, 2, None])
        rows += [(f"g{g}", label if rng.random() < 0.8 else rng.choice([None, label]), k) for k in range(size)]
    rows += [(None, 1, 0), (None, None, 1)]
    k = 4
    got = group_folds(spark.createDataFrame(rows, "g string, y int, x int"), "g", "y", k, leaf_rows=3).collect()
    members = defaultdict(list)
    for g, y, _ in rows:
        members[g].append(y)
    classes = defaultdict(list)
    for g, ys in members.items():
        known = Counter(y for y in ys if y is not None)
        label = min(known, key=lambda y: (-known[y], y)) if known else None
        code = hashlib.md5((f"0:{g}" if g is not None else "0").encode()).hexdigest()
        classes[label].append((-len(ys), code, g))
    want = {}
    for label, groups in classes.items():
        turn = int(hashlib.md5(str(label).encode()).hexdigest()[:8], 16) % k if label is not None else 0
        loads, groups = [0] * k, sorted(groups)
        for weight in sorted({w for w, _, _ in groups}):
            order = sorted(range(k), key=lambda i: (loads[i], (i - turn) % k))
            for place, (_, _, g) in enumerate(x for x in groups if x[0] == weight):
                want[g] = order[place % k]
                loads[order[place % k]] -= weight
        assert max(loads) - min(loads) <= max(-w for w, _, _ in groups)
    assert {r["g"]: r["fold"] for r in got} == want and len(got) == len(rows)
