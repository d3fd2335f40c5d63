"""What grows with the input: dense vectors, jobs a round, tasks a pass, reads of a bag."""

import time

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabcascade.bindings import learn
from tabcascade.bindings.base import REGISTRY
from tabcascade.operators import relational
from tabcascade.operators.folds import group_folds
from tabcascade.operators.metrics import ConfusionEvaluator
from tabcascade.plans.boosting import GradientBoost, begin, best_split, bin_ends, grow
from tabcascade.plans.ensembles import seeded_bags
from tabcascade.plans.models import random_forest, with_features
from tabcascade.plans.tuning import fold_scores
from tabcascade.session import hold_few

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(800).selectExpr(
        "id", "CAST(id % 10 AS DOUBLE) AS a", "CAST(pmod(hash(id, 3), 400) AS DOUBLE) AS b", "CAST(pmod(hash(id), 50) AS DOUBLE) AS c", "CAST(id % 2 AS INT) AS fold",
        "CAST(CASE WHEN pmod(hash(id, 5), 4) = 0 THEN id % 5 ELSE (id % 10) DIV 2 END AS INT) AS five", "CAST(pmod(hash(id, 7), 10) < id % 10 AS INT) AS two",
    )
    return with_features(df, NAMES, ["id", "fold", "five", "two"]).cache()


def test_levels_of_a_wide_column_are_never_dense(spark, tmp_path):
    """40,000 buyers: dense vectors of all orders would be 13 GB."""
    orders = spark.range(40_000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "1.5D AS o_totalprice", "concat(id % 3, '-P') AS o_orderpriority", "'F' AS o_orderstatus",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    begun = time.time()
    got = {r["priority"]: (r["n"], r["n_codes"], r["n_set"]) for r in REGISTRY["F6_sparse_levels"].run(spark, str(tmp_path)).collect()}
    assert time.time() - begun < 120
    want = {}
    for i in range(40_000):
        priority = None if i % 11 == 5 else f"{i % 3}-P"
        n, codes, placed = want.get(priority, (0, set(), 0))
        want[priority] = (n + 1, codes | {i if i % 10 < 8 else -1}, placed + (priority is not None) + (i % 10 < 8))
    assert got == {p: (n, len(c), s) for p, (n, c, s) in want.items()}


def test_a_round_of_all_classes_is_a_few_jobs(spark, rows):
    """A pass a level for all classes, not a fit for each."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    state = begin(rows, "five", 5, {"max_depth": 3})

    def job(name):
        sc.setJobGroup(name, name)
        sc.parallelize([1], 1).count()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return max(tracker.getJobIdsForGroup(name))

    first = job("round begins")
    grow(state, 1)
    assert job("round ends") - first < 25


@pytest.mark.parametrize("least", [0.0, 6.5])
def test_splits_are_those_of_weighted_regression_trees(spark, rows, least):
    tree = grow(begin(rows, "two", 2, {"max_depth": 4, "min_child_weight": least}), 1).trees[0][0]
    slopes = rows.select("features", ((F.col("two") - 0.5) * 4).alias("z"), F.lit(0.25).alias("w"))
    spark_tree = DecisionTreeRegressor(
        featuresCol="features", labelCol="z", weightCol="w", maxDepth=4, maxBins=128, minInstancesPerNode=1, minWeightFractionPerNode=least / 200, minInfoGain=0.0, leafCol="leaf"
    ).fit(slopes)
    got = spark_tree.transform(slopes.select("features")).collect()
    leaves = tree.leaves(np.array([r["features"].toArray() for r in got]))
    said, ends = np.array([r["prediction"] for r in got]), [r["leaf"] for r in got]
    # pruning by gamma = 0 and the ridge may join leaves of the tree, never cut one
    assert len(set(zip(leaves.tolist(), ends))) == len(set(ends)) >= len(set(leaves.tolist())) > 6
    for leaf in set(leaves.tolist()):
        at = leaves == leaf
        assert tree.value[leaf, 1] == pytest.approx(-0.25 * said[at].sum(), abs=1e-9)


def test_thresholds_and_splits_by_hand():
    assert bin_ends(np.array([3.0, 1, 1, 2]), np.ones(4), 5).tolist() == [1.5, 2.5]
    assert bin_ends(np.arange(100.0), np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    # two features of 2 and 1 bins: rows, curvature, gradient, gradient^2 / curvature
    cells = np.array([[2.0, 2, 4], [2, 2, 4], [-2, 2, 0], [2, 2, 4]])
    gain, feature, end, left, right = best_split(cells, [2, 1], 1.0)
    assert (gain, feature, end, left, right) == (1.0, 0, 0, [-2.0, 2.0, 0.0], [2.0, 2.0, 0.0])
    assert best_split(cells, [2, 1], 2.5) is None


def test_scores_of_shared_rows_are_those_of_single_fits(rows):
    settings = [{"n_estimators": 2, "max_depth": d, "learning_rate": 0.3} for d in (1, 3)]
    for label, classes in (("two", 2), ("five", 5)):
        evaluator = ConfusionEvaluator("f1_macro", labelCol=label)
        got = fold_scores(lambda p: GradientBoost(p, label, classes), settings, rows, "fold", evaluator)
        for i, fold, score in got:
            model = GradientBoost(settings[i], label, classes).fit(rows.where(F.col("fold") != fold))
            assert evaluator.evaluate(model.transform(rows.where(F.col("fold") == fold))) == pytest.approx(score, abs=1e-12)


def test_rows_of_loops_are_read_in_few_tasks(spark):
    many = spark.range(0, 5000, 1, 300)
    few = hold_few(many)
    assert few.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 300
    assert few.agg(F.sum("id")).first()[0] == 5000 * 4999 // 2
    assert hold_few(spark.range(0, 10, 1, 3)).rdd.getNumPartitions() == 3


def test_rows_of_loops_carry_no_operators_of_their_making(spark):
    """Each task of each pass would tell the driver the counters of these operators."""
    made = spark.range(400).selectExpr("id", "id % 7 AS k").join(spark.range(7).selectExpr("id AS k", "id * 2 AS w").hint("merge"), "k")
    x = with_features(made.selectExpr("CAST(k AS DOUBLE) AS k", "CAST(w AS DOUBLE) AS w"), ["k", "w"], ["w"])
    few = hold_few(x)
    assert "Shuffled" not in few.rdd.toDebugString().decode()
    assert few.schema["features"].metadata == x.schema["features"].metadata
    assert sorted(map(str, few.collect())) == sorted(map(str, x.collect()))


class Events:
    """A table of events as a query sees it."""

    def __init__(self, spark):
        self.spark = spark
        self.events = spark.range(600).selectExpr(
            "id AS event_id", "timestamp_seconds(id * 4000) AS ts", "id % 11 AS user_id", "element_at(array('click', 'view', 'error'), CAST(id % 3 AS INT) + 1) AS event_type",
            "CAST(id AS DOUBLE) AS value", "concat('{\"k\": ', id % 5, '}') AS props",
        )


@pytest.mark.parametrize("build", [learn.fold_rows, learn.binary_fold_rows])
def test_rows_are_drawn_once_for_their_folds(spark, monkeypatch, build):
    seen = []

    def folded(df, *more):
        seen.append(df.storageLevel.useMemory)
        return group_folds(df, *more)

    monkeypatch.setattr(learn, "group_folds", folded)
    rows = build(Events(spark), 2)
    assert seen == [True]
    assert rows.count() == (360 if build is learn.fold_rows else 900)  # five classes of 72, the largest; 450 of class 0 and five of 90
    assert rows.groupBy("event_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


def test_folds_of_groups_are_not_counted_again(spark, monkeypatch):
    """They are one row a group as they were grouped."""
    monkeypatch.setattr(relational, "measured", lambda *_: pytest.fail("the folds were grouped once more"))
    got = group_folds(spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), ("c", 0)], "g string, y int"), "g", "y", 2)
    assert got.count() == 5 and got.where("fold IS NULL").isEmpty()


def test_a_bag_is_drawn_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        read.add(1)
        return x

    seeded_bags([1, 2], lambda seed: rows.select("features", seen("two").alias("two")), lambda seed: random_forest("two", 2, 3, seed), 1)
    assert read.value == 2 * rows.count()
