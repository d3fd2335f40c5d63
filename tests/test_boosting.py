"""Boosted trees: leaf values, units of the settings, rounds by error, stored families in one pass."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from tabcascade.operators.voting import with_vote
from tabcascade.plans import boosting
from tabcascade.plans.boosting import GradientBoost, begin, chosen_round, find_rounds, finished_tree, grow
from tabcascade.plans.models import add_prediction, random_forest, with_features
from tabcascade.plans.nodes import Family, Member, StoredCascade, Tree, stored_member, stored_split_counts

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).selectExpr(
        "id", "CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(pmod(hash(id), 50) AS DOUBLE) AS c", "CAST(id % 3 AS INT) AS fold",
        "CAST(CASE WHEN id % 23 = 0 THEN (id + 1) % 5 ELSE (id % 10) DIV 2 END AS INT) AS five",
        "CAST(CASE WHEN id % 23 = 0 THEN (id % 10 < 5) ELSE (id % 10 >= 5) END AS INT) AS two",
    )
    return with_features(df, NAMES, ["id", "fold", "five", "two"]).cache()


def local(rows, label):
    got = rows.orderBy("id").collect()
    return np.array([r["features"].toArray() for r in got]), np.array([r[label] for r in got])


def softmax(m):
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("label, classes", [("two", 2), ("five", 5)])
def test_leaf_values_are_newton_steps(rows, label, classes):
    """Every round again in numpy: sums of each leaf, its step, the margins that follow."""
    params = {"max_depth": 3, "learning_rate": 0.2, "reg_alpha": 0.3, "min_child_weight": 2.5}
    state = grow(begin(rows, label, classes, params), 3)
    x, y = local(rows, label)
    margins = np.zeros((len(y), 1 if classes == 2 else classes))
    losses = []
    for trees in state.trees:
        if classes == 2:
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y[:, None], p * (1 - p)
            losses.append(np.mean(np.log1p(np.exp(margins[:, 0])) - y * margins[:, 0]))
        else:
            p = softmax(margins)
            g, h = p - np.eye(classes)[y], 2 * p * (1 - p)
            losses.append(-np.mean(np.log(p[np.arange(len(y)), y])))
        for k, tree in enumerate(trees):
            leaf = tree.leaves(x)
            for node in set(leaf.tolist()):
                sg, sh = g[leaf == node, k].sum(), h[leaf == node, k].sum()
                assert sh >= 2.5 - 1e-9 or len(tree.feature) == 1
                assert tree.value[node] == pytest.approx([-math.copysign(max(0, abs(sg) - 0.3), sg) / (sh + 1), sg, sh], abs=1e-6)
            margins[:, k] += 0.2 * tree.value[leaf, 0]
    assert state.losses[:3] == pytest.approx(losses, abs=1e-9)
    assert all(a > b for a, b in zip(state.losses, state.losses[1:], strict=False))


def test_gamma_takes_splits_back():
    #      0: split        leaves 1, and 2: split with leaves 3, 4
    tree = Tree(np.array([0, -1, 1, -1, -1]), np.array([1.0, 0, 2.0, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.zeros((5, 1)))
    sums = {1: (-4.0, 3.0), 3: (5.0, 4.0), 4: (5.0, 4.0)}
    settings = {"reg_alpha": 0.0, "gamma": 0.0}
    kept = finished_tree(tree, sums, settings)
    inner = 5 * 5 / 5 + 5 * 5 / 5 - 10 * 10 / 9  # negative: the ridge makes two leaves worse than one
    assert inner < 0 and kept.feature.tolist() == [0, -1, -1] and kept.value[2].tolist() == pytest.approx([-10 / 9, 10, 8])
    outer = 4 * 4 / 4 + 10 * 10 / 9 - 6 * 6 / 12
    assert finished_tree(tree, sums, {**settings, "gamma": outer - 1e-9}).feature.tolist() == [0, -1, -1]
    assert finished_tree(tree, sums, {**settings, "gamma": outer + 1e-9}).feature.tolist() == [-1]
    apart = {1: (-4.0, 3.0), 3: (5.0, 4.0), 4: (-5.0, 4.0)}  # a worthless split stays above a good one
    assert finished_tree(tree, apart, {**settings, "gamma": 9.0}).feature.tolist() == [0, -1, 1, -1, -1]


def test_classes_are_learned_and_probabilities_sum_to_one(rows):
    model = GradientBoost({"n_estimators": 2, "max_depth": 3, "learning_rate": 0.5}, "five", 5).fit(rows)
    scored = model.transform(rows)
    wrong = scored.where(F.col("prediction") != F.col("five"))
    assert wrong.count() == rows.where("id % 23 = 0 AND five <> (id % 10) DIV 2").count()
    from pyspark.ml.functions import vector_to_array

    p = scored.select(vector_to_array("probability").alias("p"), "prediction")
    assert p.where("abs(aggregate(p, 0D, (a, x) -> a + x) - 1) > 1e-9 OR element_at(p, int(prediction) + 1) < array_max(p)").count() == 0
    assert set(model.split_counts(NAMES)) <= set(NAMES) and model.split_counts(NAMES)["a"] > 0
    assert len(model.node_rows()) == sum(len(t.feature) for ts in model.trees for t in ts)


@pytest.mark.parametrize("label, classes", [("two", 2), ("five", 5)])
def test_rounds_by_held_out_error(rows, label, classes):
    """The curve of blocks of two rounds, against models fitted fold by fold."""
    params = {"max_depth": 2, "learning_rate": 0.3, "n_estimators": 5, "seed": 4, "subsample": 0.8, "colsample_bytree": 0.7}
    found = find_rounds(rows, "fold", label, classes, params, patience=10, block=2)
    again = find_rounds(rows, "fold", label, classes, params, patience=10, block=5)
    assert sorted(found.curve) == sorted(again.curve) and len(found.curve) == 15
    errors = defaultdict(list)
    for r, _, n, m in found.curve:
        errors[r].append(m / n)
    means = {r: sum(e) / 3 for r, e in errors.items()}
    assert found.best == min(means, key=lambda r: (means[r], r))
    # the last round of one fold, from a model of its own
    state = grow(begin(rows, label, classes, params, held=F.col("fold") == 1), 5)
    x, y = local(rows.where("fold = 1"), label)
    margins = sum(boosting._steps(trees, 0.3, x) for trees in state.trees)
    guess = margins[:, 0] > 0 if classes == 2 else margins.argmax(axis=1)
    assert (5, 1, len(y), int((guess != y).sum())) in found.curve


@pytest.mark.parametrize("label, classes", [("two", 2), ("five", 5)])
def test_one_task_grows_the_trees_of_many(rows, label, classes, monkeypatch):
    """Fits of few rows, in one task and by passes over the parts, with samples of rows, bins and features."""
    params = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "seed": 6, "subsample": 0.7, "colsample_bytree": 0.7, "reg_alpha": 0.1}
    monkeypatch.setattr(boosting, "BIN_ROWS", 300)
    df = rows.repartition(3, "id").cache()
    here = GradientBoost(params, label, classes).fit(df)
    monkeypatch.setattr(boosting, "LOCAL_VALUES", 0)
    passes = GradientBoost(params, label, classes).fit(df)
    assert here.node_rows() == passes.node_rows() and here.losses == passes.losses and len(here.trees) == 4


def test_row_draws_are_those_of_spark(spark):
    df = spark.range(-3, 200).selectExpr("id * 8589934592 + id AS row", f"pmod(xxhash64(id * 8589934592 + id, 1126, 7), {boosting.SAMPLE_STEPS}) AS draw")
    got = df.toPandas()
    assert boosting._row_draws(got["row"].to_numpy(), 1126, 7).tolist() == got["draw"].tolist()


def test_bin_ends_follow_the_running_weight():
    """Against the rule one value at a time."""
    rng = np.random.default_rng(3)
    for n, most in ((500, 7), (3000, 127), (140, 127)):
        values, weights = rng.normal(size=n).round(2), rng.random(n) ** 4
        known, place = np.unique(values, return_inverse=True)
        reached = np.cumsum(np.bincount(place, weights))
        stride = target = reached[-1] / (most + 1)
        wanted = []
        for i in range(1, len(known)):
            if abs(reached[i - 1] - target) < abs(reached[i] - target):
                wanted.append((known[i - 1] + known[i]) / 2)
                target += stride
        if len(known) - 1 > most:
            assert boosting.bin_ends(values, weights, most).tolist() == wanted


def test_registered_settings_grow_all_their_rounds(spark, monkeypatch):
    """The query fits each registered setting as it is registered."""
    from tabcascade.bindings import sources
    from tabcascade.plans.params import registry

    seen = []

    class Told(GradientBoost):
        def fit(self, df):
            seen.append(dict(self.params))
            return GradientBoost({**self.params, "n_estimators": 1, "max_depth": 1}, self.label, self.classes).fit(df)

    monkeypatch.setattr(sources, "GradientBoost", Told)
    columns = ["event_id AS event_id", "timestamp_seconds(event_id * 977) AS ts", "event_id % 31 AS user_id", "'view' AS event_type", "CAST(event_id % 17 AS DOUBLE) AS value"]
    events = spark.range(400).withColumnRenamed("id", "event_id").selectExpr(*columns, """concat('{"k": ', event_id % 5, '}') AS props""")
    tables = type("Tables", (), {"spark": spark, "events": events})()
    assert sources.registry_fit(tables).agg(F.sum("n")).first()[0] == 100
    assert sorted(seen, key=lambda p: p["seed"]) == sorted(registry().values(), key=lambda p: p["seed"])


def random_tree(rng, depth, classes):
    nodes = []

    def grow_node(level):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1])
        if level and rng.random() < 0.9:
            nodes[at] = [int(rng.integers(4)), float(rng.integers(-3, 4)), grow_node(level - 1), grow_node(level - 1)]
        return at

    grow_node(depth)
    f, t, a, b = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(t, float), np.array(a), np.array(b), rng.random((len(f), classes)).round(1))


def test_a_family_votes_as_its_members_walk():
    """Words of several trees, trees of one leaf and of more leaves than a word has bits; values on thresholds, and unknown ones."""
    rng = np.random.default_rng(5)
    members = [Member([random_tree(rng, d, 5) for d in (0, 2, 5, 3)], [1.0, 0.5, 2.0, 1.0]) for _ in range(9)]
    members += [Member([random_tree(rng, 9, 5)], [1.0]), Member([random_tree(rng, 0, 5)], [1.0])]
    assert max((t.feature < 0).sum() for m in members for t in m.trees) > 64
    x = rng.integers(-4, 5, (5000, 4)).astype(float)
    x[::97, 2] = np.nan
    x[5::89, 1] = np.inf
    got = Family(members).predictions(x)
    for own, member in zip(got, members, strict=True):
        assert own.tolist() == member.predict(x).tolist()
    assert Family(members).votes(x, 5).sum(axis=1).tolist() == [len(members)] * len(x)


def test_a_cascade_of_trees_scores_in_one_pass(spark, rows):
    """The plan has one Python stage and no member's transform, and says what the members say."""
    from tabcascade.plans.ensembles import Cascade

    second = rows.where("five > 0").withColumn("five", F.col("five") - 1)
    both = Cascade(
        [GBTClassifier(labelCol="two", maxIter=2, maxDepth=2, seed=s).fit(rows) for s in (1, 2)],
        [random_forest("five", trees=3, depth=4, seed=s).fit(second) for s in (1, 2, 3)], 4,
    )
    for stages in (False, True):
        fast, slow = both.score(rows, "p", stages), both.score_by_members(rows, "p", stages)
        assert fast.schema.simpleString() == slow.schema.simpleString() and fast.exceptAll(slow).count() == 0 and fast.count() == 900
    assert fast._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_rows_of_one_part_are_dealt_anew(spark, monkeypatch):
    from tabcascade import session

    one = spark.range(0, 5000, 1, 1)
    assert session.hold_dealt(one).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "PART_ROWS", 100)
    dealt = session.hold_dealt(one.selectExpr("id AS key"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1000 and dealt.distinct().count() == 5000
    even = spark.range(0, 5000, 1, 16)
    assert session.hold_dealt(even).rdd.getNumPartitions() == 16


def test_patience_ends_the_search():
    curve = [(r, f, 10, m) for r, m in enumerate([5, 3, 3, 4, 3, 2], 1) for f in (0, 1)]
    assert chosen_round(curve, 3) == (2, True)
    assert chosen_round(curve, 50) == (6, False)
    assert chosen_round([], 3) == (0, False)


def test_empty_and_unlabelled_rows(spark, rows):
    none = rows.where("id < 0")
    assert find_rounds(none, "fold", "two", 2, {}).best == 0
    some = rows.where("id < 60").withColumn("two", F.when(F.col("id") % 2 == 0, F.col("two"))).withColumn("fold", F.when(F.col("id") > 5, F.col("fold")))
    found = find_rounds(some, "fold", "two", 2, {"n_estimators": 1, "max_depth": 1}, block=1)
    assert sum(n for _, _, n, _ in found.curve) == some.where("two IS NOT NULL AND fold IS NOT NULL").count()


def test_heavy_children_make_constant_trees(rows):
    model = GradientBoost({"n_estimators": 1, "min_child_weight": 1e6}, "two").fit(rows)
    assert model.split_counts(NAMES) == {}


def tree_rows(trees):
    return [(t.feature.tolist(), t.threshold.tolist(), t.value.tolist()) for own in trees for t in own]


@pytest.mark.parametrize("label, classes", [("two", 2), ("five", 5)])
def test_fits_that_grow_together_are_those_of_their_own(rows, label, classes, monkeypatch):
    """Other samples, folds, depths and numbers of rounds beside it change no fit; nor do small lots of nodes."""
    points = [{"max_depth": d, "subsample": s, "n_estimators": n, "seed": 3} for d, s, n in ((1, 1.0, 2), (3, 0.7, 1), (3, 0.7, 3), (0, 1.0, 1))]
    boosts = [GradientBoost(p, label, classes) for p in points for _ in range(2)]
    folds = [0, 2] * len(points)
    blocks = boosts[0].packed(rows, "fold")
    whole = boosting.held_out_counts(boosts, blocks, folds)
    alone = [b.held_out_counts(blocks, f) for b, f in zip(boosts, folds, strict=True)]
    assert whole == alone and all(sum(c.values()) == rows.where(f"fold = {f}").count() for c, f in zip(whole, folds, strict=True))
    settings = [(b.params, f) for b, f in zip(boosts, folds, strict=True)][2:6]
    monkeypatch.setattr(boosting, "LOT_BYTES", 1)
    grown = boosting.grow_together(boosting.start_together(blocks, classes, settings), [1, 1, 3, 3], losses=False)
    for state, (params, held), n in zip(grown, settings, [1, 1, 3, 3], strict=True):
        own = grow(boosting.start(blocks, classes, params, held), n)
        assert len(own.trees) == n and tree_rows(own.trees) == tree_rows(state.trees)


def test_rows_of_one_part_are_dealt_to_all_cores(spark):
    """A file with one row group is one task, in every pass of every fit."""
    df = with_features(spark.range(200_000).coalesce(1).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 2 AS INT) AS two", "0 AS fold"), ["a"], ["two", "fold"])
    blocks = GradientBoost({}, "two").packed(df, "fold").rows
    sizes = [r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("y") / 4).alias("n")).collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 8 and max(sizes) <= 50_000


def test_a_search_passes_over_the_rows_as_often_as_one_fit(spark, rows):
    from tabcascade.operators.metrics import ConfusionEvaluator
    from tabcascade.plans.tuning import fold_scores

    def jobs(settings):
        spark.sparkContext.setJobGroup(f"search-{settings}", "")
        points = [{"n_estimators": 1, "max_depth": 2, "min_child_weight": w} for w in range(settings)]
        scores = fold_scores(lambda p: GradientBoost(p, "two"), points, rows, "fold", ConfusionEvaluator("accuracy", "two"))
        assert len(scores) == 3 * settings
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{settings}"))

    one, eight = jobs(1), jobs(8)
    assert 0 < eight <= one + 2


# ---- stored families -------------------------------------------------------------------


def test_stored_families_score_like_their_models(spark, rows, tmp_path):
    first = [
        GBTClassifier(labelCol="two", maxIter=3, maxDepth=3, seed=1).fit(rows),
        random_forest("two", 4, 4, 2).fit(rows),
        DecisionTreeClassifier(labelCol="two", maxDepth=2).fit(rows),
    ]
    some = rows.where("two = 1")
    second = [random_forest("five", 3, 5, s).fit(some) for s in (1, 2)]
    paths = []
    for k, model in enumerate([*first, *second]):
        paths.append(str(tmp_path / f"m{k}"))
        model.save(paths[-1])
    cascade = StoredCascade.load(spark, paths[:3], paths[3:], 5)
    scored = cascade.score(rows, "label", keep_votes=True)
    plain = rows
    for k, model in enumerate([*first, *second]):
        plain = add_prediction(model, plain, f"p{k}")
    plain = with_vote(with_vote(plain, ["p0", "p1", "p2"], [0, 1], "one"), ["p3", "p4"], list(range(5)), "two_", shift=1)
    want = plain.select("id", F.when(F.col("one") == 1, F.col("two_")).otherwise(0).cast("int").alias("label"))
    assert scored.select("id", "label").exceptAll(want).count() == 0
    assert scored.where("label = 0 AND size(label_second) > 0 OR label > 0 AND aggregate(label_second, 0L, (a, x) -> a + x) <> 2").count() == 0
    counts = stored_split_counts(spark, paths[1])
    assert sum(counts.values()) == first[1].toDebugString.count("If (feature")
    x, _ = local(rows, "two")
    assert stored_member(spark, paths[0]).predict(x[:50]).tolist() == [int(r["p0"]) for r in plain.orderBy("id").limit(50).collect()]
    nothing = rows.select("id", F.lit(None).cast(rows.schema["features"].dataType).alias("features")).limit(3)
    assert [r.label for r in cascade.score(nothing, "label").collect()] == [None] * 3
