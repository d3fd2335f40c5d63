import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabcascade.operators.folds import stratified_folds
from tabcascade.operators.metrics import ConfusionEvaluator
from tabcascade.plans.ensembles import Cascade, add_votes, pseudo_label_first, pseudo_label_second, second_stage_rows, seeded_bags
from tabcascade.plans.ledger import Ledger
from tabcascade.plans.models import (
    add_prediction,
    boosted_trees,
    fit_adaboost,
    fourier_features,
    gain_importance,
    kernel_svm,
    logistic,
    random_forest,
    ranked_features,
    split_importance,
    with_features,
)
from tabcascade.plans.params import NAMES as NAMES_OF_SETTINGS
from tabcascade.plans.params import STANDARDISED_TUNING, START, all_settings, registry, tree_boost_params
from tabcascade.plans.selection import eliminate
from tabcascade.plans.tuning import (
    around,
    cross_validate,
    fixed,
    grid,
    grid_search,
    random_grid,
    refine,
    first_stage_steps,
    nine_steps,
    seven_steps,
    staged_search,
)
from tabcascade.sources import load_models, save_models
from tabcascade.sources.models import stored_params, unfitted

NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def learnable(spark):
    """Three classes that depend on a and b; the third column says nothing."""
    df = spark.range(600).selectExpr(
        "id",
        "CAST(pmod(hash(id, 1), 1000) AS DOUBLE) / 1000 AS a",
        "CAST(pmod(hash(id, 2), 1000) AS DOUBLE) / 1000 AS b",
        "CAST(pmod(hash(id, 3), 1000) AS DOUBLE) / 1000 AS noise",
    )
    return df.withColumn("label", F.expr("CASE WHEN a < 0.6 THEN 0 WHEN b < 0.5 THEN 1 ELSE 2 END").cast("int")).cache()


@pytest.fixture(scope="module")
def packed(learnable):
    return with_features(learnable, NAMES, ["id", "label"]).cache()


def accuracy(df, prediction="prediction"):
    return df.agg(F.avg((F.col("label") == F.col(prediction)).cast("double"))).first()[0]


@pytest.mark.parametrize(
    "make",
    [
        lambda: boosted_trees({"n_estimators": 3, "max_depth": 3}, "label", classes=3),
        lambda: random_forest("label", trees=10, depth=30, seed=1),
        lambda: logistic("label", 600, c=10.0, classes=3),
    ],
)
def test_families_learn(packed, make):
    assert accuracy(add_prediction(make().fit(packed), packed, "prediction")) > 0.85


def test_kernel_features_approximate_the_kernel(spark):
    points = np.random.default_rng(0).normal(size=(12, 3))
    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["id", "features"])
    mapped = {r["id"]: r["mapped"].toArray() for r in fourier_features(df, 3, gamma=0.3, size=4000, seed=1).collect()}
    for i in range(12):
        for j in range(12):
            assert mapped[i] @ mapped[j] == pytest.approx(math.exp(-0.3 * ((points[i] - points[j]) ** 2).sum()), abs=0.08)


def test_kernel_svm_bends(spark):
    rows = [(i, float(np.cos(i) * (1 + i % 2)), float(np.sin(i) * (1 + i % 2)), i % 2) for i in range(200)]
    df = with_features(spark.createDataFrame(rows, "id int, x double, y double, label int"), ["x", "y"], ["id", "label"])
    mapped = fourier_features(df, 2, gamma=1.0, size=100, seed=2).coalesce(1).cache()
    assert accuracy(add_prediction(kernel_svm("label", 10.0, 200, max_iter=10).fit(mapped), mapped, "prediction")) > 0.95


def test_adaboost_beats_its_single_tree(packed):
    one = fit_adaboost(packed, "label", 3, rounds=1)
    many = fit_adaboost(packed, "label", 3, rounds=6, cut_every=3)
    assert accuracy(many.transform(packed)) > accuracy(one.transform(packed))


def test_importance(packed):
    model = random_forest("label", trees=5, depth=4, seed=1).fit(packed)
    gains, splits = gain_importance(model, NAMES), split_importance(model, NAMES)
    assert set(ranked_features(gains)[:2]) == {"a", "b"}
    assert sum(splits.values()) == model.toDebugString.count("If (feature")


def test_votes_cascade_and_round_trip(spark, packed, tmp_path):
    first = [boosted_trees({"n_estimators": 2, "max_depth": 3, "seed": s}, "label").fit(packed.withColumn("label", (F.col("label") > 0).cast("int"))) for s in (1, 2)]
    second = [random_forest("label", 5, 4, s).fit(second_stage_rows(packed, "label")) for s in (1, 2, 3)]
    both = Cascade(first, second, 2)
    scored = both.score(packed, "prediction", keep_stages=True)
    assert scored.count() == 600 and accuracy(scored) > 0.85
    wrong = scored.filter("prediction <> CASE WHEN first_stage = 1 THEN second_stage ELSE 0 END").count()
    assert wrong == 0
    save_models(second, str(tmp_path))
    again = add_votes(load_models(str(tmp_path), 3), packed, [0, 1], "v")
    want = add_votes(second, packed, [0, 1], "v")
    assert again.exceptAll(want).count() == 0
    params = stored_params(load_models(str(tmp_path), 1)[0])
    assert unfitted(type(random_forest("label")), params).getNumTrees() == 5


def test_pseudo_labels(packed):
    binary = packed.withColumn("label", (F.col("label") > 0).cast("int"))
    known, unknown = binary.filter("id % 4 > 0"), binary.filter("id % 4 = 0").withColumn("label", F.lit(-1))
    build = lambda: random_forest("label", 5, 4, 1)
    first = build().fit(known)
    _, rows = pseudo_label_first(first, build, known, unknown, "label")
    assert rows.count() == 600 and {r[0] for r in rows.select("label").distinct().collect()} == {0, 1}
    labelled = packed.filter("id % 4 > 0")
    second = build().fit(second_stage_rows(labelled, "label"))
    _, rows = pseudo_label_second(first, second, build, labelled, unknown, "label")
    sent_on = add_prediction(first, unknown, "p").filter("p = 1").count()
    assert rows.count() == labelled.filter("label > 0").count() + sent_on
    assert {r[0] for r in rows.select("label").distinct().collect()} == {0, 1}


# ---- search ------------------------------------------------------------------------------


def test_grid_search_and_stages(packed, learnable):
    df = with_features(stratified_folds(learnable, "id", "label", 2), NAMES, ["label", "fold"]).cache()
    build = lambda p: random_forest("label", trees=3, depth=p["depth"], seed=1)
    found = grid_search(build, {}, grid({"depth": [1, 4]}), df, "fold", ConfusionEvaluator("accuracy"))
    assert found.best == {"depth": 4} and len(found.scores) == 4
    assert len(cross_validate(build, {"depth": 2}, df, "fold", ConfusionEvaluator("accuracy"))) == 2
    best, history = staged_search(build, {"depth": 4}, [fixed(depth=[1]), around("depth", [0, 1])], df, "fold", ConfusionEvaluator("accuracy"))
    assert not history[1].accepted and best["depth"] >= 4


def test_a_stopped_search_goes_on(spark, packed, learnable, tmp_path):
    """The fifth fit fails; the next driver repeats only what is missing, with the same outcome."""
    df = with_features(stratified_folds(learnable, "id", "label", 2), NAMES, ["label", "fold"]).cache()
    points, fits, broken = grid({"depth": [1, 2, 3, 4]}), [], [True]

    def build(p):
        fits.append(p["depth"])
        if broken[0] and len(fits) == 5:
            raise RuntimeError("lost")
        return random_forest("label", trees=2, depth=p["depth"], seed=1)

    how = {"folds": [0, 1], "parallelism": 1, "name": "search"}
    with pytest.raises(RuntimeError):
        grid_search(build, {}, points, df, "fold", ConfusionEvaluator("accuracy"), ledger=Ledger(spark, f"{tmp_path}/l"), **how)
    done = len(Ledger(spark, f"{tmp_path}/l").scores())
    broken[0] = False
    fits.clear()
    found = grid_search(build, {}, points, df, "fold", ConfusionEvaluator("accuracy"), ledger=Ledger(spark, f"{tmp_path}/l"), **how)
    assert 4 <= done < 8 and len(fits) == 8 - done
    assert found.scores == grid_search(build, {}, points, df, "fold", ConfusionEvaluator("accuracy"), **how).scores
    assert found.best == {"depth": 4} or found.best_score >= max(s for _, _, s in found.scores) - 0.2


def test_bags_are_stored_and_resumed(spark, packed, tmp_path):
    fits = []

    def build(seed):
        fits.append(seed)
        return random_forest("label", trees=1, depth=3, seed=seed)

    for _ in range(2):
        models = seeded_bags(range(3), lambda seed: packed, build, ledger=Ledger(spark, str(tmp_path)))
    assert sorted(fits) == [0, 1, 2] and len(models) == 3
    assert accuracy(add_votes(models, packed, [0, 1, 2], "v"), "v") > 0.6


def test_penalty_counts_the_training_rows(spark, learnable):
    df = with_features(stratified_folds(learnable, "id", "label", 3), NAMES, ["label", "fold"]).cache()
    seen = []
    build = lambda p, n: seen.append(n) or logistic("label", n, p["c"], classes=3, max_iter=2)
    refine(build, {}, "c", [1.0], df, "fold", ConfusionEvaluator("accuracy"), rounds=1, with_rows=True)
    assert sorted(seen) == [400, 400, 400]


def test_elimination_drops_the_noise(learnable):
    df = stratified_folds(learnable, "id", "label", 2).cache()
    out = eliminate(lambda: random_forest("label", 3, 4, 1), df, NAMES, "label", "fold", ConfusionEvaluator("accuracy"))
    assert out.ranking["noise"] == max(out.ranking.values()) and out.best_size == 2
    assert sorted(out.selected()) == ["a", "b"]


def test_grids():
    assert grid({"a": [1, 2], "b": [3, 4]})[1] == {"a": 1, "b": 4}
    points = random_grid({"a": range(10), "b": range(10)}, 30, seed=1)
    assert len({tuple(p.items()) for p in points}) == 30
    assert points == random_grid({"a": range(10), "b": range(10)}, 30, seed=1)
    steps = seven_steps()
    assert len(steps) == 7
    assert steps[1]({"max_depth": 5, "min_child_weight": 1.0})["min_child_weight"] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    assert len(steps[6]({"n_estimators": 200})["n_estimators"]) == 19
    assert [len(grid(s({"max_depth": 5, "min_child_weight": 3, "subsample": 0.8, "colsample_bytree": 0.8, "n_estimators": 400}))) for s in steps] == [16, 21, 5, 16, 25, 15, 19]
    assert seven_steps(200)[5]({})["n_estimators"] == [1, 2, 3, 4, 5] and seven_steps(200)[6]({"n_estimators": 2})["n_estimators"] == [1, 2, 3]
    nine = nine_steps()
    assert len(nine) == 9 and nine[6]({"reg_alpha": 0.1})["reg_alpha"] == pytest.approx([0.05, 0.1, 0.15, 0.2, 0.5, 1.0]) and nine[6]({"reg_alpha": 0.0}) == {"reg_alpha": [0.0]}
    assert len(nine[7]({})["n_estimators"]) == 9 and len(nine[8]({"n_estimators": 300})["n_estimators"]) == 17
    assert len(first_stage_steps()) == 5


def test_params():
    known = registry(STANDARDISED_TUNING)
    known[110]["max_depth"] = 99
    assert registry(STANDARDISED_TUNING)[110]["max_depth"] == 6
    assert len(all_settings()) == 18 and all(set(p) <= set(NAMES_OF_SETTINGS) for p in all_settings().values())
    assert tree_boost_params({"learning_rate": 0.01, "n_estimators": 240, "min_child_weight": 1}) == {"stepSize": 0.01, "maxIter": 240}
    for wrong in ({"in_child_weight": 4}, {"gamma": 0.3}, {"min_child_weight": 5.5}, {"reg_alpha": 10.0}):
        with pytest.raises(ValueError):
            tree_boost_params(wrong)
    assert GBTClassifier(**tree_boost_params(START)).getMaxDepth() == 5


def test_deeper_trees_than_spark_grows_are_refused():
    with pytest.raises(ValueError, match="at most 30"):
        random_forest("label", depth=80)
    with pytest.raises(ValueError, match="at most 30"):
        boosted_trees({"max_depth": 31}, "label")


def test_all_reasons_are_learned(spark, data):
    from tabcascade.bindings.base import Tables
    from tabcascade.bindings.learn import fold_rows, reason_rows

    t = Tables(spark, data)
    for rows in (reason_rows(t), fold_rows(t, 2)):
        assert {r.label for r in rows.select("label").distinct().collect()} == set(range(5))


@pytest.mark.parametrize("classes, rounds", [(2, 3), (3, 12)])
def test_kernel_machine_takes_the_steps_of_spark(spark, classes, rounds):
    """Weights and offsets of one class against the rest, with kernel features made in the passes, against LinearSVC on kept ones."""
    from tabcascade.plans.kernel import FourierMap

    df = spark.range(600).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(pmod(hash(id), 100) AS DOUBLE) / 50 AS b", f"CAST(IF(id % 11 = 0, id DIV 7, id % 7) % {classes} AS INT) AS label")
    shape = dict(width=2, gamma=0.4, size=20, seed=3)
    rows = fourier_features(with_features(df, ["a", "b"], ["label"]), **shape).repartition(3).cache()
    theirs = kernel_svm("label", 5.0, 600, max_iter=rounds).fit(rows)
    ours = kernel_svm("label", 5.0, 600, max_iter=rounds, kernel=FourierMap(**shape)).fit(rows)
    for k, model in enumerate(theirs.models):
        assert ours.weights[k] == pytest.approx(model.coefficients.toArray(), abs=1e-7) and ours.offsets[k] == pytest.approx(model.intercept, abs=1e-7)
    both = add_prediction(ours, add_prediction(theirs, rows, "theirs"), "ours")
    assert both.where("ours <> theirs").count() == 0 and both.select("ours").distinct().count() == classes


def test_kernel_machine_passes_over_the_rows_a_few_times(spark, monkeypatch):
    """All classes and tries of their line searches share passes: about one an iteration, not some ten."""
    from tabcascade.plans import kernel

    passes, summed = [], kernel._summed
    monkeypatch.setattr(kernel, "_summed", lambda *a: passes.append(1) or summed(*a))
    df = spark.range(300).selectExpr("CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 10 < 5 AS INT) AS label")
    shape = dict(width=1, gamma=0.5, size=16, seed=5)
    rows = fourier_features(with_features(df, ["a"], ["label"]), **shape)
    kernel_svm("label", 10.0, 300, max_iter=10, kernel=kernel.FourierMap(**shape)).fit(rows)
    assert len(passes) <= 30
