"""Tuning, model and ensemble queries. Fits are small in rounds, never in rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.bindings.base import EVENTS, EVENTS_SQL, Tables, query
from tabcascade.functions import binary_label
from tabcascade.operators.aggregates import confidence_histogram, row_confidence
from tabcascade.operators.folds import group_folds, stratified_folds
from tabcascade.operators.metrics import ConfusionEvaluator
from tabcascade.operators.prepare import apply_scaling, fit_standard
from tabcascade.operators.relational import append_rows, split_by_label
from tabcascade.operators.sampling import (
    balanced_bag,
    class_weight_table,
    over_sample,
    top_up,
    with_class_weight,
)
from tabcascade.plans.boosting import GradientBoost, find_rounds, rounds_by_rate
from tabcascade.plans.ensembles import (
    Cascade,
    add_votes,
    fit_cascade,
    pseudo_label_first,
    pseudo_label_second,
    second_stage_rows,
    seeded_bags,
)
from tabcascade.plans.models import (
    add_prediction,
    add_probabilities,
    boosted_trees,
    fit_adaboost,
    fourier_features,
    gain_importance,
    importance_table,
    kernel_svm,
    logistic,
    random_forest,
    ranked_features,
    split_importance,
    with_features,
)
from tabcascade.plans.selection import eliminate, top_k_sweep
from tabcascade.plans.tuning import (
    cross_validate,
    fixed,
    grid,
    grid_search,
    random_grid,
    refine,
    staged_search,
)
from tabcascade.session import hold, hold_dealt, hold_few

FEATURE_NAMES = ["value", "k", "user", "hour", "is_click", "is_view", "is_error"]
FEATURE_EXPRESSIONS = [
    "CAST(get_json_object(props, '$.k') AS DOUBLE) AS k",
    "CAST(user_id AS DOUBLE) AS user",
    "CAST(hour(ts) AS DOUBLE) AS hour",
    "CAST(event_type = 'click' AS DOUBLE) AS is_click",
    "CAST(event_type = 'view' AS DOUBLE) AS is_view",
    "CAST(event_type = 'error' AS DOUBLE) AS is_error",
]


def learn_rows(t: Tables) -> DataFrame:
    """Event features with the six-class label."""
    df = t.events.selectExpr(*[e for e in EVENTS if e not in ("user_id", "event_type")], *FEATURE_EXPRESSIONS)
    return df.select("event_id", "label", *FEATURE_NAMES)


def class_rows(t: Tables, *keep: str) -> DataFrame:
    return hold_few(with_features(learn_rows(t), FEATURE_NAMES, ["event_id", "label", *keep]))


def binary_rows(t: Tables) -> DataFrame:
    return hold_few(with_features(learn_rows(t).withColumn("label", binary_label("label")), FEATURE_NAMES, ["event_id", "label"]))


def reason_rows(t: Tables) -> DataFrame:
    """Stage-two rows, with the five reasons."""
    return hold_few(with_features(second_stage_rows(learn_rows(t), "label"), FEATURE_NAMES, ["event_id", "label"]))


def tiny_boost(label: str, seed: int = 0, **params):
    return boosted_trees({"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1, **params, "seed": seed}, label)


# A handful of rounds; all other settings are those of the query.
SMALL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1}


def newton(params=(), classes: int = 2) -> GradientBoost:
    return GradientBoost({**SMALL, **dict(params)}, "label", classes)


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def drawn_folds(drawn: DataFrame, k: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build`` of the drawn rows with their folds. The folds read the rows three times, so the draw is kept until then."""
    drawn = hold(drawn)
    rows = hold_few(build(group_folds(drawn, "event_id", "label", k)))
    drawn.unpersist()
    return rows


def fold_rows(t: Tables, k: int = 3) -> DataFrame:
    """Over-sampled stage-two rows; copies of a row share its fold."""
    df = second_stage_rows(learn_rows(t), "label")
    return drawn_folds(over_sample(df, "event_id", "label", 326), k, lambda df: with_features(df, FEATURE_NAMES, ["event_id", "label", "fold"]))


def binary_fold_rows(t: Tables, k: int = 3) -> DataFrame:
    def build(df: DataFrame) -> DataFrame:
        return with_features(df.withColumn("label", binary_label("label")), FEATURE_NAMES, ["event_id", "label", "fold"])

    return drawn_folds(top_up(learn_rows(t), "event_id", "label", 1126), k, build)


def forest(params=()):
    return random_forest("label", **{"trees": 5, "depth": 5, **dict(params)})


def score_table(t: Tables, rows, schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# ---- cross-validation and search ---------------------------------------------------------


@query("K2_out_of_fold_predictions")
def out_of_fold(t: Tables):
    """Predictions of each row by the model that did not see it, with the A12 histogram."""
    df = stratified_folds(learn_rows(t).withColumn("label", binary_label("label")), "event_id", "label", 3, seed=1126)
    rows = hold_few(with_features(df, FEATURE_NAMES, ["event_id", "label", "fold"]))
    parts = []
    for i in range(3):
        model = tiny_boost("label", 1126).fit(rows.filter(F.col("fold") != i))
        parts.append(add_probabilities(model, rows.filter(F.col("fold") == i).select("event_id", "label", "fold", "features"), ["p0", "p1"], "prediction"))
    scored = append_rows(*parts).withColumn("confidence", row_confidence(["p0", "p1"]))
    return confidence_histogram(scored, "fold", "label", "prediction", "confidence")


@query("K4_cross_validate")
def cross_validated(t: Tables):
    scores = cross_validate(lambda p: tiny_boost("label", **p), {}, binary_fold_rows(t), "fold", ConfusionEvaluator("f1"))
    return score_table(t, [(i, float(s)) for i, s in enumerate(scores)], "fold int, score double")


@query("K5_grid_search")
def searched(t: Tables):
    points = grid({"max_depth": [2, 4], "gamma": [0.0, 0.1]})
    found = grid_search(lambda p: newton(p), {"n_estimators": 2}, points, binary_fold_rows(t), "fold", ConfusionEvaluator("f1_micro"))
    return found.table(t.spark)


@query("K6_boosting_rounds")
def rounds(t: Tables):
    """Misses on the rows held out, after each round."""
    return find_rounds(binary_fold_rows(t), "fold", "label", 2, {**SMALL, "n_estimators": 5}, patience=2, block=3).table(t.spark)


@query("K6_boosting_rounds_classes")
def class_rounds(t: Tables):
    return find_rounds(fold_rows(t, 2), "fold", "label", 5, SMALL, patience=2, block=3).table(t.spark)


@query("K8_keep_if_not_worse")
def not_worse(t: Tables):
    """A stage that scores lower is tried once and not taken over."""
    steps = [fixed(depth=[1]), fixed(depth=[5], minInstancesPerNode=[1])]
    start = {"trees": 3, "depth": 5, "seed": 1}
    best, history = staged_search(forest, start, steps, fold_rows(t, 2), "fold", ConfusionEvaluator("f1_macro"))
    taken = max(s.score for s in history if s.accepted)
    rows = [(s.number, float(s.score), s.accepted, s.score <= taken) for s in history]
    return score_table(t, rows, "stage int, score double, accepted boolean, not_above_best boolean")


@query("K9_rate_sweep")
def rates(t: Tables):
    found = rounds_by_rate(binary_fold_rows(t, 2), "fold", "label", 2, SMALL, [0.1, 0.01], patience=2, block=3)
    return score_table(t, [(r, s.best) for r, s in found.items()], "learning_rate double, rounds int")


@query("K10_randomized_search")
def randomized(t: Tables):
    points = random_grid({"trees": [2, 4, 6, 8], "depth": [2, 4, 6], "minInstancesPerNode": [1, 2, 4]}, 1000, seed=7)
    found = grid_search(forest, {}, points, fold_rows(t, 2), "fold", ConfusionEvaluator("f1_macro"))
    return found.table(t.spark)


@query("K11_refined_search")
def refined(t: Tables):
    searches = refine(
        lambda p, n: logistic("label", n, p["c"], classes=5, max_iter=10), {}, "c", [0.01, 1.0], fold_rows(t, 2), "fold", ConfusionEvaluator("f1_macro"), with_rows=True
    )
    return append_rows(*[s.table(t.spark) for s in searches])


# ---- families ----------------------------------------------------------------------------


@query("M1_boosted_binary")
def boosted_binary(t: Tables):
    rows = binary_rows(t)
    return tally(add_prediction(newton({"min_child_weight": 5.5, "gamma": 0.9}).fit(rows), rows, "prediction"), "label", "prediction")


@query("M2_boosted_classes")
def boosted_classes(t: Tables):
    rows = reason_rows(t)
    return tally(add_prediction(newton({"n_estimators": 2}, 5).fit(rows), rows, "prediction"), "label", "prediction")


def weighted(rows: DataFrame) -> DataFrame:
    return hold_few(with_class_weight(rows, "label", class_weight_table(rows, "label")))


def scaled_rows(t: Tables) -> DataFrame:
    df = learn_rows(t)
    return with_features(apply_scaling(df, fit_standard(df, FEATURE_NAMES)), FEATURE_NAMES, ["event_id", "label"])


@query("M3_logistic_weighted")
def logistic_weighted(t: Tables):
    rows = weighted(scaled_rows(t))
    model = logistic("label", rows.count(), classes=6, weight="weight", max_iter=20).fit(rows)
    return tally(add_prediction(model, rows, "prediction"), "label", "prediction")


@query("M4_logistic_stages")
def logistic_stages(t: Tables):
    rows = hold(scaled_rows(t))
    first, second = rows.withColumn("label", binary_label("label")), second_stage_rows(rows, "label")
    n1, n2 = first.count(), second.count()
    both = fit_cascade(first, second, lambda: [logistic("label", n1, max_iter=10)], lambda: [logistic("label", n2, classes=5, max_iter=10)], 5)
    return tally(both.score(rows, "prediction"), "label", "prediction")


@query("M5_kernel_svm")
def svm(t: Tables):
    rows = weighted(fourier_features(scaled_rows(t), len(FEATURE_NAMES), gamma=0.1, size=32, seed=5))
    model = kernel_svm("label", 1.0, rows.count(), weight="weight", max_iter=5).fit(rows)
    return tally(add_prediction(model, rows, "prediction"), "label", "prediction")


@query("M6_random_forest")
def forests(t: Tables):
    rows = class_rows(t)
    return tally(add_prediction(forest({"seed": 1126}).fit(rows), rows, "prediction"), "label", "prediction")


@query("M7_adaboost")
def adaboost(t: Tables):
    rows = reason_rows(t)
    model = fit_adaboost(rows, "label", classes=5, rounds=3, depth=2)
    return tally(model.transform(rows), "label", "prediction")


@query("M8_hard_vote")
def hard_vote(t: Tables):
    rows = binary_rows(t)
    models = [tiny_boost("label", 1).fit(rows), forest().fit(rows), logistic("label", rows.count(), max_iter=10).fit(rows)]
    return tally(add_votes(models, rows, [0, 1], "vote"), "label", "vote")


@query("M9_seeded_bags")
def bags(t: Tables):
    df = hold(learn_rows(t))

    def resample(seed):
        bag = balanced_bag(df, "event_id", "label", 600, 120, seed).withColumn("label", binary_label("label"))
        return with_features(bag, FEATURE_NAMES, ["event_id", "label"])

    models = seeded_bags(range(15), resample, lambda seed: tiny_boost("label", seed))
    return tally(add_votes(models, with_features(df, FEATURE_NAMES, ["event_id", "label"]), [0, 1], "vote"), "label", "vote")


@query("M10_predict")
def predict(t: Tables):
    rows = class_rows(t)
    return add_prediction(forest().fit(rows), rows, "prediction").select("event_id", "prediction")


@query("M11_probabilities")
def probabilities(t: Tables):
    rows = binary_rows(t)
    return add_probabilities(forest().fit(rows), rows, ["p0", "p1"]).select("event_id", "p0", "p1")


@query("M12_importance")
def importance(t: Tables):
    model = tiny_boost("label", 3).fit(binary_rows(t))
    splits = importance_table(t.spark, split_importance(model, FEATURE_NAMES)).withColumn("kind", F.lit("splits"))
    return splits.unionByName(importance_table(t.spark, gain_importance(model, FEATURE_NAMES)).withColumn("kind", F.lit("gain")))


@query("P12_project_top_k")
def top_features(t: Tables):
    """Project to the most important features."""
    df = learn_rows(t)
    model = forest().fit(hold(with_features(df, FEATURE_NAMES, ["label"])))
    return df.select("event_id", *ranked_features(split_importance(model, FEATURE_NAMES))[:3])


@query("M13_feature_elimination")
def elimination(t: Tables):
    df = hold_few(stratified_folds(learn_rows(t).withColumn("label", binary_label("label")), "event_id", "label", 2))
    out = eliminate(lambda: RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=4, seed=1), df, FEATURE_NAMES, "label", "fold", ConfusionEvaluator("accuracy"))
    return score_table(t, [(f, r, out.best_size) for f, r in out.ranking.items()], "feature string, ranking int, best_size int")


@query("M14_top_k_sweep")
def sweep(t: Tables):
    df = second_stage_rows(learn_rows(t), "label")
    df = drawn_folds(over_sample(df, "event_id", "label", 326), 2, lambda df: df)
    ranking = split_importance(forest().fit(with_features(df, FEATURE_NAMES, ["label"])), FEATURE_NAMES)
    scores = top_k_sweep(forest, df, ranking, range(1, len(FEATURE_NAMES) + 1), "label", "fold", ConfusionEvaluator("accuracy"))
    return score_table(t, [(k, float(s)) for k, s in scores.items()], "k int, mean_score double")


# ---- cascade and pseudo-labels -------------------------------------------------------------


def two_stage_models(t: Tables, rows: DataFrame) -> Cascade:
    first = with_features(top_up(rows, "event_id", "label", 1126).withColumn("label", binary_label("label")), FEATURE_NAMES, ["label"])
    second = with_features(over_sample(second_stage_rows(rows, "label"), "event_id", "label", 326), FEATURE_NAMES, ["label"])
    return fit_cascade(hold_few(first), hold_few(second), lambda: [tiny_boost("label", s) for s in range(15)], lambda: [forest({"seed": s}) for s in range(29)], 5)


@query("M15_cascade")
def two_stages(t: Tables):
    df = hold_dealt(learn_rows(t))
    both = two_stage_models(t, df)
    return both.score(with_features(df, FEATURE_NAMES, ["event_id", "label"]), "prediction").select("event_id", "label", "prediction")


def partly_labelled(t: Tables) -> tuple[DataFrame, DataFrame]:
    df = learn_rows(t).withColumn("label", F.when(F.col("event_id") % 9 == 4, F.lit(-1)).otherwise(F.col("label")))
    return split_by_label(class_rows_of(df), "label")


def class_rows_of(df: DataFrame) -> DataFrame:
    return hold_few(with_features(df, FEATURE_NAMES, ["event_id", "label"]))


@query("M16_pseudo_label_first")
def pseudo_first(t: Tables):
    labelled, unlabelled = partly_labelled(t)
    known = labelled.withColumn("label", binary_label("label"))
    model = tiny_boost("label", 1).fit(known)
    again, rows = pseudo_label_first(model, lambda: tiny_boost("label", 1), known, unlabelled, "label")
    return tally(add_prediction(again, rows, "prediction"), "label", "prediction")


@query("M17_pseudo_label_second")
def pseudo_second(t: Tables):
    labelled, unlabelled = partly_labelled(t)
    first = forest({"seed": 2}).fit(hold(labelled.withColumn("label", binary_label("label"))))
    second = forest({"seed": 3}).fit(hold(second_stage_rows(labelled, "label")))
    again, rows = pseudo_label_second(first, second, lambda: forest({"seed": 3}), labelled, unlabelled, "label")
    return tally(add_prediction(again, rows, "prediction"), "label", "prediction")


def report_of(t: Tables, rows: DataFrame, classes: int, params: dict, names: list[str], patience: int) -> list[tuple[str, str, float]]:
    """Rounds by early stopping on held-out folds, then fit, in-sample accuracy and importance."""
    best = find_rounds(rows, "fold", "label", classes, params, patience=patience, block=3).best
    model = GradientBoost({**params, "n_estimators": best}, "label", classes).fit(rows)
    accuracy = ConfusionEvaluator("accuracy").evaluate(model.transform(rows))
    report = [("rounds", "", float(best)), ("accuracy", "", accuracy)]
    return report + [("splits", f, float(n)) for f, n in sorted(model.split_counts(names).items())]


@query("M18_fit_report")
def fit_report(t: Tables):
    """Of both stages."""
    first = report_of(t, binary_fold_rows(t, 2), 2, SMALL, FEATURE_NAMES, 50)
    second = report_of(t, fold_rows(t, 2), 5, {**SMALL, "n_estimators": 2}, FEATURE_NAMES, 50)
    return score_table(t, [(2, *r) for r in first] + [(5, *r) for r in second], "classes int, measure string, feature string, value double")


# ---- what must hold for any fit: these have SQL -----------------------------------------------


def broken(df: DataFrame, rule: str) -> DataFrame:
    """How many rows there are, and how many break a rule."""
    return df.agg(F.count("*").alias("n_rows"), F.count(F.expr(f"CASE WHEN NOT ({rule}) THEN 1 END")).alias("n_broken"))


ALL_HOLD = "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken FROM events"


@query("K2_every_row_scored_once", ALL_HOLD)
def scored_once(t: Tables):
    df = stratified_folds(learn_rows(t).withColumn("label", binary_label("label")), "event_id", "label", 3, seed=7)
    rows = hold_few(with_features(df, FEATURE_NAMES, ["event_id", "label", "fold"]))
    parts = [add_prediction(forest().fit(rows.filter(F.col("fold") != i)), rows.filter(F.col("fold") == i), "prediction") for i in range(3)]
    per_row = append_rows(*parts).groupBy("event_id").agg(F.count("*").alias("n"), F.max("prediction").alias("prediction"))
    return broken(per_row, "n = 1 AND prediction IN (0, 1)")


@query("M8_vote_is_majority", ALL_HOLD)
def majority(t: Tables):
    rows = binary_rows(t)
    models = [forest({"seed": s, "depth": 8}).fit(rows) for s in (1, 2, 3)]
    voted = add_votes(models, rows, [0, 1], "vote", keep_members=True)
    return broken(voted, "vote = CASE WHEN vote_m1 + vote_m2 + vote_m3 >= 2 THEN 1 ELSE 0 END")


@query("M11_probabilities_sum_to_one", ALL_HOLD)
def sums(t: Tables):
    rows = class_rows(t)
    names = [f"p{i}" for i in range(6)]
    return broken(add_probabilities(forest().fit(rows), rows, names), f"abs({' + '.join(names)} - 1) < 1e-9")


@query(
    "M2_class_probabilities",
    "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken, 3 AS n_rounds, 0 AS n_rises FROM (SELECT * FROM " + EVENTS_SQL + ") WHERE label > 0",
)
def boosted_probabilities(t: Tables):
    """They sum to one, the predicted class has the largest, and the training loss falls every round."""
    rows = reason_rows(t)
    model = newton({"n_estimators": 3}, 5).fit(rows)
    scored = add_probabilities(model, rows, [f"p{i}" for i in range(5)], "prediction")
    rises = sum(b >= a for a, b in zip(model.losses, model.losses[1:], strict=False))
    rule = "abs(p0 + p1 + p2 + p3 + p4 - 1) < 1e-9 AND greatest(p0, p1, p2, p3, p4) = element_at(array(p0, p1, p2, p3, p4), CAST(prediction AS INT) + 1)"
    return broken(scored, rule).select("n_rows", "n_broken", F.lit(len(model.losses) - 1).alias("n_rounds"), F.lit(rises).alias("n_rises"))


@query("M15_cascade_consistent", ALL_HOLD)
def consistent(t: Tables):
    df = hold_dealt(learn_rows(t))
    rows = with_features(df, FEATURE_NAMES, ["event_id", "label"])
    scored = two_stage_models(t, df).score(rows, "prediction", keep_stages=True)
    return broken(scored, "prediction = CASE WHEN first_stage = 1 THEN second_stage ELSE 0 END AND second_stage BETWEEN 1 AND 5")


@query("M16_pseudo_label_rows", "SELECT COUNT(*) AS n_rows, CAST(COUNT(CASE WHEN event_id % 9 = 4 THEN 1 END) AS BIGINT) AS n_predicted, CAST(0 AS BIGINT) AS n_changed FROM events")
def pseudo_rows_kept(t: Tables):
    """Known labels stay as they are, every unlabelled row gets one."""
    labelled, unlabelled = partly_labelled(t)
    known = labelled.withColumn("label", binary_label("label"))
    model = forest({"seed": 1}).fit(known)
    _, rows = pseudo_label_first(model, lambda: forest({"seed": 1, "trees": 1}), known, unlabelled, "label")
    was = learn_rows(t).select("event_id", binary_label("label").alias("was"))
    both = rows.select("event_id", "label").join(was, "event_id")
    predicted = F.col("event_id") % 9 == 4
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(predicted & F.col("label").isin(0, 1), 1)).alias("n_predicted"),
        F.count(F.when(~predicted & (F.col("label") != F.col("was")), 1)).alias("n_changed"),
    )
