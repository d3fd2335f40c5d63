"""Fits judged by SQL: labels follow a rule of one feature, but for some rows.

A model that learns the rule predicts it on every row, so that SQL knows its predictions, its
misses on held-out folds, and with them every score.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.bindings.base import Tables, query, scratch, sub
from tabcascade.operators.aggregates import best_by_mean
from tabcascade.operators.metrics import ConfusionEvaluator
from tabcascade.operators.relational import append_rows
from tabcascade.operators.sampling import balanced_bag
from tabcascade.plans.boosting import GradientBoost, find_rounds, rounds_by_rate
from tabcascade.plans.ensembles import add_votes, fit_cascade, pseudo_label_second, seeded_bags
from tabcascade.plans.kernel import FourierMap
from tabcascade.plans.ledger import Ledger, side_by_side
from tabcascade.plans.models import (
    add_prediction,
    fit_adaboost,
    fourier_features,
    kernel_svm,
    logistic,
    random_forest,
    ranked_features,
    split_importance,
    with_features,
)
from tabcascade.plans.params import START
from tabcascade.plans.selection import eliminate, top_k_sweep
from tabcascade.plans.tuning import (
    cross_validate,
    fixed,
    grid,
    grid_search,
    nine_steps,
    random_grid,
    refine,
    seven_steps,
    staged_search,
)
from tabcascade.session import hold, hold_dealt, hold_few
from tabcascade.sources import load_models, save_models
from tabcascade.sources.models import stored_params, unfitted

NAMES = ["f1", "f2", "f3", "f4"]
FLAGS = [f"is{k}" for k in range(12)]
NOISE = "event_id % 23 = 0"
#: classes -> (feature of the rule, the rule)
RULES = {
    2: "CAST(CASE WHEN event_id % 10 >= 5 THEN 1 ELSE 0 END AS INT)",
    5: "CAST(floor((event_id % 10) / 2) AS INT)",
    6: "CAST(floor((event_id % 12) / 2) AS INT)",
}
WORDS = {2: "two", 5: "five", 6: "six"}
PLANTED = [
    "event_id",
    "CAST(event_id % 10 AS DOUBLE) AS f1",
    "CAST(CAST(floor(event_id / 10) AS BIGINT) % 7 AS DOUBLE) AS f2",
    "CAST((event_id * 13) % 17 AS DOUBLE) AS f3",
    "CAST(event_id % 12 AS DOUBLE) AS f4",
    "CAST(CAST(floor(event_id / 120) AS BIGINT) % 2 AS INT) AS fold",
    *[f"{rule} AS rule{k}" for k, rule in RULES.items()],
    *[f"CAST(CASE WHEN {NOISE} THEN ({rule} + 1) % {k} ELSE {rule} END AS INT) AS {WORDS[k]}" for k, rule in RULES.items()],
]
SQL = sub("events", PLANTED)


def planted(t: Tables) -> DataFrame:
    return t.events.selectExpr(*PLANTED)


def planted_rows(t: Tables, label: str, names: list[str] = NAMES) -> DataFrame:
    df = planted(t).withColumn("label", F.col(label))
    return hold_few(with_features(df, names, ["event_id", "label", "fold"]))


def flag_rows(t: Tables, label: str, feature: str = "f1") -> DataFrame:
    """One 0/1 column for each value of the rule's feature, for linear models."""
    df = planted(t).withColumn("label", F.col(label)).withColumns({n: (F.col(feature) == k).cast("double") for k, n in enumerate(FLAGS)})
    return hold_few(with_features(df, FLAGS, ["event_id", "label", "fold"]))


def tally(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def tally_sql(classes: int) -> str:
    return f"SELECT {WORDS[classes]} AS label, rule{classes} AS prediction, COUNT(*) AS n FROM {SQL} GROUP BY ALL"


def forest(params=()):
    return random_forest("label", **{"trees": 5, "depth": 4, "featureSubsetStrategy": "all", "seed": 1, **dict(params)})


def boost(params=(), classes: int = 5) -> GradientBoost:
    return GradientBoost({"n_estimators": 2, "max_depth": 3, "learning_rate": 0.3, **dict(params)}, "label", classes)


def curve_sql(classes: int, last: int) -> str:
    return (
        f"SELECT {classes} AS classes, round, fold, COUNT(*) AS n_rows, CAST(sum(CASE WHEN {WORDS[classes]} <> rule{classes} THEN 1 ELSE 0 END) AS BIGINT) AS misses, "
        f"round = 1 AS is_best FROM {SQL}, (SELECT CAST(unnest(range(1, {last + 1})) AS INT) AS round) GROUP BY round, fold"
    )


# ---- rounds, search --------------------------------------------------------------------


@query("K6_rounds_by_error", " UNION ALL ".join(curve_sql(k, 3) for k in RULES))
def rounds_by_error(t: Tables):
    """Misses on held-out folds after each round; the first round is as good as any, two more are tried."""

    def search(classes: int) -> DataFrame:
        params = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3}
        found = find_rounds(planted_rows(t, WORDS[classes]), "fold", "label", classes, params, patience=2, block=3)
        return found.table(t.spark).select(F.lit(classes).alias("classes"), "round", "fold", F.col("rows").alias("n_rows"), "misses", "is_best")

    return append_rows(*side_by_side(t.spark, [lambda k=k: search(k) for k in RULES]))


@query("K9_rounds_by_rate", "SELECT * FROM (VALUES (CAST(0.3 AS DOUBLE), 1, 3), (CAST(0.1 AS DOUBLE), 1, 3)) AS v(learning_rate, rounds, tried)")
def rates(t: Tables):
    found = rounds_by_rate(planted_rows(t, "two"), "fold", "label", 2, {"n_estimators": 6, "max_depth": 1}, [0.3, 0.1], patience=2, block=3)
    return t.spark.createDataFrame([(r, s.best, max(c[0] for c in s.curve)) for r, s in found.items()], "learning_rate double, rounds int, tried int")


def accuracy_sql(classes: int, by: str = "") -> str:
    return f"SELECT {by} round(avg(CASE WHEN {WORDS[classes]} = rule{classes} THEN 1.0 ELSE 0.0 END), 6) AS score FROM {SQL}"


@query(
    "M18_report_of_rule",
    f"""WITH two AS ({accuracy_sql(2)}), five AS ({accuracy_sql(5)}), six AS ({accuracy_sql(6)})
    SELECT 2 AS classes, 'rounds' AS measure, '' AS feature, 1.0 AS value UNION ALL SELECT 2, 'accuracy', '', score FROM two UNION ALL SELECT 2, 'splits', 'f1', 1.0
    UNION ALL SELECT 5, 'rounds', '', 1.0 UNION ALL SELECT 5, 'accuracy', '', score FROM five
    UNION ALL SELECT 6, 'rounds', '', 1.0 UNION ALL SELECT 6, 'accuracy', '', score FROM six""",
)
def report(t: Tables):
    """Rounds, accuracy in sample, and for the one split of two classes its feature."""
    rows = []
    for classes, word in WORDS.items():
        params = {"n_estimators": 3, "max_depth": 1 if classes == 2 else 3, "learning_rate": 0.3}
        df = planted_rows(t, word)
        best = find_rounds(df, "fold", "label", classes, params, patience=1, block=2).best
        model = GradientBoost({**params, "n_estimators": best}, "label", classes).fit(df)
        rows += [(classes, "rounds", "", float(best)), (classes, "accuracy", "", round(ConfusionEvaluator("accuracy").evaluate(model.transform(df)), 6))]
        if classes == 2:
            rows += [(2, "splits", f, float(n)) for f, n in model.split_counts(NAMES).items()]
    return t.spark.createDataFrame(rows, "classes int, measure string, feature string, value double")


@query("K4_scores_of_rule", accuracy_sql(5, "fold,") + " GROUP BY fold")
def cross_validated(t: Tables):
    scores = cross_validate(forest, {}, planted_rows(t, "five"), "fold", ConfusionEvaluator("accuracy"))
    return t.spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(scores)], "fold int, score double")


def judged(t: Tables, found, settings: int) -> DataFrame:
    """The best setting of a search, its score, and whether it is the arg-max of the score table."""
    again = best_by_mean(found.table(t.spark), "setting", "score").first()
    top = abs(again["mean_score"] - found.best_score) < 1e-12
    rows = [(str(sorted(found.best.items())), round(float(found.best_score), 6), bool(top), len(found.points) == settings)]
    return t.spark.createDataFrame(rows, "best string, score double, is_max boolean, all_tried boolean")


def judged_sql(best: str, classes: int = 5, folds: int = 2) -> str:
    quoted = best.replace("'", "''")
    per_fold = accuracy_sql(classes, "fold,") + " GROUP BY fold"
    exact = per_fold.replace("round(avg(", "(avg(").replace(", 6) AS score", ") AS score")
    return f"SELECT '{quoted}' AS best, round(avg(score), 6) AS score, true AS is_max, true AS all_tried FROM ({exact})"


@query("K5_best_of_rule", judged_sql("[('gamma', 0.0), ('max_depth', 3)]"))
def searched(t: Tables):
    """Trees without depth, or a gain that no split has, cannot tell five classes."""
    points = grid({"gamma": [1e9, 0.0], "max_depth": [0, 3]})
    return judged(t, grid_search(boost, {}, points, planted_rows(t, "five"), "fold", ConfusionEvaluator("f1_micro")), 4)


@query("K10_best_of_rule", judged_sql("[('depth', 3), ('trees', 3)]"))
def randomized(t: Tables):
    points = random_grid({"depth": [1, 3], "trees": [3]}, 1000, seed=7)
    return judged(t, grid_search(forest, {}, points, planted_rows(t, "five"), "fold", ConfusionEvaluator("accuracy")), 2)


@query("K11_best_of_rule", judged_sql("[('c', 100.0)]"))
def refined(t: Tables):
    """A penalty that leaves no room for the rule loses."""
    found = refine(
        lambda p, n: logistic("label", n, p["c"], classes=5, max_iter=30), {}, "c", [1e-7, 100.0], flag_rows(t, "five"), "fold",
        ConfusionEvaluator("accuracy"), rounds=1, with_rows=True,
    )
    return judged(t, found[0], 2)


STEPS_SQL = "SELECT CAST(unnest(range(0, {last})) AS INT) AS stage, true AS is_max, true AS kept_best"


def steps_table(t: Tables, history) -> DataFrame:
    """Of each step: is its score the largest of its settings, and does the search go on from the best so far."""
    rows, best = [], None
    for s in history:
        kept = s.accepted == (best is None or s.score >= best)
        best = s.score if best is None else max(best, s.score)
        rows.append((s.number, bool(s.is_max), bool(kept)))
    return t.spark.createDataFrame(rows, "stage int, is_max boolean, kept_best boolean")


@query("K7_staged_tuning", STEPS_SQL.format(last=8))
def staged(t: Tables):
    """All seven steps, 1000 of the reference's rounds counted as one; then once more from the ledger of the first run."""
    folder, rows = scratch(t.spark, "ledger"), planted_rows(t, "two")
    start = {**START, "n_estimators": 1, "seed": 1126}
    runs = [
        staged_search(lambda p: boost(p, 2), start, seven_steps(1000), rows, "fold", ConfusionEvaluator("f1_micro"), ledger=Ledger(t.spark, folder), parallelism=8)
        for _ in range(2)
    ]
    if [s.best for s in runs[0][1]] != [s.best for s in runs[1][1]]:
        raise AssertionError("the ledger changed the outcome")
    return steps_table(t, runs[1][1])


# ---- families --------------------------------------------------------------------------


@query("M1_boosted_rule", tally_sql(2))
def boosted_two(t: Tables):
    rows = planted_rows(t, "two")
    return tally(add_prediction(boost({"gamma": 0.9, "min_child_weight": 5.5}, 2).fit(rows), rows, "prediction"))


@query("M2_boosted_rule", f"SELECT 5 AS classes, * FROM ({tally_sql(5)}) UNION ALL SELECT 6, * FROM ({tally_sql(6)})")
def boosted_classes(t: Tables):
    parts = []
    for k in (5, 6):
        rows = planted_rows(t, WORDS[k])
        parts.append(tally(add_prediction(boost({}, k).fit(rows), rows, "prediction")).select(F.lit(k).alias("classes"), "label", "prediction", "n"))
    return append_rows(*parts)


@query("M3_logistic_rule", tally_sql(6))
def logistic_rule(t: Tables):
    rows = flag_rows(t, "six", "f4")
    return tally(add_prediction(logistic("label", rows.count(), 100.0, classes=6, max_iter=50).fit(rows), rows, "prediction"))


@query("M4_logistic_stages_rule", tally_sql(6))
def logistic_cascade(t: Tables):
    rows = flag_rows(t, "six", "f4")
    first = rows.withColumn("label", (F.col("label") > 0).cast("int"))
    second = rows.where("label > 0").withColumn("label", F.col("label") - 1)
    n = rows.count()
    both = fit_cascade(first, second, lambda: [logistic("label", n, 100.0, max_iter=50)], lambda: [logistic("label", n, 100.0, classes=5, max_iter=50)], 5)
    return tally(both.score(rows, "prediction"))


@query("M5_kernel_rule", tally_sql(2))
def kernel_rule(t: Tables):
    """The kernel features of the rows, five times as wide as the flags, are not kept."""
    shape = dict(width=len(FLAGS), gamma=0.5, size=64, seed=5)
    rows = fourier_features(hold_dealt(flag_rows(t, "two")), **shape)
    return tally(add_prediction(kernel_svm("label", 10.0, rows.count(), max_iter=30, kernel=FourierMap(**shape)).fit(rows), rows, "prediction"))


@query("M6_forest_rule", tally_sql(6))
def forest_rule(t: Tables):
    rows = planted_rows(t, "six")
    return tally(add_prediction(forest().fit(rows), rows, "prediction"))


@query("M7_adaboost_rule", tally_sql(5))
def adaboost_rule(t: Tables):
    rows = planted_rows(t, "five")
    scored = fit_adaboost(rows, "label", classes=5, rounds=2, depth=4).transform(rows)
    return tally(scored.withColumn("prediction", F.col("prediction").cast("int")))


@query("M9_bags_rule", tally_sql(2))
def bags_rule(t: Tables):
    """15 balanced bags, fitted side by side, vote."""
    df = hold_few(planted(t).withColumn("label", F.col("two")))

    def resample(seed: int) -> DataFrame:
        return with_features(balanced_bag(df, "event_id", "label", 300, 300, seed), NAMES, ["label"])

    models = seeded_bags(range(15), resample, lambda seed: forest({"seed": seed, "depth": 1}), 8)
    return tally(add_votes(models, planted_rows(t, "two"), [0, 1], "prediction"))


@query("M10_prediction_rule", f"SELECT event_id, rule5 AS prediction FROM {SQL}")
def predicted_rule(t: Tables):
    rows = planted_rows(t, "five")
    return add_prediction(forest().fit(rows), rows, "prediction").select("event_id", "prediction")


@query("M12_importance_rule", "SELECT 'f1' AS feature, 2 AS splits")
def importance_rule(t: Tables):
    """Two rounds of one split each, read off the stored node tables."""
    model = GBTClassifier(labelCol="label", maxIter=2, maxDepth=1, seed=1).fit(planted_rows(t, "two"))
    return t.spark.createDataFrame(list(split_importance(model, NAMES).items()), "feature string, splits int")


@query("P12_top_feature_rule", f"SELECT event_id, f4 FROM {SQL}")
def top_feature(t: Tables):
    model = forest({"depth": 3}).fit(planted_rows(t, "six"))
    return planted(t).select("event_id", *ranked_features(split_importance(model, NAMES))[:1])


@query("M13_elimination_rule", "SELECT 'f1' AS feature, 1 AS ranking, 1 AS best_size")
def elimination_rule(t: Tables):
    df = hold_few(planted(t).withColumn("label", F.col("two")).select("label", "fold", *NAMES))
    out = eliminate(lambda: forest({"trees": 2, "depth": 1}), df, NAMES, "label", "fold", ConfusionEvaluator("accuracy"))
    return t.spark.createDataFrame([(f, out.ranking[f], out.best_size) for f in out.selected()], "feature string, ranking int, best_size int")


@query("M14_sweep_rule", f"SELECT k, score FROM ({judged_sql('')}), (SELECT CAST(unnest(range(1, 5)) AS INT) AS k)")
def sweep_rule(t: Tables):
    """With the rule's feature first, any number of features scores the same."""
    df = hold_few(planted(t).withColumn("label", F.col("five")).select("label", "fold", *NAMES))
    scores = top_k_sweep(lambda _=(): forest({"trees": 2, "depth": 3}), df, {"f1": 9, "f2": 3, "f3": 2, "f4": 1}, range(1, 5), "label", "fold", ConfusionEvaluator("accuracy"))
    return t.spark.createDataFrame([(k, round(float(s), 6)) for k, s in scores.items()], "k int, score double")


@query(
    "M17_pseudo_second_rule",
    f"""SELECT label, COUNT(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 4 THEN rule6 ELSE six END - 1 AS label FROM {SQL}) WHERE label >= 0 GROUP BY label""",
)
def pseudo_second(t: Tables):
    """Unlabelled rows get the rule's reason if the first stage sends them on."""
    rows = planted_rows(t, "six")
    known, unknown = rows.where("event_id % 9 <> 4"), rows.where("event_id % 9 = 4").withColumn("label", F.lit(-1))
    first = forest().fit(hold(known.withColumn("label", (F.col("label") > 0).cast("int"))))
    second = forest().fit(hold(known.where("label > 0").withColumn("label", F.col("label") - 1)))
    _, got = pseudo_label_second(first, second, lambda: forest({"trees": 1, "depth": 1}), known, unknown, "label")
    return got.groupBy("label").agg(F.count("*").alias("n"))


@query("S7_rebuilt_rule", tally_sql(2))
def rebuilt(t: Tables):
    """A new model with a stored one's parameters, fitted anew."""
    rows, folder = planted_rows(t, "two"), scratch(t.spark, "models")
    save_models([GBTClassifier(labelCol="label", maxIter=1, maxDepth=2, seed=7).fit(rows)], folder)
    again = unfitted(GBTClassifier, stored_params(load_models(folder, 1)[0])).fit(rows)
    return tally(add_prediction(again, rows, "prediction"))


@query("K8_lower_step_refused", "SELECT * FROM (VALUES (0, true), (1, false), (2, true)) AS v(stage, accepted)")
def refused(t: Tables):
    """A step of trees without depth scores lower and is not taken over; the next goes on from before it."""
    steps = [fixed(depth=[0]), fixed(depth=[6, 7])]
    _, history = staged_search(forest, {"depth": 6}, steps, planted_rows(t, "five"), "fold", ConfusionEvaluator("accuracy"))
    return t.spark.createDataFrame([(s.number, s.accepted) for s in history], "stage int, accepted boolean")


@query("K7_nine_steps", STEPS_SQL.format(last=10))
def nine(t: Tables):
    """The nine steps; trees of at most two levels, so that as many fits take a minute or two."""
    start = {**START, "n_estimators": 1, "max_depth": 2, "seed": 326}
    _, history = staged_search(
        lambda p: boost({**p, "max_depth": min(2, p["max_depth"])}, 2), start, nine_steps(1000), planted_rows(t, "two"), "fold", ConfusionEvaluator("f1_micro"),
        ledger=Ledger(t.spark, scratch(t.spark, "ledger")), parallelism=8,
    )
    return steps_table(t, history)
