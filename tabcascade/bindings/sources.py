"""Round trips through files, and stored models."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcascade.bindings.base import ORDERS_SQL, PREDICTED, Tables, orders, query, scratch
from tabcascade.bindings.learn import FEATURE_NAMES, binary_rows, broken, forest, learn_rows, tiny_boost, two_stage_models
from tabcascade.bindings.planted import planted_rows
from tabcascade.operators.prepare import apply_scaling, fit_min_max, fit_standard
from tabcascade.operators.sampling import over_sample
from tabcascade.plans.boosting import GradientBoost
from tabcascade.plans.ensembles import add_votes, second_stage_rows
from tabcascade.plans.ledger import side_by_side
from tabcascade.plans.models import add_prediction, with_features
from tabcascade.plans.nodes import StoredCascade
from tabcascade.plans.params import all_settings, registry
from tabcascade.session import hold, hold_dealt
from tabcascade.sources import load_models, read_csv, read_labels, save_models, write_clean, write_submission
from tabcascade.sources.models import stored_params, unfitted

CUSTOMER_CSV = [
    "c_custkey",
    "CASE WHEN c_custkey % 5 = 1 THEN 'NA' ELSE CAST(c_acctbal AS STRING) END AS c_acctbal",
    "CASE WHEN c_custkey % 7 = 2 THEN 'None' WHEN c_custkey % 7 = 3 THEN 'null' ELSE c_mktsegment END AS c_mktsegment",
    "c_nationkey AS unused",
]


@query(
    "S1_csv_scan",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 7 = 2 THEN 'None' WHEN c_custkey % 7 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def csv_scan(t: Tables):
    path = scratch(t.spark, "csv")
    t.customer.selectExpr(*CUSTOMER_CSV).write.option("header", True).csv(path)
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_acctbal", T.DoubleType()),
            T.StructField("c_mktsegment", T.StringType()),
            T.StructField("unused", T.IntegerType()),
        ]
    )
    return read_csv(t.spark, path, schema, drop=["unused"])


@query("S3_submission", f"SELECT CAST(event_id AS VARCHAR) AS event_id, {PREDICTED} AS label FROM events")
def submission(t: Tables):
    path = scratch(t.spark, "submission")
    write_submission(t.events.selectExpr("event_id", f"{PREDICTED} AS label", "value"), path, "event_id", "label")
    return read_labels(t.spark, path, "event_id", "label")


@query(
    "S4_variants",
    f"""SELECT o_orderkey, 'std' AS norm, round((price - m) / s, 6) AS price FROM {ORDERS_SQL}, (SELECT AVG(price) AS m, stddev_samp(price) AS s FROM {ORDERS_SQL})
    UNION ALL SELECT o_orderkey, 'minmax', round((price - l) / (h - l), 6) FROM {ORDERS_SQL}, (SELECT MIN(price) AS l, MAX(price) AS h FROM {ORDERS_SQL})""",
)
def variants(t: Tables):
    df, folder = orders(t).select("o_orderkey", "price"), scratch(t.spark, "clean")
    for norm, fit in (("std", fit_standard), ("minmax", fit_min_max)):
        write_clean(apply_scaling(df, fit(df, ["price"])), folder, "train", norm)
    stored = t.spark.read.parquet(f"{folder}/part=train")
    return stored.select("o_orderkey", "norm", F.round("price", 6).alias("price"))


@query("S5_S6_model_round_trip")
def model_round_trip(t: Tables):
    """A numbered family goes to disk and comes back to vote on all rows."""
    rows, folder = binary_rows(t), scratch(t.spark, "models")
    save_models([tiny_boost("label", seed).fit(rows) for seed in (0, 1, 2)], folder)
    return add_votes(load_models(folder, 3), rows, [0, 1], "vote").groupBy("label", "vote").agg(F.count("*").alias("n"))


@query("S6_loaded_equals_stored", "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken FROM events")
def loaded_equals_stored(t: Tables):
    rows, folder = binary_rows(t), scratch(t.spark, "models")
    models = [forest({"seed": s}).fit(rows) for s in (0, 1)]
    save_models(models, folder)
    scored = rows
    for name, model in zip(("a0", "a1", "b0", "b1"), [*models, *load_models(folder, 2)]):
        scored = add_prediction(model, scored, name)
    return broken(scored, "a0 = b0 AND a1 = b1")


@query("S7_rebuild_unfitted")
def rebuild(t: Tables):
    """Parameters are read off a stored model and a new one is fitted with them."""
    rows, folder = binary_rows(t), scratch(t.spark, "models")
    save_models([tiny_boost("label", 7).fit(rows)], folder)
    params = stored_params(load_models(folder, 1)[0])
    again = unfitted(GBTClassifier, params, maxIter=1).fit(rows)
    return add_prediction(again, rows, "prediction").groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("S8_registry_fit")
def registry_fit(t: Tables):
    """The five registered five-class settings, each on its own over-sampled rows, vote on the reasons.

    Rounds, depth, shares, child weight, gain, L1 term, rate and seed are those of the registry.
    """
    df = hold(second_stage_rows(learn_rows(t), "label"))
    rows = with_features(df, FEATURE_NAMES, ["event_id", "label"])

    def fit(setting: dict):
        own = with_features(over_sample(df, "event_id", "label", setting["seed"]), FEATURE_NAMES, ["label"])
        return GradientBoost(setting, "label", 5).fit(own)

    models = side_by_side(t.spark, [lambda p=p: fit(p) for p in registry().values()])
    return add_votes(models, rows, list(range(5)), "vote").groupBy("label", "vote").agg(F.count("*").alias("n"))


@query(
    "S8_settings_split",
    "SELECT family, seed, true AS splits, 0 AS light_leaves, 0 AS weak_splits FROM (VALUES "
    + ", ".join(f"('{family}', {seed})" for family, seed in all_settings())
    + ") AS s(family, seed)",
)
def settings_split(t: Tables):
    """One round of every registered setting: does it split, and do its nodes keep to it.

    A leaf is light if its sum of curvature is below ``min_child_weight``; a split of two leaves
    is weak if it gains less than ``gamma``. Sums are taken from the rows in each leaf.
    """
    rows = planted_rows(t, "two")

    def judge(name: tuple[str, int], setting: dict) -> tuple[str, int, bool, int, int]:
        # all features, so that no seed draws only those that say nothing
        model = GradientBoost({**setting, "n_estimators": 1, "colsample_bytree": 1.0}, "label").fit(rows)
        tree = model.trees[0][0]
        leaves = [n for n in range(len(tree.feature)) if tree.feature[n] < 0]
        light = sum(tree.value[n, 2] < float(setting["min_child_weight"]) - 1e-6 for n in leaves)
        alpha = float(setting.get("reg_alpha", 0.0))

        def worth(n: int) -> float:
            return max(0.0, abs(tree.value[n, 1]) - alpha) ** 2 / (tree.value[n, 2] + 1)

        ends = [n for n in range(len(tree.feature)) if tree.feature[n] >= 0 and {int(tree.left[n]), int(tree.right[n])} <= set(leaves)]
        weak = sum(worth(int(tree.left[n])) + worth(int(tree.right[n])) - worth(n) < setting["gamma"] - 1e-9 for n in ends)
        return (*name, len(leaves) > 1, int(light), int(weak))

    found = side_by_side(t.spark, [lambda n=n, p=p: judge(n, p) for n, p in all_settings().items()], 8)
    return t.spark.createDataFrame(found, "family string, seed int, splits boolean, light_leaves int, weak_splits int")


@query("S6_stored_cascade", "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken, 44 AS n_members FROM events")
def stored_cascade(t: Tables):
    """15 + 29 stored models in one pass over the rows, against the members' own predictions."""
    df = hold_dealt(learn_rows(t))
    rows = with_features(df, FEATURE_NAMES, ["event_id", "label"])
    both, folder = two_stage_models(t, df), scratch(t.spark, "family")
    first, second = save_models(both.first, f"{folder}/first"), save_models(both.second, f"{folder}/second")
    fast = StoredCascade.load(t.spark, first, second, 5)
    scored = both.score_by_members(fast.score(rows, "fast"), "slow")
    return broken(scored, "fast = slow").withColumn("n_members", F.lit(len(fast.first) + len(fast.second)))
