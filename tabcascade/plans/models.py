"""Model families as ``pyspark.ml`` estimators, and what is read off a fitted model."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcascade.plans.kernel import FourierMap, KernelMachine
from tabcascade.plans.nodes import per_row, stored_split_counts
from tabcascade.plans.params import tree_boost_params, tree_depth
from tabcascade.session import cut_lineage, ensure_checkpoint_dir, use_checkpoint_dir

FEATURES = "features"
TREE_MODELS = (DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel)


def with_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str], name: str = FEATURES) -> DataFrame:
    """Pack columns into a vector; only the kept columns stay next to it."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)
    return assembled.select(*[F.col(f"`{c}`") for c in keep], name)


# ---- families ---------------------------------------------------------------------


def boosted_trees(params: Mapping, label: str, classes: int = 2, features: str = FEATURES) -> Estimator:
    """Spark's boosted trees; more than two classes are fitted one against the rest.

    :class:`boosting.GradientBoost` grows all classes together and knows all settings.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        use_checkpoint_dir(spark)
    one = GBTClassifier(labelCol=label, featuresCol=features, **tree_boost_params(params))
    return one if classes == 2 else OneVsRest(classifier=one, labelCol=label, featuresCol=features)


def logistic(label: str, rows: int, c: float = 1.0, classes: int = 2, weight: str | None = None,
             max_iter: int = 100, features: str = FEATURES) -> LogisticRegression:
    """Ridge-penalised logistic regression; ``c`` counts against the summed loss."""
    model = LogisticRegression(
        labelCol=label, featuresCol=features, maxIter=max_iter, regParam=1.0 / (c * max(1, rows)),
        standardization=False, family="binomial" if classes == 2 else "multinomial",
    )
    return model.setWeightCol(weight) if weight else model


def random_forest(label: str, trees: int = 100, depth: int = 30, seed: int = 0, features: str = FEATURES,
                  **params) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=trees, maxDepth=tree_depth(depth), seed=seed, **params
    )


def fourier_features(df: DataFrame, width: int, gamma: float, size: int, seed: int,
                     source: str = FEATURES, out: str = "mapped") -> DataFrame:
    """The features of :class:`kernel.FourierMap`, whose inner product approximates the RBF kernel exp(-gamma |x - y|^2)."""
    return df.withColumn(out, array_to_vector(per_row(F.col(source), "array<double>", FourierMap(width, gamma, size, seed).of)))


def kernel_svm(label: str, c: float, rows: int, weight: str | None = None, max_iter: int = 50,
               features: str = "mapped", kernel: FourierMap | None = None, source: str = FEATURES) -> OneVsRest | KernelMachine:
    """Large-margin classifier on kernel features, one class against the rest.

    With ``kernel``, that of ``features``, the fit reads ``source`` and makes the kernel features in its passes: for rows
    whose kernel features do not fit in memory.
    """
    if kernel is not None:
        if weight:
            raise ValueError("weights need the column of kernel features alone")
        return KernelMachine(kernel, label, 1.0 / (c * max(1, rows)), max_iter, source, features)
    one = LinearSVC(labelCol=label, featuresCol=features, maxIter=max_iter, regParam=1.0 / (c * max(1, rows)))
    model = OneVsRest(classifier=one, labelCol=label, featuresCol=features)
    if weight:
        one.setWeightCol(weight)
        model.setWeightCol(weight)
    return model


# ---- adaptive boosting ---------------------------------------------------------------


class AdaBoostModel:
    """Weighted vote of small trees."""

    def __init__(self, stages: Sequence[tuple[float, Model]], classes: int):
        self.stages = list(stages)
        self.classes = classes

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        columns = df.columns
        names = []
        for i, (_, tree) in enumerate(self.stages):
            names.append(f"_vote{i}")
            df = add_prediction(tree, df, names[-1])
        sums = [
            sum((F.when(F.col(n) == c, w).otherwise(0.0) for n, (w, _) in zip(names, self.stages)), F.lit(0.0))
            for c in range(self.classes)
        ]
        best = F.greatest(*[F.struct(s.alias("w"), F.lit(-c).alias("c")) for c, s in enumerate(sums)])
        return df.withColumn(out, (-best["c"]).cast("double")).select(*columns, out)


def fit_adaboost(df: DataFrame, label: str, classes: int, rounds: int = 50, depth: int = 1, seed: int = 0,
                 features: str = FEATURES, cut_every: int = 5) -> AdaBoostModel:
    """Multi-class adaptive boosting (Zhu, Zou, Rosset and Hastie, 2009) over weighted trees.

    The row weights live in the data; each round adds one column expression and
    the lineage is cut every few rounds.
    """
    rows = df.select(features, label).withColumn("_w", F.lit(1.0)).persist(StorageLevel.MEMORY_AND_DISK)
    stages = []
    for r in range(rounds):
        tree = DecisionTreeClassifier(labelCol=label, featuresCol=features, weightCol="_w", maxDepth=depth, seed=seed + r).fit(rows)
        scored = add_prediction(tree, rows, "_p")
        missed = F.col("_p") != F.col(label)
        sums = scored.agg(F.sum("_w").alias("all"), F.sum(F.when(missed, F.col("_w")).otherwise(0.0)).alias("bad")).first()
        error = sums["bad"] / sums["all"]
        if error >= 1 - 1 / classes:
            if not stages:
                stages.append((1.0, tree))
            break
        if error <= 0:
            stages.append((1.0, tree))
            break
        weight = math.log((1 - error) / error) + math.log(classes - 1)
        stages.append((weight, tree))
        scale = sums["all"]
        update = F.col("_w") / scale * F.when(missed, F.exp(F.lit(weight))).otherwise(1.0)
        fresh = scored.withColumn("_w", update).drop("_p")
        fresh = cut_lineage(fresh) if (r + 1) % cut_every == 0 else fresh.persist(StorageLevel.MEMORY_AND_DISK)
        fresh.count()
        rows.unpersist()
        rows = fresh
    rows.unpersist()
    return AdaBoostModel(stages, classes)


# ---- prediction ------------------------------------------------------------------------


def add_prediction(model, df: DataFrame, out: str, shift: int = 0) -> DataFrame:
    """One integer prediction column; the model's other output is dropped, that of trees not made."""
    less = {model.rawPredictionCol: "", model.probabilityCol: ""} if isinstance(model, TREE_MODELS) else {}
    scored = model.transform(df, less) if less else model.transform(df)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("prediction") + shift).cast("int").alias(out))


def class_probabilities(scored: DataFrame) -> Column:
    """Array of class probabilities of a scored frame.

    One-vs-rest has margins only. Boosted trees turn a margin m into
    1 / (1 + exp(-2 m)); over the classes these are made to sum to one.
    """
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    odds = F.transform(vector_to_array(F.col("rawPrediction")), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def add_probabilities(model, df: DataFrame, names: Sequence[str], out: str | None = None) -> DataFrame:
    """One column per class probability, and the prediction where ``out`` names it."""
    scored = model.transform(df)
    scored = scored.withColumn("_p", class_probabilities(scored))
    extra = [F.col("_p")[i].alias(n) for i, n in enumerate(names)]
    if out:
        extra.append(F.col("prediction").cast("int").alias(out))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], *extra)


# ---- importance ----------------------------------------------------------------------------


def _members(model) -> list:
    return list(getattr(model, "models", [model]))


def gain_importance(model, names: Sequence[str]) -> dict[str, float]:
    """Mean importance over the class models; unused features are absent."""
    total = np.zeros(len(names))
    members = _members(model)
    for m in members:
        total += m.featureImportances.toArray()
    return {n: float(v) / len(members) for n, v in zip(names, total) if v > 0}


def split_importance(model, names: Sequence[str]) -> dict[str, int]:
    """How many tree nodes split on a feature; unused features are absent.

    Counted by Spark in the node tables that the model's writer puts into the shared folder.
    """
    if hasattr(model, "split_counts"):
        return model.split_counts(names)
    spark = SparkSession.active()
    counts: Counter = Counter()
    for m in _members(model):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"
        m.save(path)
        counts.update(stored_split_counts(spark, path))
    return {names[i]: n for i, n in counts.items()}


def ranked_features(importance: Mapping[str, float]) -> list[str]:
    return sorted(importance, key=lambda n: (-importance[n], n))


def importance_table(spark, importance: Mapping[str, float]) -> DataFrame:
    rows = [(n, float(importance[n]), i + 1) for i, n in enumerate(ranked_features(importance))]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")
