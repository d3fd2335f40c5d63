"""Scores from a confusion table: one aggregation of the predictions, then k x k rows."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(f"`{label}`").alias("label"), F.col(f"`{prediction}`").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    right = F.avg((F.col(f"`{label}`") == F.col(f"`{prediction}`")).cast("double"))
    return df.agg(right.alias("accuracy"))


def error_rate(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return accuracy(df, label, prediction).select((1 - F.col("accuracy")).alias("error"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class that occurs as label or prediction."""
    cell = F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("actual")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("actual")),
    )
    sums = (
        counts.select(F.explode(cell).alias("c")).select("c.*")
        .groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))
    )
    tp = F.col("tp").cast("double")

    def share(of):
        return F.when(of > 0, tp / F.nullif(of, F.lit(0))).otherwise(0.0)

    return sums.select(
        "class",
        share(F.col("predicted")).alias("precision"),
        share(F.col("actual")).alias("recall"),
        F.when(F.col("predicted") + F.col("actual") > 0, 2 * tp / (F.col("predicted") + F.col("actual"))).otherwise(0.0).alias("f1"),
        F.col("actual").alias("support"),
    )


def f1_binary(counts: DataFrame, positive: int = 1) -> DataFrame:
    return class_scores(counts).filter(F.col("class") == positive).select("f1")


def f1_macro(counts: DataFrame) -> DataFrame:
    """Unweighted mean over classes; Spark's own ``f1`` weights by support."""
    return class_scores(counts).agg(F.avg("f1").alias("f1_macro"))


def f1_micro(counts: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.agg((hit / F.sum("n")).alias("f1_micro"))


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve; Spark sorts and sums by range partition."""
    rows = df.select(F.col(f"`{label}`").cast("double").alias("label"), F.col(f"`{score}`").cast("double").alias("score"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(rows)


class ConfusionEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Evaluator for the tuning loops: accuracy, F1 of one class, macro or micro F1.

    Only the k x k counts reach the driver.
    """

    def __init__(self, metric: str = "f1_macro", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        if metric not in ("accuracy", "f1", "f1_macro", "f1_micro"):
            raise ValueError(f"unknown metric {metric}")
        self.metric = metric
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        cells = confusion(dataset, self.getLabelCol(), self.getPredictionCol()).collect()
        return self.score_of({(float(r["label"]), float(r["prediction"])): r["n"] for r in cells})

    def score_of(self, counts: dict[tuple[float, float], int]) -> float:
        """The score from (label, prediction) -> rows."""
        total = sum(counts.values())
        if not total:
            return 0.0
        if self.metric in ("accuracy", "f1_micro"):
            return sum(n for (y, p), n in counts.items() if y == p) / total
        scores = {}
        for c in {y for y, _ in counts} | {p for _, p in counts}:
            seen = sum(n for (y, p), n in counts.items() if y == c) + sum(n for (y, p), n in counts.items() if p == c)
            scores[c] = 2 * counts.get((c, c), 0) / seen
        return scores.get(1.0, 0.0) if self.metric == "f1" else sum(scores.values()) / len(scores)

    def isLargerBetter(self) -> bool:
        return True
