"""Model groups: bags, votes, the two-stage cascade and pseudo-labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcascade.functions import binary_label, shift_label
from tabcascade.operators.voting import with_vote
from tabcascade.plans.ledger import Ledger, key_of, side_by_side
from tabcascade.plans.models import FEATURES, TREE_MODELS, add_prediction
from tabcascade.plans.nodes import READERS, StoredCascade
from tabcascade.session import ensure_checkpoint_dir, few_tasks

#: Rows of fits side by side, whose own copies of the rows are kept in memory at once.
ROWS_AT_ONCE = 16_000_000


def fit_all(estimators: Sequence[Estimator], df: DataFrame, parallelism: int = 4) -> list[Model]:
    """All fits on the same rows, a few side by side; of many rows, which fill the cores, fewer."""
    few = max(1, min(parallelism, ROWS_AT_ONCE // max(1, df.count()))) if len(estimators) > 1 else 1
    return side_by_side(df.sparkSession, [lambda e=e: e.fit(df) for e in estimators], few)


def seeded_bags(
    seeds: Sequence[int],
    resample: Callable[[int], DataFrame],
    build: Callable[[int], Estimator],
    parallelism: int = 4,
    ledger: Ledger | None = None,
    name: str = "bag",
) -> list[Model]:
    """One model per seed, each on its own resampled rows; with a ledger they are stored and resumed."""
    spark = SparkSession.active()

    def fit(seed: int) -> Model:
        rows = resample(seed).persist(StorageLevel.MEMORY_AND_DISK)  # a fit reads them several times
        try:
            return build(seed).fit(few_tasks(rows))
        finally:
            rows.unpersist()

    jobs = {key_of(name=name, seed=seed): (lambda seed=seed: fit(seed)) for seed in seeds}
    if ledger is not None:
        return list(ledger.models(jobs, parallelism).values())
    return side_by_side(spark, list(jobs.values()), parallelism)


def add_votes(models: Sequence, df: DataFrame, labels: Sequence[int], out: str, shift: int = 0,
              keep_members: bool = False) -> DataFrame:
    """Predictions of all models and their majority, in one pass over the rows."""
    names = [f"{out}_m{i + 1}" for i in range(len(models))]
    scored = df
    for name, model in zip(names, models):
        scored = add_prediction(model, scored, name)
    scored = with_vote(scored, names, labels, out, shift)
    return scored if keep_members else scored.drop(*names)


@dataclass
class Cascade:
    """Does it happen, and if so for which reason.

    Either stage may be a single model or a list that votes. Stage two works in
    a label space of its own, one lower.
    """

    first: Sequence
    second: Sequence
    reasons: int

    def score(self, df: DataFrame, out: str, keep_stages: bool = False) -> DataFrame:
        """Both stages are evaluated on the row and merged there.

        Scoring a row twice is cheaper at scale than splitting the rows and
        joining the parts again by key. Trees are scored by their node tables in one pass.
        """
        stored = self.by_nodes(df.sparkSession)
        if stored is None:
            return self.score_by_members(df, out, keep_stages)
        two = stored.stages(df, "_first", "_second", self.first[0].getFeaturesCol(), keep_stages)
        return self._merged(two, out, keep_stages)

    def score_by_members(self, df: DataFrame, out: str, keep_stages: bool = False) -> DataFrame:
        """The same from each member's own ``transform``."""
        one = add_votes(self.first, df, [0, 1], "_first")
        two = add_votes(self.second, one, list(range(self.reasons)), "_second", shift=1)
        return self._merged(two, out, keep_stages)

    def _merged(self, two: DataFrame, out: str, keep_stages: bool) -> DataFrame:
        merged = two.withColumn(out, F.when(F.col("_first") == 1, F.col("_second")).otherwise(F.col("_first")).cast("int"))
        if keep_stages:
            return merged.withColumnsRenamed({"_first": "first_stage", "_second": "second_stage"})
        return merged.drop("_first", "_second")

    def by_nodes(self, spark: SparkSession) -> StoredCascade | None:
        """The node tables of the members, written to the checkpoint folder and read again; None if not all are trees that vote for known labels."""
        members = [*self.first, *self.second]
        if not all(isinstance(m, TREE_MODELS) and not m.isSet("thresholds") for m in members) or not self.first or not self.second:
            return None
        if len({m.getFeaturesCol() for m in members}) > 1 or any(m.numClasses > n for own, n in ((self.first, 2), (self.second, self.reasons)) for m in own):
            return None
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"
        paths = [f"{folder}/{i}" for i in range(len(members))]
        side_by_side(spark, [lambda m=m, p=p: m.save(p) for m, p in zip(members, paths, strict=True)], READERS)
        return StoredCascade.load(spark, paths[: len(self.first)], paths[len(self.first) :], self.reasons)


def first_stage_rows(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, binary_label(label))


def second_stage_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows with a reason, labels moved down to start at 0; only the label changes."""
    return df.filter(F.col(f"`{label}`") > 0).withColumn(label, shift_label(label, -1))


def fit_cascade(
    first: DataFrame,
    second: DataFrame,
    build_first: Callable[[], Sequence[Estimator]],
    build_second: Callable[[], Sequence[Estimator]],
    reasons: int,
) -> Cascade:
    return Cascade(fit_all(build_first(), first), fit_all(build_second(), second), reasons)


# ---- pseudo-labels --------------------------------------------------------------------------


def pseudo_rows(model, unlabelled: DataFrame, label: str, shift: int = 0) -> DataFrame:
    """Unlabelled rows with the model's prediction in the label's place."""
    scored = add_prediction(model, unlabelled.drop(label), label, shift)
    return scored.select(*unlabelled.columns)


def pseudo_label_first(model, build: Callable[[], Estimator], labelled: DataFrame, unlabelled: DataFrame, label: str) -> tuple[Model, DataFrame]:
    """Refit stage one on known and predicted labels."""
    rows = labelled.unionByName(pseudo_rows(model, unlabelled, label))
    return build().fit(rows), rows


def pseudo_label_second(first, second, build: Callable[[], Estimator], labelled: DataFrame, unlabelled: DataFrame, label: str) -> tuple[Model, DataFrame]:
    """Refit stage two with the unlabelled rows that stage one sends on.

    ``labelled`` holds full-space labels; the result is in stage-two labels.
    """
    sent_on = pseudo_rows(first, unlabelled, label).filter(F.col(f"`{label}`") == 1)
    reasons = pseudo_rows(second, sent_on, label, shift=1)
    rows = second_stage_rows(labelled, label).unionByName(reasons.withColumn(label, shift_label(label, -1)))
    return build().fit(rows), rows


__all__ = [
    "FEATURES",
    "Cascade",
    "add_votes",
    "first_stage_rows",
    "fit_all",
    "fit_cascade",
    "pseudo_label_first",
    "pseudo_label_second",
    "pseudo_rows",
    "second_stage_rows",
    "seeded_bags",
]
