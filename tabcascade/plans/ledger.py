"""Fits side by side, and a ledger of finished ones that outlives the driver."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import SparkSession

T = TypeVar("T")
SCORES = "key string, score double"


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], parallelism: int = 4) -> list[T]:
    """Run jobs in a few threads, each with its own scheduler pool; results in the jobs' order.

    Under a fair scheduler the pools share the cluster evenly, so that tasks of one fit fill the
    cores that another leaves while it waits for its last ones.
    """
    if not jobs:
        return []

    def run(job: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{threading.get_ident()}")
        return job()

    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(run, jobs, chunksize=1)


def key_of(**parts) -> str:
    """One name for the same fit in every run."""
    said = json.dumps(parts, sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:32]


class Ledger:
    """Keys of finished fits with their score, one small file each, and stored models.

    ``folder`` lies where all executors and the next driver see it. A driver that starts again with
    the same folder repeats only what was not finished. The key must name everything that the
    result depends on; the caller chooses a new folder for other rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # so that there is always something to read
        spark.createDataFrame([], SCORES).write.mode("ignore").parquet(f"{self.folder}/scores/fit=none")

    def scores(self) -> dict[str, float | None]:
        rows = self.spark.read.schema(SCORES).parquet(f"{self.folder}/scores").collect()  # one row a fit
        return {r["key"]: r["score"] for r in rows}

    def add(self, key: str, score: float | None) -> None:
        row = self.spark.createDataFrame([(key, None if score is None else float(score))], SCORES)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/scores/fit={key}")

    def scored(self, jobs: Mapping[str, Callable[[], float]], parallelism: int = 4) -> dict[str, float]:
        """The score of each key; those that the ledger has are not computed again."""
        known = self.scores()

        def finish(key: str, job: Callable[[], float]) -> Callable[[], tuple[str, float]]:
            def run() -> tuple[str, float]:
                score = job()
                self.add(key, score)
                return key, score

            return run

        done = side_by_side(self.spark, [finish(k, j) for k, j in jobs.items() if k not in known], parallelism)
        known |= dict(done)
        return {k: known[k] for k in jobs}

    def models(self, jobs: Mapping[str, Callable[[], Model]], parallelism: int = 4) -> dict[str, PipelineModel]:
        """The stored model of each key; those that are not stored yet are fitted."""
        known = self.scores()

        def finish(key: str, job: Callable[[], Model]) -> Callable[[], None]:
            def run() -> None:
                model = job()
                whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
                whole.write().overwrite().save(self.path(key))
                self.add(key, None)

            return run

        side_by_side(self.spark, [finish(k, j) for k, j in jobs.items() if k not in known], parallelism)
        return dict(zip(jobs, side_by_side(self.spark, [lambda k=k: PipelineModel.load(self.path(k)) for k in jobs], parallelism), strict=True))

    def path(self, key: str) -> str:
        return f"{self.folder}/models/{key}"
