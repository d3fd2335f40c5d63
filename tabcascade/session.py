"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime re-planning does the partition sizing: start from many shuffle
# partitions on a cluster, let AQE merge the small and split the skewed ones.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above this size; split such stages
    # into expression-wise code instead of running them interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app: str = "tabcascade",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with adaptive execution on.

    Leave ``master`` and ``shuffle_partitions`` unset on a cluster so that the
    submitted configuration wins.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for name, value in ADAPTIVE.items():
        builder = builder.config(name, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in extra.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without one gets a temporary folder; anywhere else that would put
    the data on a machine that can be lost, so it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if folder:
        if current is None:
            sc.setCheckpointDir(folder)
        return folder
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tabcascade-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage where the session names a folder."""
    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_held: list[DataFrame] = []
#: Tasks of a pass over rows that :func:`hold_few` keeps.
TASKS_A_CORE = 4


def hold(df: DataFrame) -> DataFrame:
    """Keep rows that several jobs read, in memory or on disk.

    Lost blocks are recomputed from the source. :func:`release_held` frees what
    was kept; results stay correct, later jobs just compute it again.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


#: Parts a core of rows that are dealt anew, and rows of a part that are never too many.
PARTS_A_CORE, PART_ROWS = 2, 200_000


def hold_dealt(df: DataFrame) -> DataFrame:
    """As :func:`hold`, the rows dealt anew if a part has more than twice its share.

    A table comes in as few parts as its files have row groups, and every pass over the rows, and over
    what is made from them, would be as slow as the largest part. Small tables stay as they are.
    """
    held = hold(df)
    told = held.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    parts = PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    if not told["all"] or told["most"] <= max(PART_ROWS, 2 * told["all"] // parts):
        return held
    dealt = hold(held.repartition(parts))
    dealt.count()  # so that the rows before can go
    held.unpersist()
    return dealt


def hold_few(df: DataFrame) -> DataFrame:
    """As :func:`hold`, for rows that loops of fits read: in a few tasks a core.

    Every pass of a fit is a small job, and the driver is told of each of its tasks; as many tasks
    as a shuffle has partitions would cost more there than the rows cost the executors. Each task
    also tells the counters of all operators that the kept rows come from, back to their shuffles,
    so the rows go through the checkpoint folder and have no such operators. Rows, their order and
    their parts are those of ``few_tasks(hold(df))``.
    """
    made = hold(df)
    kept = hold(cut_lineage(few_tasks(made)))
    made.unpersist()
    return kept


def few_tasks(held: DataFrame) -> DataFrame:
    """Kept rows, read in ``TASKS_A_CORE`` tasks a core, or in a sixteenth of their partitions."""
    parts = held.rdd.getNumPartitions()
    few = max(TASKS_A_CORE * held.sparkSession.sparkContext.defaultParallelism, parts // 16)
    return held.coalesce(few) if few < parts else held


def release_held() -> None:
    while _held:
        _held.pop().unpersist()
