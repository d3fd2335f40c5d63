"""Majority votes. On a tie the smallest label wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_vote(df: DataFrame, columns: Sequence[str], labels: Sequence[int], out: str, shift: int = 0) -> DataFrame:
    """Vote over prediction columns of one row, for labels without gaps.

    The counts of all labels are kept in one long, a few bits each, so that the
    generated code is one shift per model and one comparison per label. Nested
    comparisons would outgrow what the JVM compiles and run interpreted.
    """
    low, size = min(labels), len(labels)
    if sorted(labels) != list(range(low, low + size)):
        raise ValueError(f"labels have gaps: {sorted(labels)}")
    bits = len(columns).bit_length()
    if bits * size > 63:
        return _with_long_vote(df, columns, low, size, out, shift)
    place = [(F.col(f"`{c}`") - low) * bits for c in columns]
    known = [F.col(f"`{c}`").between(low, low + size - 1) for c in columns]
    one = F.lit(1).cast("bigint")
    marks = [F.when(k, F.call_function("shiftleft", one, p)).otherwise(F.lit(0).cast("bigint")) for k, p in zip(known, place)]
    packed = df.withColumn("_packed", reduce(lambda a, b: a + b, marks))
    # Votes first, then the smaller label: the larger number wins.
    ranks = [
        F.shiftright("_packed", i * bits).bitwiseAND(F.lit(2**bits - 1).cast("bigint")) * size + (size - 1 - i) for i in range(size)
    ]
    best = packed.withColumn("_best", F.greatest(*ranks) if size > 1 else ranks[0])
    label = F.lit(low + size - 1 + shift) - F.col("_best") % size
    return best.withColumn(out, F.when(F.col("_packed") != 0, label).cast("int")).drop("_packed", "_best")


def _with_long_vote(df: DataFrame, columns: Sequence[str], low: int, size: int, out: str, shift: int) -> DataFrame:
    """The same for more models and labels than fit into one long."""
    votes = F.filter(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: v.between(low, low + size - 1))
    counts = F.transform(
        F.array_distinct("_votes"),
        lambda v: F.struct(F.size(F.filter(F.col("_votes"), lambda w: w == v)).alias("n"), (-v).alias("rank")),
    )
    return df.withColumn("_votes", votes).withColumn(out, (F.lit(shift) - F.array_max(counts)["rank"]).cast("int")).drop("_votes")


def vote_rows(votes: DataFrame, key: str, label: str, out: str = "vote", shift: int = 0) -> DataFrame:
    """Vote over (key, label) rows, one per model.

    Equal votes are combined on the map side before either shuffle.
    """
    counted = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    winner = F.min_by(F.col(f"`{label}`"), F.struct(-F.col("n"), F.col(f"`{label}`")))
    return counted.groupBy(key).agg((winner + shift).cast("int").alias(out))
