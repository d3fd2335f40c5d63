"""Projection, filter, join and union builders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.session import hold

BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
#: Most hot keys whose lookup rows are broadcast, and items that the sketch follows for each.
HOT_KEYS, TRACKED = 1000, 10
NULL_SPREAD = 1024


# ---- projection and filter -------------------------------------------------


def predictors(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    left_out = set(exclude)
    return [c for c in df.columns if c not in left_out]


def label_last(df: DataFrame, label: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != label], F.col(f"`{label}`"))


def split_by_label(df: DataFrame, label: str, unlabelled: int = -1) -> tuple[DataFrame, DataFrame]:
    """Rows with a known label and rows without one."""
    known = F.col(f"`{label}`") != unlabelled
    return df.filter(known), df.filter(~known)


def routed(df: DataFrame, first_stage: str, positive: int = 1) -> DataFrame:
    """Rows that the first stage sends on to the second."""
    return df.filter(F.col(f"`{first_stage}`") == positive)


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), others, first)


# ---- joins ------------------------------------------------------------------


def assemble(ids: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join entity tables onto the id list, one after the other.

    All joins use the same key, so the id side is shuffled once and keeps its
    partitioning through the chain; tables bucketed by the key need no shuffle.
    """
    return reduce(lambda left, table: left.join(table, key, "left"), tables, ids)


def with_suffix(df: DataFrame, keep: Iterable[str], suffix: str) -> DataFrame:
    """Rename every column but ``keep``, so that a join has no name clash."""
    kept = set(keep)
    return df.select(*[F.col(f"`{c}`").alias(c if c in kept else c + suffix) for c in df.columns])


def measured_bytes(df: DataFrame) -> int:
    """Size of a lookup as text, counted by Spark in one pass."""
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns],
    )
    return df.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"] or 0


@dataclass(frozen=True)
class Lookup:
    """A table with one row per non-NULL key, and its measured size."""

    rows: DataFrame
    key: str
    bytes: int

    def values(self) -> list[str]:
        return [c for c in self.rows.columns if c != self.key]


def measured(lookup: DataFrame, key: str) -> Lookup:
    """The lookup's rows with a key, held and measured; a repeated key is refused."""
    rows = hold(lookup.filter(F.col(f"`{key}`").isNotNull()))
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key}={again[0][0]!r} is {again[0]['n']} times in the lookup: facts would be multiplied")
    return Lookup(rows, key, measured_bytes(rows))


def hot_lookup_keys(df: DataFrame, lookup: Lookup, needed: Column, most: int, limit_bytes: int) -> list:
    """Keys that alone hold more facts than a shuffle task should, most frequent first.

    A mergeable sketch of frequent items reads the facts' key once and shuffles nothing but
    itself. A key is hot if it has more than half of the rows that a task gets in an even shuffle;
    it is left out when the lookup rows of the hot keys before it fill ``limit_bytes``.
    """
    key = F.col(f"`{lookup.key}`")
    if not most:
        return []
    wanting = df.filter(needed & key.isNotNull()).select(key.alias("_key"))
    told = wanting.agg(F.expr(f"approx_top_k(_key, {most}, {most * TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = [r["item"] for r in told["top"] or [] if 2 * r["count"] * tasks > told["rows"]]
    if not hot:
        return []
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in lookup.rows.columns])
    sizes = {r["k"]: r["w"] for r in lookup.rows.filter(key.isin(hot)).select(key.alias("k"), width.alias("w")).collect()}  # ``most`` rows
    kept, total = [], 0
    for k in hot:
        total += sizes.get(k, 0)
        if total > limit_bytes:
            break
        kept.append(k)
    return kept


def enrich(
    df: DataFrame,
    lookup: DataFrame | Lookup,
    key: str,
    needed: Column | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    hot_keys: int = HOT_KEYS,
    hot_bytes: int = BROADCAST_LIMIT_BYTES,
    row_key: str | None = None,
) -> DataFrame:
    """Left-join a lookup with one row per key onto facts of any skew.

    The lookup is measured first, and refused if a key is repeated. Up to ``broadcast_limit`` bytes
    it is broadcast and the facts are not shuffled at all. Beyond that the join is
    shuffled, and rows that would pile up in one task are moved off it:

    * rows with a missing key, or for which ``needed`` is false, cannot match
      and are spread over ``NULL_SPREAD`` salt values;
    * keys that hold more rows than a task should, ``hot_keys`` at most, have their lookup rows, up
      to ``hot_bytes``, broadcast and are spread the same way.

    Rows are spread by the hash of ``row_key``, a column that tells rows apart, so that only it is
    read beside what the query needs; without it all columns are. Every fact row comes out exactly
    once.
    """
    found = lookup if isinstance(lookup, Lookup) else measured(lookup, key)
    names, rows = found.values(), found.rows
    needed = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
    if found.bytes <= broadcast_limit:
        joined = df.withColumn("_probe", F.when(needed, F.col(f"`{key}`"))).join(
            F.broadcast(rows.withColumnRenamed(key, "_probe")), "_probe", "left"
        )
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in names])

    hot = hot_lookup_keys(df, found, needed, hot_keys, hot_bytes)
    is_hot = F.col(f"`{key}`").isin(hot) if hot else F.lit(False)
    # Not the row order decides the salt, so that a retried task repeats it. Without a key that tells
    # rows apart, the task number spreads copies of one row.
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in ([row_key] if row_key else df.columns)]) % NULL_SPREAD
    mixed = mixed if row_key else mixed + F.spark_partition_id()
    rows_hash = F.pmod(mixed, F.lit(NULL_SPREAD)).cast("bigint") + 1
    can_match = needed & F.col(f"`{key}`").isNotNull() & ~is_hot
    salted = df.withColumn("_salt", F.when(can_match, F.lit(0).cast("bigint")).otherwise(rows_hash))
    cold = with_suffix(rows, [key], "_cold").withColumn("_salt", F.lit(0).cast("bigint"))
    joined = salted.join(cold, [key, "_salt"], "left")
    values = {c: F.col(f"`{c}_cold`") for c in names}
    if hot:
        hot_rows = with_suffix(rows.filter(is_hot), [key], "_hot").withColumn("_found", F.lit(True))
        hot_rows = hot_rows.withColumnRenamed(key, "_probe")
        joined = joined.withColumn("_probe", F.when(needed, F.col(f"`{key}`")))
        joined = joined.join(F.broadcast(hot_rows), "_probe", "left")
        values = {c: F.when(F.col("_found"), F.col(f"`{c}_hot`")).otherwise(v) for c, v in values.items()}
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for c, v in values.items()])


def last_value_lookup(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A dictionary from two columns.

    Repeated pairs count once, at their first row; of the pairs that share a
    key the one that starts last wins. Both steps combine on the map side, so a
    hot key costs one row per task.
    """
    known = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{value}`").isNotNull())
    pairs = known.groupBy(key, value).agg(F.min(order).alias("_first"))
    return pairs.groupBy(key).agg(F.max_by(F.col(f"`{value}`"), F.col("_first")).alias(value))


def fill_from_lookup(df: DataFrame, lookup: DataFrame | Lookup, key: str, value: str, **how) -> DataFrame:
    """Fill NULLs of ``value`` from a ``key -> value`` dictionary; nothing else changes."""
    found = lookup if isinstance(lookup, Lookup) else measured(lookup, key)
    found = Lookup(found.rows.withColumnRenamed(value, "_found_value"), key, found.bytes)
    joined = enrich(df, found, key, needed=F.col(f"`{value}`").isNull(), **how)
    return joined.withColumn(value, F.coalesce(F.col(f"`{value}`"), F.col("_found_value"))).drop("_found_value")


def cascade_merge(
    first: DataFrame,
    second: DataFrame,
    key: str,
    label: str,
    positive: int = 1,
    second_label: str | None = None,
) -> DataFrame:
    """Put the second-stage label on the rows that stage one marked, by key."""
    reason = second.select(F.col(f"`{key}`"), F.col(f"`{second_label or label}`").alias("_reason"))
    merged = first.join(reason, key, "left")
    final = F.when(F.col(f"`{label}`") == positive, F.col("_reason")).otherwise(F.col(f"`{label}`"))
    return merged.withColumn(label, final.cast("int")).drop("_reason").select(*first.columns)


def cascade_columns(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """The same with both results on one row: 0 stays 0, 1 takes the second stage."""
    one, two = F.col(f"`{first}`"), F.col(f"`{second}`")
    return df.withColumn(out, F.when(one == 0, one).when(one == 1, two).cast("int"))


def attach_label(df: DataFrame, labels: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Attach a stored label file by key; row positions are never used."""
    return df.join(labels.select(F.col(f"`{key}`"), F.col(f"`{label}`").alias(out)), key, "left")
