"""Placement on shards through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size. Shards take turns;
in its turn a shard claims the first free slot of its permutation, so that all shards own the
same number of slots, give or take one. A key hashes to a slot, the slot names the shard. When
a shard is added or goes, few slots change hands.

The table has ``size`` entries, whatever the data; it is filled where the plan is built and
travels as one small broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
WIDTH = 5


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of its shard in ``shards``.

    Preference number k of a shard is slot ``(offset + k * skip) % size``. The result depends on
    the shards' names and their order only. ``size`` must be a prime of at least ten slots a
    shard, names must differ.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each by its own name")
    if any("," in s for s in shards):
        raise ValueError("a shard's name must not have a comma")
    if not is_prime(size) or size < 10 * len(shards):
        raise ValueError("size must be a prime of at least ten slots for each shard")
    if size >= 10**WIDTH:
        raise ValueError(f"size must be below {10**WIDTH}")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            left -= 1
    return owner


def key_slot(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text; a null key counts as the empty text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digest, 16, 10).cast("long") % F.lit(size)).cast("int")


def place(rows: DataFrame, key_col: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` and ``shard`` to all rows; columns of these names are replaced.

    Equal keys meet on one shard. Null keys are placed like the empty text. Name a unique key to
    spread rows evenly: a key that holds a third of the rows takes them all to its shard.
    """
    listed = F.split(F.lit(",".join(shards[k] for k in fill_table(shards, size))), ",")
    table = rows.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "shard"))
    placed = rows.drop("slot", "shard").withColumn("slot", key_slot(F.col(key_col), size))
    return placed.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def placement_sql(key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> tuple[str, str]:
    """SQL expressions (slot, shard) of a key, for engines with MD5 and hexadecimal casts."""
    owner = fill_table(shards, size)
    digits = "".join(f"{k:0{WIDTH}d}" for k in owner)
    slot = f"CAST(CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15)) AS BIGINT) % {size} AS INTEGER)"
    names = "[" + ", ".join(f"'{s}'" for s in shards) + "]"
    return slot, f"({names})[CAST(substr('{digits}', {slot} * {WIDTH} + 1, {WIDTH}) AS INTEGER) + 1]"
