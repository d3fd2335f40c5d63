"""Helpers of the text operators: batches, words as 64-bit hashes, shared tables, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcascade.session import ensure_checkpoint_dir

BROADCAST_BYTES = 32 << 20
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(8 << 20)
#: A worker keeps what its operators remember, one after the other, so that each has little.
MEMO_WORDS = 100_000


_memos: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def remember(owner: str, clear: Callable[[], None]) -> None:
    """Say how to empty what an operator's module keeps in a worker between tasks."""
    _memos[owner] = clear


def task_of(owner: str) -> None:
    """Called where a task of an operator starts: workers are used again by other operators, so what
    those keep is emptied first, and memory that nothing holds goes back to the system."""
    if _owner[0] != owner:
        for name, clear in _memos.items():
            if name != owner:
                clear()
        _owner[0] = owner
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the folder that all executors see and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only where the counted rows fit the limit; else leave a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Let the session pass texts to Python in batches of a few megabytes, whatever their rows.

    Only Spark's own default is replaced.
    """
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes); null text is empty, other columns are left behind."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def buckets(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def text_hash(text: bytes) -> int:
    """What Spark's ``xxhash64`` says of the text, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


class WordHashes(dict):
    """Word bytes -> xxh64; the first words seen are remembered, up to a limit."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


_hashes = WordHashes()
remember("words", _hashes.clear)


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at runs of ``[\\x20\\x09-\\x0D]``."""
    return text.lower().split()


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; order counts. Fewer words than ``width``: none."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return out


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle, no words none."""
    codes = hashed(words(text))
    if not len(codes):
        return codes
    return np.unique(grams(codes, min(width, len(codes))))


def chunks(rows: list, weight, limit: int) -> Iterator[list]:
    """Consecutive pieces whose weights sum to about ``limit``."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += weight(row)
        if total >= limit:
            yield part
            part, total = [], 0
    if part:
        yield part


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node that links reach.

    Large-star and small-star steps in turn; each works on edges only, so a node with very
    many links costs rows in proportion to its links. Written to the shared folder between
    rounds.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = shared(edges, "edges")
    before = None
    while True:
        # large star: every larger neighbour of u points at u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = shared(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


