"""Token ids as ORC files: one row a document, in ascending order of document ids.

A document's ids are an integer list, which ORC writes in run-length encoded streams. Files are
cut into stripes and stripes into row groups, each with minimum and maximum of every column and
a Bloom filter on the document id: readers work on stripes side by side, and look at few of
them for one document or for a span of the token stream. Beside the files lies a manifest with
one row a file.

The table is one stream of tokens: file by file (``part``), row by row. Each row knows how many
tokens lie before it in its file (``part_start``), the manifest how many lie before the file, so
that no reader has to read anything in order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabcascade.llm.byte_tokens import loaded
from tabcascade.llm.common import text_rows
from tabcascade.session import ensure_checkpoint_dir

ROWS = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
MANIFEST = "part int, rows long, tokens long, first_doc long, last_doc long, start long"
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    # the writer looks at a stripe's size every so many rows; rows may be long
    "orc.rows.between.memory.checks": "100",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", **options: str) -> None:
    """Tokenize all documents and write them and the manifest under the new folder ``path``.

    Null texts are empty, and empty ones the end id alone. Null ids come first. Rows that share
    an id are ordered by a hash of their text; rows that share both are equal, each is written.
    Other columns are not read. Texts, not ids, are sorted: they are cut into ranges of the id,
    then of the text's hash, so that rows without id or with the same one spread over tasks, and
    no range has more than its share of equal rows. An empty table writes no rows.
    Special tokens' strings inside texts become their ids, as the tokenizer does by itself.
    ``options`` go to the ORC writer, over :data:`ORC`.
    """
    rows = text_rows(docs, id_col, text_col)
    # equal rows differ by their place in the scan alone, which decides nothing but their range
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        tokens = loaded(tokenizer_path, False)
        for batch in batches:
            for small in _by_bytes(batch):
                flat, sizes = tokens.encode(small.column(1).to_pylist())
                ends = np.cumsum(sizes + 1)
                ids = np.insert(flat, ends - np.arange(1, len(ends) + 1), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), part, np.int32)),
                        small.column(0),
                        pa.array(start + ends - sizes - 1),
                        pa.array(sizes + 1),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids, pa.int32())),
                    ],
                    ["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    writer = dealt.mapInArrow(encode, ROWS).write
    for name, value in (ORC | options).items():
        writer = writer.option(name, value)
    writer.orc(f"{path}/rows")
    _write_manifest(docs.sparkSession, path)


def _by_bytes(batch: pa.RecordBatch, limit: int = 8 << 20):
    """Slices of a batch with about ``limit`` bytes of text, one row at least."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _write_manifest(spark: SparkSession, path: str) -> None:
    """One row a file, from the small columns of the files."""
    parts = _rows(spark, path).groupBy("part").agg(
        F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
    )
    # running sum over files, not rows
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.select("*", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{path}/manifest")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(f"{path}/rows")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, rows, tokens, first_doc, last_doc, start) of each file that has rows."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; stripes are read side by side.

    ``start`` counts the tokens of all documents before. The manifest, a row a file, is
    broadcast where Spark's own limit allows it.
    """
    starts = manifest(spark, path).select("part", F.col("start").alias("before"))
    return _rows(spark, path).join(starts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the named documents; null is no name.

    Ranges in the files' footers and row indexes, then Bloom filters, rule out stripes and row
    groups without any of the ids.
    """
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(d) for d in doc_ids]))


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents with tokens from ``start`` up to ``stop``.

    The manifest names the files; the places at which the span ends in the first and last of
    them are filters that the row indexes answer.
    """
    files = manifest(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("tokens") > start))
    ends = files.agg(F.min_by(F.struct("part", "start"), "start"), F.max_by(F.struct("part", "start"), "start")).first()
    if ends[0] is None:
        return read_tokens(spark, path).where("false")
    first, last = ends
    rows = _rows(spark, path).where(F.col("part").between(first["part"], last["part"]))
    rows = rows.where((F.col("part") != last["part"]) | (F.col("part_start") < stop - last["start"]))
    rows = rows.where((F.col("part") != first["part"]) | (F.col("part_start") + F.col("n_tokens") > start - first["start"]))
    starts = files.select("part", F.col("start").alias("before"))
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): lengths and unsigned crc32 of the ids as read.

    crc32 is over the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            flat = np.ascontiguousarray(ids.values, "<i4").tobytes() if batch.num_rows else b""
            at = 4 * np.asarray(ids.offsets, np.int64)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at) // 4), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, name: str = "tokens") -> str:
    """A name for a new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
