"""Exact deduplication with counting quotient filters.

Each task puts the 64-bit fingerprints of its rows into counting quotient filters, one per
range of fingerprints. The filters of one range merge without loss, because a filter keeps
whole fingerprints: the quotient is the slot's home, the remainder is stored in sorted runs.
Fingerprints counted more than once send their rows to a comparison of the texts' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabcascade.llm.common import shared, small_enough, task_of, text_hash, text_rows

SPACES = b" \t\n\x0b\x0c\r"
RANGE_ROWS = 1 << 20


class CountingQuotientFilter:
    """Counts of fingerprints of ``bits`` bits, quotiented at ``q`` bits.

    ``occupied`` has one bit per quotient and ``runend`` one per slot, as in a quotient filter;
    slots hold the remainders of each run in ascending order, ``counts`` their counters. The
    fingerprints come back exactly, so merging filters is merging sorted remainders.
    """

    def __init__(self, q: int, bits: int, occupied: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.bits = q, bits
        self.occupied, self.runend, self.remainders, self.counts = occupied, runend, remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64, q: int | None = None) -> "CountingQuotientFilter":
        """From fingerprints in any order, with repeats; ``counts`` are their weights."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order].astype(np.uint64)
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order].astype(np.int64)
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        starts = np.flatnonzero(first)
        distinct = prints[starts]
        counts = np.add.reduceat(counts, starts) if len(starts) else counts
        q = max(1, int(len(distinct)).bit_length()) if q is None else q
        quotient = (distinct >> np.uint64(bits - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        runend = np.ones(len(distinct), bool)
        runend[:-1] = quotient[1:] != quotient[:-1]
        remainders = distinct & np.uint64((1 << (bits - q)) - 1)
        return cls(q, bits, np.packbits(occupied), np.packbits(runend), remainders, counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct fingerprints, counts)."""
        n = len(self.remainders)
        homes = np.flatnonzero(np.unpackbits(self.occupied))
        ends = np.unpackbits(self.runend)[:n].astype(np.int64)
        run = np.cumsum(ends) - ends
        return (homes[run].astype(np.uint64) << np.uint64(self.bits - self.q)) | self.remainders, self.counts

    def merge(self, *others: "CountingQuotientFilter") -> "CountingQuotientFilter":
        parts = [f.items() for f in (self, *others)]
        return self.build(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]), self.bits)

    def dump(self) -> bytes:
        head = np.array([self.q, self.bits, len(self.remainders), len(self.occupied), len(self.runend)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.remainders, self.counts, self.occupied, self.runend))

    @classmethod
    def load(cls, raw: bytes) -> "CountingQuotientFilter":
        q, bits, n, o, r = (int(x) for x in np.frombuffer(raw, np.int64, 5))
        at = 40 + 16 * n
        return cls(
            q, bits, np.frombuffer(raw, np.uint8, o, at), np.frombuffer(raw, np.uint8, r, at + o),
            np.frombuffer(raw, np.uint64, n, 40), np.frombuffer(raw, np.int64, n, 40 + 8 * n),
        )


def _digests(batches):
    task_of("exact_dedup")
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        bare = [t.translate(None, SPACES) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(t.decode("utf-8", "replace")) for t in texts], pa.int64()),
                pa.array(np.array([xxhash.xxh64_intdigest(b) for b in bare], np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(b).hexdigest() for b in bare], pa.string()),
                pa.array([text_hash(t) for t in texts], pa.int64()),
            ],
            ["doc_id", "n_chars", "fp", "text_sha256", "row_hash"],
        )


def _filters(width: int):
    """Per task: one filter for each range of fingerprints; ``width`` leading bits name the range."""

    def run(batches):
        seen = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        prints = np.concatenate(seen) if seen else np.empty(0, np.uint64)
        part = prints >> np.uint64(64 - width)
        low = prints & np.uint64((1 << (64 - width)) - 1)
        for p in np.unique(part):
            f = CountingQuotientFilter.build(low[part == p], bits=64 - width)
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([f.dump()], pa.binary())], ["part", "filter"])

    return run


def _repeated(width: int):
    def run(key, table):
        first, *rest = [CountingQuotientFilter.load(x) for x in table.column("filter").to_pylist()]
        prints, counts = (first.merge(*rest) if rest else first).items()
        full = (np.uint64(key[0].as_py()) << np.uint64(64 - width)) | prints[counts > 1]
        return pa.table({"fp": pa.array(full.view(np.int64)), "copies": pa.array(counts[counts > 1])})

    return run


def repeated_fingerprints(prints: DataFrame, rows: int, column: str = "fp") -> DataFrame:
    """(fp, copies) of the fingerprints that occur more than once among ``rows`` rows."""
    width = max(1, (rows // RANGE_ROWS + 1).bit_length())
    filters = prints.select(F.col(column).alias("fp")).mapInArrow(_filters(width), "part int, filter binary")
    return filters.groupBy("part").applyInArrow(_repeated(width), "fp long, copies long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row with the most
    code points stays, then the smallest doc_id (a null id comes last); of rows that repeat that
    id exactly one is kept. Null text is empty; empty texts are one group. An empty table gives
    no rows. ``row_hash`` is the xxhash64 of the whole text. Columns other than the two named are
    not read.
    """
    rows = text_rows(docs, id_col, text_col)
    digests = shared(rows.mapInArrow(_digests, "doc_id long, n_chars long, fp long, text_sha256 string, row_hash long"), "digests")
    repeated = shared(repeated_fingerprints(digests, digests.count()), "repeated")
    suspects = digests.join(small_enough(repeated.select("fp"), repeated.count(), 16), "fp")
    suspects = shared(suspects, "suspects")
    # Byte verification: only texts of suspects travel, and equal ones meet as bytes. Rows without id
    # are told apart by their text's hash, so that they neither meet in one task nor are all drawn in.
    unnamed = F.when(F.col("doc_id").isNull(), F.col("row_hash")).alias("unnamed")
    ids = suspects.select(F.col("doc_id").alias("id"), unnamed).distinct()
    own = F.when(rows["doc_id"].isNull(), F.xxhash64("text"))
    texts = rows.join(small_enough(ids, suspects.count(), 24), rows["doc_id"].eqNullSafe(ids["id"]) & own.eqNullSafe(ids["unnamed"]), "left_semi")
    bare = F.regexp_replace(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+", "")
    named = texts.select("doc_id", F.length(F.col("text").cast("string")).alias("n"), bare.alias("bare"))
    classes = (
        named.groupBy("bare")
        .agg(F.count("*").alias("size"), F.max(F.struct("n", F.bitwise_not("doc_id").alias("inverse"))).alias("best"))
        .where("size > 1")
        .select(F.sha2("bare", 256).alias("text_sha256"), "size", F.bitwise_not("best.inverse").alias("keeper"))
    )
    # Rows that repeat an id are numbered before the join, by id and digest: no large groups.
    same = Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("n_chars"))
    told = digests.withColumn("place", F.row_number().over(same)).join(classes, "text_sha256", "left")
    keeper = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keeper"))
    return told.select(
        "doc_id",
        keeper.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keeper) & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
        "row_hash",
    )
