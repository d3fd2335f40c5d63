"""Alignment of two tokenizers over the same texts, in Arrow batches.

Both tokenizers read a space and the text. Where a token of each ends at the same byte, the
texts' tokens are cut into groups, and the two tokens are linked. A batch is flat: token lists
are flattened with the number of their document beside each token, byte ends are cumulative sums
that begin anew with each document, and links are a hash join on (document, end). What a task
found of pairs is summed by ``Table.group_by`` and merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.byte_tokens import loaded
from tabcascade.llm.common import chunks, remember, shared, small_enough, text_rows
from tabcascade.llm.piece_table import PieceTable, padded

#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: Pairs whose counts go to all tasks, 17 bytes each; the counts of rarer pairs are joined.
BROADCAST_PAIRS = 1_000_000
ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class SpacePieces:
    """Ids of texts under a sentencepiece file that puts a space before each text.

    Where the file neither normalises nor has pieces with a space behind another character, runs
    of text from one space to the next are encoded once each; else every text is by itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        probe = "ﬁ  Ａé ²\t　\n x  "
        as_is = self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.space = self.model.piece_to_id("▁")
        self.by_run = as_is and names[self.space] == "▁" and not any("▁" in name.lstrip("▁") for name in names)
        self.entries = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.table = PieceTable(self._run)

    def _run(self, run: bytes) -> bytes:
        # an empty text gets no space of its own, a run of one space is that space
        ids = self.model.encode(run[1:].decode("utf-8", "replace")) if len(run) > 1 else [self.space]
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); texts begin with the space."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if not self.by_run:
            out = self.model.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)
            return np.concatenate([np.array(ids, np.int32) for ids in out]), np.array([len(ids) for ids in out], np.int64)
        buffer, bounds = padded(texts)
        own = buffer[: bounds[-1]]
        start = own == 32
        start[1:] &= own[:-1] != 32
        start[bounds[:-1]] = True
        starts = np.flatnonzero(start)
        ids, counts = self.table.ids(buffer, starts, np.diff(np.append(starts, bounds[-1])))
        before = np.append(0, np.cumsum(counts, dtype=np.int64))
        return ids, np.diff(before[np.searchsorted(starts, bounds)])


class Entries:
    """Bytes of the ids of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def said(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after the other."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + size, size)]


class Aligner:
    """Both tokenizers of a worker, and the decimal strings of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = loaded(byte_path, True), SpacePieces(piece_path)
        self.a_entries, self.b_entries = Entries(self.a.entries()), Entries(self.b.entries)
        self.b_size = len(self.b.entries)
        most = max(len(self.a_entries.sizes), self.b_size)
        # id k followed by "," "|" ";" or nothing is string 4 k, 4 k + 1, ...
        self.strings = pa.array([f"{k}{sign}" for k in range(most) for sign in (",", "|", ";", "")], pa.binary())

    def batch(self, texts: list[bytes]) -> dict[str, list | np.ndarray]:
        """Columns of the aligned texts; ``pairs`` is a table (doc, pair, count) sorted by both."""
        n = len(texts)
        spaced = [b" " + t for t in texts]
        ids_a, count_a = self.a.encode(spaced)
        ids_b, count_b = self.b.encode(spaced)
        fine = np.fromiter(map(bool, texts), bool, n)
        for ids, counts, entries in ((ids_a, count_a, self.a_entries), (ids_b, count_b, self.b_entries)):
            fine &= _same_bytes(ids, counts, entries, spaced)
        ids_a, count_a = ids_a[np.repeat(fine, count_a)], np.where(fine, count_a, 0)
        ids_b, count_b = ids_b[np.repeat(fine, count_b)], np.where(fine, count_b, 0)
        a, b = _ends(ids_a, count_a, self.a_entries, "a"), _ends(ids_b, count_b, self.b_entries, "b")
        links = a.join(b, "end", join_type="inner", use_threads=False).sort_by("a")
        last_a, last_b = np.asarray(links["a"]), np.asarray(links["b"])
        doc = np.repeat(np.arange(n), count_a)[last_a]
        n_groups = np.bincount(doc, minlength=n)
        pair = ids_a[last_a].astype(np.int64) * self.b_size + ids_b[last_b]
        pairs = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
        return {
            "n_a": count_a, "n_b": count_b, "n_groups": n_groups, "n_links": n_groups,
            "groups_sha256": self._digests(ids_a, ids_b, last_a, last_b, n_groups), "pairs": pairs,
        }

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """sha256 of each document's groups: a1,a2|b1;a3|b2,b3."""
        which = np.zeros(len(ids_a) + len(ids_b), np.int64)
        # tokens of the first tokenizer come after the second's tokens of all groups before, and the other way round
        for ids, own, other, shift, sign in ((ids_a, last_a, last_b, 0, 1), (ids_b, last_b, last_a, 1, 2)):
            sizes = np.diff(np.append(-1, own))
            before = np.append(0, other + 1)
            place = np.arange(len(ids)) + np.repeat(before[shift : shift + len(own)], sizes)
            code = 4 * ids.astype(np.int64)
            code[own] += sign
            which[place] = code
            if shift:
                ends = np.cumsum(n_groups)[n_groups > 0] - 1  # no sign behind a document's last group
                which[place[own[ends]]] += 1
        said = self.strings.take(pa.array(which))
        offsets = np.frombuffer(said.buffers()[1], np.int32, len(said) + 1)
        raw = said.buffers()[2].to_pybytes() if len(said) else b""
        groups = np.append(0, np.cumsum(n_groups))
        ends_a, ends_b = np.append(0, last_a + 1)[groups], np.append(0, last_b + 1)[groups]
        cut = offsets[ends_a + ends_b]
        return [hashlib.sha256(raw[i:j]).hexdigest() if j > i else "" for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _same_bytes(ids: np.ndarray, counts: np.ndarray, entries: Entries, texts: list[bytes]) -> np.ndarray:
    """Which documents' tokens have exactly the bytes of their text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.append(0, np.cumsum(entries.sizes[ids]))[np.append(0, np.cumsum(counts))]
    fine = np.diff(ends) == sizes
    said = entries.said(ids)
    if fine.all():
        wrong = np.flatnonzero(said != np.frombuffer(b"".join(texts), np.uint8))
        fine[np.searchsorted(np.cumsum(sizes), wrong, "right")] = False
        return fine
    for k in np.flatnonzero(fine).tolist():
        fine[k] = said[ends[k] : ends[k + 1]].tobytes() == texts[k]
    return fine


def _ends(ids: np.ndarray, counts: np.ndarray, entries: Entries, name: str) -> pa.Table:
    """(end, number of the token): the key says document and byte end within it."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))
    doc = pc.cast(pc.list_parent_indices(lists), pa.int64())
    sizes = pa.array(entries.sizes).take(lists.flatten())
    running = pc.cumulative_sum(sizes)
    before = pc.subtract(running.take(lists.offsets.slice(0, len(lists)).filter(pa.array(counts > 0))), sizes.take(lists.offsets.slice(0, len(lists)).filter(pa.array(counts > 0))))
    base = np.zeros(len(lists), np.int64)
    base[counts > 0] = np.asarray(before)
    end = pc.subtract(running, pa.array(base).take(doc))
    return pa.table({"end": pc.bit_wise_or(pc.shift_left(doc, 32), end), name: pa.array(np.arange(len(ids)))})


_aligners: dict[tuple[str, str], Aligner] = {}
remember("alignment", _aligners.clear)


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _aligners:
        _aligners.clear()
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def aligned_rows(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, with its distinct pairs (first id times the second vocabulary's size, plus second id)."""

    def run(batches):
        both, row = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in chunks(list(zip(ids, batch.column(1).to_pylist(), strict=True)), lambda r: len(r[1]) + 64, SLICE):
                found = both.batch([t for _, t in part])
                pairs = found.pop("pairs")
                offsets = pa.array(np.searchsorted(np.asarray(pairs["doc"]), np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pairs[c].combine_chunks()) for c in ("pair", "count_all")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(part))), pa.array([d for d, _ in part], pa.int64())] + [pa.array(found[c]) for c in list(found)] + lists,
                    ["row", "doc_id", *found, "pairs", "times"],
                )
                row += len(part)

    return text_rows(docs, id_col, text_col).mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): links of each pair; whether none of its second id has more."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            flat = pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten()})
            held.append(flat.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]))
            size += len(held[-1])
            if size > 2_000_000:
                held = [pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])]
                size = len(held[0])
                if size > 1_000_000:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]).to_batches()

    counts = shared(rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair") % b_size
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(small_enough(most, b_size, 16), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, broadcast_pairs: int = BROADCAST_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row a document, counts of id pairs) of the two tokenizers' alignment.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent
    of its second id, ties included), count_sum (sum of the counts of the links' pairs), and
    groups_sha256. Pairs: a_id, b_id, count, best. Null and empty texts, and those whose tokens of
    either side do not have the bytes of space + text, have no tokens: zeros and an empty digest.
    Special tokens' strings inside texts are plain text. Rows with the same id, or null as id,
    are aligned each for itself; columns other than the two named are not read. An empty table
    gives two empty ones.

    Counts of the most frequent pairs, at most ``broadcast_pairs``, go to every task; links of all
    other pairs, each of them rare, are joined with their counts by a shuffle.
    """
    spark = docs.sparkSession
    rows = shared(aligned_rows(docs, byte_path, piece_path, id_col, text_col), "aligned")
    b_size = len(SpacePieces(piece_path).entries)
    counts = shared(pair_counts(rows, b_size), "pairs")
    level = F.floor(F.log2("count")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > broadcast_pairs:
            break
        least, held = k, held + sizes[k]
    often = counts.where(level >= least).select("pair", "count", "best").toArrow()
    order = np.argsort(np.asarray(often["pair"]), kind="stable")
    known = spark.sparkContext.broadcast(tuple(np.asarray(often[c])[order] for c in ("pair", "count", "best")))
    scored = rows.mapInArrow(_score(known), f"{ROWS.split(', pairs')[0]}, n_best long, count_sum long, rest array<struct<pair: long, times: long>>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    pairs = counts.select((F.col("pair") / b_size).cast("long").alias("a_id"), (F.col("pair") % b_size).alias("b_id"), "count", "best")
    if held == sum(sizes.values()):
        return scored.select(columns), pairs
    scored = shared(scored, "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    rest = rest.join(counts.where(level < least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    both = scored.join(rest, "row", "left")
    for name in ("best", "sum"):
        whole = "n_best" if name == "best" else "count_sum"
        both = both.withColumn(whole, F.col(whole) + F.coalesce(F.col(f"more_{name}"), F.lit(0)))
    return both.select(columns), pairs


def _score(known) -> Callable:
    """Sums over each row's pairs whose counts all tasks have; the others stay with the row."""

    def run(batches):
        pairs, counts, best = known.value
        for batch in batches:
            lists, times = batch.column("pairs"), np.asarray(batch.column("times").flatten())
            flat = np.asarray(lists.flatten())
            row = np.asarray(pc.list_parent_indices(lists))
            place = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            found = pairs[place] == flat if len(pairs) else np.zeros(len(flat), bool)
            count, top = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
            count[found], top[found] = counts[place[found]], best[place[found]]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sums = [np.append(0, np.cumsum(x))[bounds] for x in (times * top, times * count, ~found)]
            rest = pa.StructArray.from_arrays([pa.array(flat[~found]), pa.array(times[~found])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), pa.ListArray.from_arrays(pa.array(sums[2].astype(np.int32)), rest)],
                [*batch.schema.names[:-2], "n_best", "count_sum", "rest"],
            )

    return run
