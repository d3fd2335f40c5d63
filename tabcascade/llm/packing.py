"""Packing of tokenized documents into sequences of bounded length.

Only documents longer than a sequence are cut. Pieces are dealt to groups of about
``GROUP_PIECES`` by a hash and each group is packed by itself: best fit in order of falling
length, then a local search between bins that are not full. A group costs at most a fraction of
a bin more than packing everything at once.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.byte_tokens import DIGIT, SPACE, byte_letters, classes, cut_contractions, plain
from tabcascade.llm.common import chunks, remember, shared, task_of, text_rows
from tabcascade.llm.piece_table import PieceTable, padded

MAX_TOKENS = 2048
SEPARATOR = 0
GROUP_PIECES = 20_000
#: Bytes of text that are tokenized at once.
SLICE = 1 << 18
# The normaliser and the way of cutting under which texts are cut into pieces here.
_NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class ChunkTokens:
    """Ids of texts under a tokenizer of the tokenizers library.

    Under the normaliser and cuts named above a plain text (:func:`byte_tokens.plain`) is lower-cased
    and cut into runs of letters, single digits and runs of marks without a step per piece, and
    each distinct piece goes through the merges once. Any other text, and every text under another
    tokenizer, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_chunk = told["normalizer"] == _NORMALISED and told["pre_tokenizer"] == _CUT and told["model"]["type"] == "BPE" and not told["model"]["dropout"]
        self.marks = [t["content"].encode() for t in told["added_tokens"]]
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = PieceTable(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        mapped = piece.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        parts = [self._slice(part) for part in chunks(texts, len, SLICE)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buffer, bounds = padded(texts)
        cut = plain(buffer, bounds) if self.by_chunk else np.zeros(len(texts), bool)
        for mark in self.marks:
            cut &= np.fromiter((mark not in t for t in texts), bool, len(texts))
        if cut.all():
            return self._cut(buffer, bounds)
        ids, counts = self._cut(*padded([t for t, c in zip(texts, cut, strict=True) if c]))
        easy = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        out = [next(easy) if c else self._whole(t) for t, c in zip(texts, cut, strict=True)]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _cut(self, buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = lowered(buffer)
        own = low[: bounds[-1]]
        kind = classes(own)
        first = np.ones(len(own), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        cut_contractions(low, bounds, kind, first)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(own)))
        said = kind[starts] != SPACE
        starts, sizes = starts[said], sizes[said]
        ids, counts = self.pieces.ids(low, starts, sizes)
        before = np.append(0, np.cumsum(counts, dtype=np.int64))
        return ids, np.diff(before[np.searchsorted(starts, bounds)])


def lowered(buffer: np.ndarray) -> np.ndarray:
    """Plain texts in lower case: ASCII and the Latin-1 letters, whose second byte is 0x20 less."""
    out = buffer.copy()
    out[(buffer >= 65) & (buffer <= 90)] += 32
    second = np.zeros(len(buffer), bool)
    second[1:] = (buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E)
    out[second] += 32
    return out


_loaded: dict[str, ChunkTokens] = {}
remember("packing", _loaded.clear)


def loaded(path: str) -> ChunkTokens:
    """The encoder of this worker; only the last one is kept."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = ChunkTokens(path)
    return _loaded[path]


def token_bytes(text: bytes, path: str) -> bytes:
    """Ids of a UTF-8 text as little-endian unsigned 32-bit numbers, without special tokens."""
    return loaded(path).encode([text])[0].astype("<u4").tobytes()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and a separator.

    Null and empty texts are the separator alone. Documents of more than ``max_tokens`` ids are
    cut into pieces of that length, the last may be shorter; repeated rows are cut each for
    itself. Columns other than the two named are not read.
    """
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        task_of("packing")
        for batch in batches:
            out: list[tuple] = []
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for some in chunks(rows, lambda r: len(r[1]), 4 << 20):
                flat, counts = loaded(tokenizer_path).encode([t for _, t in some])
                raw, ends = flat.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                for (doc, _), a, b in zip(some, (ends - 4 * counts).tolist(), ends.tolist(), strict=True):
                    ids = raw[a:b] + end
                    for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                        part = ids[at : at + 4 * max_tokens]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(cols[i], pa.int64()) for i in (2, 3, 4)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return text_rows(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: best fit, longest first."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        room -= n
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moving and exchanging documents between bins that are not full.

    From the least filled bin, a document moves to a bin with room, or is exchanged for one or
    two smaller ones of another bin that then fits. Each step takes from a bin what a fuller or
    equally useful one gains, so the sum of squared fills rises and the search ends. Every bin that
    is not full is tried, until the lower bound is reached.
    """
    size = lengths.astype(int).tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    open_bins = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    alive = len(bins)
    for donor in open_bins:
        if alive <= least:
            break
        if not bins[donor]:
            continue
        targets = [b for b in open_bins if b != donor and bins[b] and fill[b] < capacity and fill[b] >= fill[donor]]
        targets.sort(key=lambda b: -fill[b])
        moved = True
        while bins[donor] and moved:
            moved = False
            for item in sorted(bins[donor], key=lambda i: -size[i]):
                if _step(item, donor, targets, bins, fill, size, capacity):
                    moved = True
                    break
        alive -= not bins[donor]
    return [b for b in bins if b]


def _step(item: int, donor: int, targets: list[int], bins, fill, size, capacity: int) -> bool:
    """One move or exchange that raises the sum of squared fills; False if there is none."""
    n = size[item]
    for b in targets:
        room = capacity - fill[b]
        if room >= n:
            bins[donor].remove(item)
            bins[b].append(item)
            fill[donor] -= n
            fill[b] += n
            return True
    for b in targets:
        room = capacity - fill[b]
        if not room or fill[b] < fill[donor]:
            continue
        # the target gains at most its room: the outgoing documents have at least n - room, less than n
        low = n - room
        parts = sorted(bins[b], key=lambda i: size[i])
        gone = next(([i] for i in parts if low <= size[i] < n), None)
        if gone is None:
            small, large = 0, len(parts) - 1
            while small < large:
                two = size[parts[small]] + size[parts[large]]
                if two < low:
                    small += 1
                elif two >= n:
                    large -= 1
                else:
                    gone = [parts[small], parts[large]]
                    break
        if gone is None:
            continue
        back = sum(size[i] for i in gone)
        bins[donor].remove(item)
        bins[donor].extend(gone)
        bins[b] = [i for i in bins[b] if i not in gone] + [item]
        fill[donor] += back - n
        fill[b] += n - back
        return True
    return False


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces.

    Each piece must be 1 to ``capacity`` long. Sequences are gapless from offset 0. Rows that
    repeat are packed each for itself. An empty table gives no rows.
    """
    pieces = shared(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))

    def run(key, rows):
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = np.asarray(rows.column("length"))
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for b, members in enumerate(bins):
            n = lengths[members]
            sequence[members] = (int(key[0].as_py()) << 32) + b
            offset[members] = np.cumsum(n) - n
        return rows.drop_columns("part").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # the row number spreads pieces without id or with the same one; the table is written, so it holds
    own = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("part", F.pmod(own, F.lit(groups).cast("long")))
    schema = f"{PIECES}, sequence_id long, offset long"
    return dealt.groupBy("part").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents; see :func:`cut_pieces` and :func:`pack`."""
    return pack(cut_pieces(docs, tokenizer_path, max_tokens, with_ids=False, id_col=id_col, text_col=text_col), max_tokens)
