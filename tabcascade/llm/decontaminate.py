"""Benchmark decontamination by edit distance over words.

A random walk turns a sequence into one of three times its length: at each step it writes the
current symbol and a hash of step and symbol says whether to go on. Walks with the same hashes
of sequences at small edit distance differ in few places, so sampled places of the walk are
locality-sensitive keys. Windows of a text as long as an item are keyed by several samples of
several walks; a window that shares a key with the item is verified by exact edit distance.

Only windows that can be near an item are walked. With at most e edits, at least one of e + 1
runs of an item's words stays whole, and of its n - g + 1 runs of g words all but e * g do; a
window with fewer of them is too far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.common import MEMO_WORDS, chunks, grams, hashed, mix, remember, task_of, text_hash, text_rows, words

EDIT_PERCENT = 20
WALKS, TABLES, PLACES = 6, 8, 2
BLOCK_ITEMS = 20_000
MAX_GRAM = 4
CHUNK_BYTES = 4 << 20
_BREAK = np.array([0x5EED_0F_B4EA4], np.uint64)
_STRIP = b".,;:!?\"'()[]{}<>"


class _BareHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int(hashed([word.strip(_STRIP) or word])[0])
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


_bare = _BareHashes()
remember("decontaminate", _bare.clear)


def item_words(text: bytes) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, punctuation at the ends taken off; marks alone stay."""
    parts = words(text)
    return np.fromiter(map(_bare.__getitem__, parts), np.uint64, len(parts))


def allowed_edits(n: int, percent: int = EDIT_PERCENT) -> int:
    return n * percent // 100


def run_length(n: int, edits: int) -> int:
    """Words in a row of an item that some window within ``edits`` keeps."""
    return min(MAX_GRAM, max(1, -(-(n - edits) // (edits + 1))))


def runs_kept(n: int, edits: int, g: int) -> int:
    """Runs of ``g`` words that a window within ``edits`` shares with an item of ``n`` at least."""
    return max(1, n - g + 1 - edits * g)


def walks(rows: np.ndarray, lengths: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The walk of each row of symbols (rows, width): (rows, steps), 0 after the end."""
    out = np.zeros((len(rows), steps), np.uint64)
    at = np.zeros(len(rows), np.int64)
    line = np.arange(len(rows))
    for t in range(steps):
        live = at < lengths
        symbol = np.where(live, rows[line, np.minimum(at, rows.shape[1] - 1)], np.uint64(0))
        out[:, t] = symbol
        salt = np.uint64((walk * 1_000_003 + t * 7_919 + 12_345) & (2**64 - 1))
        at += (mix(symbol ^ mix(np.full(len(rows), salt, np.uint64))) & np.uint64(1)).astype(np.int64) * live
    return out


def walk_steps(n: int) -> int:
    """Steps that are sampled for an item of ``n`` words: the walk takes two a word on average,
    and most have not ended after three quarters of that."""
    return max(PLACES, 3 * n // 2)


def sampled_keys(rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, WALKS * TABLES) keys of windows that are compared with items of ``sizes`` words."""
    out = np.empty((len(rows), WALKS * TABLES), np.uint64)
    steps = walk_steps(int(sizes.max())) if len(sizes) else 0
    kinds = [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
    for w in range(WALKS):
        seen = walks(rows, lengths, w, steps)
        for n, at in kinds:
            rng = np.random.default_rng(1000 * w + n)
            for t in range(TABLES):
                key = np.full(len(at), w + 1, np.uint64)
                for place in rng.choice(walk_steps(n), PLACES, replace=False):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[at, place])
                out[at, w * TABLES + t] = key
    return out


def closest(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, words) of the run of ``part`` with the fewest word edits to the item."""
    edits, end = _align(item, part, np.zeros(len(part) + 1, np.int64))
    _, words = _align(item[::-1], part[:end][::-1], np.arange(end + 1))
    return edits, end - words, words


def _align(item: np.ndarray, part: np.ndarray, row: np.ndarray) -> tuple[int, int]:
    """Fewest edits and the first place where a run of ``part`` ends; ``row`` is the cost of each
    start. Skipped words of ``part`` are a running minimum."""
    place = np.arange(len(part) + 1)
    for i, x in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (part != x))
        row = np.minimum.accumulate(np.r_[i, best] - place) + place
    return int(row.min()), int(row.argmin())


@dataclass
class Items:
    """A block of benchmark items as the tasks use them."""

    ids: list[int]
    codes: list[np.ndarray]
    edits: list[int]
    keys: np.ndarray
    lookup: dict[int, dict[int, list[tuple[int, int]]]]
    marks: dict[int, np.ndarray]
    need: list[int]

    @classmethod
    def build(cls, rows: list[tuple[int, bytes]], percent: int) -> "Items":
        ids, codes, edits = [], [], []
        lookup: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, text in rows:
            c = item_words(text)
            if not len(c):
                continue
            e = allowed_edits(len(c), percent)
            g = run_length(len(c), e)
            for offset, value in enumerate(grams(c, g).tolist()):
                lookup.setdefault(g, {}).setdefault(value, []).append((len(ids), offset))
            ids.append(item)
            codes.append(c)
            edits.append(e)
        marks = {}
        for g, known in lookup.items():
            bits = min(26, max(16, (64 * len(known)).bit_length()))
            flags = np.zeros(1 << bits, bool)
            flags[np.fromiter((v >> (64 - bits) for v in known), np.int64, len(known))] = True
            marks[g] = np.packbits(flags, bitorder="little")  # 8 MB at most
        need = [runs_kept(len(c), e, run_length(len(c), e)) for c, e in zip(codes, edits, strict=True)]
        sizes = np.array([len(c) for c in codes], np.int64)
        keys = np.empty((len(codes), WALKS * TABLES), np.uint64)
        for some in _alike(sizes):
            rows = np.zeros((len(some), int(sizes[some].max())), np.uint64)
            for k, at in enumerate(some.tolist()):
                rows[k, : sizes[at]] = codes[at]
            keys[some] = sampled_keys(rows, sizes[some], sizes[some])
        return cls(ids, codes, edits, keys, lookup, marks, need)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits): the best window of each item found in a text."""
        parts = [item_words(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        # a word that no item has stands between texts, so that no run crosses them
        codes = np.concatenate([x for p in parts for x in (p, _BREAK)]) if parts else _BREAK
        begin = np.cumsum(counts + 1) - counts - 1
        starts: dict[tuple[int, int], list[int]] = {}
        for g, known in self.lookup.items():
            values = grams(codes, g)
            marks = self.marks[g]
            place = values >> np.uint64(64 - (8 * len(marks)).bit_length() + 1)
            hits = np.flatnonzero(marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            docs = np.searchsorted(begin, hits, "right") - 1
            for p, d, value in zip(hits.tolist(), docs.tolist(), values[hits].tolist(), strict=True):
                for item, offset in known.get(value, ()):
                    starts.setdefault((d, item), []).append(p - offset)
        windows: list[tuple[int, int, int]] = []
        for (d, item), near in starts.items():
            low, high, e = int(begin[d]), int(begin[d] + counts[d]), self.edits[item]
            if len(self.codes[item]) > counts[d] + e:
                continue
            dense = self._dense(item, sorted(near))
            windows += [(d, item, s) for s in sorted({max(low, s) for p in dense for s in range(p - e, p + e + 1) if s < high})]
        found = []
        # long items by themselves; the windows of one text and item stay together
        windows.sort(key=lambda w: (len(self.codes[w[1]]), w))
        sizes = np.array([len(self.codes[w[1]]) for w in windows], np.int64)
        for part in _alike(sizes, np.array([w[:2] for w in windows], np.int64).reshape(-1, 2)):
            found += self._verify(codes, begin, counts, [windows[k] for k in part.tolist()])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, edits, start, n in found:
            best[d, item] = min(best.get((d, item), (edits, start, n)), (edits, start, n))
        return [(d, self.ids[item], start, n, edits) for (d, item), (edits, start, n) in sorted(best.items())]

    def _dense(self, item: int, near: list[int]) -> set[int]:
        """The starts with enough shared runs around them: those of one window lie within
        ``edits`` of its start to either side."""
        need, reach = self.need[item], 2 * self.edits[item]
        if need == 1:
            return set(near)
        out: set[int] = set()
        for k in range(len(near) - need + 1):
            if near[k + need - 1] - near[k] <= reach:
                out.update(near[k : k + need])
        return out

    def _verify(self, codes: np.ndarray, begin: np.ndarray, counts: np.ndarray, windows: list[tuple[int, int, int]]):
        """Of (text, item, start), those that share a key with their item and hold it; starts of
        one item that lie together are aligned at once."""
        d, item, start = np.array(windows, np.int64).T
        sizes = np.array([len(self.codes[i]) for i in item.tolist()], np.int64)
        lengths = np.minimum(sizes, begin[d] + counts[d] - start)
        rows = codes[np.minimum(start[:, None] + np.arange(int(sizes.max())), len(codes) - 1)]
        hits = np.flatnonzero((sampled_keys(rows, lengths, sizes) == self.keys[item]).any(1))
        out, k = [], 0
        while k < len(hits):
            first = last = hits[k]
            i, t = int(item[first]), int(d[first])
            n, e = len(self.codes[i]), self.edits[i]
            while k + 1 < len(hits) and item[hits[k + 1]] == i and d[hits[k + 1]] == t and start[hits[k + 1]] - start[last] <= n:
                k += 1
                last = hits[k]
            k += 1
            # the item may begin up to ``e`` words before the first window that shares a key
            low, high = max(int(begin[t]), int(start[first]) - e), min(int(begin[t] + counts[t]), int(start[last]) + n + e)
            edits, at, n_words = closest(self.codes[i], codes[low:high])
            if edits <= e:
                out.append((t, i, edits, low + at - int(begin[t]), n_words))
        return out


def _alike(sizes: np.ndarray, group: np.ndarray | None = None, cells: int = 1 << 22) -> list[np.ndarray]:
    """Rows in order of size, in parts whose matrix has about ``cells`` cells; equal rows of
    ``group`` that lie together are not parted."""
    order = np.argsort(sizes, kind="stable")
    parts, start = [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * int(sizes[order[stop]]) <= cells:
            stop += 1
        while group is not None and stop < len(order) and (group[order[stop]] == group[order[stop - 1]]).all():
            stop += 1
        parts.append(order[start:stop])
        start = stop
    return parts


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int = BLOCK_ITEMS):
    """The items in blocks of bounded size, one after the other."""
    items = text_rows(benchmark, id_col, text_col)
    parts = max(1, -(-items.count() // block))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")) == k).orderBy("doc_id", "text").collect()
        if rows:
            yield [(r.doc_id, bytes(r.text)) for r in rows]


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits, row_hash): where a document holds a benchmark item.

    A document holds an item when some run of its words is at most ``percent`` in a hundred of
    the item's words away from it, in word edits; the best window found is reported, the first of
    equals. Words are lower-cased and freed of punctuation. Null and empty texts hold nothing,
    items without words are never found; an item without id is found under a null id, each such
    row for itself. Repeated rows are searched each for
    itself; ``row_hash`` is the xxhash64 of the text. The search is whole-text; recall is that of
    the sampled keys.
    """
    rows = text_rows(docs, id_col, text_col)
    schema = "doc_id long, item_id long, start_word long, n_words long, edits int, row_hash long"
    found = None
    for block in item_blocks(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(Items.build(block, percent))

        def run(batches, sent=sent):
            task_of("decontaminate")
            items = sent.value
            for batch in batches:
                out: list[tuple] = []
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for part in chunks(list(pairs), lambda r: len(r[1]), CHUNK_BYTES):
                    out += [(part[d][0], *hit, text_hash(part[d][1])) for d, *hit in items.find([t for _, t in part])]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())], ["doc_id", "item_id", "start_word", "n_words", "edits", "row_hash"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found
