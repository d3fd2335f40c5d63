"""Phrase collocations with stripes.

A stripe belongs to a prefix of zero to three words and counts the words that follow it. Tasks
build partial stripes, equal stripes are added element by element, and what is left says
everything: an entry is the count of prefix + word, the entries of the empty prefix sum to the
number of words, and the largest entry is the most frequent extension of the prefix.

Stripes are built by the length of their prefix. A phrase cannot be more frequent than the part
without its first or last word, so a stripe of the next length only gets the entries for which
both parts may be frequent. That is asked of a bit table of the frequent phrases, which has no
false negatives; false positives cost rows, not results. Its size is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabcascade.llm.common import grams, mix, shared

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
UNKNOWN_LANG = "und"
#: Bytes of text that a task cuts into words at once.
CHUNK_BYTES = 8 << 20
#: Entries of partial stripes that a task holds.
HELD = 1_000_000
#: Entries a row of a partial stripe.
ROW_ENTRIES = 256
#: A bit table has 16 bits for each frequent phrase, up to 32 MB.
BITS_EACH, MAX_BITS = 16, 1 << 28
#: A stripe is cut into segments by a hash of the next word, one for each SEGMENT_COUNT
#: occurrences of its prefix, up to MAX_SEGMENTS. At most SHARE prefixes of each length are
#: frequent enough for a second segment. The empty prefix has EMPTY_SEGMENTS.
SEGMENT_COUNT, SHARE, MAX_SEGMENTS, EMPTY_SEGMENTS = 200_000, 200_000, 4096, 8192

CODED = "lang string, words binary, ids binary"
#: Words of a stripe are joined by spaces, their counts are little-endian 64-bit numbers.
STRIPES = "lang string, prefix binary, seg int, words binary, counts binary"
_BREAK = b"\xff"  # a byte that no text has
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


class Numbers(dict):
    """Words in the order in which they were met; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.words = [_BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def cut_words(texts: list[bytes]) -> list[bytes]:
    """A-Z lower-cased words of all texts; ``_BREAK`` stands between pieces."""
    return _BREAK.join(texts).lower().translate(_CUT).replace(_BREAK, b" \xff ").split()


def coded_texts(docs: DataFrame) -> DataFrame:
    """Texts (lang, bytes) of a task's chunk and language as numbers of its distinct words.

    The words are joined by spaces, the first is the end of a piece; of each number there are
    four planes of bytes, lowest first, which compress well.
    """

    def coded(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        numbers, words = Numbers(), cut_words(texts)
        ids = np.fromiter(map(numbers.__getitem__, words), "<u4", len(words))
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()
        columns = [pa.array([lang], pa.string()), pa.array([b" ".join(numbers.words)], pa.binary()), pa.array([planes], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "ids"])

    def run(batches):
        by_lang: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    for own, texts in by_lang.items():
                        yield coded(own, texts)
                    by_lang, size = {}, 0
        for own, texts in by_lang.items():
            yield coded(own, texts)

    return docs.mapInArrow(run, CODED)


def _decoded(words: bytes, planes: bytes) -> tuple[list[bytes], np.ndarray]:
    ids = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return words.split(b" "), ids


def _merged(columns: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in the order of the first row, then the next, and their summed counts.

    Columns are packed into one number each as far as it holds them; beyond that their
    distinct beginnings are numbered anew.
    """
    code, span, steps = np.zeros(columns.shape[1], np.int64), 1, []
    for row in columns:
        size = int(row.max(initial=0)) + 1
        if span * size >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            span = len(known)
            steps.append((0, known))
        code, span = code * size + row, span * size
        steps.append((size, None))
    if counts is None:
        code = np.sort(code)
    else:
        order = np.argsort(code, kind="stable")
        code, counts = code[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    sums = np.diff(np.append(starts, len(code))) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts
    code, out = code[starts], []
    for size, known in reversed(steps):
        if known is None:
            code, row = np.divmod(code, size)
            out.append(row.astype(np.int32))
        else:
            code = known[code]
    return np.stack(out[::-1]), sums.astype(np.int64)


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def _phrase_hash(word_hashes: np.ndarray, width: int, lang: str) -> np.ndarray:
    """Hash of each run of ``width`` words of a language."""
    return mix(grams(word_hashes, width) ^ _lang_hash(lang))


class BitTable:
    """A set of 64-bit hashes, two bits each."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.table = np.zeros(bits >> 6, np.uint64)
        self.table[slots] = values

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(bits - 1)
        return hashes & low, (hashes >> np.uint64(32)) & low

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.bits):
            out &= (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Partial:
    """Partial stripes of one task, as sorted runs of word numbers."""

    def __init__(self, width: int, frequent: BitTable | None, hot: tuple[np.ndarray, np.ndarray]):
        self.width, self.frequent = width, frequent
        self.hot, self.segments = hot
        self.start()

    def start(self) -> None:
        self.numbers, self.langs = Numbers(), {}
        self.hashes = np.empty(0, np.uint64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def _word_hashes(self) -> np.ndarray:
        new = self.numbers.words[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes

    def add(self, lang: str, words: list[bytes], local: np.ndarray) -> None:
        """Count the runs of ``width`` words of a chunk."""
        number = self.langs.setdefault(lang, len(self.langs))
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        k = self.width
        if len(local) < k:
            return
        if k == 1:
            counts = np.bincount(local, minlength=len(words))[1:]
            self.parts.append((np.stack([np.full(len(counts), number, np.int32), numbers[1:]]), counts))
        else:
            ids = numbers[local]
            # both parts of one word less must be whole and may have to be frequent
            known = ids != 0
            whole = np.logical_and.reduce([known[j : len(ids) - k + 2 + j] for j in range(k - 1)])
            may = whole & self.frequent.holds(_phrase_hash(self._word_hashes()[ids], k - 1, lang))
            at = np.flatnonzero(may[:-1] & may[1:])
            self.parts.append(_merged(np.stack([np.full(len(at), number, np.int32)] + [ids[at + j] for j in range(k)])))
        self.held += self.parts[-1][0].shape[1]

    def full(self) -> bool:
        if self.held <= HELD and len(self.numbers) <= HELD:
            return False
        self.parts = [_merged(np.concatenate([c for c, _ in self.parts], axis=1), np.concatenate([n for _, n in self.parts]))]
        self.held = self.parts[0][0].shape[1]
        return self.held > HELD // 2 or len(self.numbers) > HELD

    def rows(self):
        """The stripes as record batches; then everything is forgotten."""
        if self.parts:
            columns, counts = _merged(np.concatenate([c for c, _ in self.parts], axis=1), np.concatenate([n for _, n in self.parts]))
            if len(counts):
                yield from self._batches(columns, counts)
        self.start()

    def _batches(self, columns: np.ndarray, counts: np.ndarray):
        langs = list(self.langs)
        hashes, prefix = self._word_hashes(), columns[1:-1]
        seg = (hashes[columns[-1]] >> np.uint64(40)).astype(np.int64)
        if self.width == 1:
            seg %= EMPTY_SEGMENTS
        else:
            code = np.zeros(len(counts), np.uint64)
            for number, lang in enumerate(langs):
                of = columns[0] == number
                code[of] = _hash_columns([hashes[p[of]] for p in prefix], lang)
            place = np.searchsorted(self.hot, code)
            place[place == len(self.hot)] = 0
            cut = self.hot[place] == code if len(self.hot) else np.zeros(len(code), bool)
            seg = np.where(cut, seg % (self.segments[place] if len(self.hot) else 1), 0)
        order = np.lexsort((columns[-1], seg, *prefix[::-1], columns[0]))
        columns, counts, seg = columns[:, order], counts[order], seg[order].astype(np.int32)
        fresh = np.ones(len(counts), bool)
        fresh[1:] = (columns[:-1, 1:] != columns[:-1, :-1]).any(axis=0) | (seg[1:] != seg[:-1])
        starts = np.flatnonzero(fresh)
        place = np.arange(len(counts)) - np.repeat(starts, np.diff(np.append(starts, len(counts))))
        starts = np.flatnonzero(place % ROW_ENTRIES == 0)
        table = pa.array(self.numbers.words, pa.binary())
        for a in range(0, len(starts), 4096):
            own = starts[a : a + 4096]
            stop = starts[a + 4096] if a + 4096 < len(starts) else len(counts)
            offsets = pa.array(np.append(own, stop) - own[0], pa.int32())
            head = [table.take(pa.array(c[own])) for c in columns[1:-1]]
            if not head:
                prefixes = pa.array([b""] * len(own), pa.binary())
            else:
                prefixes = pc.binary_join_element_wise(*head, pa.scalar(b" ", pa.binary())) if len(head) > 1 else head[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[i] for i in columns[0][own]], pa.string()),
                    prefixes,
                    pa.array(seg[own]),
                    pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(pa.array(columns[-1][own[0] : stop]))), b" "),
                    _raw_counts(offsets, counts[own[0] : stop]),
                ],
                ["lang", "prefix", "seg", "words", "counts"],
            )


def _raw_counts(offsets: pa.Array, counts: np.ndarray) -> pa.Array:
    places = np.asarray(offsets) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(counts, "<i8"))])


def _entries(words: pa.Array, counts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(word, count, row) of each entry of stripes."""
    sizes = np.asarray(pc.binary_length(counts), np.int64) // 8
    lists = pc.split_pattern(words.filter(pa.array(sizes > 0)), pattern=" ")
    raw = b"".join(counts.to_pylist())
    return lists.flatten(), pa.array(np.frombuffer(raw, "<i8")), np.repeat(np.arange(len(sizes)), sizes)


def _hash_columns(word_hashes: list[np.ndarray], lang: str) -> np.ndarray:
    """As :func:`_phrase_hash`, of phrases given word by word."""
    width = len(word_hashes)
    flat = np.stack(word_hashes, axis=1).reshape(-1)
    return mix(grams(flat, width)[::width] ^ _lang_hash(lang)) if len(flat) else flat


def partial_stripes(coded: DataFrame, width: int, frequent, hot) -> DataFrame:
    """Partial stripes of the prefixes of ``width`` - 1 words."""

    def run(batches):
        held = Partial(width, frequent.value if frequent is not None else None, hot.value)
        for batch in batches:
            for lang, words, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.add(lang, *_decoded(words, ids))
                if held.full():
                    yield from held.rows()
        yield from held.rows()

    return coded.mapInArrow(run, STRIPES)


def merge_stripes(partial: DataFrame, least: int) -> DataFrame:
    """Equal stripes added element by element: (lang, prefix, seg, words, counts, total, best).

    Entries below ``least`` are left out after adding; ``total`` is the sum of all entries and
    ``best`` the largest. Rows of a stripe meet in sorted order, so a task holds one stripe (or
    segment of a frequent prefix's stripe) beside a batch.
    """
    key = ["lang", "prefix", "seg"]

    def add(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """(first row of each key, (key number, word, count) sorted by key)."""
        table = table.combine_chunks()
        fresh = np.zeros(len(table), bool)
        fresh[0] = True
        for name in key:
            column = table.column(name)
            fresh[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)))
        number = np.cumsum(fresh) - 1
        words, counts, row = _entries(*(table.column(n).combine_chunks() for n in ("words", "counts")))
        flat = pa.table({"key": number[row], "word": words, "count": counts})
        summed = flat.group_by(["key", "word"], use_threads=False).aggregate([("count", "sum")]).rename_columns(["key", "word", "count"])
        return table.select(key).filter(pa.array(fresh)), summed.take(pa.array(np.argsort(np.asarray(summed.column("key")), kind="stable")))

    def as_rows(heads: pa.Table, entries: pa.Table) -> pa.Table:
        offsets = pa.array(np.searchsorted(np.asarray(entries.column("key")), np.arange(len(heads) + 1)), pa.int32())
        words = pc.binary_join(pa.ListArray.from_arrays(offsets, entries.column("word").combine_chunks()), b" ")
        return heads.append_column("words", words).append_column("counts", _raw_counts(offsets, np.asarray(entries.column("count"))))

    def finish(heads: pa.Table, entries: pa.Table):
        numbers, counts = np.asarray(entries.column("key")), np.asarray(entries.column("count"))
        starts = np.searchsorted(numbers, np.arange(len(heads)))
        total, best = np.add.reduceat(counts, starts), np.maximum.reduceat(counts, starts)
        rows = as_rows(heads, entries.filter(pa.array(counts >= least)))
        return rows.append_column("total", pa.array(total)).append_column("best", pa.array(best)).to_batches()

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            heads, entries = add(table if kept is None else pa.concat_tables([kept.cast(table.schema), table]))
            last = len(heads) - 1
            cut = int(np.searchsorted(np.asarray(entries.column("key")), last))
            if last:
                yield from finish(heads.slice(0, last), entries.slice(0, cut))
            tail = entries.slice(cut)
            kept = as_rows(heads.slice(last), tail.set_column(0, "key", pa.array(np.zeros(len(tail), np.int64))))
        if kept is not None:
            yield from finish(*add(kept))

    dealt = partial.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, f"{STRIPES}, total long, best long")


def _phrases(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, count) of the entries of stripes."""


    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words, counts, row = _entries(batch.column("words"), batch.column("counts"))
                prefix = batch.column("prefix").take(pa.array(row))
                phrase = pc.binary_join_element_wise(prefix, words, b" ")
                phrase = pc.if_else(pc.equal(pc.binary_length(prefix), 0), words, phrase)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row)), phrase, counts], ["lang", "phrase", "count"])

    entries = stripes.select("lang", "prefix", "words", "counts").mapInArrow(run, "lang string, phrase binary, count long")
    return entries.withColumn("phrase", F.col("phrase").cast("string"))


def _hashes_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    out = np.empty(batch.num_rows, np.uint64)
    langs = np.array(batch.column(0).to_pylist(), object)
    flat = b" ".join(p.encode() for p in batch.column(1).to_pylist()).split(b" ")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat)).reshape(-1, width)
    for lang in set(langs.tolist()):
        of = langs == lang
        out[of] = _hash_columns(list(hashes[of].T), lang)
    return out


def _bit_table(phrases: DataFrame, rows: int, width: int, max_bits: int) -> BitTable:
    """The bits of all phrases, or-ed in Spark; at most ``max_bits`` of them reach the driver."""
    bits = min(max_bits, 1 << max(10, int(rows * BITS_EACH - 1).bit_length()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                place = np.concatenate(BitTable.places(_hashes_of(batch, width), bits))
                slot, inverse = np.unique(place >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(value, inverse, np.uint64(1) << (place & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(value.view(np.int64))], ["slot", "value"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    return BitTable(bits, np.asarray(found["slot"]), np.asarray(found["value"]).view(np.uint64))


def _hot_prefixes(phrases: DataFrame, words: int, width: int, segment_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, segments) of the phrases whose stripes are cut; at most ``SHARE`` of them."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_hashes_of(batch, width).view(np.int64)), batch.column("count")], ["h", "count"])

    often = phrases.where(F.col("count") >= max(segment_count, words // SHARE + 1))
    found = often.select("lang", "phrase", "count").mapInArrow(run, "h long, count long").toArrow()
    hashes, counts = np.asarray(found["h"]).view(np.uint64), np.asarray(found["count"])
    order = np.argsort(hashes)
    return hashes[order], np.minimum(1 + counts // segment_count, MAX_SEGMENTS)[order]


def stripes(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, max_bits: int = MAX_BITS, segment_count: int = SEGMENT_COUNT, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """([stripes of prefixes of 0, 1, ... words], (lang, n)), in the shared folder.

    Words are runs of ``[^\\x20\\x09]`` between ``[.,;:!?\\x0A-\\x0D]``, A-Z lower-cased. Null texts
    are empty and add nothing; a null language is ``und``. Columns other than the two named are
    not read. An empty table has no stripes. Words of languages without any frequent phrase are
    in their n alone.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    coded = shared(coded_texts(rows), "coded", compression="zstd")
    out: list[DataFrame] = []
    frequent, hot = None, sc.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))
    sums = words = None
    for width in range(1, max_words + 1):
        found = shared(merge_stripes(partial_stripes(coded, width, frequent, hot), least), f"stripes-{width}")
        if width == 1:
            sums = found.groupBy("lang").agg(F.sum("total").alias("n"))
            words = sums.agg(F.sum("n")).first()[0] or 0
        found = found.where(F.length("words") > 0)
        out.append(found)
        phrases = _phrases(found)
        known = phrases.count()
        if not known:
            break
        frequent = sc.broadcast(_bit_table(phrases, known, width, max_bits))
        hot = sc.broadcast(_hot_prefixes(phrases, words, width, segment_count))
    return out, sums


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, subsumed: int = 80, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut (ties: the
    shortest first part), n the language's words, score floor(2,000,000 a / (l + r)). A phrase is
    left out where a longer frequent one around it has at least ``subsumed`` percent of its
    count: as counts fall with length, it is enough to look one word to the right (the maximum of
    its stripe) and one to the left. Order: score and a falling, phrase by its bytes. See
    :func:`stripes` for nulls, empty texts and options.
    """
    found, sums = stripes(docs, least, **options)
    known = [_phrases(s).withColumn("m", F.lit(k)) for k, s in enumerate(found, 1)]
    counts = shared(_union(known), "phrases")
    right = [s.groupBy("lang", "prefix").agg(F.max("best").alias("most")).select("lang", F.col("prefix").cast("string").alias("phrase"), "most") for s in found[2:]]
    left = counts.where("m > 2").groupBy("lang", F.expr("substring_index(phrase, ' ', 1 - m)").alias("phrase")).agg(F.max("count").alias("most"))
    around = _union([*right, left]).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    big = "decimal(30,0)"
    candidates = counts.where("m > 1").join(around, ["lang", "phrase"], "left")
    candidates = candidates.where(F.col("most").isNull() | (F.col("most").cast(big) * 100 < F.col("count").cast(big) * subsumed))
    cuts = candidates.select("lang", "phrase", F.col("count").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - m)"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a AS {big}) * 2000000) div (cast(l AS {big}) + cast(r AS {big}))").cast("long")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first rows of each of many slices, then of them
    slices = scored.withColumn("slice", F.xxhash64("phrase") % 64)
    near = slices.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
