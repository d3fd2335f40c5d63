"""Similarity join on sets of word shingles by parity sketches.

Each set is folded into a parity sketch: a shingle flips one bit. Two sets whose symmetric
difference has D elements have sketches that differ in at most D bits. Sets of similar size
share a size band; the band fixes D and cuts the sketch into D + 1 + m wide blocks, so
that similar sets agree in at least 1 + m whole blocks. Up to m of a set's emptiest blocks, by a
common rule, need not be joined on. Sets meet in the blocks' values, are compared by a whole
sketch and then verified on the shingles themselves.

Copies are one class. Sets that meet in a block's value are rows of the group of its first class;
they are compared with that class and, unless both are near it, with each other. Large groups are
compared in parts of bounded size. Two like sets meet in many groups, so the groups compare sketches only. What is near by them joins the sets into
components of which no link leaves any, and the shingles travel once for each component. There
the links are verified, again as a spanning forest. Components of the forests are those of all
links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.common import components, mix, shared, shingles, small_enough, task_of, text_hash, text_rows

GROUP_CLASSES = 20_000
SMALL_PART = 64
BLOCK_SHINGLES = 1_500_000
SKETCH_WORDS = 64
#: Bits of a block that is joined on: so many that blocks of few shingles are alike by chance hardly ever.
BLOCK_BITS = 1 << 20
_SEED = 0xA24BAED4963EE407


def max_difference(total: np.ndarray | int, percent: int):
    """Largest symmetric difference of two sets with ``total`` elements together that link."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int, largest: int = 1 << 40) -> list[int]:
    """First size of each band: sets link within a band or with the next one."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return out


def block_counts(starts: list[int], percent: int) -> list[tuple[int, int]]:
    """(blocks, spare blocks m) of each band; (0, 0) where only equal sets link."""
    out = []
    for low, high in zip(starts, starts[1:], strict=False):
        largest = high - 1
        d = max_difference(largest + largest * 100 // percent, percent)
        occupancy = (low + high) / 2 / (d + 1)
        m = 1 + int((d + 1) * min(0.25, 3 * np.exp(-occupancy))) if d else 0
        out.append((d + 1 + m, m) if d else (0, 0))
    return out


class SketchKeys:
    """Join keys of a set: one 64-bit value for each block that is joined on."""

    def __init__(self, percent: int):
        self.starts = bands(percent)
        self.blocks = block_counts(self.starts, percent)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        band = int(np.searchsorted(self.starts, len(items), "right")) - 1
        keys = [self.of_band(items, b) for b in (band, band - 1) if b >= 0 and self.blocks[b][0]]
        return np.concatenate(keys) if keys else np.empty(0, np.uint64)

    def of_band(self, items: np.ndarray, band: int) -> np.ndarray:
        k, spare = self.blocks[band]
        # items are sorted, and so are their blocks
        block = ((items >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        bit = items & np.uint64(BLOCK_BITS - 1)
        filled = np.bincount(block, minlength=k)
        # A block's value is the sum of its set bits' hashes, modulo 2: a bit flipped twice is gone.
        value = np.zeros(k, np.uint64)
        some = np.flatnonzero(filled)
        value[some] = np.bitwise_xor.reduceat(mix(block.astype(np.uint64) * np.uint64(BLOCK_BITS) + bit), (np.cumsum(filled) - filled)[some])
        # The highest level at which at most ``spare`` blocks lie: blocks alike in two sets have
        # the same level, so the set that skips more still shares one block with the other.
        level = np.sort(filled)[spare] - 1
        keep = np.flatnonzero(filled > level)
        return mix(mix(value[keep] + np.uint64(_SEED * (band + 1) & (2**64 - 1))) + keep.astype(np.uint64))


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity sketch of about one bit per shingle, a power of two of 64-bit words."""
    words = 1
    while words < SKETCH_WORDS and 64 * words < len(items):
        words *= 2
    bits = np.bincount((mix(items) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def stacked(sketches: list[np.ndarray]) -> np.ndarray:
    """One row per sketch, all folded to the length of the shortest: halves of a parity sketch add
    up to the sketch of half the length."""
    words = min(map(len, sketches))
    return np.stack([x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words)) for x in sketches])


def _sets(width: int, percent: int):
    """(doc_id, n_shingles, cls, row_hash, sketch, keys); the last two only for the first row of a
    class in a task, else null and empty."""
    emit = SketchKeys(percent)

    def run(batches):
        task_of("jaccard")
        seen: set[int] = set()
        for batch in batches:
            n, cls, rows, sketches, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text, width)
                c = xxhash.xxh64_intdigest(items.tobytes())
                n.append(len(items))
                cls.append(c)
                rows.append(text_hash(text))
                if len(items) and c not in seen:
                    if len(seen) < 200_000:
                        seen.add(c)
                    keys.append(emit(items).view(np.int64))
                    sketches.append(sketch(items).tobytes())
                else:
                    keys.append(np.empty(0, np.int64))
                    sketches.append(None)
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(rows, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "cls", "row_hash", "sketch", "keys"],
            )

    return run


def _class_sets(width: int):
    """(cls, items) of the given documents, each class once in a task."""

    def run(batches):
        task_of("jaccard")
        seen: set[int] = set()
        for batch in batches:
            cls, items = [], []
            for text in batch.column(1).to_pylist():
                raw = shingles(text, width).tobytes()
                c = xxhash.xxh64_intdigest(raw)
                if c not in seen:
                    if len(seen) < 200_000:
                        seen.add(c)
                    cls.append(c)
                    items.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(items, pa.binary())], ["cls", "items"])

    return run


def _near(sketches: np.ndarray, sizes: np.ndarray, percent: int, k: int, others: np.ndarray) -> np.ndarray:
    """Those of the rows ``others`` whose size and sketch allow a link with row ``k``."""
    low, high = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
    others = others[low * 100 >= high * percent]
    differ = np.bitwise_count(sketches[others] ^ sketches[k]).sum(1, dtype=np.int64)
    return others[differ <= max_difference(sizes[others] + sizes[k], percent)]


def _runs(batches, columns: int):
    """Rows of sorted batches, one list per value of the first ``columns`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if row[:columns] != key:
                if rows:
                    yield rows
                key, rows = row[:columns], []
            rows.append(row)
    if rows:
        yield rows


def _forest(sketches: np.ndarray, sizes: np.ndarray, percent: int, linked=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows whose sketches allow a link and that ``linked`` confirms."""
    tree, out = np.arange(len(sizes)), []
    for k in range(len(sizes) - 1):
        if len(out) == len(sizes) - 1:
            break
        # Rows that are in one tree already need not be compared.
        others = k + 1 + np.flatnonzero(tree[k + 1 :] != tree[k])
        for x in _near(sketches, sizes, percent, k, others) if len(others) else ():
            if tree[x] != tree[k] and (linked is None or linked(k, x)):
                tree[tree == tree[x]] = tree[k]
                out.append((k, int(x)))
    return out


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Members:
    """Rows (g, i, j, tag, cls, n, sketch) of whole parts, as flat arrays; sketches are runs of words."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.g, i, j, tag, self.cls, self.n = (np.asarray(table.column(k)) for k in range(6))
        raw = table.column(6).to_pylist()
        self.words = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        self.begin = np.cumsum(self.words) - self.words
        self.bits = np.frombuffer(b"".join(raw), np.uint64)
        new = np.ones(len(self.g), bool)
        new[1:] = (self.g[1:] != self.g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        self.part = np.cumsum(new) - 1
        new[1:] |= tag[1:] != tag[:-1]
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(self.g)))
        self.met = np.cumsum(new) - 1  # rows that met in one block's value

    def near(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether sizes and sketches of the rows ``a`` and ``b`` allow a link, pair by pair."""
        low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        out = low * 100 >= high * percent
        at = np.flatnonzero(out)
        kind = self.words[a[at]] * 1000 + self.words[b[at]]
        for k in np.unique(kind).tolist():
            some = at[kind == k]
            x, y = (self._folded(rows[some], words, min(divmod(k, 1000))) for rows, words in ((a, k // 1000), (b, k % 1000)))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out[some] = differ <= max_difference(self.n[a[some]] + self.n[b[some]], percent)
        return out

    def _folded(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        found = self.bits[self.begin[rows][:, None] + np.arange(words)]
        return found if words == to else np.bitwise_xor.reduce(found.reshape(len(rows), -1, to), axis=1)

    def sketch(self, row: int) -> np.ndarray:
        return self.bits[self.begin[row] : self.begin[row] + self.words[row]]


def _near_in(rows: _Members, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that met and whose sketches allow a link; where many do, enough to connect them.

    Every part holds its group's first class, with which all others are compared at once. Of the
    pairs without it, those of two rows near it need no comparison; the rest is compared among the
    rows that met in the same value, pair by pair where they are few, else by growing trees.
    """
    lead = np.full(int(rows.part[-1]) + 1, -1)
    own = np.flatnonzero(rows.cls == rows.g)
    lead[rows.part[own]] = own
    mine = lead[rows.part]
    others = np.flatnonzero(mine != np.arange(len(mine)))
    close = rows.near(mine[others], others, percent)
    out = [(mine[others[close]], others[close])]
    is_far = np.zeros(len(mine), bool)
    is_far[others[~close]] = True
    far_count = np.bincount(rows.met[is_far], minlength=len(rows.starts))
    few = rows.sizes <= SMALL_PART
    far = np.flatnonzero(is_far & (few & (rows.sizes > 1))[rows.met])
    width = rows.sizes[rows.met[far]]
    for at in np.array_split(np.arange(len(far)), max(1, int(width.sum()) // 1_000_000)):
        # each far row with every other row that met there; two far rows once
        first, n = rows.starts[rows.met[far[at]]], width[at]
        a = np.repeat(far[at], n)
        b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(a))
        keep = (a != b) & (~is_far[b] | (b > a))
        a, b = a[keep], b[keep]
        close = rows.near(a, b, percent)
        out.append((a[close], b[close]))
    for k in np.flatnonzero(~few & (far_count > 0)).tolist():
        start, size = int(rows.starts[k]), int(rows.sizes[k])
        sketches = stacked([rows.sketch(start + x) for x in range(size)])
        found = _forest(sketches, rows.n[start : start + size], percent)
        if found:
            a, b = np.array(found).T
            out.append((start + a, start + b))
    return out


def _near_pairs(percent: int):
    """Pairs of classes of a group whose sketches allow a link, a batch at a time."""

    def pairs(rows: _Members):
        found = _near_in(rows, percent)
        a = rows.cls[np.concatenate([x for x, _ in found])]
        b = rows.cls[np.concatenate([x for _, x in found])]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        task_of("jaccard")
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = [np.asarray(table.column(k))[-1] for k in range(3)]
            same = np.logical_and.reduce([np.asarray(table.column(k)) == v for k, v in enumerate(last)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = table.slice(cut)
            if cut:
                yield pairs(_Members(table.slice(0, cut)))
        if held is not None:
            yield pairs(_Members(held))

    return run


def _links(percent: int):
    """Verified links of a part of a component, as a spanning forest."""

    def run(batches):
        for rows in _runs(batches, 3):
            items = [np.frombuffer(r[4], np.uint64) for r in rows]
            sizes = np.array([len(x) for x in items], np.int64)

            def linked(k, x, items=items, sizes=sizes):
                both = len(np.intersect1d(items[k], items[x], assume_unique=True))
                return 100 * both >= percent * (sizes[k] + sizes[x] - both)

            out = _forest(stacked([sketch(x) for x in items]), sizes, percent, linked)
            if out:
                yield _pairs([(rows[a][3], rows[b][3]) for a, b in out])

    return run


def _in_parts(members: DataFrame, weight, limit: int) -> DataFrame:
    """Rows (g, i, j, cls): each two parts of a group's members meet once.

    ``weight`` sums over a part to about ``limit``; nearly all groups are one part.
    """
    total = members.groupBy("g").agg(F.sum(weight).alias("total")).where(F.col("total") > limit)
    large = shared(total.select("g", F.ceil(F.col("total") / limit).cast("int").alias("parts")), "large")
    dealt = members.join(small_enough(large, large.count(), 16), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    others = F.expr("filter(sequence(0, parts - 1), q -> parts = 1 or q <> p)")
    meet = F.transform(others, lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
    if "tag" in members.columns:
        # the first class is in every part
        every = F.expr("flatten(transform(sequence(0, parts - 1), i -> transform(filter(sequence(i, parts - 1), j -> parts = 1 or j > i), j -> struct(i, j))))")
        meet = F.when(F.col("cls") == F.col("g"), every).otherwise(meet)
    return dealt.withColumn("meet", F.explode(meet)).select("g", "meet.i", "meet.j", *[c for c in members.columns if c in ("tag", "cls")])


def link_classes(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, cls, row_hash; links: a, b between classes, a spanning forest)."""
    rows = text_rows(docs, id_col, text_col)
    sets = shared(rows.mapInArrow(_sets(width, percent), "doc_id long, n_shingles long, cls long, row_hash long, sketch binary, keys array<long>"), "sets")
    keys = sets.select(F.explode("keys").alias("key"), "cls")
    # Each class of a block's value meets the first one; sorted streams, no buffered groups.
    ordered = keys.repartition("key").sortWithinPartitions("key", "cls")
    stars = shared(ordered.mapInArrow(_stars, "g long, cls long, tag int").distinct(), "stars")
    members = stars.unionByName(stars.select("g", F.col("g").alias("cls"), F.lit(-1).alias("tag")).distinct())
    sketches = sets.where("sketch IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    part = ["g", "i", "j"]
    parts = _in_parts(members, F.lit(1), GROUP_CLASSES).join(sketches, "cls").select(*part, "tag", "cls", "n", "sketch")
    near = parts.repartition(*part).sortWithinPartitions(*part, "tag", "cls").mapInArrow(_near_pairs(percent), "a long, b long")
    close = shared(components(near).select(F.col("root").alias("g"), F.col("node").alias("cls")), "close")
    # Only now the shingles themselves, of the classes that may have a partner.
    reps = sets.where("n_shingles > 0").groupBy("cls").agg(F.min("row_hash").alias("row_hash")).join(close.select("cls"), "cls", "left_semi")
    reps = shared(reps.select("row_hash").distinct(), "reps")
    texts = rows.join(small_enough(reps, reps.count(), 16), F.xxhash64("text") == reps["row_hash"], "left_semi")
    class_sets = texts.mapInArrow(_class_sets(width), "cls long, items binary")
    full = _in_parts(close.join(sketches.select("cls", "n"), "cls"), F.col("n"), BLOCK_SHINGLES).join(class_sets, "cls").select(*part, "cls", "items")
    links = full.repartition(*part).sortWithinPartitions(*part, "cls").mapInArrow(_links(percent), "a long, b long")
    return sets.select("doc_id", "n_shingles", "cls", "row_hash"), shared(links.distinct(), "links")


def _stars(batches):
    """From rows sorted by key: (first class of the key, other class, a tag of the key)."""
    key, first = None, None
    for batch in batches:
        keys, cls = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = key is None or keys[0] != key
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        firsts = cls[starts]
        lead = np.where(run >= 0, firsts[np.maximum(run, 0)] if len(firsts) else 0, first if first is not None else 0)
        keep = lead != cls
        if keep.any():
            # the lowest bits of a key are as good as a hash; rows of different keys that share them
            # are compared for nothing
            rows = np.unique(np.stack([lead[keep], cls[keep], keys[keep] & 0x7FFF], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], ["g", "cls", "tag"])
        key, first = int(keys[-1]), int(lead[-1])


def join_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, row_hash), one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct runs of
    ``width`` words, or the whole text's words if there are fewer. Documents link when the
    intersection holds at least ``percent`` in a hundred of the union. component_id is the
    smallest doc_id that links reach (null ids come last). A document without words, or with
    null text, has an empty set and is alone; its component is its own id. An empty table gives
    no rows. ``row_hash`` is the xxhash64 of the whole text. Columns other than the two named are
    not read.
    """
    documents, links = link_classes(docs, width, percent, id_col, text_col)
    roots = components(links)
    # Per class first: what is joined to the documents is one row a class.
    classes = documents.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("members"))
    classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    roots = classes.groupBy("root").agg(F.min("lowest").alias("component_id"), F.sum("members").alias("members")).where("members > 1 AND component_id IS NOT NULL")
    placed = shared(classes.select("cls", "root").join(roots, "root").select("cls", "component_id"), "placed")
    told = documents.join(placed, "cls", "left")
    return told.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row_hash")
