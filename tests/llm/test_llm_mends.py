"""Lengths, edits, nulls and sizes at which earlier forms lost rows or grew."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabcascade.llm import decontaminate, exact_dedup, jaccard, markov_secrets, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, part int")


# ---- secrets ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def markov(spark, data):
    return markov_secrets.train(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.mark.parametrize("length", [12, 13, 14, 16, 19, 24, 40])
def test_random_strings_of_any_length_are_found(spark, markov, length):
    rng = random.Random(length)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=length)) for _ in range(400)]
    found = markov_secrets.scan(docs(spark, [(k, f"see {key} here") for k, key in enumerate(keys)]), markov).collect()
    assert sum(bool(r.spans) for r in found) >= 0.95 * 400
    assert all((s["start"], s["end"]) == (4, 4 + length) for r in found for s in r.spans)


def test_ordinary_runs_are_left_alone(spark, data, markov):
    words = [w for r in spark.read.parquet(f"{data}/documents.parquet").collect() for w in r.text.split() if w.isascii() and w.isalpha() and len(w) >= 12]
    assert len(words) > 300
    assert sum(markov.is_secret(w.encode()) for w in words) <= 0.002 * len(words)


# ---- benchmark items -------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["insert", "insert_front", "delete", "replace"])
@pytest.mark.parametrize("n", [15, 40, 59])
def test_items_with_the_most_edits(spark, kind, n):
    rng = random.Random(n)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(60)]
    rows = []
    for k, item in enumerate(items):
        text, e = list(item), n // 5
        places = sorted(rng.sample(range(n), e), reverse=True) if kind != "insert_front" else sorted(rng.choices(range(1, n // 3), k=e), reverse=True)
        for p in places:
            text[p : p + 1] = {"delete": [], "replace": [f"r{rng.randrange(10**6)}"]}.get(kind, [f"i{rng.randrange(10**6)}", text[p]])
        pad = [f"p{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((k, " ".join(pad + text + pad)))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = decontaminate.matches(docs(spark, rows), bench).collect()
    assert sum((r.doc_id, r.item_id) == (k, k) for k in range(60) for r in got if r.doc_id == k) >= 0.99 * 60 - 1
    for r in got:
        assert r.edits <= n // 5 and brute_edits(items[r.item_id], rows[r.doc_id][1].split()[r.start_word : r.start_word + r.n_words]) == r.edits


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_items_without_id_and_of_any_length(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(2500))
    bench = spark.createDataFrame([(None, "one two three four five six"), (7, long), (8, "short item of few words"), (None, None)], "item_id long, text string")
    rows = [(1, f"x {long} y"), (2, "a one two three four five six b"), (3, "a short item of few words"), (None, "short item of few words")]
    got = {(r.doc_id, r.item_id, r.start_word, r.edits) for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert got == {(1, 7, 1, 0), (2, None, 1, 0), (3, 8, 1, 0), (None, 8, 0, 0)}


def test_one_long_item_among_many_takes_little_memory():
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)).encode()) for k in range(2000)]
    rows.append((-1, " ".join(f"v{k}" for k in range(20_000)).encode()))
    tracemalloc.start()
    items = decontaminate.Items.build(rows, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(items.ids) == 2001 and peak < 500 << 20
    assert items.find([b"x " + rows[5][1], rows[-1][1]]) == [(0, 5, 1, 20, 0), (1, -1, 0, 20_000, 0)]


# ---- groups ----------------------------------------------------------------------------


@pytest.mark.parametrize("small, group", [(64, 20_000), (3, 20_000), (64, 5)])
def test_near_rows_of_groups_by_brute_force(small, group, monkeypatch):
    """Pairs found connect exactly what all pairs connect, whichever way a part is compared."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "SMALL_PART", small)
    rng = np.random.default_rng(small + group)
    rows = []
    for g in range(60):
        base = np.unique(rng.integers(0, 2**63, int(rng.choice([5, 40, 200])), np.uint64))
        rows.append((g * 100, 0, 0, -1, g * 100, len(base), jaccard.sketch(base).tobytes()))
        for k in range(1, int(rng.integers(2, 9))):
            items = base if rng.random() < 0.4 else np.unique(np.r_[base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, 2, np.uint64)])
            if rng.random() < 0.3:
                items = np.unique(rng.integers(0, 2**63, len(base) + 1, np.uint64))
            for tag in sorted(rng.choice(3, int(rng.integers(1, 3)), replace=False).tolist()):
                rows.append((g * 100, 0, 0, tag, g * 100 + k, len(items), jaccard.sketch(items).tobytes()))
    rows.sort()
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "i", "j", "tag", "cls", "n", "sketch"])
    batches = [batch.slice(a, group) for a in range(0, batch.num_rows, group)]
    got = [(a, b) for out in jaccard._near_pairs(80)(iter(batches)) for a, b in zip(*[c.to_pylist() for c in out.columns], strict=True)]

    def joined(pairs):
        up = {r[4]: r[4] for r in rows}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        groups = {}
        for x in up:
            groups.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    every = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] < b[4] and (a[3] == b[3] or a[3] == -1):
                x, y = jaccard.stacked([np.frombuffer(a[6], np.uint64), np.frombuffer(b[6], np.uint64)])
                low, high = min(a[5], b[5]), max(a[5], b[5])
                if low * 100 >= high * 80 and int(np.bitwise_count(x ^ y).sum()) <= jaccard.max_difference(a[5] + b[5], 80):
                    every.append((a[4], b[4]))
    assert set(got) <= set(every) and joined(got) == joined(every)


# ---- rows without id, other tokenizers ---------------------------------------------------


def test_a_third_of_rows_without_id_spreads(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.format_string("text %d", F.col("id") % 50).alias("text"))
    got = exact_dedup.deduplicate(rows).groupBy("text_sha256").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert len(got) == 50 and all((r.n, r.kept) == (60, 1) for r in got)
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") % 9).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    packed = packing.pack(pieces, 16, group_pieces=500)
    sizes = [r["n"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("part")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 650 and sum(sizes) == 4000


def test_other_tokenizers_read_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = ["Hello  world\n x", "", "it's"]
    other = packing.ChunkTokens(path)
    assert not other.by_chunk and packing.ChunkTokens(TOKENIZER).by_chunk
    ids, counts = other.encode([t.encode() for t in texts])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
