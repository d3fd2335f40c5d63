"""Exact dedup, the Jaccard join and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabcascade.llm import common, exact_dedup, jaccard
from tabcascade.llm.exact_dedup import CountingQuotientFilter

DOC = "doc_id long, text string, lang string, n_chars long, component_id string, fp string, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "x", "y", 1) for i, t in rows], DOC)


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


# ---- exact dedup -----------------------------------------------------------------------


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[bare(t)]
        out.append((i, min(g)[3], len(g), hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_deduplicate_edge_cases(spark):
    rows = [
        (5, "a b c"), (4, "abc"), (3, "a  b c"), (9, "a  b c"), (None, "a  b c"), (7, None), (8, ""), (2, " \t\n\x0b\x0c\r "),
        (1, "a b"), (11, "a b "), (12, "é"), (13, "é"), (20, "x" * 300_000), (21, "x " * 300_000), (30, "z"), (30, "z"), (31, "z"),
    ]
    got = exact_dedup.deduplicate(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_dedup(rows)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(set(bare(t) for _, t in rows)) and len(set(s for _, s in kept)) == len(kept)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)
    assert exact_dedup.deduplicate(table(spark, rows).limit(0)).count() == 0


def test_deduplicate_hot_group(spark):
    rows = [(i, "same text " + " " * (i % 3)) for i in range(900)] + [(10_000 + i, f"text {i}") for i in range(1800)]
    got = exact_dedup.deduplicate(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_dedup(rows)


@given(st.lists(st.integers(0, 2**12 - 1), max_size=60), st.lists(st.integers(0, 2**12 - 1), max_size=60))
@settings(max_examples=60, deadline=None)
def test_filters_merge_without_loss(a, b):
    build = lambda x: CountingQuotientFilter.build(np.array(x, np.uint64), bits=12)
    merged = CountingQuotientFilter.load(build(a).merge(CountingQuotientFilter.load(build(b).dump())).dump())
    prints, counts = merged.items()
    want = {x: (a + b).count(x) for x in a + b}
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == want
    assert list(prints) == sorted(want)


def test_equal_fingerprints_of_other_texts_are_told_apart(spark, monkeypatch):
    def colliding(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([1] * len(texts), pa.int64()),
                    pa.array([hashlib.sha256(t.translate(None, b" ")).hexdigest() for t in texts]),
                    pa.array([0] * len(texts), pa.int64()),
                ],
                ["doc_id", "n_chars", "fp", "text_sha256", "row_hash"],
            )

    monkeypatch.setattr(exact_dedup, "_digests", colliding)
    rows = [(1, "a"), (2, "b"), (3, "a "), (4, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(table(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


# ---- Jaccard join ----------------------------------------------------------------------


def shingle_set(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted([(i, len(sets[k]), low.get(root(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows)], key=repr)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[k], f"m{rng.randrange(10**6)}"]])
    return words


def near_copies(seed, groups=40, copies=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        size = rng.choice([1, 2, 3, 4, 6, 10, 15, 20, 30, 60, 150, 400])
        last = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(rng.randrange(1, copies)):
            last = edited(last, rng.randrange(0, max(2, size // 12)), rng) or ["w1"]
            rows.append((n, " ".join(last)))
            n += rng.randrange(1, 5)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 90, 3), (2, 60, 4)])
def test_components_match_brute_force(spark, width, percent, seed):
    rows = near_copies(seed) + [(100_000, None), (100_001, ""), (100_002, " \n"), (100_003, "One"), (100_004, "one"), (100_004, "one"), (None, "two words"), (100_006, "Two WORDS")]
    got = jaccard.join_components(table(spark, rows), width, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, width, percent)


def test_hot_group_of_near_copies(spark):
    """Copies that are alike but mostly do not link: every link between two texts must be found."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = [(i, " ".join(edited(base, rng.randrange(0, 6), rng))) for i in range(300)]
    got = jaccard.join_components(table(spark, rows), 3, 90).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, 3, 90)


def test_blocks_of_a_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(jaccard, "GROUP_CLASSES", 7)
    test_hot_group_of_near_copies(spark)


def test_driver_documents_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jaccard.join_components(docs, 3, 90).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, 3, 90)


def test_empty_table(spark):
    assert jaccard.join_components(table(spark, [(1, "a")]).limit(0)).count() == 0


@given(st.integers(1, 400), st.integers(0, 60), st.sampled_from([60, 80, 90, 95]), st.integers(0, 2**32))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_key(n, changes, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, np.uint64))
    b = np.unique(np.r_[a[min(len(a) - 1, changes // 2) :], rng.integers(0, 2**63, changes // 2, np.uint64)])
    both = len(np.intersect1d(a, b))
    keys = jaccard.SketchKeys(percent)
    if 100 * both >= percent * (len(a) + len(b) - both):
        assert len(a) + len(b) == 2 * both or np.intersect1d(keys(a), keys(b)).size
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(jaccard.stacked([jaccard.sketch(a), jaccard.sketch(b)]))).sum())
    assert differ <= len(a) + len(b) - 2 * both


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
