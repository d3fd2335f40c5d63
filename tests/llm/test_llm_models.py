"""Networks: gradients by differences, states and scores by brute force, held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabcascade.llm import gru, gru_lm, quality, toxicity
from tabcascade.llm.common import buckets


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, label int")


EDGES = [(90_001, None), (90_002, ""), (90_003, " \n\t"), (90_004, "word " * 30_000), (None, "no id at all"), (90_005, "same"), (90_005, "same")]


def numeric(loss, x, at, step=1e-5):
    old = x[at]
    x[at] = old + step
    high = loss()
    x[at] = old - step
    low = loss()
    x[at] = old
    return (high - low) / (2 * step)


def test_gru_gradient():
    rng = np.random.default_rng(0)
    gates, u, h0 = rng.normal(size=(6, 4, 9)), rng.normal(size=(3, 9)), rng.normal(size=(4, 3))
    mask = rng.random((6, 4)) < 0.8
    pull = rng.normal(size=(6, 4, 3))
    loss = lambda: float((gru.forward(gates, u, h0, mask)[0][1:] * pull).sum())
    states, kept = gru.forward(gates, u, h0, mask)
    dgates, du = gru.backward(pull, states, kept, u, mask)
    for at in [(0, 0, 0), (3, 2, 4), (5, 3, 8), (2, 1, 6)]:
        assert numeric(loss, gates, at) == pytest.approx(dgates[at], abs=1e-6)
    for at in [(0, 0), (1, 4), (2, 8)]:
        assert numeric(loss, u, at) == pytest.approx(du[at], abs=1e-6)


def test_toxicity_gradient_and_fast_scores():
    model = toxicity.ToxicityModel.start(1)
    params = {k: v.astype(np.float64) * 2 for k, v in model.params.items()}
    model = toxicity.ToxicityModel(params)
    texts = [b"one two three four five", b"six", b"", b"two two nine ten eleven twelve one"]
    vocabulary, codes, counts = toxicity.tokenize(texts)
    at, doc = toxicity.windows(counts)
    numbers = np.where(at >= 0, codes[at], -1)
    pull = np.arange(1.0, len(numbers) + 1)

    def loss():
        return float(model.run(model.embed(vocabulary)[0], numbers)[0] @ pull)

    vectors, kept_words = model.embed(vocabulary)
    logits, kept = model.run(vectors, numbers)
    grads = model.gradient(pull, kept, kept_words)
    for name in ("uf", "ub", "wf", "wb", "cf", "attend", "out", "bias", "word", "char"):
        g = grads[name]
        where = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        assert numeric(loss, params[name], where) == pytest.approx(g[where], rel=1e-3, abs=1e-6), name
    small = toxicity.ToxicityModel({k: v.astype(np.float32) for k, v in params.items()})
    best = np.array([logits[doc == d].max() for d in range(len(texts))])
    assert small.document_logits(texts) == pytest.approx(best, abs=1e-3)


def test_windows_cover_every_word_twice_or_at_an_end():
    for n in (0, 1, 39, 40, 41, 60, 61, 500):
        at, doc = toxicity.windows(np.array([7, n]))
        assert set(at[doc == 1][at[doc == 1] >= 0].tolist()) == set(range(7, 7 + n))
    seen = np.bincount(at[(doc[:, None] == 1) & (at >= 0)])[7:]
    assert (seen[toxicity.STRIDE : -toxicity.WINDOW] == 2).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "re"], 3))
    rows, labels = [], []
    for k in range(900):
        words = [word() for _ in range(int(rng.integers(20, 200)))]
        toxic, good = int(k % 3 == 0), int(k % 4 != 0)
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[int(rng.integers(len(words)))] = rng.choice(["zqbad", "xxvile", "grukk"]) + rng.choice(["", "s", "!"])
        if not good:
            words = [w.upper() + "!!" for w in words] if k % 8 else [w for w in words[:8] for _ in range(30)]
        rows.append((k, " ".join(words)))
        labels.append((k, good, toxic, "x"))
    labels += [(None, 1, 1, "x"), (5000, 1, 0, "x"), (1, None, None, "x")]
    return table(spark, rows + EDGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def judged(scored, labels, label, mod, remainder):
    held = [r for r in scored.join(labels.where(f"{label} IS NOT NULL"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % mod == remainder]
    return np.mean([r.predicted == r[label] for r in held]), len(held)


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    scored = toxicity.score(docs, toxicity.fit(docs, labels, quality.learn_from(5, 0)))
    accuracy, n = judged(scored, labels, "toxic", 5, 0)
    assert accuracy >= 0.9 and n > 100
    got = scored.collect()
    assert len(got) == 900 + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 90_005}) == 1
    assert toxicity.score(docs.limit(0), toxicity.ToxicityModel.start()).count() == 0


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, quality.learn_from(4, 2))
    accuracy, n = judged(quality.score(docs, model), labels, "quality", 4, 2)
    assert accuracy >= 0.97 and n > 100
    kept = quality.accepted_rows(docs, model)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.score(docs.limit(0), model).count() == 0


def test_no_labels_give_constant_models(spark, labelled):
    docs, labels = labelled
    for fit, score in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        model = fit(docs, labels.limit(0))
        assert len({round(r.score, 6) for r in score(docs, model).collect()}) == 1


def test_context_sums_match_brute_force():
    rng = np.random.default_rng(2)
    at, sign = quality.index_vectors()
    texts = [rng.integers(0, 30, n) for n in (0, 1, 5, 12)]
    breaks = np.zeros(18, np.int64)
    breaks[[0, 1, 6]] = 1
    want = np.zeros((quality.CLASSES, quality.DIM), np.int64)
    for t in texts:
        for i in range(len(t)):
            for j in range(len(t)):
                if i != j and abs(i - j) <= quality.WINDOW:
                    np.add.at(want[t[i]], at[t[j]], sign[t[j]])
    assert (quality.context_sums(np.concatenate(texts), breaks, at, sign).reshape(want.shape) == want).all()


def test_held_out_accuracy_on_driver_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for module, label, mod, remainder, least in ((toxicity, "toxic", 5, 0, 0.95), (quality, "quality", 4, 2, 0.97)):
        scored = module.score(docs.join(labels.select("doc_id"), "doc_id"), module.fit(docs, labels, quality.learn_from(mod, remainder)))
        accuracy, _ = judged(scored, labels, label, mod, remainder)
        assert accuracy >= least, (label, accuracy)


# ---- language model --------------------------------------------------------------------


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]


def test_base_scores_match_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + EDGES
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts = {}
    for i, t in rows:
        if learned(i):
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for limit in (None, 500):
        with pytest.MonkeyPatch.context() as patch:
            if limit:  # nearly all words by the shuffled join
                patch.setattr(gru_lm, "FREQUENT", limit)
            got = gru_lm.score(table(spark, rows), buckets("doc_id", 10) != 0, rounds=1).collect()
        want = sorted([(i, len(words(t)), sum(w in counts for w in words(t)), sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t))) for i, t in rows], key=repr)
        said = sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], key=repr)
        assert [w[:3] for w in want] == [s[:3] for s in said]
        assert [s[3] for s in said] == pytest.approx([w[3] for w in want], rel=1e-9)
        assert {r.train_tokens for r in got} == {total} and all(np.isfinite(r.score) and r.score < 0 for r in got)


def small_lexicon():
    h = np.arange(gru_lm.TAIL, gru_lm.TAIL * 2000, gru_lm.TAIL, dtype=np.uint64)[:60] + np.arange(60, dtype=np.uint64) % 5
    h = np.sort(np.r_[h, gru_lm.END])
    number = np.full(61, -1, np.int64)
    number[:40] = np.arange(40) % gru_lm.CLASSES * gru_lm.CLASS_SIZE
    tail = np.zeros(gru_lm.TAIL)
    return gru_lm.Lexicon(h, np.arange(1, 62), number, tail + 3, tail + 2, 1891, 61)


def test_states_carry_through_whole_documents():
    """Documents side by side, in windows, give what one long loop over one document gives."""
    p = {k: v * 3 for k, v in gru_lm.start_params(small_lexicon()).items()}
    p["bw"] = p["bw"] / 30
    rng = np.random.default_rng(1)
    counts = np.array([1, 70, 32, 33, 200])
    symbols = rng.integers(0, gru_lm.SYMBOLS, counts.sum())
    got = gru_lm.model_logs(symbols, counts, p)
    for d, (n, at) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)):
        h, total = np.zeros((1, gru_lm.HIDDEN)), 0.0
        for s in symbols[at : at + n]:
            cls = int(gru_lm._classes(np.array([s]))[0])
            z = (h @ p["wc"] + p["bc"])[0].astype(float)
            total += z[cls] - np.log(np.exp(z).sum())
            if s < gru_lm.VOCABULARY:
                z = (h @ p["ww"][cls] + p["bw"][cls])[0].astype(float)
                total += z[s % gru_lm.CLASS_SIZE] - np.log(np.exp(z).sum())
            h = gru.cell(p["gates"][[s]], h, p["u"])[0]
        assert got[d] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_language_model_gradient():
    p = {k: v.astype(np.float64) * 2 for k, v in gru_lm.start_params(small_lexicon()).items()}
    p["bw"] = p["bw"] / 30
    rng = np.random.default_rng(6)
    symbols = rng.choice([1, 33, 64, gru_lm.VOCABULARY + 2, gru_lm.SYMBOLS - 1], (5, 3))
    mask = np.ones((5, 3), bool)
    mask[3:, 0] = False
    h0 = rng.normal(size=(3, gru_lm.HIDDEN))

    def loss():
        states, _ = gru.forward(p["gates"][symbols], p["u"], h0, mask)
        at = mask.reshape(-1)
        h = states[:-1].reshape(-1, gru_lm.HIDDEN)[at]
        return -gru_lm.output_logs(h, symbols.reshape(-1)[at], p).mean()

    grads, _ = gru_lm.train_window(p, symbols, mask, h0)
    for name, g in grads.items():
        where = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        assert numeric(loss, p[name], where, 1e-4) == pytest.approx(g[where], rel=1e-3, abs=1e-7), name


def test_network_beats_the_base_on_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet")
    held = gru_lm.score(docs, buckets("doc_id", 10) != 0).where(buckets("doc_id", 10) == 0)
    base, score = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base + 0.02 * abs(base)


def test_nothing_learned_and_empty_table(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    got = gru_lm.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got) and len(got) == 2
    assert gru_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_network_learns_from_every_training_document(spark):
    """Copies of one text, which a hash of the text alone takes whole or not at all."""
    docs = gru_lm.text_rows(table(spark, [(i, "one two three four " * 9) for i in range(60)]))
    lexicon = gru_lm.learn_lexicon(gru_lm.count_tokens(docs))
    rounds = [{r.doc_id for r in gru_lm.dealt(docs, r, 2, lexicon.total).collect()} for r in range(2)]
    assert not rounds[0] & rounds[1] and rounds[0] | rounds[1] == set(range(60)) and min(map(len, rounds)) > 10
    start, p = gru_lm.start_params(lexicon), gru_lm.train(docs, lexicon)
    assert not np.array_equal(start["u"], p["u"])


def test_training_does_not_depend_on_the_layout(spark, data):
    docs = gru_lm.text_rows(spark.read.parquet(f"{data}/documents.parquet"))
    lexicon = gru_lm.learn_lexicon(gru_lm.count_tokens(docs))
    one, seven = (gru_lm.train(docs.repartition(n, "doc_id"), lexicon) for n in (1, 7))
    assert all(np.array_equal(one[k], seven[k]) for k in one)


def test_vocabulary_grows_with_the_distinct_words(spark):
    counts = spark.range(1, 40_001).select((F.col("id") * 1024).alias("h"), F.lit(3).cast("long").alias("c"))
    lexicon = gru_lm.learn_lexicon(counts)
    assert lexicon.vocabulary >= 3200 and (lexicon.number >= 0).sum() == lexicon.vocabulary
    assert gru_lm.learn_lexicon(counts.limit(100)).shape == (64, 32)
    p = gru_lm.start_params(lexicon)
    everything = np.arange(lexicon.vocabulary + gru_lm.TAIL)
    h = np.repeat(np.random.default_rng(3).normal(0, 0.5, (1, gru_lm.HIDDEN)).astype(np.float32), len(everything), 0)
    assert np.exp(gru_lm.output_logs(h, everything, p)).sum() == pytest.approx(1, rel=1e-4)
    symbols, mask = np.array([[5, 5], [3100, 7], [5, 2500]]), np.ones((3, 2), bool)
    dense, thin = (gru_lm.train_window(p, symbols, mask, h[:2], sparse=s)[0]["gates"] for s in (False, True))
    assert np.array_equal(dense[thin[0]], thin[1]) and len(dense) == len(everything) and np.count_nonzero(dense) == np.count_nonzero(thin[1])


def test_tokens_of_a_batch_match_splitting():
    def token(word):
        tail = (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 17 + (3 if len(word) > 2 else 0)) % gru_lm.TAIL
        return xxhash.xxh64_intdigest(word) & ~(gru_lm.TAIL - 1) | tail

    texts = [b"", b"  a B\tc\x0b ", b"\x1c x\x1f y \xff\xfe Z", b" ", "É word WORD   x".encode(), b"a" * 10, b"b"]
    for some in (pa.array(texts, pa.binary()), pa.array([b"zz", *texts], pa.binary()).slice(1), pa.array([b"one two"], pa.binary()), pa.array([b"", b" "], pa.binary())):
        own, number, counts = gru_lm.tokens(some)
        want = [[token(w) for w in t.lower().split()] + [int(gru_lm.END)] for t in some.to_pylist()]
        assert own[number].tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_documents_of_one_lane_are_learned_apart():
    """A window over two documents gives the mean of the gradients of both, the second from an empty state."""
    p = {k: v.astype(np.float64) * 2 for k, v in gru_lm.start_params(small_lexicon()).items()}
    q, rng = gru_lm.joined(p), np.random.default_rng(8)
    symbols = rng.choice([1, 33, 64, gru_lm.VOCABULARY + 2], (7, 2))
    starts, h0 = np.zeros((7, 2), bool), rng.normal(size=(gru_lm.HIDDEN, 2))
    starts[[0, 3]] = True
    both, last = gru_lm.window_gradients(q, symbols, np.ones((7, 2), bool), h0, starts)
    parts = [gru_lm.window_gradients(q, s, np.ones(s.shape, bool), np.zeros_like(h0)) for s in (symbols[:3], symbols[3:])]
    few = gru_lm.Gathered()
    for (g, _), n in zip(parts, (6, 8), strict=True):
        few.add(g, n)
    apart = few.mean()
    for name in ("u", "c", "w"):
        assert np.allclose(both[name], apart[name], atol=1e-7), name
    assert np.array_equal(both["gates"][0], apart["gates"][0]) and np.allclose(both["gates"][1], apart["gates"][1], atol=1e-7)
    assert np.allclose(last, parts[1][1])


def test_every_document_is_in_one_lane():
    counts = np.array([500, *range(1, 90)])
    dealt_to = gru_lm.lanes(counts, 8)
    assert sorted(np.concatenate(dealt_to).tolist()) == list(range(90))
    length = [int(counts[docs].sum()) for docs in dealt_to]
    assert len(length) == 8 and length == sorted(length, reverse=True) and min(length) >= 490
    assert len(gru_lm.lanes(counts[:3], 8)) == 3


def test_changes_are_summed_in_pieces(spark):
    """A partition sends a few rows of bytes, not one row a parameter; the mean goes by tokens."""
    far = [np.array([0, 1, -1, 2**30, -(2**30), 77], np.int32), np.array([4, -9, 0, 2**30, 5, -77], np.int32)]
    assert all(np.array_equal(gru_lm.unpacked(gru_lm.packed(x)), x) for x in far)
    parts = spark.createDataFrame([(a, n, bytearray(gru_lm.packed(x[a : a + 3]))) for n, x in zip((3, 1), far, strict=True) for a in (0, 3)], "piece long, seen long, far binary")
    got = {r.piece: np.frombuffer(r.mean, np.float32) for r in gru_lm.summed(parts).collect()}
    want = (3 * far[0].astype(float) + far[1]) / 4 / gru_lm.ONE
    assert np.allclose(np.r_[got[0], got[3]], want.astype(np.float32))
