"""The stages of the pipeline against brute force, and the whole of it."""

import re

import corpus_pipeline
from tabcascade.llm import quality


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_exact(rows):
    best = {}
    for i, t in rows:
        key = bare(t)
        if key not in best or (-len(t or ""), i) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = (i, t)
    return sorted(best.values(), key=repr)


def brute_near(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted([(i, t) for k, (i, t) in enumerate(rows) if low[root(k)] == i or not sets[k]], key=repr)


def pairs(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def test_stages_match_brute_force(spark, data):
    names = [f for _, f in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, data)
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), quality.learn_from(4, 2))
    wanted = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == wanted and good.columns == docs.columns
    exact = corpus_pipeline.drop_exact(spark, docs, data)
    assert pairs(exact) == brute_exact(pairs(docs)) and exact.columns == docs.columns
    near = corpus_pipeline.drop_near(spark, docs, data)
    assert pairs(near) == brute_near(pairs(docs)) and near.columns == docs.columns
    leaks = corpus_pipeline.drop_leaks(spark, docs, data)
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = pairs(leaks)
    assert not any(b in t for b in bench for _, t in left) and leaks.columns == docs.columns
    assert set(left) <= set(pairs(docs)) and len(left) >= 0.9 * docs.count()


def test_repeated_rows_keep_one(spark, data):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "other", "y"), (2, "ab", "z"), (3, None, None), (None, "n", "n"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted([tuple(r) for r in corpus_pipeline.drop_exact(spark, docs, data).collect()], key=repr)
    assert got == sorted([(1, "a b", "x"), (1, "other", "y"), (3, None, None), (None, "n", "n")], key=repr)


def test_whole_pipeline(spark, data):
    packed = corpus_pipeline.run(spark, data).collect()
    assert packed and all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in packed)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs_after = stage(spark, docs, data)
        assert docs_after.count() == 0
