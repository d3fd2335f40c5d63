import itertools
import random
from collections import Counter

import pytest

from tabcascade.operators.metrics import ConfusionEvaluator, class_scores, confusion, f1_macro, roc_auc
from tabcascade.operators.voting import vote_rows, with_vote


def majority(votes):
    counts = Counter(v for v in votes if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


@pytest.mark.parametrize("models, labels", [(3, range(2)), (5, range(5)), (29, range(6)), (15, range(1, 6)), (40, range(12))])
def test_vote_against_counting(spark, models, labels):
    rng = random.Random(models)
    table = [[rng.choice([*labels, None]) for _ in range(models)] for _ in range(200)] + [[None] * models]
    names = [f"m{i}" for i in range(models)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "id int, " + ", ".join(f"{n} int" for n in names))
    got = {r["id"]: r["v"] for r in with_vote(df, names, list(labels), "v").collect()}
    assert got == {i: majority(r) for i, r in enumerate(table)}
    flipped = {r["id"]: r["v"] for r in with_vote(df, names[::-1], list(labels), "v", shift=1).collect()}
    assert flipped == {i: None if majority(r) is None else majority(r) + 1 for i, r in enumerate(table)}
    long = spark.createDataFrame([(i, v) for i, r in enumerate(table) for v in r if v is not None], "id int, v int")
    assert {r["id"]: r["vote"] for r in vote_rows(long, "id", "v").collect()} == {i: v for i, v in got.items() if v is not None}


def test_vote_ties(spark):
    df = spark.createDataFrame([(2, 2, 4, 4, 1), (0, 1, 0, 1, 5)], "a int, b int, c int, d int, e int")
    assert [r["v"] for r in with_vote(df, list("abcde"), range(6), "v").collect()] == [2, 0]


def test_vote_refuses_gaps(spark):
    with pytest.raises(ValueError):
        with_vote(spark.createDataFrame([(1,)], "a int"), ["a"], [0, 2], "v")


def test_scores(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)] * 1
    df = spark.createDataFrame(pairs, "y int, p int")
    scores = {r["class"]: r for r in class_scores(confusion(df, "y", "p")).collect()}
    f1 = {c: 2 * sum(y == p == c for y, p in pairs) / sum((y == c) + (p == c) for y, p in pairs) for c in range(3)}
    assert {c: r["f1"] for c, r in scores.items()} == pytest.approx(f1)
    assert scores[2]["precision"] == 0.0 and scores[2]["support"] == 1
    macro = sum(f1.values()) / 3
    assert f1_macro(confusion(df, "y", "p")).first()[0] == pytest.approx(macro)
    assert ConfusionEvaluator("f1_macro", "y", "p").evaluate(df) == pytest.approx(macro)
    assert ConfusionEvaluator("f1", "y", "p").evaluate(df) == pytest.approx(f1[1])
    assert ConfusionEvaluator("accuracy", "y", "p").evaluate(df) == pytest.approx(8 / 11)


def test_roc_auc_counts_ties_half(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 6))) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s") == pytest.approx(want)
