"""Feature selection by repeated fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame

from tabcascade.plans.models import gain_importance, ranked_features, with_features
from tabcascade.plans.tuning import cross_validate, fold_numbers, fold_split


@dataclass
class Elimination:
    ranking: dict[str, int]
    mean_score: dict[int, float]
    best_size: int

    def selected(self) -> list[str]:
        return [f for f, r in self.ranking.items() if r == 1]


def _drop_order(build: Callable[[], Estimator], train: DataFrame, columns: Sequence[str], label: str,
                down_to: int, score: Callable | None = None, keep: Sequence[str] = ()) -> tuple[list[str], dict[int, float]]:
    left, dropped, scores = list(columns), [], {}
    while True:
        model = build().fit(with_features(train, left, [label, *keep]))
        if score is not None:
            scores[len(left)] = score(model, left)
        if len(left) <= down_to:
            return dropped, scores
        importance = gain_importance(model, left)
        worst = min(left, key=lambda f: (importance.get(f, 0.0), left.index(f)))
        left.remove(worst)
        dropped.append(worst)


def eliminate(build: Callable[[], Estimator], df: DataFrame, columns: Sequence[str], label: str, fold: str,
              evaluator: Evaluator, least: int = 1) -> Elimination:
    """Drop the least important feature, one at a time, and let the folds choose the size.

    The order is found anew in every fold and scored on the rows held out; the
    ranking comes from all rows, down to the best size (the smallest on ties).
    """
    totals: dict[int, list[float]] = {}
    for held_out in fold_numbers(df, fold):
        train, validation = fold_split(df, fold, held_out)

        def score(model, left, validation=validation):
            return evaluator.evaluate(model.transform(with_features(validation, left, [label])))

        for size, s in _drop_order(build, train, columns, label, least, score)[1].items():
            totals.setdefault(size, []).append(s)
    means = {size: sum(s) / len(s) for size, s in totals.items()}
    best = max(means, key=lambda size: (means[size], -size))
    dropped, _ = _drop_order(build, df, columns, label, best)
    ranking = {c: 1 for c in columns}
    for place, name in enumerate(reversed(dropped), 2):
        ranking[name] = place
    return Elimination(ranking, means, best)


def top_k_sweep(build: Callable[[], Estimator], df: DataFrame, importance: dict[str, float], sizes: Sequence[int],
                label: str, fold: str, evaluator: Evaluator, parallelism: int = 2) -> dict[int, float]:
    """Mean fold score with the k most important features, for each k."""
    order = ranked_features(importance)
    out = {}
    for k in sizes:
        rows = with_features(df, order[:k], [label, fold])
        scores = cross_validate(lambda _: build(), {}, rows, fold, evaluator, parallelism=parallelism)
        out[k] = sum(scores) / len(scores)
    return out
