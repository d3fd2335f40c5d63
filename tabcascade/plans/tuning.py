"""Cross-validation and parameter search over a fold column."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.operators.metrics import ConfusionEvaluator
from tabcascade.plans.boosting import GradientBoost, held_out_counts
from tabcascade.plans.ledger import Ledger, key_of, side_by_side

Params = Mapping[str, object]
#: From a setting; with ``with_rows`` from a setting and the number of training rows.
Build = Callable[..., Estimator]


def fold_numbers(df: DataFrame, fold: str) -> list[int]:
    """The folds of the rows; rows without a fold (their label is unknown) are neither fitted nor scored."""
    return sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())


def fold_split(df: DataFrame, fold: str, held_out: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(fold) != held_out), df.filter(F.col(fold) == held_out)


def fold_scores(
    build: Build,
    settings: Sequence[Params],
    df: DataFrame,
    fold: str,
    evaluator: Evaluator,
    folds: Sequence[int] | None = None,
    parallelism: int = 4,
    ledger: Ledger | None = None,
    name: str = "",
    with_rows: bool = False,
    tables: dict | None = None,
) -> list[tuple[int, int, float]]:
    """(setting, fold, score) for each setting fitted without each fold.

    A few fits run side by side so that the cluster stays busy while one of them waits for its
    last tasks. With a ledger, scores of an earlier run under the same ``name`` are taken over.
    ``with_rows`` gives ``build`` the number of rows that a fit learns from. Fits of
    :class:`boosting.GradientBoost` grow together over packed rows, which ``tables`` keeps for
    further calls on the same rows.
    """
    folds = fold_numbers(df, fold) if folds is None else list(folds)
    if not folds:
        return []
    sizes: dict[int, int] = {}
    if with_rows:
        per_fold = {r[0]: r[1] for r in df.where(F.col(fold).isNotNull()).groupBy(fold).count().collect()}
        sizes = {f: sum(per_fold.values()) - per_fold.get(f, 0) for f in folds}

    tables = {} if tables is None else tables
    jobs = list(itertools.product(range(len(settings)), folds))

    def built(i: int, held_out: int) -> Estimator:
        return build(settings[i], sizes[held_out]) if with_rows else build(settings[i])

    def one(j: tuple[int, int]) -> float:
        train, validation = fold_split(df, fold, j[1])
        estimator = ready.pop(j) if j in ready else built(*j)
        return evaluator.evaluate(estimator.fit(train).transform(validation))

    def many(some: Sequence[tuple[int, int]]) -> list[float]:
        boosts = [ready.pop(j) for j in some]
        key = (boosts[0].label, boosts[0].features, fold)
        rows = tables[key] = tables.get(key) or boosts[0].packed(df, fold)

        def finished(found: Mapping[int, dict]) -> None:
            if ledger:
                adds = [lambda i=i, c=c: ledger.add(keys[some[i]], evaluator.score_of(c)) for i, c in found.items()]
                side_by_side(df.sparkSession, adds, parallelism)

        return [evaluator.score_of(counts) for counts in held_out_counts(boosts, rows, [f for _, f in some], finished)]

    def shared(boost: Estimator) -> tuple | None:
        """Fits that may grow together say the same."""
        counts = isinstance(boost, GradientBoost) and isinstance(evaluator, ConfusionEvaluator) and evaluator.getLabelCol() == boost.label
        return (boost.label, boost.classes, boost.features) if counts else None

    keys = {j: key_of(name=name, setting=dict(settings[j[0]]), fold=j[1]) if ledger else j for j in jobs}
    scores: dict = ledger.scores() if ledger else {}
    left = list({keys[j]: j for j in jobs if keys[j] not in scores}.values())
    # other estimators are built when their turn comes, so that one that fails loses no fit before it
    ready = {j: built(*j) for j in left[:1]}
    if any(shared(e) for e in ready.values()):
        ready |= {j: built(*j) for j in left[1:]}
    groups: dict[tuple | None, list[tuple[int, int]]] = {}
    for j in left:
        groups.setdefault(shared(ready[j]) if j in ready else None, []).append(j)
    for kind, some in groups.items():
        if kind is not None:
            scores |= dict(zip([keys[j] for j in some], many(some), strict=True))
        elif ledger is None:
            scores |= dict(zip(some, side_by_side(df.sparkSession, [lambda j=j: one(j) for j in some], parallelism), strict=True))
        else:
            scores |= ledger.scored({keys[j]: (lambda j=j: one(j)) for j in some}, parallelism)
    return [(i, f, scores[keys[i, f]]) for i, f in jobs]


def cross_validate(build: Build, params: Params, df: DataFrame, fold: str, evaluator: Evaluator, **how) -> list[float]:
    """Score per fold, in fold order."""
    return [s for _, _, s in fold_scores(build, [params], df, fold, evaluator, **how)]


def mean_scores(scores: Sequence[tuple[int, int, float]]) -> dict[int, float]:
    by_setting: dict[int, list[float]] = {}
    for i, _, s in scores:
        by_setting.setdefault(i, []).append(s)
    return {i: sum(v) / len(v) for i, v in by_setting.items()}


def grid(options: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the first parameter varying slowest."""
    names = list(options)
    return [dict(zip(names, values)) for values in itertools.product(*options.values())]


def random_grid(options: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """A seeded choice of combinations without repeats; all of them if they are few."""
    sizes = [len(v) for v in options.values()]
    total = 1
    for n in sizes:
        total *= n
    rng = random.Random(seed)
    chosen = []
    for number in rng.sample(range(total), min(draws, total)):
        point = {}
        for name, values in options.items():
            number, i = divmod(number, len(values))
            point[name] = values[i]
        chosen.append(point)
    return chosen


@dataclass
class Search:
    """Outcome of a grid search."""

    points: list[dict]
    scores: list[tuple[int, int, float]]
    best: dict = field(init=False)
    best_score: float = field(init=False)

    def __post_init__(self):
        means = mean_scores(self.scores)
        i = max(means, key=lambda i: (means[i], -i))
        self.best, self.best_score = dict(self.points[i]), means[i]

    def table(self, spark) -> DataFrame:
        rows = [(str(self.points[i]), f, float(s)) for i, f, s in self.scores]
        return spark.createDataFrame(rows, "setting string, fold int, score double")


def grid_search(build: Build, base: Params, points: Sequence[Params], df: DataFrame, fold: str, evaluator: Evaluator, **how) -> Search:
    """Mean score over the folds of each point, the other parameters as in ``base``."""
    settings = [{**base, **p} for p in points]
    return Search([dict(p) for p in points], fold_scores(build, settings, df, fold, evaluator, **how))


@dataclass
class Stage:
    number: int
    best: dict
    score: float
    accepted: bool
    is_max: bool = True


def staged_search(
    build: Build,
    start: Params,
    stages: Sequence[Callable[[Params], Mapping[str, Sequence]]],
    df: DataFrame,
    fold: str,
    evaluator: Evaluator,
    **how,
) -> tuple[dict, list[Stage]]:
    """Tune one or two parameters at a time around the best setting so far.

    A stage is a function from the current setting to the values to try. A
    stage that scores below its predecessor is tried once and not taken over.
    """
    current = dict(start)
    how.setdefault("tables", {})
    score = sum(s := cross_validate(build, current, df, fold, evaluator, **how)) / len(s)
    history = [Stage(0, dict(current), score, True)]
    for number, options in enumerate(stages, 1):
        found = grid_search(build, current, grid(options(current)), df, fold, evaluator, **how)
        taken = found.best_score >= score
        if taken:
            current, score = {**current, **found.best}, found.best_score
        top = found.best_score >= max(mean_scores(found.scores).values())
        history.append(Stage(number, dict(found.best), found.best_score, taken, top))
    return current, history


def around(name: str, steps: Sequence[float], low: float | None = None) -> Callable[[Params], dict]:
    """A stage that tries offsets from the current value of one parameter."""

    def options(current: Params) -> dict:
        values = [round(current[name] + s, 10) for s in steps]
        return {name: [v for v in values if low is None or v >= low]}

    return options


def together(*parts: Callable[[Params], Mapping]) -> Callable[[Params], dict]:
    """A stage over the product of several parameters."""
    return lambda current: {k: v for part in parts for k, v in part(current).items()}


def fixed(**options: Sequence) -> Callable[[Params], dict]:
    """A stage with the same values whatever the current setting."""
    return lambda current: dict(options)


def rounded(values: Sequence[float], unit: float, least: int = 1) -> list[int]:
    """Numbers of rounds in another unit, without repeats."""
    return sorted({max(least, round(v / unit)) for v in values})


def around_rounds(steps: Sequence[float], unit: float = 1) -> Callable[[Params], dict]:
    return lambda current: {"n_estimators": rounded([current["n_estimators"] * unit + s for s in steps], unit)}


# The steps of the five-class tuning, of the one after under- and over-sampling, and of the
# first stage. ``unit`` is the number of rounds that count as one.
def _common_steps(first: Callable[[Params], dict], second: Callable[[Params], dict]) -> list[Callable[[Params], dict]]:
    shares = [0.6, 0.7, 0.8, 0.9]
    return [
        first,
        second,
        fixed(gamma=[0.0, 0.1, 0.2, 0.3, 0.4]),
        fixed(subsample=shares, colsample_bytree=shares),
        together(
            around("subsample", [-0.1, -0.05, 0, 0.05, 0.1], 0.05),
            around("colsample_bytree", [-0.1, -0.05, 0, 0.05, 0.1], 0.05),
        ),
    ]


HALF_STEPS = [-1.5, -1, -0.5, 0, 0.5, 1, 1.5]


def _depth_and_weight() -> tuple[Callable[[Params], dict], Callable[[Params], dict]]:
    wide = fixed(max_depth=[3, 5, 7, 9], min_child_weight=[1, 3, 5, 7])
    return wide, together(around("max_depth", [-1, 0, 1], 1), around("min_child_weight", HALF_STEPS, 0))


def seven_steps(unit: float = 1) -> list[Callable[[Params], dict]]:
    return [
        *_common_steps(*_depth_and_weight()),
        fixed(learning_rate=[0.1, 0.01, 0.001], n_estimators=rounded([200, 400, 600, 800, 1000], unit)),
        around_rounds(list(range(-180, 190, 20)), unit),
    ]


def nine_steps(unit: float = 1) -> list[Callable[[Params], dict]]:
    def alphas(current: Params) -> dict:
        return {"reg_alpha": sorted({current["reg_alpha"] * f for f in (0.5, 1.0, 1.5, 2.0, 5.0, 10.0)})}

    return [
        *_common_steps(*_depth_and_weight()),
        fixed(reg_alpha=[0.0, 1e-5, 1e-2, 0.1, 1.0, 100.0]),
        alphas,
        fixed(learning_rate=[0.1, 0.01, 0.001], n_estimators=rounded(range(100, 1000, 100), unit)),
        around_rounds(list(range(-80, 90, 10)), unit),
    ]


def first_stage_steps() -> list[Callable[[Params], dict]]:
    return _common_steps(fixed(min_child_weight=[1]), around("min_child_weight", HALF_STEPS, 0))


def refine(build: Build, base: Params, name: str, values: Sequence[float], df: DataFrame, fold: str,
           evaluator: Evaluator, rounds: int = 2, factor: float = 3.0, **how) -> list[Search]:
    """Search a scale, then again more narrowly around its best value."""
    searches = []
    for _ in range(rounds):
        found = grid_search(build, base, [{name: v} for v in values], df, fold, evaluator, **how)
        searches.append(found)
        best = found.best[name]
        values = [best / factor, best, best * factor]
        factor = factor**0.5
    return searches
