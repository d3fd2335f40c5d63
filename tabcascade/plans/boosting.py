"""Gradient boosting with second-order steps over histograms.

All classes grow together: margins are an array, probabilities their softmax (one margin and a
sigmoid for two classes). Rows lie packed in blocks. A round grows one tree a class, level by level:
tasks add up gradients and curvatures by node, feature and bin, Spark brings the sums of a node
together and picks its best split, and only the splits reach the driver. A tree is fitted to
-gradient / curvature, weighted by curvature, so that a node's weight is its sum of curvatures:
``min_child_weight`` is the least of a child, and what a split gains is known in the units of
``gamma``. Leaf values, their ridge and L1 terms and the pruning by ``gamma`` follow from the sums
of each leaf, after the tree is grown.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.plans.nodes import Tree, leaf_tree, per_row
from tabcascade.plans.params import checked, tree_depth
from tabcascade.session import cut_lineage, few_tasks, hold

# Defaults of the settings' names.
DEFAULTS = {
    "learning_rate": 0.3,
    "n_estimators": 100,
    "max_depth": 6,
    "min_child_weight": 1.0,
    "gamma": 0.0,
    "subsample": 1.0,
    "colsample_bytree": 1.0,
    "reg_alpha": 0.0,
    "seed": 0,
}
RIDGE = 1.0
#: The least curvature of a row, so that a certain row does not ask for an endless step.
LEAST_CURVATURE = 1e-6
MAX_BINS = 128
#: Rows whose values say where the bins of a round end, at most (about as many are drawn).
BIN_ROWS = MAX_BINS**2
#: Bytes of features a block, and cells of histograms that a task holds.
BLOCK_BYTES, MAX_CELLS = 1 << 20, 1 << 22
#: Margins a row of fits that grow together, and bytes of histograms that are added up at once.
MAX_MARGINS, LOT_BYTES = 32, 1 << 23
#: Parts for each core when blocks are dealt anew.
PARTS_A_CORE = 2
#: Rounds after which margins are written to the checkpoint folder.
CUT_EVERY = 5
SAMPLE_STEPS = 1 << 20
#: Values of features of rows that one task grows on: a pass over as few takes less time than its jobs.
LOCAL_VALUES = 1 << 21


def settings_of(params: Mapping) -> dict:
    found = {**DEFAULTS, **checked(params)}
    tree_depth(found["max_depth"])
    return found


# ---- margins, gradients, loss ------------------------------------------------------------


def probabilities(margins: Column, classes: int) -> Column:
    """Array of class probabilities."""
    if classes == 2:
        one = 1 / (1 + F.exp(-margins[0]))
        return F.array(1 - one, one)
    odds = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _predicted(margins: Column, classes: int) -> Column:
    """The most probable class, the smallest on ties."""
    if classes == 2:
        return (margins[0] > 0).cast("double")
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("double")


def _slopes(m: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss in each margin, (rows, margins) each."""
    with np.errstate(over="ignore"):
        if classes == 2:
            p = 1 / (1 + np.exp(-m))
            return p - y[:, None], np.maximum(p * (1 - p), LEAST_CURVATURE)
        odds = np.exp(m - m.max(axis=1, keepdims=True))
    p = odds / odds.sum(axis=1, keepdims=True)
    h = np.maximum(2 * p * (1 - p), LEAST_CURVATURE)
    p[np.arange(len(y)), y] -= 1
    return p, h


def _loss(m: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    if classes == 2:
        one = m[:, 0]
        return np.maximum(one, 0) + np.log1p(np.exp(-np.abs(one))) - y * one
    top = m.max(axis=1)
    return np.log(np.exp(m - top[:, None]).sum(axis=1)) + top - m[np.arange(len(y)), y]


# ---- rows in blocks ------------------------------------------------------------------------


@dataclass(frozen=True)
class Packed:
    """Rows in blocks: labels, features, a tag and the number of each row; features a row.

    ``kept`` is the frame to free when no fit reads the blocks any more.
    """

    rows: DataFrame
    width: int
    kept: DataFrame


def spread(blocks: DataFrame) -> DataFrame:
    """The kept blocks, dealt anew if a core would get more than twice its share of them.

    Rows come in as few parts as their files have row groups, or as a shuffle wrote, and every pass
    of every fit would be as slow as the largest part.
    """
    told = blocks.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    if not told["all"] or told["most"] <= 2 * -(-told["all"] // cores):
        return blocks
    dealt = hold(blocks.repartition(min(told["all"], PARTS_A_CORE * cores)))
    dealt.count()  # so that the blocks before can go
    blocks.unpersist()
    return dealt


def packed(df: DataFrame, label: str, features: str, tag: Column) -> Packed:
    """Rows with label and features, written to the checkpoint folder.

    Rows are numbered there, so that samples of them are the same whenever a part is computed again.
    """
    known = df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{features}`").isNotNull())
    rows = known.select(
        F.col(f"`{label}`").cast("int").alias("y"),
        F.col(f"`{features}`").alias("x"),
        F.coalesce(tag, F.lit(-1)).cast("int").alias("tag"),
        F.monotonically_increasing_id().alias("row"),
    )
    told = rows.schema["x"].metadata.get("ml_attr", {}).get("num_attrs")

    def pack(batches):
        for batch in batches:
            y, x, tag, row = batch.columns
            n = len(y)
            if not n:
                continue
            flat = np.asarray(x.flatten(), float)
            width = len(flat) // n
            step = max(1, BLOCK_BYTES // (8 * max(1, width)))
            for a in range(0, n, step):
                b = min(n, a + step)
                numbers = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), row.slice(a, b - a))
                said = [np.asarray(y)[a:b].astype("<i4"), flat[a * width : b * width].astype("<f8"), np.asarray(tag)[a:b].astype("<i4")]
                yield pa.RecordBatch.from_arrays([*[pa.array([v.tobytes()], pa.binary()) for v in said], numbers], ["y", "x", "tag", "row"])

    blocks = rows.withColumn("x", vector_to_array("x")).mapInArrow(pack, "y binary, x binary, tag binary, row array<long>")
    kept = spread(hold(cut_lineage(blocks)))
    blocks = few_tasks(kept)
    if told is None:
        first = blocks.select(F.length("x") / F.length("y") / 2).first()
        told = int(first[0]) if first else 0
    return Packed(blocks, told, kept)


@dataclass
class Block:
    """A block as one fit sees it; ``memo`` keeps what fits over the same block share."""

    y: np.ndarray
    x: np.ndarray
    held: np.ndarray
    inside: np.ndarray
    m: np.ndarray
    #: Of the rows inside and of the margins: equal for fits that have the same.
    kind: tuple
    memo: dict

    def known(self, key: tuple, build: Callable[[], object]):
        if key not in self.memo:
            self.memo[key] = build()
        return self.memo[key]

    def taught(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of the rows inside."""
        return self.known(("taught", *self.kind[:2]), lambda: (self.x[self.inside], self.y[self.inside]))

    def slopes(self, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the rows inside."""
        return self.known(("slopes", *self.kind), lambda: _slopes(self.m[self.inside], self.taught()[1], classes))


# ---- growth ------------------------------------------------------------------------------


@dataclass
class Growth:
    """Blocks with the margins of all rounds so far, and the trees of each round.

    Rows whose tag is ``held`` get margins but teach nothing. Fits that grow together share the
    blocks, which have margins of ``fits`` of them; this one's have the number ``place``.
    """

    rows: DataFrame
    classes: int
    params: dict
    width: int
    held: int
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    place: int = 0
    fits: int = 1

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes

    @property
    def limit(self) -> int | None:
        """Rows whose number is below it are in a round's sample; None: all are."""
        share = float(self.params["subsample"])
        return int(share * SAMPLE_STEPS) if share < 1 else None


def _read(states: Sequence[Growth], sample: bool = False):
    """(blocks with what a pass needs, function from Arrow batches to a :class:`Block` for each fit).

    The fits share their blocks, their seed and the number of their rounds. With ``sample`` a block
    says which of its rows are in the next round's sample.
    """
    one = states[0]
    number, outputs, width, fits = len(one.trees), one.outputs, one.width, one.fits
    told = [(s.place, s.held, s.limit if sample else None) for s in states]
    drawn = F.lit(None).cast("array<int>")
    if any(limit is not None for *_, limit in told):
        hashed = lambda r: F.xxhash64(r, F.lit(int(one.params["seed"])), F.lit(number))
        drawn = F.transform("row", lambda r: F.pmod(hashed(r), F.lit(SAMPLE_STEPS)).cast("int"))

    def blocks(batches) -> Iterator[list[Block]]:
        for batch in batches:
            for y, x, tag, m, draw in zip(*[batch.column(i) for i in range(5)], strict=True):
                y, tag = np.frombuffer(y.as_buffer(), "<i4"), np.frombuffer(tag.as_buffer(), "<i4")
                x = np.frombuffer(x.as_buffer(), "<f8").reshape(len(y), width)
                whole = np.frombuffer(m.as_buffer(), "<f8").reshape(len(y), fits * outputs) if m.is_valid else None
                zero = np.zeros((len(y), outputs)) if whole is None else None
                draw = draw.values.to_numpy(zero_copy_only=False) if draw.is_valid else None
                memo: dict = {}
                seen = []
                for place, held, limit in told:
                    if ("held", held) not in memo:
                        memo["held", held] = tag == held
                    out = memo["held", held]
                    if ("inside", held, limit) not in memo:
                        memo["inside", held, limit] = ~out if limit is None else ~out & (draw < limit)
                    margins = zero if whole is None else whole[:, place * outputs : (place + 1) * outputs]
                    seen.append(Block(y, x, out, memo["inside", held, limit], margins, (held, limit, None if whole is None else place), memo))
                yield seen

    return one.rows.select("y", "x", "tag", "m", drawn.alias("inside")), blocks


def start(rows: Packed, classes: int, params: Mapping, held: int) -> Growth:
    """All rows at margin zero; those whose tag is ``held`` teach nothing."""
    return start_together(rows, classes, [(params, held)])[0]


def begin(df: DataFrame, label: str, classes: int, params: Mapping, features: str = "features", held: Column | None = None) -> Growth:
    """Rows at margin zero. Those for which ``held`` is true get margins but teach nothing.

    Rows without label or features take no part.
    """
    tag = F.coalesce(held if held is not None else F.lit(False), F.lit(False)).cast("int")
    return start(packed(df, label, features, tag), classes, params, 1)


def _tree_features(params: Mapping, number: int, output: int, width: int) -> list[int]:
    """The features that one tree may use."""
    keep = max(1, int(width * float(params["colsample_bytree"])))
    if keep >= width:
        return list(range(width))
    rng = np.random.default_rng([int(params["seed"]), number, output])
    return sorted(rng.choice(width, keep, replace=False).tolist())


def bin_ends(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds: between all values, or where about equal weights lie between them.

    The rule of Spark's trees: a threshold follows the value at which the running weight is
    nearest to the next multiple of the mean weight of a bin.
    """
    known, place = np.unique(values, return_inverse=True)
    middle = (known[:-1] + known[1:]) / 2
    if len(middle) <= most:
        return middle
    sums = np.bincount(place, weights)
    stride = sums.sum() / (most + 1)
    reached, target, out = np.cumsum(sums), stride, []
    halves = (reached[:-1] + reached[1:]) / 2
    # the first place from which on the sum before is the nearer one; by the halves, but for their rounding
    i = 1
    while i < len(reached):
        i = max(i, int(np.searchsorted(halves, target)) - 1)
        while i < len(reached) and not abs(reached[i - 1] - target) < abs(reached[i] - target):
            i += 1
        if i < len(reached):
            out.append(i - 1)
            target += stride
            i += 1
    return middle[out]


def _bin_samples(states: Sequence[Growth], rows: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each fit features and curvatures of the round's rows: all of them, or about ``BIN_ROWS``."""
    frame, blocks = _read(states, sample=True)
    classes, seed = states[0].classes, [int(states[0].params["seed"]), len(states[0].trees)]
    shares = [min(1.0, BIN_ROWS / max(1, n)) for n in rows]
    # in the first round fits with the same rows have the same sample
    kinds = [(s.held, s.limit, s.place if s.trees else None) for s in states]
    first = [kinds.index(k) for k in kinds]

    def run(batches):
        rngs = {i: np.random.default_rng([*seed, TaskContext.get().partitionId()]) for i in first}
        for seen in blocks(batches):
            for i, rng in rngs.items():
                b = seen[i]
                at = np.flatnonzero(b.inside)
                if shares[i] < 1:
                    at = at[rng.random(len(at)) < shares[i]]
                if len(at):
                    h = _slopes(b.m[at], b.y[at], classes)[1]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (b.x[at], h)]], ["fit", "x", "h"])

    got = frame.mapInArrow(run, "fit int, x binary, h binary").collect()
    found = {}
    for i in set(first):
        x, h = (np.frombuffer(b"".join(bytes(r[c]) for r in got if r["fit"] == i), "<f8") for c in ("x", "h"))
        found[i] = x.reshape(-1, states[i].width), h.reshape(-1, states[i].outputs)
    return [found[i] for i in first]


@dataclass
class Sprout:
    """A tree of a round while it grows: its nodes, the open ones, and the sums of its leaves."""

    fit: int
    output: int
    columns: list[int]
    ends: list[np.ndarray]
    nodes: list[list]
    open: list[int]
    sums: dict[int, tuple[float, float]]

    def tree(self) -> Tree:
        f, t, a, b = zip(*self.nodes, strict=True)
        return Tree(np.array(f, np.int64), np.array(t, float), np.array(a, np.int64), np.array(b, np.int64), np.zeros((len(f), 1)))

    @property
    def cells(self) -> int:
        return sum(len(e) + 1 for e in self.ends)

    def split(self, node: int, found) -> None:
        """Take over a split; children with a spread of their own stay open."""
        column, end = found["feature"], found["end"]
        left = len(self.nodes)
        self.nodes[node] = [self.columns[column], float(self.ends[column][end]), left, left + 1]
        del self.sums[node]
        for child, side in ((left, "left"), (left + 1, "right")):
            self.nodes.append([-1, 0.0, -1, -1])
            self.sums[child] = tuple(found[side][:2])
            if found[side][2] >= np.finfo(float).eps:
                self.open.append(child)

    def merged(self) -> Tree:
        """Two leaves that say the same are one."""
        for node in reversed(range(len(self.nodes))):
            f, _, a, b = self.nodes[node]
            if f >= 0 and a in self.sums and b in self.sums:
                (gl, hl), (gr, hr) = self.sums[a], self.sums[b]
                if gl / hl == gr / hr:
                    self.nodes[node] = [-1, 0.0, -1, -1]
                    self.sums[node] = (gl + gr, hl + hr)
        return self.tree()


SPLITS = "fit int, output int, node int, gain double, feature int, end int, left array<double>, right array<double>"
CELLS = "fit int, output int, lot int, node int, part int, cells binary"


def _names(schema: str) -> list[str]:
    return [n.split()[0] for n in schema.split(", ")]


def _wanted(sprouts: Sequence[tuple[Sprout, list[int]]], parts: int) -> list[tuple]:
    """What a pass needs to know of the open nodes of each tree."""
    wanted = []
    for s, nodes in sprouts:
        slot = np.full(len(s.nodes), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        lot = max(1, LOT_BYTES // (32 * max(1, s.cells) * max(1, parts)))
        wanted.append((s.fit, s.output, s.tree(), slot, nodes, s.columns, s.ends, lot))
    return wanted


def _added_cells(wanted: Sequence[tuple], blocks: Iterable[list[Block]], classes: int) -> list[np.ndarray]:
    """Of each tree rows, curvature, gradient and gradient^2 / curvature by node and bin."""
    sums = [np.zeros((4, len(nodes), sum(len(e) + 1 for e in ends))) for _, _, _, _, nodes, _, ends, _ in wanted]
    for seen in blocks:
        for total, (i, k, tree, slot, nodes, columns, ends, _) in zip(sums, wanted, strict=True):
            b = seen[i]
            x = b.taught()[0]
            g, h = b.slopes(classes)
            place = slot[tree.leaves(x)]
            at = np.flatnonzero(place >= 0)
            place, gk, hk = place[at], g[at, k], h[at, k]
            weights = (None, hk, gk, gk * gk / hk)
            first = 0
            for column, end in zip(columns, ends, strict=True):
                bins = b.known(("bins", *b.kind[:2], column, end.tobytes()), lambda: np.searchsorted(end, x[:, column]))  # noqa: B023
                size = len(end) + 1
                cell = place * size + bins[at]
                for j, weight in enumerate(weights):
                    total[j, :, first : first + size] += np.bincount(cell, weight, len(nodes) * size).reshape(len(nodes), size)
                first += size
    return sums


def _histograms(states: Sequence[Growth], sprouts: Sequence[tuple[Sprout, list[int]]]) -> DataFrame:
    """(fit, output, lot, node, part, cells): rows, curvature, gradient and gradient^2 / curvature by bin, of each task.

    A lot is some nodes of a tree, whose sums of all tasks take about ``LOT_BYTES``.
    """
    frame, blocks = _read(states, sample=True)
    classes, wanted = states[0].classes, _wanted(sprouts, frame.rdd.getNumPartitions())

    def run(batches):
        sums = _added_cells(wanted, blocks(batches), classes)
        part = TaskContext.get().partitionId()
        for total, (i, k, _, _, nodes, _, _, lot) in zip(sums, wanted, strict=True):
            some = np.flatnonzero(total[0].any(axis=1)).tolist()
            for a in range(0, len(some), lot):
                own = some[a : a + lot]
                columns = [[v] * len(own) for v in (i, k)] + [[p // lot for p in own], [nodes[p] for p in own], [part] * len(own)]
                cells = pa.array([np.ascontiguousarray(total[:, p]).tobytes() for p in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], cells], _names(CELLS))

    return frame.mapInArrow(run, CELLS)


def _spread(n, w, g, q):
    """Variance of -gradient / curvature, weighted by curvature; 0 without rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - g * g / w) / w, 0.0)


def best_split(cells: np.ndarray, sizes: Sequence[int], least: float) -> tuple[float, int, int, list[float], list[float]] | None:
    """(gain, feature, end, left, right) of the split with the largest gain, the first on ties.

    ``cells`` are the rows of :func:`_histograms`, features one after the other. Of each side the
    gradient, the curvature and the spread are said; a side weighs ``least`` or more.
    """
    best, first = None, 0
    for f, size in enumerate(sizes):
        own = cells[:, first : first + size]
        first += size
        if size < 2:
            continue
        left = np.cumsum(own, axis=1)
        total, left = left[:, -1:], left[:, :-1]
        right = total - left
        fits = (left[0] > 0) & (right[0] > 0) & (left[1] >= least) & (right[1] >= least)
        if not fits.any():
            continue
        a, b = _spread(*left), _spread(*right)
        gain = np.where(fits, _spread(*total) - left[1] / total[1] * a - right[1] / total[1] * b, -np.inf)
        e = int(np.argmax(gain))
        if gain[e] > 0 and (best is None or gain[e] > best[0]):
            best = (float(gain[e]), f, e, *([float(s[2, e]), float(s[1, e]), float(v[e])] for s, v in ((left, a), (right, b))))
    return best


def _splits(states: Sequence[Growth], sprouts: Sequence[tuple[Sprout, list[int]]], least: Mapping[tuple[int, int], float]) -> list:
    """The best split of each node that has one."""
    sizes = {(s.fit, s.output): [len(e) + 1 for e in s.ends] for s, _ in sprouts}
    names = _names(SPLITS)

    def pick(key, table):
        fit, output = (k.as_py() for k in key[:2])
        table = table.sort_by([("node", "ascending"), ("part", "ascending")])
        nodes, rows = table.column("node").to_numpy(), []
        cells = [c.as_buffer() for c in table.column("cells")]
        ends = [*(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for a, b in zip([0, *ends], ends, strict=False):
            found = best_split(sum(np.frombuffer(c, "<f8") for c in cells[a:b]).reshape(4, -1), sizes[fit, output], least[fit, output])
            if found is not None:
                rows.append(dict(zip(names, (fit, output, int(nodes[a]), *found), strict=True)))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    return _histograms(states, sprouts).groupBy("fit", "output", "lot").applyInArrow(pick, SPLITS).collect()


def _chunks(sprouts: Sequence[Sprout], nodes: Mapping[tuple[int, int], list[int]]) -> Iterator[list[tuple[Sprout, list[int]]]]:
    """Open nodes in parts that a task can hold the histograms of."""
    chunk, room = [], MAX_CELLS
    for s in sprouts:
        left = nodes[s.fit, s.output]
        while left:
            fit = max(0 if chunk else 1, room // max(1, s.cells))
            if not fit:
                yield chunk
                chunk, room = [], MAX_CELLS
                continue
            chunk.append((s, left[:fit]))
            room -= len(left[:fit]) * s.cells
            left = left[fit:]
    if chunk:
        yield chunk


def _grown(
    states: Sequence[Growth], measured: Sequence[tuple], samples_of: Callable = _bin_samples, splits_of: Callable = _splits
) -> list[list[tuple[Tree, dict[int, tuple[float, float]]]]]:
    """Of each fit one tree a class with the sums of its leaves, from the sums over all rows of the round."""
    number, sprouts, grows, deepest, least = len(states[0].trees), [], [], 0, {}
    for i, (state, (_, _, g, h)) in enumerate(zip(states, measured, strict=True)):
        child, depth = float(state.params["min_child_weight"]), tree_depth(state.params["max_depth"])
        own = [Sprout(i, k, _tree_features(state.params, number, k, state.width), [], [[-1, 0.0, -1, -1]], [], {0: (g[k], h[k])}) for k in range(state.outputs)]
        sprouts.append(own)
        some = [s for s in own if h[s.output] and 2 * child < h[s.output] and depth]
        grows += some
        deepest = max(deepest, depth if some else 0)
        # as a share of the whole and back
        least |= {(i, k): child / w * w if w else child for k, w in enumerate(h)}
    if grows:
        samples = samples_of(states, [n for _, n, _, _ in measured])
        told: dict[tuple, np.ndarray] = {}
        for s in grows:
            (x, weights), most = samples[s.fit], min(MAX_BINS, measured[s.fit][1]) - 1
            for c in s.columns:
                key = (id(x), s.output, c, most)
                if key not in told:
                    told[key] = bin_ends(x[:, c], weights[:, s.output], most)
                s.ends.append(told[key])
            s.open = [0]
    by_key = {(s.fit, s.output): s for s in grows}
    for level in range(deepest):
        live = [s for s in grows if s.open and level < tree_depth(states[s.fit].params["max_depth"])]
        if not live:
            break
        nodes = {(s.fit, s.output): s.open for s in live}
        for s in live:
            s.open = []
        found = [r for chunk in _chunks(live, nodes) for r in splits_of(states, chunk, least)]
        for r in sorted(found, key=lambda r: (r["fit"], r["output"], r["node"])):
            by_key[r["fit"], r["output"]].split(r["node"], r)
    return [[(s.merged(), s.sums) for s in own] for own in sprouts]


def finished_tree(tree: Tree, sums: Mapping[int, tuple[float, float]], params: Mapping) -> Tree:
    """Leaf values from the sums of each leaf, splits that gain less than ``gamma`` taken back.

    A node is worth G^2 / (H + ridge), G shrunk by the L1 term; a split whose children are leaves
    stays if they are worth ``gamma`` more than it. Columns of ``value``: step, G, H.
    """
    alpha, gamma = float(params["reg_alpha"]), float(params["gamma"])
    nodes: list[list] = []

    def shrunk(g: float) -> float:
        return np.sign(g) * max(0.0, abs(g) - alpha)

    def worth(g: float, h: float) -> float:
        return shrunk(g) ** 2 / (h + RIDGE)

    def walk(k: int) -> tuple[list, float, float, bool]:
        """(rows of the part below, G, H, is it a leaf); places are relative."""
        if tree.feature[k] < 0:
            g, h = sums.get(k, (0.0, 0.0))
            return [[-1, 0.0, -1, -1, g, h]], g, h, True
        left, gl, hl, leaf_l = walk(int(tree.left[k]))
        right, gr, hr, leaf_r = walk(int(tree.right[k]))
        g, h = gl + gr, hl + hr
        if leaf_l and leaf_r and worth(gl, hl) + worth(gr, hr) - worth(g, h) < gamma:
            return [[-1, 0.0, -1, -1, g, h]], g, h, True
        head = [int(tree.feature[k]), float(tree.threshold[k]), 1, 1 + len(left), g, h]
        moved = [[f, t, a + 1 if a >= 0 else a, b + 1 if b >= 0 else b, *x] for f, t, a, b, *x in left]
        moved += [[f, t, a + 1 + len(left) if a >= 0 else a, b + 1 + len(left) if b >= 0 else b, *x] for f, t, a, b, *x in right]
        return [head, *moved], g, h, False

    nodes = walk(0)[0]
    value = np.array([[-shrunk(g) / (h + RIDGE), g, h] for *_, g, h in nodes])
    whole = [np.array([n[c] for n in nodes], np.int64) for c in (0, 2, 3)]
    return Tree(whole[0], np.array([n[1] for n in nodes], float), whole[1], whole[2], value)


def _steps(trees: Sequence[Tree], rate: float, x: np.ndarray) -> np.ndarray:
    return np.stack([rate * t.value[t.leaves(x), 0] for t in trees], axis=1)


def _measure(states: Sequence[Growth], losses: bool) -> list[tuple[float | None, int, list[float], list[float]]]:
    """Of each fit (mean loss of the taught rows; rows, sums of gradient and of curvature of the round's sample)."""
    frame, blocks = _read(states, sample=True)
    classes, outputs, fits = states[0].classes, states[0].outputs, len(states)

    def run(batches):
        sums = _added_sums(blocks(batches), fits, outputs, classes, losses)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    got = sorted(frame.mapInArrow(run, "part int, sums binary").collect(), key=lambda r: r["part"])  # one row a task
    return _measured([np.frombuffer(bytes(r["sums"]), "<f8").reshape(fits, 3 + 2 * outputs) for r in got], (fits, 3 + 2 * outputs), outputs, losses)


def _added_sums(blocks: Iterable[list[Block]], fits: int, outputs: int, classes: int, losses: bool) -> np.ndarray:
    """Of each fit loss and number of the taught rows; number, gradient and curvature of those in the sample."""
    sums = np.zeros((fits, 3 + 2 * outputs))
    for seen in blocks:
        for own, b in zip(sums, seen, strict=True):
            if losses:
                own[0] += float(_loss(b.m[~b.held], b.y[~b.held], classes).sum())
            found = b.known(("sums", *b.kind), lambda: np.concatenate([v.sum(axis=0) for v in b.slopes(classes)]))  # noqa: B023
            own[1] += b.known(("rows", b.kind[0]), lambda: int((~b.held).sum()))  # noqa: B023
            own[2] += b.known(("rows", *b.kind[:2]), lambda: int(b.inside.sum()))  # noqa: B023
            own[3:] += found
    return sums


def _measured(parts: Sequence[np.ndarray], shape: tuple[int, int], outputs: int, losses: bool) -> list[tuple[float | None, int, list[float], list[float]]]:
    whole = np.zeros(shape)
    for sums in parts:
        whole += sums
    return [(float(v[0] / v[1]) if losses and v[1] else None, int(v[2]), v[3 : 3 + outputs].tolist(), v[3 + outputs :].tolist()) for v in whole]


def _moved(states: Sequence[Growth], trees: Sequence[Sequence[Tree]]) -> DataFrame:
    """The blocks with a round's steps added to the margins of some of the fits."""
    frame, blocks = _read(states)
    outputs, fits = states[0].outputs, states[0].fits
    told = [(s.place, float(s.params["learning_rate"])) for s in states]

    def run(batches):
        for batch in batches:
            added = []
            for m, seen in zip(batch.column(3), blocks([batch]), strict=True):
                shape = (len(seen[0].y), fits * outputs)
                now = np.frombuffer(m.as_buffer(), "<f8").reshape(shape).copy() if m.is_valid else np.zeros(shape)
                for (place, rate), own, b in zip(told, trees, seen, strict=True):
                    now[:, place * outputs : (place + 1) * outputs] += _steps(own, rate, b.x)
                added.append(now.astype("<f8").tobytes())
            kept = [batch.column(i) for i in (0, 1, 2, 5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(added, pa.binary())], ["y", "x", "tag", "row", "m"])

    whole = states[0].rows.select(*[F.col(c) for c in frame.columns[:4]], F.lit(None).cast("array<int>").alias("inside"), "row")
    return whole.mapInArrow(run, "y binary, x binary, tag binary, row array<long>, m binary")


def grow(state: Growth, rounds: int, closing: bool = True, margins: bool = True) -> Growth:
    """Some more rounds on top of the stored margins, as in :func:`grow_together`."""
    return grow_together([state], [rounds], closing, margins)[0]


def grow_together(states: Sequence[Growth], rounds: Sequence[int], closing: bool = True, margins: bool = True, losses: bool = True) -> list[Growth]:
    """Some more rounds of several fits, each pass over the blocks for all of them.

    Margins are kept in memory or on disk, and written to the checkpoint folder every few rounds.
    ``closing`` measures the loss after the last round; without ``margins`` those of the last round
    are left out. ``states`` stay as they are.
    """
    now = [replace(s, trees=list(s.trees), losses=list(s.losses)) for s in states]
    first, most, before = states[0].rows, max(rounds), None
    for r in range(most + 1):
        if r == most and not closing:
            break
        active = now if r == most else [s for s, n in zip(now, rounds, strict=True) if r < n]
        measured = _measure(active, losses)
        if before is not None:  # the measure has read all margins, so that no later pass reads the rows before
            before.unpersist()
            before = None
        for s, (loss, *_) in zip(active, measured, strict=True):
            if losses and len(s.losses) == len(s.trees):
                s.losses.append(loss)
        if r == most:
            break
        trees = [[finished_tree(t, sums, s.params) for t, sums in own] for s, own in zip(active, _grown(active, measured), strict=True)]
        moved = None if r == most - 1 and not margins else _moved(active, trees)
        for s, own in zip(active, trees, strict=True):
            s.trees.append(own)
        if moved is None:
            break
        rows = cut_lineage(moved) if len(active[0].trees) % CUT_EVERY == 0 else moved.persist(StorageLevel.MEMORY_AND_DISK)
        before = now[0].rows if now[0].rows is not first else None
        for s in now:
            s.rows = rows
        if r == most - 1 and not closing:
            rows.agg(F.sum(F.length("m"))).first()
    if before is not None:
        before.unpersist()
    return now


# ---- growth in one task --------------------------------------------------------------------


def _row_draws(row: np.ndarray, seed: int, number: int) -> np.ndarray:
    """``pmod(xxhash64(row, seed, number), SAMPLE_STEPS)``, as Spark's of a long and two ints."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray, by: int) -> np.ndarray:
        return (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = mixed(turned(h ^ (turned(row.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        for v in (seed, number):
            h = h + p5 + np.uint64(4)
            h = mixed(turned(h ^ (np.uint64(v & 0xFFFFFFFF) * p1), 23) * p2 + p3)
    return (h & np.uint64(SAMPLE_STEPS - 1)).astype(np.int64)


def _grown_here(state: Growth, rounds: int, parts: Sequence[Sequence[tuple]]) -> tuple[list[list[Tree]], list[float]]:
    """Trees and losses of a fit from margin zero over blocks (y, x, tag, row) of parts, sums in the order of :func:`grow`."""
    now = replace(state, trees=[], losses=[])
    classes, outputs, held, rate = now.classes, now.outputs, now.held, float(now.params["learning_rate"])
    margins = [[np.zeros((len(y), outputs)) for y, *_ in part] for part in parts]
    seen: list[list[list[Block]]] = []

    def samples_of(states, rows) -> list[tuple[np.ndarray, np.ndarray]]:
        share = min(1.0, BIN_ROWS / max(1, rows[0]))
        xs, hs = [np.empty((0, now.width))], [np.empty((0, outputs))]
        for p, part in enumerate(seen):
            rng = np.random.default_rng([int(now.params["seed"]), len(now.trees), numbers[p]])
            for (b,) in part:
                at = np.flatnonzero(b.inside)
                if share < 1:
                    at = at[rng.random(len(at)) < share]
                xs.append(b.x[at])
                hs.append(_slopes(b.m[at], b.y[at], classes)[1])
        return [(np.concatenate(xs), np.concatenate(hs))]

    def splits_of(states, sprouts, least) -> list[dict]:
        wanted, found = _wanted(sprouts, len(parts)), []
        whole = [_added_cells(wanted, part, classes) for part in seen]
        for j, (s, nodes) in enumerate(sprouts):
            sizes = [len(e) + 1 for e in s.ends]
            total = sum(cells[j] for cells in whole)
            for p, node in enumerate(nodes):
                split = best_split(total[:, p], sizes, least[s.fit, s.output])
                if split is not None:
                    found.append(dict(zip(_names(SPLITS), (s.fit, s.output, node, *split), strict=True)))
        return found

    numbers = [part[0][4] for part in parts]
    for r in range(rounds + 1):
        seen = []
        for part, own in zip(parts, margins, strict=True):
            seen.append([])
            for (y, x, tag, row, _), m in zip(part, own, strict=True):
                out = tag == held
                inside = ~out if now.limit is None else ~out & (_row_draws(row, int(now.params["seed"]), r) < now.limit)
                seen[-1].append([Block(y, x, out, inside, m, (held, now.limit, 0), {})])
        measured = _measured([_added_sums(part, 1, outputs, classes, True) for part in seen], (1, 3 + 2 * outputs), outputs, True)
        now.losses.append(measured[0][0])
        if r == rounds:
            break
        trees = [finished_tree(t, sums, now.params) for t, sums in _grown([now], measured, samples_of, splits_of)[0]]
        now.trees.append(trees)
        for part, own in zip(parts, margins, strict=True):
            for (_, x, *_), m in zip(part, own, strict=True):
                m += _steps(trees, rate, x)
    return now.trees, now.losses


def grow_here(state: Growth, rounds: int) -> Growth:
    """As :func:`grow` from margin zero, all rounds in one task that holds the rows.

    The same trees: sums go over parts, and samples are drawn in them, as in passes over the blocks. A
    round of few rows takes milliseconds, and each of its jobs a tenth of a second.
    """
    width, told = state.width, replace(state, rows=None)

    def run(batches):
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, y, x, tag, row in zip(*batch.columns, strict=True):
                y, tag = (np.frombuffer(v.as_buffer(), "<i4") for v in (y, tag))
                number = part.as_py()
                block = (y, np.frombuffer(x.as_buffer(), "<f8").reshape(len(y), width), tag, row.values.to_numpy(zero_copy_only=False), number)
                parts.setdefault(number, []).append(block)
        found = _grown_here(told, rounds, [parts[p] for p in sorted(parts)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    frame = state.rows.select(F.spark_partition_id().alias("part"), "y", "x", "tag", "row").coalesce(1)
    trees, losses = pickle.loads(bytes(frame.mapInArrow(run, "found binary").first()[0]))
    return replace(state, trees=trees, losses=losses)


def together(classes: int, settings: Sequence[tuple[Mapping, int]], rounds: int) -> list[list[int]]:
    """Which of the fits, (params, held) each, grow together: those of a seed, in parts of ``MAX_MARGINS`` a row.

    With a single round no margins are stored, and twice as many go together.
    """
    outputs = 1 if classes == 2 else classes
    size = max(1, MAX_MARGINS * (2 if rounds == 1 else 1) // outputs)
    by_seed: dict[int, list[int]] = {}
    for i, (params, _) in enumerate(settings):
        by_seed.setdefault(int(settings_of(params)["seed"]), []).append(i)
    return [own[a : a + size] for own in by_seed.values() for a in range(0, len(own), size)]


def start_together(rows: Packed, classes: int, settings: Sequence[tuple[Mapping, int]]) -> list[Growth]:
    """Fits over the same blocks at margin zero."""
    blocks = rows.rows.withColumn("m", F.lit(None).cast("binary"))
    return [Growth(blocks, classes, settings_of(p), rows.width, held, place=i, fits=len(settings)) for i, (p, held) in enumerate(settings)]


# ---- models ------------------------------------------------------------------------------


@dataclass
class BoostModel:
    """Trees of all rounds; ``losses`` are the mean training loss before and after each round."""

    trees: list[list[Tree]]
    classes: int
    rate: float
    losses: list[float] = field(default_factory=list)
    features: str = "features"

    def with_margins(self, df: DataFrame, name: str = "_margins") -> DataFrame:
        outputs = 1 if self.classes == 2 else self.classes
        known, rate = df.sparkSession.sparkContext.broadcast(self.trees), self.rate

        def build(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), outputs))
            for trees in known.value:
                out += _steps(trees, rate, x)
            return out

        return df.withColumn(name, per_row(F.col(f"`{self.features}`"), "array<double>", build))

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction`` and the vector ``probability``."""
        scored = self.with_margins(df).withColumn("_p", probabilities(F.col("_margins"), self.classes))
        scored = scored.withColumn("probability", array_to_vector("_p")).withColumn("prediction", _predicted(F.col("_margins"), self.classes))
        return scored.drop("_margins", "_p")

    def split_counts(self, names: Sequence[str]) -> dict[str, int]:
        """How many nodes split on each feature; unused ones are absent."""
        counts = sum((t.splits() for trees in self.trees for t in trees), Counter())
        return {names[f]: n for f, n in counts.items()}

    def node_rows(self) -> list[tuple[int, int, int, int, float, float, float, float]]:
        """(round, output, node, feature, threshold, step, gradient, curvature) of all nodes."""
        return [
            (r, k, n, int(t.feature[n]), float(t.threshold[n]), *map(float, t.value[n]))
            for r, trees in enumerate(self.trees, 1)
            for k, t in enumerate(trees)
            for n in range(len(t.feature))
        ]


@dataclass(frozen=True)
class GradientBoost:
    """Settings by the names of :data:`params.NAMES`; ``fit`` and ``transform`` as in ``pyspark.ml``."""

    params: Mapping
    label: str
    classes: int = 2
    features: str = "features"

    def fit(self, df: DataFrame) -> BoostModel:
        rows = packed(df, self.label, self.features, F.lit(0))
        state = start(rows, self.classes, self.params, 1)
        values = rows.rows.agg(F.sum(F.length("x")).alias("bytes")).first()["bytes"] or 0
        grown = grow_here if 0 < values <= 8 * LOCAL_VALUES else grow
        done = grown(state, int(state.params["n_estimators"]))
        done.rows.unpersist()
        rows.kept.unpersist()
        return BoostModel(done.trees, self.classes, float(done.params["learning_rate"]), done.losses, self.features)

    def packed(self, df: DataFrame, fold: str) -> Packed:
        """Rows of all folds, for fits without each of them."""
        return packed(df.where(F.col(f"`{fold}`").isNotNull()), self.label, self.features, F.col(f"`{fold}`"))

    def held_out_counts(self, rows: Packed, fold: int) -> dict[tuple[float, float], int]:
        """(label, prediction) -> rows of a fold, by the model that did not see it."""
        return held_out_counts([self], rows, [fold])[0]


def held_out_counts(
    boosts: Sequence[GradientBoost], rows: Packed, folds: Sequence[int], finished: Callable[[dict[int, dict]], None] = lambda found: None
) -> list[dict[tuple[float, float], int]]:
    """Of each fit (label, prediction) -> rows of its fold, by the model that did not see it.

    The fits have the same label and classes, and grow together; ``finished`` is told the counts, by
    the number of the fit, whenever some of them are done.
    """
    classes = boosts[0].classes
    settings = [(b.params, f) for b, f in zip(boosts, folds, strict=True)]
    rounds = [int(settings_of(p)["n_estimators"]) for p, _ in settings]
    out: list[dict] = [{} for _ in settings]
    for own in together(classes, settings, max(rounds)):
        states = start_together(rows, classes, [settings[i] for i in own])
        done = grow_together(states, [rounds[i] for i in own], closing=False, margins=False, losses=False)
        if done[0].rows is not states[0].rows:
            done[0].rows.unpersist()
        for r in _held_out_cells(states, [d.trees for d in done]).collect():  # classes squared a fit
            out[own[r["fit"]]][float(r["label"]), float(r["prediction"])] = r["n"]
        finished({i: out[i] for i in own})
    return out


def _held_out_cells(states: Sequence[Growth], trees: Sequence[Sequence[Sequence[Tree]]]) -> DataFrame:
    """(fit, label, prediction, n) of the rows that each fit holds out, after all its trees."""
    frame, blocks = _read(states)
    classes, rates = states[0].classes, [float(s.params["learning_rate"]) for s in states]

    def run(batches):
        cells: Counter = Counter()
        for seen in blocks(batches):
            for i, (b, rate, whole) in enumerate(zip(seen, rates, trees, strict=True)):
                x, y = b.known(("out", b.kind[0]), lambda: (b.x[b.held], b.y[b.held]))  # noqa: B023
                margins = b.m[b.held]
                for own in whole:
                    margins = margins + _steps(own, rate, x)
                pairs, counts = np.unique(y * np.int64(classes) + _class_of(margins), return_counts=True)
                for pair, n in zip(pairs.tolist(), counts.tolist(), strict=True):
                    cells[i, *divmod(pair, classes)] += n
        if cells:
            columns = [*zip(*cells, strict=True), cells.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["fit", "label", "prediction", "n"])

    counted = frame.mapInArrow(run, "fit long, label long, prediction long, n long")
    return counted.groupBy("fit", "label", "prediction").agg(F.sum("n").alias("n"))


# ---- rounds ------------------------------------------------------------------------------


def _class_of(margins: np.ndarray) -> np.ndarray:
    """The most probable class, the smallest on ties."""
    return (margins[:, 0] > 0).astype(np.int64) if margins.shape[1] == 1 else np.argmax(margins, axis=1)


def round_misses(states: Sequence[Growth], trees: Sequence[Sequence[Sequence[Tree]]]) -> DataFrame:
    """(fit, round, misses, rows) of the rows each fit holds out after each round of its ``trees`` on top of its margins.

    One pass over the blocks and one aggregation over (fit, round) count them all.
    """
    frame, blocks = _read(states)
    rates = [float(s.params["learning_rate"]) for s in states]

    def run(batches):
        for seen in blocks(batches):
            for i, (b, rate, whole) in enumerate(zip(seen, rates, trees, strict=True)):
                x, y, margins, misses = b.x[b.held], b.y[b.held], b.m[b.held], []
                if not len(y):
                    continue
                for own in whole:
                    margins = margins + _steps(own, rate, x)
                    misses.append(int((_class_of(margins) != y).sum()))
                columns = [[i] * len(whole), range(len(whole)), misses, [len(y)] * len(whole)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["fit", "round", "misses", "rows"])

    counted = frame.mapInArrow(run, "fit long, round long, misses long, rows long")
    return counted.groupBy("fit", "round").agg(F.sum("misses").alias("misses"), F.sum("rows").alias("rows"))


@dataclass
class RoundSearch:
    """Misses on the rows held out, by round (from 1) and fold, and the chosen number of rounds."""

    curve: list[tuple[int, int, int, int]]
    best: int

    def table(self, spark) -> DataFrame:
        rows = [(r, f, n, m, r == self.best) for r, f, n, m in sorted(self.curve)]
        return spark.createDataFrame(rows, "round int, fold int, rows long, misses long, is_best boolean")


def chosen_round(curve: Sequence[tuple[int, int, int, int]], patience: int) -> tuple[int, bool]:
    """(first round with the least mean error over the folds, have ``patience`` rounds passed since)."""
    errors: dict[int, list[float]] = {}
    for r, _, n, m in curve:
        errors.setdefault(r, []).append(m / n if n else 0.0)
    best = None
    for r in sorted(errors):
        mean = sum(errors[r]) / len(errors[r])
        if best is None or mean < best[1]:
            best = (r, mean)
        elif r - best[0] >= patience:
            return best[0], True
    return (best[0] if best else 0), False


def find_rounds(
    df: DataFrame,
    fold: str,
    label: str,
    classes: int,
    params: Mapping,
    patience: int = 50,
    block: int = 10,
    features: str = "features",
    parallelism: int = 2,
) -> RoundSearch:
    """Number of rounds by the share of wrong classes on held-out folds, with early stopping.

    All folds grow a block of rounds together, the misses of all its rounds and folds are counted in one
    aggregation, and the next block goes on from the stored margins, until no round of
    ``patience`` has had a lower mean error or ``n_estimators`` is reached. Rows without fold or
    label take no part. The curve ends where the search does.
    """
    rows = df.where(F.col(f"`{fold}`").isNotNull())
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    if not folds:
        return RoundSearch([], 0)
    tags = {f: i for i, f in enumerate(folds)}
    tag = F.coalesce(*[F.when(F.col(f"`{fold}`") == f, i) for f, i in tags.items()])
    blocks = packed(rows, label, features, tag)
    settings = [(params, i) for i in tags.values()]
    most = int(settings_of(params)["n_estimators"])
    lots = together(classes, settings, most)
    states = [start_together(blocks, classes, [settings[i] for i in own]) for own in lots]
    curve: list[tuple[int, int, int, int]] = []
    best, ended, done = 0, False, 0
    while done < most and not ended:
        size = min(block, most - done)
        with ThreadPool(min(parallelism, len(lots))) as pool:
            grown = pool.map(lambda own: grow_together(own, [size] * len(own), closing=False, losses=False), states, chunksize=1)
        counted = [round_misses(was, [s.trees[done:] for s in now]).withColumn("lot", F.lit(k)) for k, (was, now) in enumerate(zip(states, grown, strict=True))]
        for r in reduce(DataFrame.unionByName, counted).collect():
            curve.append((done + r["round"] + 1, folds[lots[r["lot"]][r["fit"]]], r["rows"], r["misses"]))
        for own in states:
            own[0].rows.unpersist()
        states, done = grown, done + size
        best, ended = chosen_round(curve, patience)
    for own in states:
        own[0].rows.unpersist()
    blocks.kept.unpersist()
    last = best + patience if ended else done
    return RoundSearch([c for c in curve if c[0] <= last], best)


def rounds_by_rate(df: DataFrame, fold: str, label: str, classes: int, params: Mapping, rates: Sequence[float], **how) -> dict[float, RoundSearch]:
    """The search for each learning rate."""
    return {rate: find_rounds(df, fold, label, classes, {**params, "learning_rate": rate}, **how) for rate in rates}
