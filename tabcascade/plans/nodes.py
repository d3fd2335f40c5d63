"""Trees as node tables: read off fitted or stored models, scored in one pass over the rows."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabcascade.plans.ledger import side_by_side


@dataclass(frozen=True)
class Tree:
    """Row k of the table splits on ``feature[k]`` at ``threshold[k]``, or is a leaf (feature -1).

    Values up to the threshold go left. ``value`` has a row for each node and a column for each
    number that a leaf says.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row of ``x`` ends."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            left = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)

    def splits(self) -> Counter:
        return Counter(self.feature[self.feature >= 0].tolist())


def leaf_tree(value: Sequence[float] = (0.0,)) -> Tree:
    return Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.array([value], float))


#: Stored models that are written or read side by side.
READERS = 8

# ---- stored models ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """One model as trees: the class with the largest weighted sum wins, the smallest on ties."""

    trees: list[Tree]
    weights: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(w * t.value[t.leaves(x)] for w, t in zip(self.weights, self.trees, strict=True))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.scores(x), axis=1)


def _told(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def tree_path(spark: SparkSession, path: str) -> str:
    """The folder of the tree model itself; of a stored pipeline its only stage."""
    told = _told(spark, path)
    if not told["class"].endswith(".PipelineModel"):
        return path
    uids = told["paramMap"]["stageUids"]
    if len(uids) != 1:
        raise ValueError(f"{path}: a pipeline of {len(uids)} stages")
    return f"{path}/stages/0_{uids[0]}"


def node_rows(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, threshold, left_child, right_child, prediction, stats) of a stored tree model."""
    rows = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in rows.columns else F.lit(0)
    rows = rows.select(tree.alias("tree"), "nodeData.*") if "nodeData" in rows.columns else rows.withColumn("tree", tree)
    return rows.select(
        "tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), F.col("split.numCategories").alias("categories"),
        F.col("leftChild").alias("left_child"), F.col("rightChild").alias("right_child"), "prediction", F.col("impurityStats").alias("stats"),
    )


def stored_member(spark: SparkSession, path: str) -> Member:
    """A stored decision tree, forest or boosted classifier over numeric features.

    Its node table is as large as the model, which one driver fitted and every task holds when
    it scores; rows of data are not read.
    """
    path = tree_path(spark, path)
    kind = _told(spark, path)["class"].rsplit(".", 1)[1]
    nodes = node_rows(spark, path).toPandas().sort_values(["tree", "node"])
    if (nodes["categories"] >= 0).any():
        raise ValueError(f"{path}: splits over categories are not read")
    boosted = kind.startswith("GBT")
    if not boosted and "Classification" not in kind:
        raise ValueError(f"{path}: {kind} is no classifier of trees")
    trees = []
    for _, own in nodes.groupby("tree"):
        if boosted:
            margin = own["prediction"].to_numpy(float)
            value = np.stack([-margin, margin], axis=1)
        else:
            stats = np.stack(own["stats"].to_numpy()).astype(float)
            total = stats.sum(axis=1, keepdims=True)
            value = np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)
        whole = [own[c].to_numpy(np.int64) for c in ("feature", "left_child", "right_child")]
        trees.append(Tree(whole[0], own["threshold"].fillna(0).to_numpy(float), whole[1], whole[2], value))
    weights = [1.0] * len(trees)
    if boosted:
        # columns by place: their names depend on the version that wrote them
        told = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").select("treeID", "weights").toPandas().sort_values("treeID")
        weights = told["weights"].tolist()
    return Member(trees, weights)


def stored_split_counts(spark: SparkSession, path: str) -> dict[int, int]:
    """How many nodes of a stored model split on each feature, counted where the nodes lie."""
    inner = node_rows(spark, tree_path(spark, path)).where("left_child >= 0")
    return {r["feature"]: r["count"] for r in inner.groupBy("feature").count().collect()}


# ---- scoring ---------------------------------------------------------------------------


def matrix(rows: pa.Array) -> np.ndarray:
    flat = np.asarray(rows.flatten(), float)
    return flat.reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def per_row(features: Column, kind: str, build: Callable[[np.ndarray], list | np.ndarray]) -> Column:
    """A column from the matrix of features, a batch at a time."""
    inner = {"array<double>": pa.float64(), "array<long>": pa.int64(), "int": pa.int32()}[kind]

    @F.arrow_udf(kind)
    def score(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], inner if kind == "int" else pa.list_(inner))
        found = build(matrix(rows))
        if kind == "int":
            return pa.array(found, inner)
        ends = np.cumsum([0, *map(len, found)]) if isinstance(found, list) else np.arange(len(found) + 1) * found.shape[1]
        flat = np.concatenate(found) if isinstance(found, list) else found.reshape(-1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, inner))

    return score(vector_to_array(features))


#: Leaves of the trees that share a word, and rows that go through all words at once.
WORD, STRIP = 64, 4096


def _leaf_order(tree: Tree) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Leaves from left to right, and (node, first leaf, end) of what lies to the left of each inner node."""
    leaves: list[int] = []
    spans: list[tuple[int, int, int]] = []

    def walk(node: int) -> None:
        if tree.feature[node] < 0:
            leaves.append(node)
            return
        first = len(leaves)
        walk(int(tree.left[node]))
        spans.append((node, first, len(leaves)))
        walk(int(tree.right[node]))

    walk(0)
    return leaves, spans


class Family:
    """Members whose trees are scored together.

    After Lucchese et al., "QuickScorer", 2015: a leaf is a bit, a value that goes right at a node
    strikes out the leaves to its left, and the first leaf that is left is the one reached. What a
    value strikes out of all trees of a word is read from a table by its place among all
    thresholds of its feature. Larger trees are walked.
    """

    def __init__(self, members: Sequence[Member]):
        self.members = list(members)
        trees = [(i, j, t) for i, m in enumerate(members) for j, t in enumerate(m.trees)]
        ends: dict[int, np.ndarray] = {}
        for f in sorted({int(f) for _, _, t in trees for f in t.feature if f >= 0}):
            ends[f] = np.unique(np.concatenate([t.threshold[t.feature == f] for _, _, t in trees]))
        self.ends = ends
        #: (place of the first bit, leaves, values of the leaves) of each tree; words[k] is the word of the tree, None: walked
        self.place: dict[tuple[int, int], tuple[int, int, int, np.ndarray]] = {}
        self.words: list[dict[int, np.ndarray]] = []
        room = 0
        for i, j, t in trees:
            leaves, spans = _leaf_order(t)
            if len(leaves) > WORD:
                continue
            if len(leaves) > room:
                self.words.append({})
                room = WORD
            first, word = WORD - room, self.words[-1]
            room -= len(leaves)
            self.place[i, j] = (len(self.words) - 1, first, len(leaves), members[i].weights[j] * t.value[leaves])
            for node, a, b in spans:
                f = int(t.feature[node])
                table = word.setdefault(f, np.full(len(ends[f]) + 1, np.iinfo(np.uint64).max, np.uint64))
                table[int(np.searchsorted(ends[f], t.threshold[node])) + 1 :] &= ~np.uint64(((1 << (b - a)) - 1) << (first + a))

    def predictions(self, x: np.ndarray) -> np.ndarray:
        """(members, rows): the class of each member."""
        out = np.empty((len(self.members), len(x)), np.int32)
        for a in range(0, len(x), STRIP):
            self._strip(x[a : a + STRIP], out[:, a : a + STRIP])
        return out

    def _strip(self, x: np.ndarray, out: np.ndarray) -> None:
        bins = {f: np.searchsorted(e, x[:, f]) for f, e in self.ends.items()}
        words = []
        for tables in self.words:
            left = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
            for f, table in tables.items():
                left &= table[bins[f]]
            words.append(left)
        for i, member in enumerate(self.members):
            total = 0.0
            for j, (tree, weight) in enumerate(zip(member.trees, member.weights, strict=True)):
                if (i, j) not in self.place:
                    total = total + weight * tree.value[tree.leaves(x)]
                    continue
                word, first, size, value = self.place[i, j]
                if size == 1:
                    total = total + value[0]
                    continue
                left = words[word] >> np.uint64(first) if first else words[word]
                # the lowest bit as a power of two, whose exponent is its place
                low = (left & (~left + np.uint64(1))).astype(np.float64)
                total = total + value[(low.view(np.int64) >> 52) - 1023]
            out[i] = np.argmax(np.broadcast_to(total, (len(x), np.shape(total)[-1])), axis=1)

    def votes(self, x: np.ndarray, labels: int) -> np.ndarray:
        """How many members vote for each label, per row."""
        counts = np.zeros((len(x), labels), np.int64)
        rows = np.arange(len(x))
        for own in self.predictions(x):
            counts[rows, own] += 1
        return counts


def two_stages(first: Family, second: Family, reasons: int, x: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tally of the first family, rows that the second one sees, their tally); with ``whole`` it sees all rows."""
    tally = first.votes(x, 2)
    go = np.arange(len(x)) if whole else np.flatnonzero(np.argmax(tally, axis=1) == 1)
    return tally, go, second.votes(x[go], reasons)


@dataclass(frozen=True)
class StoredCascade:
    """Two families of stored models: does it happen, and if so for which reason.

    All members are scored in one pass over the rows; the second family sees those rows alone
    that the first one marks. Votes go to the smallest label on ties.
    """

    first: list[Member]
    second: list[Member]
    reasons: int

    @classmethod
    def load(cls, spark: SparkSession, first: Sequence[str], second: Sequence[str], reasons: int) -> StoredCascade:
        """From the folders of the members' tree models."""
        found = side_by_side(spark, [lambda p=p: stored_member(spark, p) for p in [*first, *second]], READERS)
        return cls(found[: len(first)], found[len(first) :], reasons)

    def score(self, df: DataFrame, out: str, features: str = "features", keep_votes: bool = False) -> DataFrame:
        """``out`` is 0, or 1 + the second stage's label; ``keep_votes`` adds both tallies of votes.

        Rows without features get NULL. The second tally is empty where the first stage says 0.
        """
        known = df.sparkSession.sparkContext.broadcast((Family(self.first), Family(self.second)))
        reasons = self.reasons

        def build(x: np.ndarray) -> list:
            tally, go, more = two_stages(*known.value, reasons, x)
            found = list(tally)
            for k, row in zip(go.tolist(), np.concatenate([tally[go], more], axis=1), strict=True):
                found[k] = row
            return found

        some = df.withColumn("_tally", F.when(F.col(features).isNotNull(), per_row(F.col(features), "array<long>", build)))
        first, second = F.slice("_tally", 1, 2), F.slice("_tally", 3, reasons)

        def largest(counts: Column) -> Column:
            return F.array_position(counts, F.array_max(counts)).cast("int")

        label = F.when(largest(first) == 1, F.lit(0)).otherwise(largest(second))
        scored = some.withColumn(out, F.when(F.col("_tally").isNotNull(), label))
        if keep_votes:
            scored = scored.withColumn(f"{out}_first", first).withColumn(f"{out}_second", second)
        return scored.drop("_tally")

    def stages(self, df: DataFrame, first: str, second: str, features: str = "features", whole: bool = False) -> DataFrame:
        """The vote of each stage. The second one sees the rows that the first marks, and says 0 of others; with ``whole`` it sees all."""
        known = df.sparkSession.sparkContext.broadcast((Family(self.first), Family(self.second)))
        reasons = self.reasons

        def build(x: np.ndarray) -> np.ndarray:
            tally, go, more = two_stages(*known.value, reasons, x, whole)
            found = np.zeros(len(x), np.int32)
            found[go] = 2 * (1 + np.argmax(more, axis=1))
            return found + (np.argmax(tally, axis=1) == 1)

        told = df.withColumn("_stages", per_row(F.col(features), "int", build))
        return told.withColumns({first: F.col("_stages") % 2, second: F.shiftright("_stages", 1)}).drop("_stages")
