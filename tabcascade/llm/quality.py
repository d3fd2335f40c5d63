"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token class has a sparse random index vector. The vector of a class is the sum of the
index vectors of the tokens beside it, over all documents. A document is pooled from the vectors
of its tokens; a two-layer network gives its logit and one temperature calibrates it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.common import buckets, remember, shared, small_enough, task_of, text_hash, text_rows

CLASSES = 2048
DIM = 48
NONZERO = 4
WINDOW = 2
HIDDEN = 24
SAMPLE = 4_000
MEMO = 100_000
THRESHOLD = 0.7
_PART = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+")
SHAPES = 6  # leading classes: capitals, capitalised, digits, marks by length, long words


class TokenClasses(dict):
    """Chunk between spaces -> bytes of int16 classes: each part's shape and its spelling."""

    def __missing__(self, chunk: bytes) -> bytes:
        out = []
        for part in _PART.findall(chunk):
            c = part[:1]
            if c.isdigit():
                out.append(0)
            elif not (c.isalpha() or c >= b"\x80"):
                out.append(1 if len(part) == 1 else 2)
                out.append(SHAPES + xxhash.xxh32_intdigest(part[:4]) % (CLASSES - SHAPES))
            else:
                letters = part.decode("utf-8", "replace")
                if len(letters) > 1 and letters.isupper():
                    out.append(3)
                elif len(letters) > 20:
                    out.append(4)
                out.append(SHAPES + xxhash.xxh32_intdigest(letters.lower().encode()) % (CLASSES - SHAPES))
        found = np.array(out, np.int16).tobytes()
        if len(self) < MEMO:
            self[chunk] = found
        return found


_classes = TokenClasses()
remember("quality", _classes.clear)


def token_classes(text: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(map(_classes.__getitem__, text.split())), np.int16).astype(np.int64)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero entries, CLASSES x NONZERO each."""
    rng = np.random.default_rng(seed)
    at = np.stack([rng.choice(DIM, NONZERO, replace=False) for _ in range(CLASSES)])
    return at, rng.choice([-1, 1], (CLASSES, NONZERO))


def context_sums(codes: np.ndarray, breaks: np.ndarray, at: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """CLASSES x DIM integer sums of the neighbours' index vectors; ``breaks`` marks first tokens."""
    total = np.zeros(CLASSES * DIM)
    part = np.cumsum(breaks)
    for k in range(1, WINDOW + 1):
        same = part[k:] == part[:-k]
        left, right = codes[:-k][same], codes[k:][same]
        for z in range(NONZERO):
            total += np.bincount(left * DIM + at[right, z], weights=sign[right, z], minlength=CLASSES * DIM)
            total += np.bincount(right * DIM + at[left, z], weights=sign[left, z], minlength=CLASSES * DIM)
    return np.rint(total).astype(np.int64)


def word_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """CLASSES x DIM unit vectors from all documents; only this table comes to the driver."""
    at, sign = index_vectors()

    def run(batches):
        task_of("quality")
        total = np.zeros(CLASSES * DIM, np.int64)
        for batch in batches:
            parts = [token_classes(t) for t in batch.column(0).to_pylist()]
            parts = [p for p in parts if len(p)]
            for k in range(0, len(parts), 1000):
                some = parts[k : k + 1000]
                breaks = np.zeros(sum(map(len, some)), np.int64)
                breaks[np.cumsum([0, *map(len, some)])[:-1]] = 1
                total += context_sums(np.concatenate(some), breaks, at, sign)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell])], ["cell", "value"])

    sums = text_rows(docs, id_col, text_col).select("text").mapInArrow(run, "cell long, value long")
    table = sums.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    vectors = np.zeros(CLASSES * DIM)
    vectors[np.asarray(table.column("cell"))] = np.asarray(table.column("value"))
    vectors = vectors.reshape(CLASSES, DIM)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, share of each shape, and how often a token repeats."""
    codes = token_classes(text)
    n = len(codes)
    if not n:
        return np.zeros(2 * DIM + SHAPES + 4, np.float32)
    counts = np.bincount(codes, minlength=CLASSES)
    used = np.flatnonzero(counts)
    share = (counts[used] / n).astype(np.float32)
    mean = share @ vectors[used]
    spread = np.sqrt(np.maximum(share @ vectors[used] ** 2 - mean**2, 0))
    again = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    more = [again, float((share**2).sum()), np.log1p(n) / 10, len(used) / n]
    return np.concatenate([mean, spread, counts[:SHAPES] / n, more]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum((features - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def fit_network(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, epochs: int = 60, seed: int = 5) -> QualityModel:
    """Train by Adam on four fifths of the rows, with equal weight for both labels; the rest sets
    the temperature. With one label only, the network is a constant."""
    features, labels = features.astype(np.float64), labels.astype(np.float64)
    n, d = features.shape
    rng = np.random.default_rng(seed)
    centre, scale = (features.mean(0), features.std(0) + 1e-3) if n else (np.zeros(d), np.ones(d))
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    ones = labels.sum()
    if not 0 < ones < n:
        w = [x * 0 for x in w]
        w[3] = w[3] + (0.0 if n == 0 else 4.0 if ones else -4.0)
        return QualityModel(vectors, centre, scale, *w[:3], float(w[3][0]), 1.0)
    order = rng.permutation(n)
    train, held = order[: max(1, n * 4 // 5)], order[max(1, n * 4 // 5) :]
    weight = np.where(labels == 1, n / (2 * ones), n / (2 * (n - ones)))
    x = (features - centre) / scale
    first, second, step = [0 * p for p in w], [0 * p for p in w], 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for k in range(0, len(train), 64):
            at = mixed[k : k + 64]
            hidden = np.maximum(x[at] @ w[0] + w[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))
            g = (p - labels[at]) * weight[at] / len(at)
            back = np.outer(g, w[2]) * (hidden > 0)
            grads = [x[at].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                w[i] = w[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, centre, scale, *w[:3], float(w[3][0]), 1.0)
    at = held if len(held) else train
    z, y = model.logits(features[at]), labels[at]
    grid = np.geomspace(0.25, 8, 60)
    loss = [np.mean(np.logaddexp(0, -np.where(y == 1, z, -z) / t)) for t in grid]
    return QualityModel(vectors, centre, scale, *w[:3], float(w[3][0]), float(grid[int(np.argmin(loss))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``limit`` documents of each label, the first by a hash of the id.

    ``learn`` says which ids may be learned from. Null labels and ids are left out, a label that
    is repeated counts once, of conflicting labels the larger holds.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn("doc_id")).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    parts = [known.where(F.col("label") == v).orderBy(order).limit(limit) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = text_rows(docs, id_col, text_col)
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn=lambda c: F.lit(True), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all documents; the network from at most ``sample`` labelled rows a label."""
    vectors = word_vectors(docs, id_col, text_col)
    rows = labelled_sample(docs, labels, "quality", learn, sample, id_col, text_col)
    width = 2 * DIM + SHAPES + 4

    def run(batches):
        for batch in batches:
            features = [pooled(t, vectors) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(features, pa.list_(pa.float32()))], ["doc_id", "label", "features"])

    table = rows.mapInArrow(run, "doc_id long, label int, features array<float>").toArrow().sort_by([("doc_id", "ascending")])
    features = np.array(table.column("features").to_pylist(), np.float32).reshape(-1, width)
    return fit_network(features, np.asarray(table.column("label"), dtype=np.float64), vectors)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, row_hash, predicted) of each row; null and empty texts are scored as no tokens.

    ``score`` is the calibrated probability of quality 1, ``predicted`` is 1 where it is at least
    ``threshold``. Repeated rows are scored each for itself, an empty table gives no rows.
    ``row_hash`` is the xxhash64 of the whole text.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        task_of("quality")
        m = shared_model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            p = m.probability(np.stack([pooled(t, m.vectors) for t in texts]))
            hashes = pa.array([text_hash(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), hashes], ["doc_id", "score", "row_hash"])

    scored = text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, row_hash long")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted_rows(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    Only keys and scores pass through Python. Rows of one id and text share their score, so all of
    them stay or go; a null id is an id of its own.
    """
    gone = score(docs, model, threshold, id_col, text_col).where("predicted = 0").select("doc_id", "row_hash").distinct()
    gone = shared(gone.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")), "rejected")
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    known = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__hash"))
    return docs.join(small_enough(gone, gone.count(), 32), known, "left_anti")


def learn_from(mod: int, remainder: int):
    """Ids whose crc32 of their text, modulo ``mod``, is not ``remainder``."""
    return lambda c: buckets(c, mod) != remainder
