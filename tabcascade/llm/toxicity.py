"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own hashed vector plus the mean vector of its character trigrams, so that
unseen and altered words are read by their letters. Whole texts are cut into overlapping
windows; the score of a document is that of its highest window.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm import gru
from tabcascade.llm.common import chunks, mix, text_rows
from tabcascade.llm.quality import labelled_sample

WORD_ROWS, CHAR_ROWS = 8192, 4096
EMBED, HIDDEN = 14, 10
WINDOW, STRIDE = 40, 20
SAMPLE = 800
EPOCHS = 8
BATCH = 32
DECAY = 2e-4
CHUNK_BYTES = 1 << 21
MEMO_WORDS = 250_000
THRESHOLD = 0.5
_MARKS = b".,;:!?\"'()[]{}<>*&%$#@|-_/\\"


class _Numbers(dict):
    """Words numbered in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class GateTables:
    """Both directions' gate inputs of words, for one model; the first words seen are remembered."""

    def __init__(self, model: "ToxicityModel"):
        self.model, self.known, self.rows = model, _Numbers(), np.zeros((0, 6 * HIDDEN), np.float32)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table, rows of all words one after the other, words of each text)."""
        if len(self.known) > MEMO_WORDS:
            late = _Numbers(zip(list(self.known)[:MEMO_WORDS], range(MEMO_WORDS), strict=True))
            self.known, self.rows = late, self.rows[:MEMO_WORDS]
        had = len(self.known)
        codes, counts = numbered(texts, self.known)
        fresh = list(itertools.islice(self.known, had, None))
        vectors, _ = self.model.embed(fresh)
        p = self.model.params
        gates = np.hstack([vectors @ p["wf"] + p["cf"], vectors @ p["wb"] + p["cb"]])
        self.rows = np.vstack([self.rows, gates]) if len(gates) else self.rows
        return self.rows, codes, counts


def numbered(texts: list[bytes], known: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    codes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts = t.lower().split()
        counts[i] = len(parts)
        codes.extend(map(known.__getitem__, parts))
    return np.array(codes, np.int64), counts


def tokenize(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, their positions in all texts one after the other, words of each text).

    A-Z are lower-cased, marks at the ends of a word are taken off.
    """
    known = _Numbers()
    codes, counts = numbered(texts, known)
    return list(known), codes, counts


def word_rows(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of all trigrams, first trigram of each word)."""
    bare = [w.strip(_MARKS) for w in vocabulary]
    flat = np.frombuffer(b"\x00" + b"\x00".join(bare) + b"\x00\x00", np.uint8).astype(np.uint64)
    three = flat[:-2] * np.uint64(65536) + flat[1:-1] * np.uint64(256) + flat[2:]
    # one trigram per letter, centred on it; an empty word has the trigram of its separators
    letters = np.fromiter(map(len, bare), np.int64, len(bare))
    lengths = np.maximum(1, letters)
    starts = np.cumsum(letters + 1) - letters - 1
    first = np.cumsum(lengths) - lengths
    at = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    tri = three[at]
    offset = np.arange(len(tri)) - np.repeat(first, lengths)
    row = np.add.reduceat(mix(tri + np.uint64(0x9E3779B97F4A7C15) * offset.astype(np.uint64)), first) if len(bare) else np.empty(0, np.uint64)
    return (row % np.uint64(WORD_ROWS)).astype(np.int64), (mix(tri) % np.uint64(CHAR_ROWS)).astype(np.int64), first


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions (windows, WINDOW) into all words, -1 beyond the text; document of each window)."""
    per_doc = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    begin = np.cumsum(counts) - counts
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < counts[doc][:, None], begin[doc][:, None] + at, -1), doc


@dataclass(frozen=True)
class ToxicityModel:
    params: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int = 3) -> "ToxicityModel":
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": normal(0.1, WORD_ROWS, EMBED), "char": normal(0.1, CHAR_ROWS, EMBED)}
        for d in "fb":
            p |= {f"w{d}": normal(EMBED**-0.5, EMBED, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN)}
        return cls(p | {"attend": normal(0.3, 2 * HIDDEN), "out": normal(0.5, 2 * HIDDEN), "bias": np.zeros(1, np.float32)})

    def embed(self, vocabulary: list[bytes], known: np.ndarray | None = None):
        """Input vectors of words; where ``known`` is 0 a word is read by its letters alone."""
        rows, tri, first = word_rows(vocabulary)
        known = np.ones((len(rows), 1), np.float32) if known is None else known
        if not len(rows):
            return np.zeros((0, EMBED), np.float32), (rows, tri, np.empty(0, np.int64), known)
        sizes = np.diff(np.r_[first, len(tri)])
        return self.params["word"][rows] * known + np.add.reduceat(self.params["char"][tri], first) / sizes[:, None].astype(np.float32), (rows, tri, sizes, known)

    def run(self, vectors: np.ndarray, codes: np.ndarray):
        """Logits of windows (n, WINDOW) of word numbers, -1 for none, and what the gradient needs."""
        p = self.params
        mask = (codes >= 0).T
        x = np.vstack([vectors, np.zeros((1, EMBED), np.float32)])
        seen = {}
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            table = x @ p[f"w{d}"] + p[f"c{d}"]
            m = mask[order]
            states, kept = gru.forward(table[codes.T[order]], p[f"u{d}"], np.zeros((len(codes), HIDDEN), np.float32), m)
            seen[d] = (states, kept, m)
        h = np.concatenate([seen["f"][0][1:], seen["b"][0][1:][::-1]], 2)
        a = h @ p["attend"]
        a = np.where(mask, a, np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pool = np.einsum("tb,tbh->bh", a, h)
        return pool @ p["out"] + p["bias"][0], (x, codes, mask, seen, h, a, pool)

    def logits(self, gates: np.ndarray, codes: np.ndarray, batch: int = 1024) -> np.ndarray:
        """What :meth:`run` says, for many windows, from both directions' gate inputs of words. A
        missing word keeps the state, because its update gate is held open."""
        p, none = self.params, np.zeros((1, 3 * HIDDEN), np.float32)
        none[0, :HIDDEN] = 60
        out = []
        for k in range(0, len(codes), batch):
            own, local = np.unique(codes[k : k + batch], return_inverse=True)
            part = np.ascontiguousarray(local.reshape(-1, WINDOW).T)
            missing = own[0] < 0
            ff, fb = (np.ascontiguousarray((np.vstack([none, gates[own[1:], c]]) if missing else gates[own, c]).T) for c in (slice(0, 3 * HIDDEN), slice(3 * HIDDEN, None)))
            forth = gru.final_states(ff, part, p["uf"])
            back = gru.final_states(fb, part[::-1], p["ub"])[::-1]
            a = p["attend"][:HIDDEN] @ forth + p["attend"][HIDDEN:] @ back
            if missing:
                a = np.where(part > 0, a, np.float32(-30))
            a = np.exp(a - a.max(0))
            a /= a.sum(0)
            said = p["out"][:HIDDEN] @ forth + p["out"][HIDDEN:] @ back
            out.append((a * said).sum(0) + p["bias"][0])
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def gradient(self, dlogit: np.ndarray, kept, words) -> dict[str, np.ndarray]:
        p, (x, codes, mask, seen, h, a, pool) = self.params, kept
        rows, tri, sizes, known = words
        g = {"out": pool.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dpool, h)
        ds = a * (da - (a * da).sum(0)) * mask
        g["attend"] = np.einsum("tb,tbh->h", ds, h)
        dh = a[:, :, None] * dpool + ds[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for d, order, part in (("f", slice(None), dh[:, :, :HIDDEN]), ("b", slice(None, None, -1), dh[::-1, :, HIDDEN:])):
            states, steps, m = seen[d]
            dgates, g[f"u{d}"] = gru.backward(part, states, steps, p[f"u{d}"], m)
            flat = dgates.reshape(-1, 3 * HIDDEN)
            at = codes.T[order].reshape(-1)
            per_word = gru.row_sums(np.where(at < 0, len(x) - 1, at), flat * (at >= 0)[:, None], len(x))
            g[f"w{d}"], g[f"c{d}"] = x.T @ per_word, per_word.sum(0)
            dx += per_word @ p[f"w{d}"].T
        dx = dx[:-1]
        g["word"] = gru.row_sums(rows, (dx * known).astype(np.float32), WORD_ROWS)
        g["char"] = gru.row_sums(tri, np.repeat(dx / sizes[:, None], sizes, 0).astype(np.float32), CHAR_ROWS)
        return g

    def document_logits(self, texts: list[bytes], tables: GateTables | None = None) -> np.ndarray:
        gates, codes, counts = (tables or GateTables(self)).of(texts)
        at, doc = windows(counts)
        logits = self.logits(gates, np.where(at >= 0, codes[at] if len(codes) else -1, -1))
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, doc, logits)
        return out


def fit_network(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3, rate: float = 0.01) -> ToxicityModel:
    """Two epochs on windows drawn from each document, then on each document's highest window. Half
    of the words, drawn anew for each step, are read by their letters alone."""
    model = ToxicityModel.start(seed)
    if not len(texts) or labels.min() == labels.max():
        flat = {k: v * 0 for k, v in model.params.items()}
        flat["bias"] = flat["bias"] + np.float32(4 if len(texts) and labels.max() else -4)
        return ToxicityModel(flat)
    rng, adam = np.random.default_rng(seed), gru.Adam(model.params, rate)
    vocabulary, codes, counts = tokenize(texts)
    at, doc = windows(counts)
    numbers = np.where(at >= 0, codes[at] if len(codes) else -1, -1)
    begin = np.searchsorted(doc, np.arange(len(texts)))
    per_doc = np.bincount(doc, minlength=len(texts))
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum()))).astype(np.float32)
    for epoch in range(epochs):
        if epoch < 2:
            chosen = begin + rng.integers(0, per_doc)
        else:
            gates, _, _ = GateTables(model).of([b" ".join(vocabulary)])
            logits = model.logits(gates, numbers)
            order = np.lexsort((-logits, doc))
            chosen = order[begin]
        for some in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            own, local = np.unique(numbers[chosen[some]], return_inverse=True)
            shift = int(len(own) > 0 and own[0] < 0)
            vectors, words = model.embed([vocabulary[w] for w in own[shift:]], (rng.random((len(own) - shift, 1)) < 0.5).astype(np.float32))
            logit, kept = model.run(vectors, local.reshape(len(some), WINDOW) - shift)
            d = ((gru.sigmoid(logit) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            grads = model.gradient(d, kept, words)
            grads |= {k: grads[k] + DECAY * model.params[k] for k in ("word", "char")}
            adam.update(model.params, grads)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn=lambda c: F.lit(True), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """From at most ``sample`` labelled documents of each label, chosen by a hash of the id."""
    rows = labelled_sample(docs, labels, "toxic", learn, sample, id_col, text_col).toArrow().sort_by([("doc_id", "ascending")])
    return fit_network(rows.column("text").to_pylist(), np.asarray(rows.column("label"), dtype=np.float32))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row, from all overlapping windows of the whole text.

    Null and empty texts are one empty window. Repeated rows are scored each for itself, an
    empty table gives no rows. Columns other than the two named are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tables = GateTables(sent.value)
        for batch in batches:
            scores = [gru.sigmoid(sent.value.document_logits(part, tables)) for part in chunks(batch.column(1).to_pylist(), len, CHUNK_BYTES)]
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    scored = text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
