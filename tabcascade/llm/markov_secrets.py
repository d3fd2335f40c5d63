"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order Markov models over the characters of :data:`ALPHABET` are counted in one pass
over all documents: transitions inside strings that the fixed patterns mark as secrets, and
transitions inside all other runs. A run of at least ``MIN_RUN`` characters is reported when its
log-likelihood ratio is high, in total and per character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm.common import text_rows

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs only, so a minimum says the same as dropping short matches
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
_CODE = np.full(256, SIZE, np.uint8)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(SIZE)
MIN_RUN = 12  # a shorter run of random letters and digits does not reach MIN_TOTAL
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
# Natural logarithms: a prior against random strings, and the least gain per transition.
MIN_TOTAL, MIN_MEAN = 14.0, 0.7


def base_spans(raw: bytes, text: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in code points, sorted."""
    found: list[tuple[int, int, int]] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        text = raw.decode("utf-8", "replace") if text is None else text
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    access, hexes = _byte_runs(raw)
    if access or hexes:
        at = _points(raw)
        found += [(at(a), 1, at(b)) for a, b in access] + [(at(a), 2, at(b)) for a, b in hexes]
    return sorted(found)


_ACCESS_B, _HEX_B = re.compile(ACCESS.pattern.encode()), re.compile(HEX.pattern.encode())


def _byte_runs(raw: bytes) -> tuple[list, list]:
    """Byte spans of access keys and hexadecimal runs; their characters are single bytes."""
    return [m.span() for m in _ACCESS_B.finditer(raw)] if b"AKIA" in raw else [], [m.span() for m in _HEX_B.finditer(raw)]


def _points(raw: bytes):
    """Byte position -> code point position."""
    if raw.isascii():
        return lambda k: k
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return lambda k: int(before[k])


def secret_strings(raw: bytes) -> list[bytes]:
    """The strings that base spans label as secrets (the value only, for assignments)."""
    low, out = raw.lower(), []
    if any(k in low for k in _KEYWORDS):
        out += [m[2].encode() for m in ASSIGN.finditer(raw.decode("utf-8", "replace")) if len(m[2]) >= 6]
    access, hexes = _byte_runs(raw)
    return out + [raw[a:b] for a, b in access + hexes]


def transitions(raw: bytes) -> np.ndarray:
    """SIZE x SIZE counts of neighbouring characters that are both in the alphabet."""
    code = _CODE[np.frombuffer(raw, np.uint8)].astype(np.int64)
    return np.bincount(code[:-1] * (SIZE + 1) + code[1:], minlength=(SIZE + 1) ** 2)[: (SIZE + 1) ** 2].reshape(SIZE + 1, SIZE + 1)[:SIZE, :SIZE]


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio, random to ordinary, of each transition."""

    ratio: np.ndarray

    @classmethod
    def fit(cls, secret: np.ndarray, ordinary: np.ndarray) -> "MarkovModel":
        """From transition counts. Random strings are a mixture: what the labelled secrets show,
        smoothed by uniform letters and digits, which also stand in when there are none."""

        def logs(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
            counts = counts + prior
            return np.log(counts / counts.sum(1, keepdims=True))

        uniform = np.ones((SIZE, SIZE))
        uniform[:, 62:] = 0.25
        weight = 200.0
        flat = secret.sum(0) + weight * uniform[0] / uniform[0].sum()
        even = 0.5 * flat / flat.sum() + 0.5 * uniform[0] / uniform[0].sum()
        random = logs(secret * min(1.0, 20_000 / max(1.0, secret.sum())), 50.0 * SIZE * even[None, :] * np.ones((SIZE, 1)))
        unigram = ordinary.sum(0) + 1.0
        plain = logs(ordinary, 4.0 * unigram[None, :] / unigram.sum() + 0.02)
        return cls(random - plain)

    def score(self, run: bytes) -> tuple[float, float]:
        """(total, mean per transition) of a run of alphabet characters."""
        code = _CODE[np.frombuffer(run, np.uint8)]
        gains = self.ratio[code[:-1], code[1:]]
        return float(gains.sum()), float(gains.mean())

    def is_secret(self, run: bytes) -> bool:
        total, mean = self.score(run)
        return total >= MIN_TOTAL and mean >= MIN_MEAN


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MarkovModel:
    """Count both models over all documents; only two SIZE x SIZE tables come to the driver."""

    def run(batches):
        secret, every = np.zeros((SIZE, SIZE), np.int64), np.zeros((SIZE, SIZE), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if len(raw) > 1:
                    every += transitions(raw)
                    for s in secret_strings(raw):
                        if len(s) > 1:
                            secret += transitions(s)
        ordinary = np.maximum(every - secret, 0)
        cell = np.flatnonzero((secret + ordinary).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(secret.ravel()[cell]), pa.array(ordinary.ravel()[cell])], ["cell", "secret", "ordinary"])

    counts = text_rows(docs, id_col, text_col).select("text").mapInArrow(run, "cell long, secret long, ordinary long")
    table = counts.groupBy("cell").agg(F.sum("secret").alias("secret"), F.sum("ordinary").alias("ordinary")).toArrow()
    both = np.zeros((2, SIZE * SIZE))
    both[:, np.asarray(table.column("cell"))] = [np.asarray(table.column("secret")), np.asarray(table.column("ordinary"))]
    return MarkovModel.fit(*both.reshape(2, SIZE, SIZE))


def scan(docs: DataFrame, model: MarkovModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (start, kind, end) in code points, end exclusive.

    One row per input row, sorted by start, then kind as in :data:`KINDS`. Base spans are all
    kept; a Markov span is added where it overlaps none of them. Null and empty texts have no
    spans, an empty table no rows. Columns other than the two named are not read.
    """
    model = train(docs, id_col, text_col) if model is None else model

    def find(raw: bytes) -> list[tuple[int, int, int]]:
        base = base_spans(raw)
        runs = [m for m in _RUN.finditer(raw) if model.is_secret(m[0])]
        if runs:
            at = _points(raw)
            more = [(at(m.start()), 3, at(m.end())) for m in runs]
            base = sorted(base + [s for s in more if not any(a < s[2] and s[0] < b for a, _, b in base)])
        return base

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
        for batch in batches:
            spans = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in find(raw)] for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start: long, kind: string, end: long>>")


