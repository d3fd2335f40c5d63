"""Language-model scoring: a gated recurrent model with a class-factored output.

Words are counted over all training documents. The most frequent ones are the vocabulary, in
classes of equal size, and more with more distinct words; every other word belongs to one of a few tail classes by its last bytes.
The network predicts the class of the next token, then the word within a vocabulary class; a
word of a tail class has its smoothed share of the class's count. So each word that can occur
has a probability and they sum to at most one.

The network is trained on all training documents by truncated backpropagation, inside
partitions of about equally many tokens, and averaged after each round. Documents are scored whole: their state is carried from window to window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcascade.llm import gru
from tabcascade.llm.common import shared, task_of, text_rows

HIDDEN = 16
CLASSES, CLASS_SIZE = 64, 32  # at least; see vocabulary_shape
VOCABULARY = CLASSES * CLASS_SIZE
GROWTH = 16
TAIL = 32
SYMBOLS = VOCABULARY + TAIL
STEPS = 32
FREQUENT = 1_000_000
ROUNDS = 2
PART_TOKENS = 1 << 21  # a partition's share of a round
LANES, FEWEST_LANES, LANE_TOKENS = 512, 16, 4000
RATE, LAST_RATE = 0.05, 0.0005
ONE = 1 << 16  # of a parameter's change in whole numbers
PIECE = 1 << 16  # changes in a row
CHUNK_BYTES = 8 << 20
CHUNK_TOKENS = 1 << 20
BLOCK, TRAIN_BLOCK = 512, 256  # rows of a block of logits, which stays in the cache
STACK = 8  # classes whose words are predicted together in training
SCORE_DOCS, SCORE_ROWS = 512, 1 << 16
SMOOTH = 0.1
END = np.uint64(TAIL - 1)  # the end token; no word hashes to it in practice


def token_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of words, with the tail class of their last bytes in the lowest bits."""
    listed = words.view(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))
    _, offsets, data = words.buffers()
    if data is None or not data.size:
        return hashes
    until = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, ends, text = np.diff(until), until[1:], np.frombuffer(data, np.uint8)
    last, before = (np.where(size >= k, text[np.maximum(ends - k, 0)].astype(np.int64), 0) for k in (1, 2))
    tail = (last * 31 + before * 17 + np.where(size > 2, 3, 0)) % TAIL
    return hashes & ~np.uint64(TAIL - 1) | tail.astype(np.uint64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens of an array of texts as bytes, END last; numbers among them of all
    tokens, one text after the other, each ended by END; counts of tokens)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = pc.dictionary_encode(parts.flatten())
    own = token_hashes(coded.dictionary)
    codes = np.asarray(coded.indices)
    until = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(parts)).astype(np.int64))]
    blank = pc.index(coded.dictionary, pa.scalar("")).as_py()
    if blank >= 0:  # blanks at the ends of a text leave an empty piece there
        word = codes != blank
        until, codes = np.r_[0, np.cumsum(word)][until], codes[word]
    counts = np.diff(until) + 1
    number = np.full(counts.sum(), len(own), np.int32)
    inside = np.ones(len(number), bool)
    inside[np.cumsum(counts) - 1] = False
    number[inside] = codes
    return np.r_[own, END], number, counts


def pieces(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive slices of about ``limit`` bytes."""
    until = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(until, limit + (until[a - 1] if a else 0))) + 1)
        yield texts.slice(a, b - a)
        a = b


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, c) of the tokens of (doc_id, text as bytes), summed in each batch before the shuffle."""

    def run(batches):
        task_of("gru_lm")
        for batch in batches:
            own, number, _ = tokens(batch.column(1))
            c = np.bincount(number, minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own[c > 0].view(np.int64)), pa.array(c[c > 0])], ["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What the counts say. ``known`` are the sorted hashes of frequent words (at most
    ``FREQUENT``, because each has at least that share of all tokens), with their counts and
    vocabulary numbers (-1: none). Tail classes have their tokens and distinct words. ``shape``
    is the vocabulary's classes and their size."""

    known: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    total: int
    distinct: int
    shape: tuple[int, int] = (CLASSES, CLASS_SIZE)

    @property
    def vocabulary(self) -> int:
        return self.shape[0] * self.shape[1]

    @property
    def symbol_type(self) -> type:
        return np.uint16 if self.vocabulary + TAIL <= 1 << 16 else np.uint32

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count, whether the count is known here) of token hashes."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        number = np.where(hit, self.number[at] if len(self.known) else -1, -1)
        symbol = np.where(number >= 0, number, self.vocabulary + (h % np.uint64(TAIL)).astype(np.int64))
        return symbol, np.where(hit, self.counts[at] if len(self.known) else 0, 0), hit


def vocabulary_shape(distinct: int, frequent: int) -> tuple[int, int]:
    """Classes and their size for about GROWTH * sqrt(distinct) of the frequent words, in as many
    classes as a class has words."""
    size = max(VOCABULARY, min(frequent, int(np.ceil(GROWTH * np.sqrt(distinct)))))
    classes = max(CLASSES, int(np.ceil(np.sqrt(size))))
    return classes, max(CLASS_SIZE, -(-size // classes))


def learn_lexicon(counts: DataFrame) -> Lexicon:
    """From (h, c). The driver gets the frequent words and the sums of the tail classes."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("c") * FREQUENT >= total).toArrow() if total else None
    h = np.asarray(frequent.column("h")).view(np.uint64) if frequent else np.empty(0, np.uint64)
    c = np.asarray(frequent.column("c")) if frequent else np.empty(0, np.int64)
    classes, size = vocabulary_shape(distinct, len(h))
    order = np.lexsort((h, -c))
    order = np.r_[order[h[order] == END], order[h[order] != END]][: classes * size]
    number = np.full(len(h), -1, np.int64)
    # neighbours in frequency go to different classes, so that classes have like shares
    rank = np.arange(len(order))
    number[order] = rank % classes * size + rank // classes
    tail_tokens, tail_words = np.zeros(TAIL), np.zeros(TAIL)
    if total:
        for row in counts.groupBy(F.expr(f"h & {TAIL - 1}").alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            tail_tokens[row.t], tail_words[row.t] = row.c, row.n
        listed = (h[order] % np.uint64(TAIL)).astype(np.int64)
        tail_tokens -= np.bincount(listed, c[order], TAIL)
        tail_words -= np.bincount(listed, minlength=TAIL)
    by = np.argsort(h)
    return Lexicon(h[by], c[by], number[by], tail_tokens, tail_words, int(total), int(distinct), (classes, size))


def start_params(lexicon: Lexicon, seed: int = 7) -> dict[str, np.ndarray]:
    """Random recurrence; output biases are the counted shares."""
    rng = np.random.default_rng(seed)
    classes, size = lexicon.shape
    share = np.zeros(lexicon.vocabulary)
    share[lexicon.number[lexicon.number >= 0]] = lexicon.counts[lexicon.number >= 0]
    by_class = np.r_[share.reshape(classes, size).sum(1), lexicon.tail_tokens] + 0.5
    within = np.where(share > 0, np.log(np.maximum(share, 1)), -30).reshape(classes, size)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "gates": normal(0.3, lexicon.vocabulary + TAIL, 3 * HIDDEN),
        "u": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN),
        "wc": normal(0.05, HIDDEN, classes + TAIL),
        "bc": np.log(by_class / by_class.sum()).astype(np.float32),
        "ww": normal(0.05, classes, HIDDEN, size),
        "bw": (within - within.max(1, keepdims=True)).astype(np.float32),
    }


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _classes(symbols: np.ndarray, classes: int = CLASSES, size: int = CLASS_SIZE) -> np.ndarray:
    return np.where(symbols < classes * size, symbols // size, symbols - classes * size + classes)


def _exponentials(h: np.ndarray, weights: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(exp of the logits ``h @ weights``, their sums, numbers of the cells of ``column``, their logits), all less
    a shift. A state is within -1..1, so logits are small unless training ran away; only where the sums say
    so are they shifted."""
    z = h @ weights
    cell = np.arange(0, z.size, z.shape[-1]) + column.reshape(-1)
    said, ones = z.reshape(-1)[cell], np.ones(z.shape[-1], z.dtype)
    with np.errstate(over="ignore"):
        np.exp(z, z)
    total = z @ ones
    if total.size and not (total.min() > 1e-30 and total.max() < 1e30):
        z = h @ weights
        z -= z.max(-1, keepdims=True)
        said = z.reshape(-1)[cell]
        np.exp(z, z)
        total = z @ ones
    return z, total, cell, said


def output_logs(h: np.ndarray, symbols: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log-probability of each symbol from states (rows, HIDDEN): its class, and in the
    vocabulary the word within it."""
    return _output_logs(np.hstack([h, np.ones((len(h), 1), h.dtype)]), symbols, joined(p))


def _chosen(h: np.ndarray, weights: np.ndarray, column: np.ndarray) -> np.ndarray:
    _, total, _, said = _exponentials(h, weights, column)
    return said.astype(np.float64) - np.log(total)


def _output_logs(h: np.ndarray, symbols: np.ndarray, q: dict[str, np.ndarray]) -> np.ndarray:
    classes, _, size = q["w"].shape
    cls = _classes(symbols, classes, size)
    out = np.concatenate([_chosen(h[a : a + BLOCK], q["c"], cls[a : a + BLOCK]) for a in range(0, max(1, len(h)), BLOCK)])
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(classes + 1))
    spoken = order[: cuts[-1]]
    h, column, more = h[spoken], symbols[spoken] % size, np.empty(len(spoken))
    for c in range(classes):
        for a in range(cuts[c], cuts[c + 1], BLOCK):
            b = min(a + BLOCK, cuts[c + 1])
            more[a:b] = _chosen(h[a:b], q["w"][c], column[a:b])
    out[spoken] += more
    return out


def model_logs(symbols: np.ndarray, counts: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Sum over each document of the natural logs of its symbols, state carried to its end.

    Documents run SCORE_DOCS side by side, longest first; the outputs of about SCORE_ROWS tokens are taken at once.
    """
    order = np.argsort(-counts, kind="stable")
    total, at = np.zeros(len(counts)), np.cumsum(counts) - counts
    q = joined(p)
    table, across = p["gates"].copy(), np.ascontiguousarray(p["u"].T)
    half = np.float32(0.5)
    k = HIDDEN
    table[:, : 2 * k] *= half
    across[: 2 * k] *= half
    states, said, doc, rows = [], [], [], 0

    def spoken() -> None:
        h = np.ones((rows, k + 1), np.float32)
        np.concatenate(states, out=h[:, :k])
        total[:] += np.bincount(np.concatenate(doc), _output_logs(h, np.concatenate(said), q), len(counts))

    for some in (order[a : a + SCORE_DOCS] for a in range(0, len(order), SCORE_DOCS)):
        begin, left = at[some], counts[some]
        h = np.zeros((k, len(some)), np.float32)
        lives = np.searchsorted(-left, -np.arange(left[0]), "left").tolist()
        for t, live in enumerate(lives):
            symbol = symbols[begin[:live] + t]
            h = h[:, :live]
            states.append(h.T)
            said.append(symbol)
            doc.append(some[:live])
            rows += live
            rec = across @ h
            gates = np.take(table, symbol, axis=0, mode="clip").T
            zr, n = rec[: 2 * k], rec[2 * k :]
            zr += gates[: 2 * k]
            np.tanh(zr, zr)
            zr *= half
            zr += half
            n *= rec[k : 2 * k]
            n += gates[2 * k :]
            np.tanh(n, n)
            h = h - n
            h *= rec[:k]
            h += n
            if rows >= SCORE_ROWS:
                spoken()
                states, said, doc, rows = [], [], [], 0
    if rows:
        spoken()
    return total


def joined(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Own copies of the parameters, each output matrix with its biases as a last row."""
    return {
        "gates": p["gates"].copy(),
        "u": p["u"].copy(),
        "c": np.vstack([p["wc"], p["bc"]]),
        "w": np.concatenate([p["ww"], p["bw"][:, None]], 1),
    }


def split(q: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters, or gradients, of :func:`joined` by their own names."""
    return {"gates": q["gates"], "u": q["u"], "wc": q["c"][:-1], "bc": q["c"][-1], "ww": q["w"][:, :-1], "bw": q["w"][:, -1]}


def _output_gradient(h: np.ndarray, weights: np.ndarray, column: np.ndarray, share: np.ndarray, dh: np.ndarray) -> np.ndarray:
    """Gradient of ``weights`` (HIDDEN and a row of biases, outcomes) for rows of states that end in a one;
    ``dh`` is set to that of the states. ``share`` is each row's weight in the mean. All may be stacked."""
    z, total, cell, _ = _exponentials(h, weights, column)
    # rows are scaled where they are narrow
    by = (share / total)[..., None]
    z.reshape(-1)[cell] -= total.reshape(-1)
    np.matmul(z, weights[..., :-1, :].swapaxes(-1, -2), out=dh)
    dh *= by
    return (h * by).swapaxes(-1, -2) @ z


def window_gradients(q: dict[str, np.ndarray], symbols: np.ndarray, mask: np.ndarray, h0: np.ndarray, starts: np.ndarray | None = None):
    """Gradients of the mean negative log-probability of one window (steps, lanes) of the
    :func:`joined` parameters, truncated at its start, and the state (HIDDEN, lanes) after it; the
    gates' as (rows that occur, gradient). ``mask`` holds to a lane's end; ``starts`` marks first tokens
    of documents, where the state is 0."""
    steps, lanes = symbols.shape
    classes, _, size = q["w"].shape
    flat = symbols.reshape(-1)
    states, kept = gru.lanes_forward(q["gates"], symbols, q["u"], h0, starts)
    h = np.ones((len(flat), HIDDEN + 1), h0.dtype)
    h[:, :HIDDEN] = states[:-1].transpose(0, 2, 1).reshape(-1, HIDDEN)
    share = (mask.reshape(-1) / max(1, mask.sum())).astype(h0.dtype)
    cls = _classes(flat, classes, size)
    dh, g = np.empty((len(flat), HIDDEN), h0.dtype), {"c": np.zeros_like(q["c"]), "w": np.zeros_like(q["w"])}
    for a in range(0, len(flat), TRAIN_BLOCK):
        b = a + TRAIN_BLOCK
        g["c"] += _output_gradient(h[a:b], q["c"], cls[a:b], share[a:b], dh[a:b])
    # in the order of symbols, those of a class are neighbours, too
    order = np.argsort(flat.astype(np.uint16) if len(q["gates"]) <= 1 << 16 else flat, kind="stable")
    ordered = flat[order]
    cuts = np.searchsorted(ordered, np.arange(classes + 1) * size)
    # classes of like numbers of rows are stacked, filled up with rows of no share
    many = np.diff(cuts)
    by_size = np.argsort(-many, kind="stable")
    by_size = by_size[: np.count_nonzero(many)]
    for some in (by_size[a : a + STACK] for a in range(0, len(by_size), STACK)):
        row = np.arange(many[some[0]])
        real = row < many[some, None]
        own = order[np.minimum(cuts[some, None] + row, len(order) - 1)]
        more = np.empty((*own.shape, HIDDEN), h.dtype)
        g["w"][some] = _output_gradient(h[own], q["w"][some], flat[own] % size, np.where(real, share[own], 0), more)
        dh[own[real]] += more[real]
    # the state before token t is the one after token t - 1
    dstates = dh.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
    dgates, g["u"] = gru.lanes_backward(dstates, states, kept, q["u"], starts)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    g["gates"] = ordered[first], np.add.reduceat(dgates.reshape(-1, 3 * HIDDEN)[order], first)
    return g, states[-1]


def train_window(p: dict[str, np.ndarray], symbols: np.ndarray, mask: np.ndarray, h0: np.ndarray, sparse: bool = False):
    """:func:`window_gradients` of parameters by their own names, from and to states (lanes, HIDDEN).
    ``sparse``: the gates' as (rows that occur, gradient)."""
    g, h = window_gradients(joined(p), symbols, mask, np.ascontiguousarray(h0.T))
    at, rows = g["gates"]
    if not sparse:
        g["gates"] = np.zeros_like(p["gates"])
        g["gates"][at] = rows
    return split(g), h.T


class Gathered:
    """Gradients of windows of few tokens, added up to the mean over all their tokens."""

    def __init__(self):
        self.sums, self.gates, self.tokens = {}, [], 0

    def add(self, g: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], tokens_of: int) -> None:
        for k in ("u", "c", "w"):
            more = g[k] * g[k].dtype.type(tokens_of)
            self.sums[k] = np.add(self.sums[k], more, out=more) if self.tokens else more
        own, rows = g["gates"]
        self.gates.append((own, rows * rows.dtype.type(tokens_of)))
        self.tokens += tokens_of

    def mean(self) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        own, back = np.unique(np.concatenate([own for own, _ in self.gates]), return_inverse=True)
        rows = gru.row_sums(back, np.concatenate([rows for _, rows in self.gates]), len(own))
        return {k: v / v.dtype.type(self.tokens) for k, v in self.sums.items()} | {"gates": (own, rows / rows.dtype.type(self.tokens))}


def lanes(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Documents dealt to at most ``most`` lanes of about as many tokens, the longest lane first: each
    document, longest first, goes to the emptiest lane."""
    held = [(0, k, []) for k in range(min(most, len(counts)))]
    for d in np.argsort(-counts, kind="stable").tolist():
        tokens_of, k, docs = held[0]
        docs.append(d)
        heapq.heapreplace(held, (tokens_of + int(counts[d]), k, docs))
    rng = np.random.default_rng(len(counts))
    return [rng.permutation(docs) for _, _, docs in sorted(held, key=lambda x: (-x[0], x[1]))]


def train_documents(q: dict[str, np.ndarray], adam: gru.LaneAdam, symbols: np.ndarray, counts: np.ndarray, rate) -> None:
    """Truncated backpropagation over whole documents, one after the other in each of up to LANES lanes.
    Windows of few lanes are gathered to one step. ``rate`` is the step's size after so many of these tokens."""
    begin = np.cumsum(counts) - counts
    dealt_to = lanes(counts, int(min(LANES, max(FEWEST_LANES, counts.sum() // LANE_TOKENS))))
    length = np.array([counts[docs].sum() for docs in dealt_to])
    order = np.concatenate(dealt_to)
    at = np.repeat(begin[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(counts.sum())
    symbols, starts = symbols[at], np.zeros(len(at), bool)
    starts[np.cumsum(counts[order]) - counts[order]] = True
    offset = np.cumsum(length) - length
    h, seen, few = np.zeros((HIDDEN, len(length)), np.float32), 0, Gathered()
    for t in range(0, int(length[0]), STEPS):
        live = int(np.searchsorted(-length, -t, "left"))
        place = t + np.arange(min(STEPS, int(length[0]) - t))[:, None]
        mask = place < length[:live]
        where = np.minimum(offset[:live] + place, len(symbols) - 1)
        grads, h = window_gradients(q, symbols[where], mask, h[:, :live], starts[where])
        said = int(mask.sum())
        if few.tokens or 2 * said < STEPS * len(length):
            few.add(grads, said)
            if 2 * few.tokens < STEPS * len(length) and t + STEPS < length[0]:
                continue
            grads, said, few = few.mean(), few.tokens, Gathered()
        adam.update(q, grads, rate(seen) * min(1.0, np.sqrt(said / (STEPS * len(length)))))
        seen += said


def dealt(docs: DataFrame, r: int, rounds: int, total: int, seed: int = 7) -> DataFrame:
    """The rows of round ``r``, each row of ``docs`` in one of the rounds by a hash of id and text.
    Another hash deals and orders them in partitions of about ``PART_TOKENS`` of the ``total``
    tokens, so that files and cores do not matter."""
    parts = max(1, round(total / rounds / PART_TOKENS))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(rounds).cast("long")) == r)
    chosen = chosen.withColumn("place", F.xxhash64("doc_id", "text", F.lit(seed + 1)))
    return chosen.repartition(parts, "place").sortWithinPartitions("place", "doc_id", "text").select("doc_id", "text")


def packed(far: np.ndarray) -> bytes:
    """int32 numbers as four planes of their bytes, signs last, so that those of small numbers compress."""
    return ((far << 1) ^ (far >> 31)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    far = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]
    return (far >> 1).astype(np.int32) ^ -(far & 1).astype(np.int32)


def summed(parts: DataFrame) -> DataFrame:
    """(piece, seen, mean) from (piece, seen, far): the mean of the parts of a piece by their tokens, as
    float32. The sums are taken as whole numbers, in any order the same."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, seen, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = unpacked(far).astype(np.int64) * seen
                if piece in sums:
                    sums[piece][0] += seen
                    sums[piece][1] += value
                else:
                    sums[piece] = [seen, value]
        for piece, (seen, value) in sums.items():
            mean = (value / seen / ONE).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"piece": [piece], "seen": [seen], "mean": [mean]})

    return parts.repartition("piece").mapInArrow(run, "piece long, seen long, mean binary")


def looked_up(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, row, n_tokens, frequent, logs, within, rare, symbols) of (doc_id, text as bytes): a number of
    the row, its tokens, those among the known words and the sum of their log10 counts, what the words
    of tail classes add to the network's log10, the hashes of other words, and the symbols as bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        task_of("gru_lm")
        lex = sent.value
        serial = TaskContext.get().partitionId() << 40
        tail_log = np.log10(lex.tail_tokens + SMOOTH * (lex.tail_words + 1))
        width = np.dtype(lex.symbol_type).itemsize
        for batch in batches:
            done = 0
            for part in pieces(batch.column(1), CHUNK_BYTES):
                own, back, n = tokens(part)
                symbol, count, hit = lex.look(own)
                logs = np.where(hit, np.log10(count + SMOOTH), 0.0)
                within = np.where(symbol >= lex.vocabulary, logs - tail_log[np.maximum(symbol - lex.vocabulary, 0)], 0.0)
                first = np.cumsum(n) - n
                known = np.add.reduceat(hit[back].astype(np.int64), first)
                said = symbol.astype(lex.symbol_type)[back]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(n)),
                        pa.array(serial + np.arange(len(n))),
                        pa.array(n),
                        pa.array(known),
                        pa.array(np.add.reduceat(logs[back], first)),
                        pa.array(np.add.reduceat(within[back], first)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - known)], pa.int32()), pa.array(own[back[~hit[back]]].view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[first, len(said)].astype(np.int32) * np.int32(width)), pa.py_buffer(said)]),
                    ],
                    ["doc_id", "row", "n_tokens", "frequent", "logs", "within", "rare", "symbols"],
                )
                done += len(n)
                serial += len(n)

    return rows.mapInArrow(run, "doc_id long, row long, n_tokens long, frequent long, logs double, within double, rare array<long>, symbols binary")


def symbol_runs(symbols: pa.Array, lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols of some rows one after the other, their counts), about ``CHUNK_TOKENS`` at once."""
    width = np.dtype(lexicon.symbol_type).itemsize
    for part in pieces(symbols, width * CHUNK_TOKENS):
        yield np.frombuffer(b"".join(part.to_pylist()), lexicon.symbol_type).astype(np.int32), np.asarray(pc.binary_length(part)).astype(np.int64) // width


def train(docs: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """:func:`train_symbols` over (doc_id, text as bytes)."""
    return train_symbols(looked_up(docs, lexicon).select("doc_id", F.col("symbols").alias("text")), lexicon, rounds, seed)


def train_symbols(docs: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` rounds over (doc_id, text as symbols), which together have every row of ``docs`` once. In
    each, every partition trains on its rows and the partitions' parameters are averaged by
    their tokens; one with far more tokens than the others starts anew after each
    2 * ``PART_TOKENS``. Steps shrink from ``RATE`` to ``LAST_RATE`` over all rounds."""
    p = start_params(lexicon, seed)
    if not lexicon.total:
        return p
    shapes = {k: v.shape for k, v in p.items()}
    for r in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((p, lexicon))

        def run(batches, sent=sent, r=r):
            task_of("gru_lm")
            start, lex = sent.value

            def moved(symbols, counts):
                """What training on these documents changes, in pieces of whole numbers."""
                symbols, counts = np.concatenate(symbols), np.concatenate(counts)
                q, seen = joined(start), len(symbols)
                train_documents(q, gru.LaneAdam(q), symbols, counts, lambda done: RATE + (LAST_RATE - RATE) * (r + done / seen) / rounds)
                own = split(q)
                far = np.concatenate([(own[k] - start[k]).ravel() for k in shapes]).astype(np.float64)
                far = np.clip(np.rint(far * ONE), -(2**30), 2**30).astype(np.int32)
                for a in range(0, len(far), PIECE):
                    yield pa.RecordBatch.from_pydict({"piece": [a], "seen": [seen], "far": [packed(far[a : a + PIECE])]})

            symbols, counts, seen = [], [], 0
            for batch in batches:
                for some, n in symbol_runs(batch.column(1), lex):
                    symbols.append(some)
                    counts.append(n)
                    seen += len(some)
                    if seen >= 2 * PART_TOKENS:
                        yield from moved(symbols, counts)
                        symbols, counts, seen = [], [], 0
            if seen:
                yield from moved(symbols, counts)

        parts = dealt(docs, r, rounds, lexicon.total, seed).mapInArrow(run, "piece long, seen long, far binary")
        flat = np.zeros(sum(v.size for v in p.values()), np.float32)
        for row in summed(parts).toArrow().to_pylist():
            mean = np.frombuffer(row["mean"], np.float32)
            flat[row["piece"] : row["piece"] + len(mean)] = mean
        cuts = np.cumsum([v.size for v in p.values()])[:-1]
        p = {k: p[k] + d.reshape(shapes[k]) for k, d in zip(shapes, np.split(flat, cuts), strict=True)}
    return p


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    ``learn`` is a condition on a column named ``doc_id`` that says which rows are learned from;
    with none, every token is new and the network untrained. Words are ``[^\\x20\\x09-\\x0D]+``
    with A-Z lower-cased, then one end. ``base_score`` is the smoothed unigram log10 probability,
    ``score`` the network's. Null and empty texts are the end alone. Repeated rows are scored each
    for itself, an empty table gives no rows. Columns other than the two named are not read.
    """
    rows = text_rows(docs, id_col, text_col)
    learned = rows.where(learn)
    counts = shared(count_tokens(learned), "counts")
    lexicon = learn_lexicon(counts)
    looked = shared(looked_up(rows, lexicon), "looked")
    trained = train_symbols(looked.where(learn).select("doc_id", F.col("symbols").alias("text")), lexicon, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((trained, lexicon))

    def run(batches):
        task_of("gru_lm")
        p, lex = sent.value
        for batch in batches:
            logs = [model_logs(symbols, n, p) / np.log(10) for symbols, n in symbol_runs(batch.column("symbols"), lex)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pc.add(batch.column("within"), pa.array(np.concatenate(logs or [np.empty(0)])))],
                ["doc_id", "row", "n_tokens", "frequent", "logs", "model"],
            )

    scored = shared(looked.drop("rare").mapInArrow(run, "doc_id long, row long, n_tokens long, frequent long, logs double, model double"), "scored")
    # Words that are not frequent have few rows each: their counts come by a shuffled join.
    rare = looked.select("row", F.explode("rare").alias("h"))
    found = rare.join(counts, "h", "left").groupBy("row").agg(
        F.count("c").alias("seen"), F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + SMOOTH)).alias("more")
    )
    known = scored.join(found, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    total, distinct = lexicon.total, lexicon.distinct
    norm = float(np.log10(total + SMOOTH * (distinct + 1)))
    return known.select(
        "doc_id",
        "n_tokens",
        (F.col("frequent") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
