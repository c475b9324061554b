"""Language-model scoring with a gated recurrent network.

Token counts of all training texts come first, added up on the executors.  The
most frequent words, and ends of texts, are the network's symbols; any other
word is the symbol UNKNOWN followed by the word itself, drawn from a mixture of
the counts of such words and a spelling model of bytes.  The network is a
GRU in numpy, trained by truncated backpropagation through time on all training
texts: in each of ``epochs`` rounds, tasks train copies of it on a share of the
texts each, and the copies' mean goes into the next round.  Its softmax is
factored into a class of symbols and a symbol within the class.  Every text is
scored whole: many texts go through the network side by side, and each text's
state is carried from window to window.

Texts are cut into words once: a text is then its symbols, two bytes each, and
training and scoring read those.  Counts of the ``head`` most frequent words (of
at most ``head_bytes`` bytes) go to the workers that do so; the other words of a
text are counted per text and joined with the count table.

Learning uses all texts whose fold is allowed, in a fixed pseudorandom order of
ids.  Tasks and the texts of each grow with the root of their number.  Where
there are several tasks, one task makes the common start of their copies, from
about ``sample_docs`` of the texts.  The spelling model is of all words that are
no symbols; it keeps the ``contexts`` most frequent steps of each length and backs
off from any other, so what goes to the workers is bounded.

Cases: null and empty texts are a single end; repeated rows get equal scores; rows
without an id are in the fold of the empty text;
without training texts counts are 0 and the network is untrained; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, fold, lean, materialize, sample_order, tune

UNKNOWN, END = 0, 1

#: Bytes of texts that are encoded together.
ENCODE_BYTES = 8_000_000


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    folds: int = 10
    held_out_fold: int = 0
    smoothing: float = 0.1
    head: int = 200_000
    head_bytes: int = 64
    words: int = 4094
    classes: int = 64
    hidden: int = 32
    unknown_inputs: int = 512
    contexts: int = 2_000_000
    window: int = 16
    streams: int = 512
    sample_docs: int = 3000
    #: Tokens that a task holds at once while it trains; the state starts anew behind them.
    chunk_tokens: int = 500_000
    epochs: int = 2
    rate: float = 0.02
    seed: int = 3
    #: Tokens and texts that go through the network side by side.
    batch_tokens: int = 4_000_000
    batch_texts: int = 16_384
    scoring_window: int = 16


# --- spelling -----------------------------------------------------------------

ORDER = 4
ENDS = 256


class Spelling:
    """A byte model of words: contexts of up to three bytes, each backed off to the next shorter one (Witten-Bell)."""

    def __init__(self, sums: list[tuple[np.ndarray, np.ndarray]]):
        """``sums`` as of ``sums_of``, by the context's length."""
        single = np.full(257, 0.5)
        single[sums[0][0]] += sums[0][1]
        self.single = single / single.sum()
        self.tables = []
        for keys, n in sums[1:]:
            rows, row_of = np.unique(keys // 257, return_inverse=True)
            self.tables.append((keys, n, rows, np.bincount(row_of, n, len(rows)), np.bincount(row_of, minlength=len(rows)).astype(np.float64)))

    @classmethod
    def sums_of(cls, words: list[bytes], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(context * 257 + byte, ascending; weight) for contexts of no byte, one, two and three."""
        contexts, symbol, owner = cls._steps(words)
        weight = np.minimum(counts, 2).astype(np.float64)[owner]
        out = []
        for context in [np.zeros_like(symbol), *contexts]:
            keys, at = np.unique(context * 257 + symbol, return_inverse=True)
            out.append((keys, np.bincount(at, weight, len(keys))))
        return out

    @staticmethod
    def _steps(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Contexts of each length, the byte, and the word's number, for each byte and each end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbol = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbol[ends - 1] = ENDS
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(symbol)) - (ends - sizes)[owner]
        contexts, context = [], np.zeros(len(symbol), np.int64)
        for back in range(1, ORDER):
            before = np.full(len(symbol), ENDS)
            before[back:] = symbol[:-back]
            before[place < back] = ENDS
            context = context * 257 + before
            contexts.append(context)
        return contexts, symbol, owner

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        contexts, symbol, owner = self._steps(words)
        steps, at = np.unique(contexts[-1] * 257 + symbol, return_inverse=True)
        return np.bincount(owner, np.log10(self._step_p(steps))[at], len(words))

    def _step_p(self, steps: np.ndarray) -> np.ndarray:
        """p of steps (longest context * 257 + byte, ascending); shorter contexts are its first digits."""
        longest, symbol = np.divmod(steps, 257)
        p = self.single[symbol]
        for back, (keys, n, rows, total, kinds) in enumerate(self.tables, 1):
            if not len(rows):
                continue
            context = longest // 257 ** (ORDER - 1 - back)
            row = np.minimum(np.searchsorted(rows, context), len(rows) - 1)
            key = context * 257 + symbol
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            seen = np.where(keys[at] == key, n[at], 0)
            p = np.where(rows[row] == context, (seen + kinds[row] * p) / (total[row] + kinds[row]), p)
        return p


# --- network ------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def segments(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


@dataclass
class Network:
    """Weights by name; ``size`` symbols in each class, the last of which is UNKNOWN's own."""

    size: int
    weights: dict[str, np.ndarray]
    bounded: bool = False

    def bound(self) -> None:
        """States lie within -1 and 1; where no exponential can then overflow, the softmax leaves out the guard."""
        w = self.weights
        most = max(np.abs(w["class_w"]).sum(0).max(), np.abs(w["word_w"]).sum(1).max())
        highest = max(w["class_b"].max(), w["word_b"].max())
        lowest = min(w["class_b"].max(), w["word_b"].max(1).min())
        self.bounded = bool(most + highest < 60 and most - lowest < 60)

    @classmethod
    def fresh(cls, symbol_counts: np.ndarray, s: Settings) -> Network:
        """Small random weights; biases that give the symbols' frequencies."""
        rng = np.random.default_rng(s.seed)
        symbols, h = len(symbol_counts), s.hidden
        classes = max(2, min(s.classes, symbols))
        size = -(-(symbols - 1) // (classes - 1))
        counts = np.zeros(classes * size)
        counts[: symbols - 1] = symbol_counts[1:] + 0.5
        counts[-size] = symbol_counts[UNKNOWN] + 0.5
        counts = counts.reshape(classes, size)
        within = np.where(counts > 0, np.log(np.maximum(counts, 1e-9) / np.maximum(counts.sum(1, keepdims=True), 1e-9)), -40)
        of_class = np.log(np.maximum(counts.sum(1), 1e-9) / counts.sum())
        draw = lambda *shape: (rng.standard_normal(shape) * 0.5 / np.sqrt(h)).astype(np.float32)
        return cls(
            size,
            {
                "inputs": draw(symbols + s.unknown_inputs, 3 * h),
                "recur": draw(3, h, h),
                "class_w": draw(h, classes),
                "class_b": of_class.astype(np.float32),
                "word_w": draw(classes, h, size) * np.float32(0.2),
                "word_b": within.astype(np.float32),
            },
        )

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.advance(self.spread(inputs), h)

    def spread(self, inputs: np.ndarray) -> np.ndarray:
        """What inputs add to the gates z and r and to the new content, side by side along the first axis."""
        x = self.weights["inputs"].take(inputs, axis=0)
        return np.ascontiguousarray(x.reshape(len(inputs), 3, -1).transpose(1, 0, 2))

    def advance(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and the gates z and r, the state's share of the new content, and the new content."""
        u = np.matmul(h, self.weights["recur"])
        gates = u[:2]
        gates += x[:2]
        z, r = sigmoid(gates)
        c = r * u[2]
        c += x[2]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, u[2], c

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln p of each target; with ``grads`` also the slopes of the mean loss on h.

        Rows are put in the order of their classes, so that each class is a slice.
        """
        w, n = self.weights, len(targets)
        own = len(w["class_b"]) - 1
        group, place = np.divmod(targets - 1, self.size)
        group[targets == UNKNOWN], place[targets == UNKNOWN] = own, 0
        order = np.argsort(group.astype(np.uint16), kind="stable")
        group, place, h = group[order], place[order], h.take(order, axis=0)
        known = int(np.searchsorted(group, own))  # behind them, the class says all
        starts = segments(group[:known])
        slices = list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), known]))

        def normalized(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
            at = np.arange(len(target))
            if not self.bounded:
                logits -= logits.max(1, keepdims=True)
            lp = logits[at, target]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            lp -= np.log(total)
            if grads is not None:  # now the slopes
                total *= n
                logits /= total[:, None]
                logits[at, target] -= logits.dtype.type(1 / n)
            return lp

        d = h @ w["class_w"]
        d += w["class_b"]
        lp = normalized(d, group)
        ones, dh = np.ones(n, h.dtype), None
        if grads is not None:
            grads["class_w"], grads["class_b"], dh = h.T @ d, ones @ d, d @ w["class_w"].T
        d = np.empty((known, self.size), h.dtype)
        for g, a, b in slices:
            np.matmul(h[a:b], w["word_w"][g], out=d[a:b])
            d[a:b] += w["word_b"][g]
        lp[:known] += normalized(d, place[:known])
        if grads is not None:
            grads["word_w"], grads["word_b"] = np.zeros_like(w["word_w"]), np.zeros_like(w["word_b"])
            for g, a, b in slices:
                np.matmul(h[a:b].T, d[a:b], out=grads["word_w"][g])
                np.matmul(ones[a:b], d[a:b], out=grads["word_b"][g])
                dh[a:b] += d[a:b] @ w["word_w"][g].T
            placed = np.empty_like(dh)
            placed[order] = dh
            dh = placed
        out = np.empty_like(lp)
        out[order] = lp
        return out, dh


class Adam:
    """Moments of a network's weights; the rate goes down from ``high`` to ``low`` of the whole over ``steps``.

    Of ``inputs`` only the rows that a step has used move.
    """

    def __init__(self, weights: dict[str, np.ndarray], steps: int, high: float = 1.0, low: float = 0.0):
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v2 = {k: np.zeros_like(v) for k, v in weights.items()}
        self.steps, self.high, self.low, self.count = steps, high, low, 0

    def apply(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float, rows: np.ndarray) -> None:
        """``grads["inputs"]`` is of ``rows``."""
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        self.count += 1
        # Never 0: a task with more than its share of tokens learns from its last texts too.
        part = max(0.05, self.high - (self.high - self.low) * min(1.0, self.count / (self.steps + 1)))
        rate = rate * part / (1 - 0.9**self.count) * np.sqrt(1 - 0.999**self.count)
        for k, g in grads.items():
            g *= clip
            some = k == "inputs"
            m, v2 = (x[k].take(rows, axis=0) if some else x[k] for x in (self.m, self.v2))
            m += np.float32(0.1) * (g - m)
            np.square(g, out=g)
            g -= v2
            g *= np.float32(0.001)
            v2 += g
            np.sqrt(v2, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(rate)
            if some:
                self.m[k][rows], self.v2[k][rows] = m, v2
                weights[k][rows] -= g
            else:
                weights[k] -= g


def train_whole(network: Network, inputs: np.ndarray, targets: np.ndarray, s: Settings, adam: Adam) -> list[float]:
    """One pass over all of a sequence: what full windows of all streams leave over goes through fewer and shorter ones."""
    losses = []
    while len(targets):
        part = replace(s, epochs=1, streams=max(1, min(s.streams, len(targets) // s.window)), window=min(s.window, len(targets)))
        used = len(targets) // (part.streams * part.window) * part.streams * part.window
        losses += train(network, inputs[:used], targets[:used], part, adam)
        inputs, targets = inputs[used:], targets[used:]
    return losses


def train(network: Network, inputs: np.ndarray, targets: np.ndarray, s: Settings, adam: Adam | None = None) -> list[float]:
    """Truncated backpropagation over ``streams`` rows side by side; mean losses.

    ``inputs`` and ``targets`` are one sequence; a target END ends a text, and
    the state starts anew behind it.
    """
    length = len(targets) // s.streams // s.window * s.window
    if not length:
        return []
    inputs = inputs[: length * s.streams].reshape(s.streams, length)
    targets = targets[: length * s.streams].reshape(s.streams, length)
    w, n = network.weights, s.hidden
    adam = adam or Adam(w, s.epochs * (length // s.window))
    losses = []
    for _ in range(s.epochs):
        h = np.zeros((s.streams, n), w["recur"].dtype)
        ended = np.zeros(s.streams, bool)
        for start in range(0, length, s.window):
            own = targets[:, start : start + s.window].T
            loss, h, grads, rows = gradients(network, inputs[:, start : start + s.window].T, own, h, ended)
            ended = own[-1] == END
            losses.append(loss)
            adam.apply(w, grads, s.rate, rows)
    return losses


def gradients(network: Network, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, ended: np.ndarray) -> tuple[float, np.ndarray, dict, np.ndarray]:
    """Of a window (time, stream): mean loss, last state, slopes of the mean loss, and the rows of ``inputs`` that theirs are of.

    The state of a stream whose text has ended before the window, or in it, starts anew.
    """
    w, (window, streams), n = network.weights, targets.shape, h.shape[1]
    flat = np.ascontiguousarray(inputs).ravel()
    x = network.spread(flat).reshape(3, window, streams, n)
    alive = np.concatenate([~ended[None], targets[:-1] != END]).astype(h.dtype)[:, :, None]
    before, states, tape = np.empty_like(x[0]), np.empty_like(x[0]), []
    for t in range(window):
        np.multiply(h, alive[t], out=before[t])
        h, *rest = network.advance(x[:, t], before[t])
        states[t] = h
        tape.append(rest)
    grads: dict[str, np.ndarray] = {}
    network.bound()
    lp, slopes = network.log_probs(states.reshape(-1, n), np.ascontiguousarray(targets).ravel(), grads)
    slopes = slopes.reshape(window, streams, n)
    # Slopes on what inputs add (z, r, new content) and on the state's share of the new content.
    dx, du = np.empty_like(x), np.empty_like(x[0])
    back = np.ascontiguousarray(w["recur"].transpose(0, 2, 1))
    dh, kept, rest = np.zeros((3, streams, n), h.dtype)
    for t in range(window - 1, -1, -1):
        z, r, hu, c = tape[t]
        dz, dr, dc = dx[:, t]
        dh += slopes[t]
        np.multiply(dh, z, out=kept)
        np.subtract(dh, kept, out=dc)
        np.multiply(c, c, out=rest)
        np.subtract(1, rest, out=rest)
        dc *= rest
        np.subtract(before[t], c, out=dz)
        dz *= kept
        dz -= np.multiply(dz, z, out=rest)
        np.multiply(dc, r, out=du[t])
        np.multiply(du[t], hu, out=dr)
        dr -= np.multiply(dr, r, out=rest)
        np.matmul(dz, back[0], out=dh)
        dh += dr @ back[1]
        dh += du[t] @ back[2]
        dh += kept
        dh *= alive[t]
    on_state = before.reshape(-1, n).T
    grads["recur"] = np.stack([on_state @ d.reshape(-1, n) for d in (dx[0], dx[1], du)])
    rows, grads["inputs"] = sums_by(flat, np.concatenate(dx.reshape(3, -1, n), axis=1))
    return float(-lp.mean()), h, grads, rows


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of values."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys, values = keys[order], values.take(order, axis=0)
    starts = segments(keys)
    ends = np.append(starts[1:], len(keys))
    sums = values.take(starts, axis=0)
    for k in range(1, 8):  # few rows: together, the k-th of each key
        more = np.flatnonzero(ends - starts > k)
        if not len(more):
            break
        sums[more] += values.take(starts[more] + k, axis=0)
    ones = np.ones(len(keys), values.dtype)
    for i in np.flatnonzero(ends - starts > 8).tolist():  # many: each key by itself
        a, b = starts[i], ends[i]
        np.matmul(ones[a:b], values[a:b], out=sums[i])
    return keys[starts], sums


# --- model --------------------------------------------------------------------


@dataclass
class Model:
    settings: Settings
    network: Network
    head: list[bytes]  # most frequent first
    head_counts: np.ndarray
    ends: int  # training texts
    tokens: int  # N
    distinct: int  # V
    unknown: int  # training tokens that are no symbol
    known_share: float  # of the counts in the mixture for unknown words
    spelling: Spelling
    losses: list[float]

    @property
    def symbols(self) -> int:
        return min(self.settings.words, len(self.head)) + 2

    def spelt(self, counts: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """log10 p(word | UNKNOWN)."""
        known = self.known_share * counts / max(self.unknown, 1)
        return np.log10(known + (1 - self.known_share) * 10.0 ** np.maximum(spelling, -300))


@dataclass
class Vocabulary:
    """What a text becomes; every array has one entry more, for words that are not in the head."""

    settings: Settings
    spelling: Spelling
    symbols: int
    ends: int
    words: pa.Array
    codes: np.ndarray
    base: np.ndarray
    spelt: np.ndarray

    @classmethod
    def of(cls, model: Model) -> Vocabulary:
        s, head, n = model.settings, model.head, model.symbols - 2
        if model.symbols + s.unknown_inputs > 1 << 16:
            raise ValueError("symbols and unknown inputs have to fit into two bytes")
        codes = np.zeros(len(head) + 1, np.uint16)
        codes[:n] = np.arange(2, n + 2)
        codes[n:-1] = [model.symbols + unknown_bucket(w, s.unknown_inputs) for w in head[n:]]
        spelt = np.zeros(len(head) + 1)
        if len(head) > n:
            spelt[n:-1] = model.spelt(model.head_counts[n:], model.spelling.log10(head[n:]))
        base = np.append(np.log10(model.head_counts + s.smoothing), 0.0)
        return cls(s, model.spelling, model.symbols, model.ends, pa.array(head, pa.large_binary()), codes, base, spelt)


def unknown_bucket(word: bytes, n: int) -> int:
    """An input for an unknown word, by its first two bytes and its last."""
    return (word[0] * 7919 + (word[1] if len(word) > 1 else 0) * 104729 + word[-1] * 1299709) % 10007 % n


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, A-Z lower-cased, and the number of each one's text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    owner = np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    words = found.flatten().cast(pa.large_binary())
    full = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends leave empty words
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows; each task adds up before the shuffle."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            seen = pc.value_counts(words_of(batch.column(0))[0])
            held.append(pa.table({"word": seen.field(0), "c": seen.field(1)}))
            size += len(seen)
            if size > 600_000:
                held = [added(held)]
                size = len(held[0])
                if size > 300_000:
                    yield from _pairs(held[0])
                    held, size = [], 0
        if held:
            yield from _pairs(added(held))

    return texts.select("text").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pairs(seen: pa.Table) -> Iterator[pa.RecordBatch]:
    return seen.cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).to_batches(max_chunksize=50_000)


def held_out(s: Settings):
    return fold(F.col("doc_id"), s.folds) == s.held_out_fold


def fit(docs: DataFrame, s: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model, and the table of all training counts."""
    allowed = docs.where(~held_out(s))
    model, counts = fit_counts(allowed, s)
    train_rounds(materialize(encode(allowed, model).select("doc_id", "codes"), "lm-codes"), model)
    return model, counts


def fit_and_score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``score(docs, *fit(docs))``; texts are cut into words once for both."""
    model, counts = fit_counts(docs.where(~held_out(s)), s)
    parts = materialize(encode(docs, model), "lm-parts")
    train_rounds(parts.where(~held_out(s)).select("doc_id", "codes"), model)
    return score_parts(parts, model, counts)


def fit_counts(allowed: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    """The model with an untrained network, and the table of all counts."""
    tune(allowed.sparkSession)
    allowed = allowed.select("doc_id", "text")
    counts = materialize(count_words(allowed), "lm-counts")
    ends = allowed.count()
    sums = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    top = counts.where(F.length("word") <= s.head_bytes).orderBy(F.col("c").desc(), "word").limit(s.head).toArrow()
    head, head_counts = top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64)
    order = sorted(range(len(head)), key=lambda i: (-head_counts[i], head[i]))
    head, head_counts = [head[i] for i in order], head_counts[order]
    n = min(s.words, len(head))
    unknown = int((sums.n or 0) - head_counts[:n].sum())
    network = Network.fresh(np.concatenate([[unknown, ends], head_counts[:n]]).astype(np.float64), s)
    known_share = 0.0 if not unknown else float(np.clip(1 - (sums.once or 0) / unknown, 0.05, 0.98))
    model = Model(s, network, head, head_counts, ends, (sums.n or 0) + ends, sums.v + (ends > 0), unknown, known_share, Spelling(count_spelling(counts, head[:n], s.contexts)), [])
    return model, counts


def count_spelling(counts: DataFrame, symbols: list[bytes], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``Spelling.sums_of`` of all counted words but the symbols; at most ``most`` steps of each length come to the driver, no words."""
    known = frozenset(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in known]
            if rows:
                for back, (keys, n) in enumerate(Spelling.sums_of([w for w, _ in rows], np.array([n for _, n in rows]))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), back, np.int32)), pa.array(keys), pa.array(n)], ["back", "key", "n"])

    found = counts.select("word", "c").mapInArrow(lean(run), "back int, key long, n double").groupBy("back", "key").agg(F.sum("n").alias("n"))
    found = materialize(found, "lm-spelling")
    out = []
    for back in range(ORDER):
        steps = found.where(F.col("back") == back).orderBy(F.col("n").desc(), "key").limit(most).select("key", "n").toArrow()
        keys, n = steps.column("key").to_numpy(), steps.column("n").to_numpy()
        order = np.argsort(keys)
        out.append((keys[order], n[order]))
    return out


def train_rounds(encoded: DataFrame, model: Model) -> None:
    """Trains the model's network on all texts (doc_id, codes); the mean loss of each round goes into ``losses``."""
    s, network = model.settings, model.network
    tasks = max(1, math.ceil(math.sqrt(model.ends / s.sample_docs)))
    rows = encoded.select(sample_order(F.col("doc_id")).alias("at"), "doc_id", "codes")
    plans = [(rows, tasks, 1 - i / s.epochs, 1 - (i + 1) / s.epochs) for i in range(s.epochs)]
    if tasks > 1:
        plans.insert(0, (rows.where(F.pmod("at", F.lit(tasks * tasks)) == 0), 1, 1.0, 1.0))
    for texts, parts, high, low in plans:
        shared = encoded.sparkSession.sparkContext.broadcast(network)
        # As many copies as planned, however many partitions there are: a task may hold none or several.
        dealt = texts.withColumn("copy", F.pmod(F.xxhash64(F.lit("copy"), "at"), F.lit(parts)))
        dealt = dealt.repartitionByRange(parts, "copy").sortWithinPartitions("copy", "at", "doc_id", "codes").select("copy", "codes")
        # Copies are added up on the executors: the driver gets about the root of their number.
        steps = model.tokens // (tasks * s.streams * s.window)
        copies = dealt.mapInArrow(lean(_train_copy(shared, model.symbols, s, steps, high, low)), "tokens long, loss double, weights binary")
        added = copies.repartition(math.isqrt(parts - 1) + 1).mapInArrow(lean(_add_copies), copies.schema).toArrow()
        tokens = sum(added.column("tokens").to_pylist())
        if tokens:
            total = sum(np.frombuffer(x, np.float64) for x in added.column("weights").to_pylist()) / tokens
            network.weights = _unpacked(total, network.weights)
            model.losses.append(sum(added.column("loss").to_pylist()) / tokens)
        shared.destroy()
    network.bounded = False


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([w.size for w in like.values()])
    return {k: x.reshape(w.shape).astype(np.float32) for (k, w), x in zip(like.items(), np.split(flat, ends[:-1]))}


def _add_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, loss, total = 0, 0.0, None
    for batch in batches:
        for n, x, flat in zip(*(c.to_pylist() for c in batch.columns)):
            flat = np.frombuffer(flat, np.float64)
            tokens, loss, total = tokens + n, loss + x, flat if total is None else total + flat
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["tokens", "loss", "weights"])


def _train_copy(shared, symbols: int, s: Settings, steps: int, high: float, low: float):
    """A batch function over (copy, codes), copies in order: a network for each copy, trained on all of its texts; weights and loss times tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            for copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if copy != now:
                    if one:
                        yield one.result()
                    now, one = copy, _Copy(shared.value, symbols, s, Adam(shared.value.weights, steps, high, low))
                one.add(np.frombuffer(text, np.uint16))
        if one:
            yield one.result()

    return run


class _Copy:
    """A network that learns from texts as they come."""

    def __init__(self, start: Network, symbols: int, s: Settings, adam: Adam):
        self.network = Network(start.size, {k: v.copy() for k, v in start.weights.items()})
        self.symbols, self.s, self.adam = symbols, s, adam
        self.tokens, self.loss, self.held, self.size = 0, 0.0, [], 0

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.size += len(codes)
        if self.size >= self.s.chunk_tokens:
            self._learn()

    def _learn(self) -> None:
        inputs, targets = steps_of(np.concatenate(self.held), self.symbols)
        self.loss += float(np.mean(train_whole(self.network, inputs, targets, self.s, self.adam))) * self.size
        self.tokens += self.size
        self.held, self.size = [], 0

    def result(self) -> pa.RecordBatch:
        if self.size:
            self._learn()
        flat = np.concatenate([w.ravel() for w in self.network.weights.values()]).astype(np.float64) * self.tokens
        return pa.RecordBatch.from_arrays([pa.array([self.tokens]), pa.array([self.loss]), pa.array([flat.tobytes()], pa.binary())], ["tokens", "loss", "weights"])


def steps_of(codes: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of texts one after another: each input is the code before, and an END comes before the first."""
    inputs = np.empty(len(codes), np.int32)
    inputs[:1] = END
    inputs[1:] = codes[:-1]
    return inputs, np.where(codes < symbols, codes, UNKNOWN).astype(np.int32)


def rare_words(words: pa.Array, owner: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and for each distinct pair of a text and a word that place and how often; where each of ``n`` texts' pairs begin, and the end."""
    coded = words.dictionary_encode()
    which, kinds = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    pairs, times = np.unique(owner * kinds + which, return_counts=True)
    return coded.dictionary, which, pairs % kinds, times.astype(np.int64), np.searchsorted(pairs, np.arange(n + 1) * kinds)


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``most`` bytes: each look-up of words makes the head's hash table anew."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """One pass over all texts: their codes, and what the head gives of their scores.

    row, doc_id, n_tokens, n_known, base (sum of log10(c + smoothing)), spelt (of
    the head's unknown words), tail (word, times, spelling: the words that are
    not in the head), codes (two bytes a token: a symbol, or an input for an
    unknown word).
    """
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n_inputs, number = known.settings.unknown_inputs, TaskContext.get().partitionId() << 40
        for batch in _joined(batches, ENCODE_BYTES):
            n = batch.num_rows
            words, owner = words_of(batch.column(1))
            at = pc.fill_null(pc.index_in(words, value_set=known.words), -1).to_numpy()
            codes = known.codes[at]
            away = np.flatnonzero(at < 0)
            rare, which, pairs, times, starts = rare_words(words.take(pa.array(away)), owner[away], n)
            listed = rare.to_pylist()
            codes[away] = np.array([known.symbols + unknown_bucket(w, n_inputs) for w in listed], np.uint16)[which]
            sizes = np.bincount(owner, minlength=n)
            ends = np.cumsum(sizes + 1)
            every = np.full(len(codes) + n, END, np.uint16)
            every[np.arange(len(codes)) + owner] = codes
            fields = [rare.take(pa.array(pairs)).cast(pa.binary()), pa.array(times), pa.array(known.spelling.log10(listed)[pairs])]
            columns = [
                pa.array(np.arange(number, number + n)),
                batch.column(0),
                pa.array(sizes + 1),
                pa.array(sizes - np.bincount(owner[away], minlength=n) + (known.ends > 0)),
                pa.array(np.bincount(owner, known.base[at], n) + np.log10(known.ends + known.settings.smoothing), pa.float64()),
                pa.array(np.bincount(owner, known.spelt[at], n).astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, ["word", "times", "spelling"])),
                pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int64)), pa.py_buffer(every)]).cast(pa.binary()),
            ]
            number += n
            yield from pa.Table.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_known", "base", "spelt", "tail", "codes"]).to_batches(max_chunksize=ARROW_ROWS)

    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, spelt double, tail array<struct<word: binary, times: long, spelling: double>>, codes binary"
    return rows.mapInArrow(lean(run), schema)


def network_scores(network: Network, sequences: list[tuple[np.ndarray, np.ndarray]], window: int) -> np.ndarray:
    """log10 p of each sequence of symbols, the state carried from window to window."""
    order = np.argsort([-len(t) for _, t in sequences], kind="stable")
    sizes = np.array([len(sequences[i][1]) for i in order], np.int64)
    shorter = -sizes  # ascending
    first = np.cumsum(sizes) - sizes
    every_in = np.concatenate([sequences[i][0] for i in order]) if len(order) else np.empty(0, np.int32)
    every_out = np.concatenate([sequences[i][1] for i in order]) if len(order) else np.empty(0, np.int32)
    out = np.zeros(len(order))
    n = network.weights["recur"].shape[1]
    h = np.zeros((len(order), n), np.float32)
    for start in range(0, int(sizes[0]) if len(sizes) else 0, window):
        width = min(window, int(sizes[0]) - start)
        alive = np.searchsorted(shorter, -(start + np.arange(width)), side="left")
        ends = np.cumsum(alive)
        owners = np.arange(ends[-1]) - np.repeat(ends - alive, alive)
        at = first[owners] + np.repeat(start + np.arange(width), alive)
        states, inputs, targets = np.empty((ends[-1], n), np.float32), every_in[at], every_out[at]
        for lanes, end in zip(alive.tolist(), ends.tolist()):
            h = network.step(inputs[end - lanes : end], h[:lanes])[0]  # texts that have ended fall off the end
            states[end - lanes : end] = h
        for lo in range(0, len(targets), 16_384):
            lp = network.log_probs(states[lo : lo + 16_384], targets[lo : lo + 16_384])[0]
            out += np.bincount(owners[lo : lo + 16_384], lp, len(order))
    result = np.empty(len(order))
    result[order] = out / np.log(10)
    return result


def with_network(parts: DataFrame, model: Model) -> DataFrame:
    """``parts`` with the network's score of the codes in their place."""
    shared, symbols, s = parts.sparkSession.sparkContext.broadcast(model.network), model.symbols, model.settings
    rows = parts.select(*[c for c in parts.columns if c != "codes"], "codes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        network.bound()
        held, tokens, texts = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            sequences = [steps_of(np.frombuffer(x, np.uint16), symbols) for x in table.column("codes").to_pylist()]
            found = pa.array(network_scores(network, sequences, s.scoring_window))
            return table.drop_columns(["codes"]).append_column("symbols", found).to_batches()

        for batch in batches:
            held.append(batch)
            tokens += batch.column(batch.num_columns - 1).nbytes // 2
            texts += batch.num_rows
            if tokens >= s.batch_tokens or texts >= s.batch_texts:
                yield from flush()
                held, tokens, texts = [], 0, 0
        if held:
            yield from flush()

    return rows.mapInArrow(lean(run), f"{schema}, symbols double")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_parts(materialize(encode(docs, model), "lm-parts"), model, counts)


def score_parts(parts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``score`` of texts that are encoded."""
    s = model.settings
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    known = F.lit(model.known_share / max(model.unknown, 1)) * F.col("c")
    spelt = F.log10(known + F.lit(1 - model.known_share) * F.pow(F.lit(10.0), F.greatest("spelling", F.lit(-300.0))))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + s.smoothing)).alias("more_base"),
        F.sum(F.col("times") * spelt).alias("more_score"),
    )
    joined = with_network(parts.drop("tail"), model).join(tail, "row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = float(np.log10(model.tokens + s.smoothing * (model.distinct + 1)))
    return joined.select(
        "doc_id",
        held_out(s).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + more("more_known")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        (F.col("symbols") + F.col("spelt") + more("more_score")).alias("score"),
    )
