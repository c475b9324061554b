"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any other text, labelled or not, is
unlabelled.  Features are hashed words of the lower-cased text and prefixes of
words, each found at least once, twice, three or four times, restricted to those
that stand out in the positives.  A linear
model is trained in numpy on the class-prior-corrected risk
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``; whenever the bracket would fall
below zero, the step goes against it instead (the non-negative estimator).

Learning uses rows whose fold is allowed, at most ``max_positive`` positives and
``max_unlabelled`` other texts in a fixed pseudorandom order of ids; texts over
``max_train_bytes`` are passed over for learning only.  The class prior is the
share of toxic rows among the allowed labels unless it is given.

Cases: null and empty texts have no features and are scored by the intercept;
repeated rows get equal scores; without positives or unlabelled texts every
score is the prior; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, materialize, sample_order, tune


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    folds: int = 5
    held_out_fold: int = 0
    threshold: float = 0.5
    max_positive: int = 8000
    max_unlabelled: int = 16000
    max_train_bytes: int = 200_000
    features: int = 1024
    prior: float | None = None
    steps: int = 400
    rate: float = 0.1
    decay: float = 1e-3
    #: Least share of the positives that have a feature.
    support: float = 0.01


BITS = 20
#: A feature is a word, or the first 4 to 8 bytes of one, found at least so often.
LEVELS = 4
PREFIXES = (4, 5, 6, 7, 8)

#: ASCII bytes that are not letters separate words.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # of each feature
    levels: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """(levels, buckets): the number of the feature, -1 without one."""
        out = np.full((LEVELS, 1 << BITS), -1, np.int32)
        out[self.levels - 1, self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return out


def word_buckets(text: str) -> np.ndarray:
    """Buckets of every word of the lower-cased text and of its prefixes."""
    data = text.lower().encode().translate(_SPACED)
    raw = np.frombuffer(b" " + data + b" " * 9, np.uint8)
    gap = raw == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    sizes = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    head = eight[starts] & _MASKS[np.minimum(sizes, 8)]
    tail = eight[np.maximum(ends - 8, starts)] & _MASKS[np.minimum(sizes, 8)]
    parts = [head * np.uint64(0x9E3779B97F4A7C15) ^ tail * np.uint64(0xC2B2AE3D27D4EB4F) ^ sizes.astype(np.uint64)]
    for k in PREFIXES:
        parts.append((head[sizes >= k] & _MASKS[k]) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(k << 40))
    h = np.concatenate(parts)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features_of(text: str, table: np.ndarray) -> np.ndarray:
    """Numbers of the features that the text has."""
    found = word_buckets(text)
    found = found[(table[:, found] >= 0).any(0)]
    if not len(found):
        return found
    buckets, counts = np.unique(found, return_counts=True)
    hits = [table[level, buckets[counts > level]] for level in range(LEVELS)]
    out = np.concatenate(hits).astype(np.int64)
    return out[out >= 0]


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss; weights and bias.

    The whole sample enters each step: in small batches the number of positives
    among the unlabelled texts varies enough to turn steps around at random.
    """
    xp, xu = positive.astype(np.float32), unlabelled.astype(np.float32)
    dims = positive.shape[1]
    w = np.zeros(dims + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(dims + 1, np.float32), np.zeros(dims + 1, np.float32)
    for step in range(1, s.steps + 1):
        rate = s.rate * (1 - (step - 1) / s.steps)
        sp = 1 / (1 + np.exp(-np.clip(xp @ w[:-1] + w[-1], -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(xu @ w[:-1] + w[-1], -30, 30)))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean()
        up, uu = prior * sp / len(xp), su / len(xu)  # slopes of R_p(-) and R_u(-)
        if negative >= 0:
            gp, gu = prior * (sp - 1) / len(xp) - up, uu
        else:
            gp, gu = up, -uu
        grad = np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum())
        grad[:-1] += s.decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from rows outside the held-out fold."""
    spark = docs.sparkSession
    tune(spark)
    allowed = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), s.folds) != s.held_out_fold)
    known = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [sample_order(F.col("doc_id")), F.col("doc_id")]
    prior = s.prior if s.prior is not None else known.agg(F.avg("toxic")).first()[0]
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(allowed & (F.octet_length("text") <= s.max_train_bytes))
    positives = known.where("toxic = 1").orderBy(*order).limit(s.max_positive).select("doc_id", F.lit(1).alias("positive"))
    # Unlabelled texts stand for all texts, so positives may be among them too.
    others = docs.where(allowed).select("doc_id").orderBy(*order).limit(s.max_unlabelled)
    # The two limits bound the ids that are broadcast.
    ids = positives.union(others.select("doc_id", F.lit(0)))
    sample = materialize(texts.join(F.broadcast(ids), "doc_id"), "toxic-sample").dropDuplicates(["doc_id", "positive"])
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl or not prior or prior >= 1:
        base = min(max(float(prior or 0), 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), float(np.log(base / (1 - base))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, LEVELS, 1 << BITS), np.int32)
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets, times = np.unique(word_buckets(text), return_counts=True)
                for level in range(LEVELS):
                    seen[positive, level, buckets[times > level]] += 1
        level, at = np.nonzero(seen[0] + seen[1])
        columns = [at, level + 1, seen[1, level, at], seen[0, level, at]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["bucket", "level", "p", "u"])

    counts = sample.select("text", "positive").coalesce(8).mapInArrow(lean(count), "bucket long, level long, p long, u long")
    counts = counts.groupBy("bucket", "level").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    in_p, in_u = F.col("p") / n_pos, (F.col("u") + 0.5) / n_unl
    gain = F.col("p") * F.log(in_p / in_u)
    # A feature of toxic texts only is 1 / prior times as frequent in the positives; half of that is asked for.
    chosen = counts.where((F.col("p") >= max(4, s.support * n_pos)) & (in_p > max(1.5, 0.5 / prior) * in_u)).orderBy(gain.desc(), "bucket", "level").limit(s.features)
    chosen = sorted((r.bucket, r.level) for r in chosen.select("bucket", "level").collect())
    buckets, levels = np.array(chosen, np.int64).reshape(-1, 2).T
    model = Model(buckets, levels, np.zeros(len(buckets)), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            found = [features_of(x, table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "positive", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "positive").mapInArrow(lean(extract), f"doc_id {kind}, positive int, features array<int>")
    rows = rows.orderBy("positive", "doc_id").toArrow()
    x = np.zeros((rows.num_rows, len(buckets)), np.uint8)
    for i, found in enumerate(rows.column("features").to_pylist()):
        x[i, found] = 1
    is_p = rows.column("positive").to_numpy() == 1
    weights, bias = nnpu(x[is_p], x[~is_p], float(prior), s)
    return Model(buckets, levels, weights, bias)


def score_texts(texts: list[str], model: Model, table: np.ndarray) -> np.ndarray:
    z = np.array([model.weights[features_of(x, table)].sum() + model.bias for x in texts], np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; whole texts."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            found = score_texts([x or "" for x in batch.column(1).to_pylist()], shared.value, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double").select(
        "doc_id",
        (fold(F.col("doc_id"), s.folds) == s.held_out_fold).alias("held_out"),
        "score",
        (F.col("score") >= s.threshold).cast("int").alias("predicted"),
    )
