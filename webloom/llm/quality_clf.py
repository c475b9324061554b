"""Quality by compression: two zstandard dictionaries and a calibrated difference.

One dictionary is built from texts labelled good, one from texts labelled bad.
Each whole text is compressed with both; the difference of the sizes, as a share
of the larger one, and how far the text shrinks at all, go through a logistic
calibration fitted on labelled texts that built neither dictionary.

Learning uses labelled rows whose fold is allowed, at most ``per_class`` texts of
each class for a dictionary and ``calibration`` texts for the calibration, taken
in a fixed pseudorandom order of ids; texts over ``max_train_bytes`` are passed
over for learning only.

Cases: null and empty texts are scored as empty; repeated rows get equal scores;
without texts of both classes the score is the share of good labels (0.5 without
labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, materialize, sample_order, text_bytes, tune


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    folds: int = 4
    held_out_fold: int = 2
    threshold: float = 0.7
    per_class: int = 2500
    calibration: int = 8000
    max_train_bytes: int = 200_000
    dictionary_bytes: int = 112_640
    sample_bytes: int = 2_000
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def build_dictionary(texts: list[bytes], settings: Settings) -> bytes:
    """A trained dictionary; of few texts, their own bytes serve as one."""
    n = settings.sample_bytes
    pieces = [x[i : i + n] for x in texts for i in range(0, len(x), n)]
    raw = b"\n".join(p[: n // 8] for p in pieces)[-settings.dictionary_bytes :] or b"\n" * 8
    try:
        book = zstandard.train_dictionary(settings.dictionary_bytes, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return raw
    # Training gives up early on some texts; their own bytes then say more than a short dictionary.
    return book if 2 * len(book) > min(settings.dictionary_bytes, len(raw)) else raw


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes, level: int):
    out = []
    for content in (good, bad):
        kind = zstandard.DICT_TYPE_AUTO
        book = zstandard.ZstdCompressionDict(content, dict_type=kind)
        book.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False, write_dict_id=False))
    return out


def measure(texts: list[bytes], good: bytes, bad: bytes, level: int) -> np.ndarray:
    """Rows of (normalised difference, share of the size left, log size, and their products)."""
    by_good, by_bad = _compressors(good, bad, level)
    sizes = np.array([(len(by_good.compress(x)), len(by_bad.compress(x)), len(x)) for x in texts], np.float64).reshape(-1, 3)
    g, b, n = sizes.T
    diff = (b - g) / np.maximum(np.maximum(g, b), 1)
    left = np.log((np.minimum(g, b) + 1) / (n + 16))
    size = np.log(n + 16)
    return np.stack([diff, left, size, diff * diff, left * left, size * size, diff * left, diff * size, left * size], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on the ridge-penalised likelihood; (centre, scale, weights with the intercept last)."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def cost(w: np.ndarray) -> float:
        t = z @ w
        return float(np.logaddexp(0, t).sum() - y @ t + 0.5 * (penalty * w * w).sum())

    now = cost(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        size = 1.0
        while (new := cost(w + size * step)) > now and size > 1e-6:  # a full step may overshoot
            size /= 2
        if new >= now - 1e-9:
            break
        w, now = w + size * step, new
    return centre, scale, w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    tune(docs.sparkSession)
    allowed = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), settings.folds) != settings.held_out_fold))
    allowed = allowed.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(2))
    parts = []
    for quality in (0, 1):
        one = allowed.where((F.col("quality") == quality) & (by_part == 0))
        parts.append(one.orderBy(sample_order(F.col("doc_id")), "doc_id").limit(settings.per_class).withColumn("part", F.lit(0)))
    rest = allowed.where(by_part == 1).orderBy(sample_order(F.col("doc_id")), "doc_id").limit(settings.calibration)
    ids = parts[0].union(parts[1]).union(rest.withColumn("part", F.lit(1)))
    # The limits above bound the ids: per_class * 2 + calibration rows.
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= settings.max_train_bytes)
    sample = materialize(texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]), "quality-sample")
    seen = {0: [], 1: []}
    for row in sample.where("part = 0").select("quality", "doc_id", F.col("text").cast("binary").alias("text")).orderBy("doc_id").collect():
        seen[row.quality].append(bytes(row.text))
    share = sample.agg(F.avg("quality")).first()[0]
    if not seen[0] or not seen[1]:
        return Model(b"", b"", settings.level, (), (), (), 0.5 if share is None else float(share))
    good, bad = (build_dictionary(seen[q], settings) for q in (1, 0))
    rows = _measured(sample.where("part = 1").select("doc_id", "text", "quality"), good, bad, settings.level).orderBy("doc_id").collect()
    y = np.array([r.quality for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model(b"", b"", settings.level, (), (), (), float(share))
    centre, scale, weights = fit_logistic(np.array([r.features for r in rows]), y)
    return Model(good, bad, settings.level, tuple(centre), tuple(scale), tuple(weights))


def _measured(rows: DataFrame, good: bytes, bad: bytes, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(text_bytes(batch.column(1)), good, bad, level)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, quality int, features array<double>")


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant if model.constant is not None else 0.5)
    x = (measure(texts, model.good, model.bad, model.level) - np.array(model.centre)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(text_bytes(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double").select(
        "doc_id",
        (fold(F.col("doc_id"), settings.folds) == settings.held_out_fold).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
