"""Language ID with spans: script ranges, word scores, Viterbi with a switching penalty.

Each word is scored in every language whose training text uses the word's
script, by log probabilities of its hashed character trigrams; how far a
language may fall behind within one word is limited.  The best path through the
languages, with a penalty for each switch, labels spans of words.  The document
gets the language with the most words; the score is that share times the
posterior of the language over the whole text.

Learning uses rows with a language whose fold is allowed, about ``per_lang``
texts of each language in a fixed pseudorandom choice of ids.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text
whose scripts no language uses gets the most frequent language with score 0;
without training rows everything is ``und``; ties go to the language first in
code-point order; repeated rows get equal answers; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, sample_order, tune

# Code-point ranges of scripts; the last that fits counts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
)
OTHER = len(SCRIPTS)
NO_LETTER = -1
UNDETERMINED = "und"

#: ASCII bytes that are not letters separate words.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    folds: int = 4
    held_out_fold: int = 2
    per_lang: int = 3000
    bits: int = 16
    #: Log-probability price of a switch.
    switch: float = 9.0
    #: A language falls behind the best by at most this within a word.
    behind: float = 6.0
    #: Least share of a language's words in a script to be a candidate for it.
    script_share: float = 0.01


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages): log probabilities
    candidates: np.ndarray  # (scripts, languages): bool
    common: int
    settings: Settings
    cache: dict = field(default_factory=dict)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split()


def script_of(word: bytes) -> int:
    """The script of the word's letters; of several, the last in SCRIPTS."""
    if word.isascii():
        return 0
    found = NO_LETTER
    for c in word.decode():
        if c.isalpha():
            at = ord(c)
            here = next((i for i, (_, low, high) in enumerate(SCRIPTS) if low <= at <= high), OTHER)
            found = max(found, here)
    return found


def word_buckets(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of ``^word$`` one after another, and where each word begins."""
    buffer = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))  # trigrams of a word of n bytes: n
    h = (buffer[:-2] * np.uint32(0x9E3779B1) + buffer[1:-1]) * np.uint32(0x85EBCA6B) + buffer[2:]
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(buffer), bool)
    inside[ends - 1] = False
    inside[ends - 2] = False
    return h[inside[:-2]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def score_words(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores, best 0 and none below -behind; and scripts."""
    scripts = np.fromiter((script_of(w) for w in words), np.int64, len(words))
    h, starts = word_buckets(words, model.settings.bits)
    scores = np.add.reduceat(model.table[h], starts, axis=0)
    fits = np.where((scripts >= 0)[:, None], model.candidates[scripts], False)
    scores = np.where(fits, scores, -np.inf)
    best = scores.max(1, keepdims=True)
    none = ~np.isfinite(best[:, 0])
    best[none] = 0
    scores = np.maximum(scores - best, -model.settings.behind)
    scores[none] = 0
    return scores, scripts


def viterbi(emissions: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each row: sum of emissions less ``switch`` for each change.

    Ties keep the present state, else take the lowest.
    """
    n, k = emissions.shape
    total = emissions.sum(0)
    lead = int(total.argmax())
    gain = np.cumsum(emissions - emissions[:, lead : lead + 1], 0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), 0)
    if (gain - low).max() < switch:  # no stretch in another language pays for one switch
        return np.full(n, lead)
    value = emissions[0].copy()
    back = np.empty((n, k), np.int32)
    own = np.arange(k)
    for i in range(1, n):
        top = int(value.argmax())
        moved = value < value[top] - switch
        back[i] = np.where(moved, top, own)
        value = np.where(moved, value[top] - switch, value) + emissions[i]
    path = np.empty(n, np.int64)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Labeller:
    """Word scores of a worker, kept between batches up to a bounded number."""

    def __init__(self, model: Model, keep: int = 100_000):
        self.model, self.keep = model, keep
        self.index: dict[bytes, int] = {}
        self.scores = np.empty((0, len(model.langs)))
        self.scripts = np.empty(0, np.int64)

    def learn(self, docs: list[list[bytes]]) -> None:
        if len(self.index) > self.keep:
            self.__init__(self.model, self.keep)
        new = list(dict.fromkeys(w for words in docs for w in words if w not in self.index))
        if new:
            start = len(self.index)
            self.index.update(zip(new, range(start, start + len(new))))
            scores, scripts = score_words(new, self.model)
            self.scores = np.concatenate([self.scores, scores])
            self.scripts = np.concatenate([self.scripts, scripts])

    def label(self, words: list[bytes]) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language, score, spans of (first word, word after the last, language))."""
        model = self.model
        if not model.langs or not words:
            return UNDETERMINED, 0.0, []
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        scripts = self.scripts[at]
        if (scripts == NO_LETTER).all():
            return UNDETERMINED, 0.0, []
        rows = self.scores[at]
        if not rows.any() and not model.candidates[scripts[scripts >= 0]].any():
            return model.langs[model.common], 0.0, []
        path = viterbi(rows, model.settings.switch)
        votes = np.bincount(path[scripts >= 0], minlength=len(model.langs))
        best = int(votes.argmax())
        total = rows.sum(0)
        posterior = np.exp(total - total.max())
        edges = np.flatnonzero(np.diff(path)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(path)]
        spans = [(a, b, model.langs[path[a]]) for a, b in zip(starts, ends)]
        share = votes[best] / votes.sum()
        return model.langs[best], float(share * max(posterior[best] / posterior.sum(), 1 / len(model.langs))), spans


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Count trigrams of a bounded sample of each language on the executors."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), s.folds) != s.held_out_fold))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes, key=lambda x: x.encode())
    if not langs:
        return Model([], np.empty((1 << s.bits, 0), np.float32), np.zeros((OTHER + 1, 0), bool), 0, s)
    span = 1 << 31
    limits = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, s.per_lang / sizes[lang]) * span))])
    sample = rows.where(F.pmod(sample_order(F.col("doc_id")), F.lit(span)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    counts = seen.setdefault(lang, np.zeros(1 << s.bits, np.int64))
                    counts += np.bincount(word_buckets(words, s.bits)[0], minlength=1 << s.bits)
                    kinds = np.fromiter(map(script_of, words), np.int64, len(words))
                    scripts.setdefault(lang, np.zeros(OTHER + 2, np.int64))
                    scripts[lang] += np.bincount(kinds + 1, minlength=OTHER + 2)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            every = np.concatenate([at, np.arange(1, OTHER + 2) - (OTHER + 2)])  # scripts have negative numbers
            n = np.concatenate([counts[at], scripts[lang][1:]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(every)), pa.array(every), pa.array(n)], ["lang", "bucket", "n"])

    found = sample.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << s.bits, len(langs)))
    scripts = np.zeros((OTHER + 1, len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    column = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = bucket >= 0
    counts[bucket[grams], column[grams]] = n[grams]
    scripts[bucket[~grams] + OTHER + 1, column[~grams]] = n[~grams]
    table = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(counts)))
    candidates = scripts >= np.maximum(s.script_share * scripts.sum(0), 1)
    common = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i))
    return Model(langs, table.astype(np.float32), candidates, common, s)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, spans; whole texts."""
    s = model.settings
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            docs_words = [words_of(x or "") for x in batch.column(1).to_pylist()]
            if shared.value.langs:
                labeller.learn(docs_words)
            found = [labeller.label(x) for x in docs_words]
            spans = [[{"first": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, spans array<struct<first: int, end: int, lang: string>>")
    return out.withColumn("held_out", fold(F.col("doc_id"), s.folds) == s.held_out_fold)
