"""Document rules with host-level verdicts.

Counts per document come first; failures are then added up by host (the
``source``), each host's rate is shrunk towards the others with a beta prior
fitted to all hosts, and the host's verdict goes back to its documents.  A
document of a distrusted host has to pass every rule.  One of any other host has
to pass the base rules, and may not fail another rule at ``clear`` times its
limit.  A host is distrusted if its shrunk rate is high, or high beside the
overall rate.

Cases: a null text has no words; a null host is a host of its own; repeated rows
count as often as they stand there; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, lean, materialize, tune

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 50
    max_dup_line_percent: int = 30
    word_chars_low: int = 2
    word_chars_high: int = 20
    #: A host is distrusted if its shrunk failure rate is above this.
    host_limit: float = 0.5
    #: Or above so many times the overall rate.
    host_ratio: float = 1.25
    #: A document that fails a rule at so many times its limit goes on any host.
    clear: int = 2
    #: Bounds of the prior's weight, in documents.
    prior_low: float = 1.0
    prior_high: float = 10_000.0


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of five that stand in the text more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in enumerate(windows) if seen[w] > 1])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count_text(text: str) -> tuple[int, int, int, int, int]:
    """words, characters in words, symbols, repeated lines, repeated words."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in ASCII_SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source) and the counts of the whole text."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    kept = rows.drop("text").schema
    schema = ", ".join([f"doc_id {kept['doc_id'].dataType.simpleString()}", "source string", *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_text(x or "") for x in batch.column(2).to_pylist()]
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "source", *COUNTS])

    return rows.mapInArrow(lean(run), schema)


def with_rules(counts: DataFrame, rules: Rules) -> DataFrame:
    """Adds base_failed, any_failed and clear_failed; integer arithmetic only."""
    c = F.col
    base = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"))
    def more(times: int) -> Column:
        return (
            (100 * c("n_symbols") > times * rules.max_symbol_percent * c("n_words"))
            | (5 * 100 * c("n_dup_lines") > times * rules.max_dup_line_percent * c("n_words"))
            | (times * c("word_chars") < rules.word_chars_low * c("n_words"))
            | (c("word_chars") > times * rules.word_chars_high * c("n_words"))
        )

    return counts.withColumns({"base_failed": base, "any_failed": base | more(1), "clear_failed": base | more(rules.clear)})


def beta_prior(hosts: DataFrame, rules: Rules) -> tuple[float, float]:
    """Moments of the hosts' rates, less what counting alone would spread them.

    ``hosts`` has one row per host; only five sums come to the driver.
    """
    p = F.col("failed") / F.col("n")
    row = hosts.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("failed").alias("f"),
        F.sum(p * p * F.col("n")).alias("sq"),
    ).first()
    if not row.k or not row.n:
        return 1.0, 1.0
    mean = row.f / row.n
    spread = max(row.sq / row.n - mean * mean, 0.0)
    noise = mean * (1 - mean) * row.k / row.n
    between = spread - noise
    weight = rules.prior_high if between <= 0 else mean * (1 - mean) / between - 1
    weight = min(max(weight, rules.prior_low), rules.prior_high)
    return max(mean, 1e-6) * weight, max(1 - mean, 1e-6) * weight


def host_verdicts(ruled: DataFrame, rules: Rules) -> DataFrame:
    """One row per host: n, failed, shrunk rate, distrusted."""
    hosts = ruled.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("any_failed").cast("long")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    a, b = beta_prior(hosts, rules)
    rate = (F.col("failed") + a) / (F.col("n") + (a + b))
    return hosts.withColumn("rate", rate).withColumn("distrusted", (rate > rules.host_limit) | (rate > rules.host_ratio * a / (a + b)))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row: doc_id, counts, base_failed, kept, host_rate."""
    ruled = materialize(with_rules(document_counts(docs), rules), "rules")
    hosts = host_verdicts(ruled, rules).select(F.col("source").alias("host"), "rate", "distrusted")
    joined = ruled.join(hosts, ruled["source"].eqNullSafe(hosts["host"]), "left")
    return joined.select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.when(F.col("distrusted"), F.col("any_failed")).otherwise(F.col("clear_failed"))).alias("kept"),
        F.col("rate").alias("host_rate"),
    )
