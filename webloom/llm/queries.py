"""The thin queries of the ten operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, lm, mixing, neardup, quality_clf, quality_rules, toxicity, warc
from .common import read_table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lm.fit_and_score(docs)


def op10_quality_clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_clf.score(docs, quality_clf.fit(docs, labels))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_bpe, op3_mixing, op4_warc, op5_ann, op6_neardup, op7_langid, op8_quality_rules, op9_lm, op10_quality_clf)
    return {f.__name__: f for f in own}


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(v[{i // 4 + 1}] / {32 ** (3 - i % 4)}) AS INT) % 32, 1)" for i in range(32)
)

SQL = {
    "op4_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, hex, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS newest,
    list_transform(range(8), lambda i: CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT)) AS v
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM d
""",
    "op6_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS gs
  FROM w
), f AS (
  SELECT doc_id, len(gs) AS n, unnest(gs) AS s FROM g
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM f a JOIN f b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT g.doc_id, CAST(len(g.gs) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept
FROM g JOIN c ON c.x = g.doc_id
""",
    "op8_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), c AS (
  SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM w
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM win, (SELECT unnest(range(5)) AS d) WHERE times > 1 GROUP BY doc_id
), r AS (
  SELECT c.doc_id, c.source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM c LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM r
), a AS (
  SELECT *, (base_failed OR 100 * n_symbols > 50 * n_words OR 500 * n_dup_lines > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS any_failed,
    (base_failed OR 100 * n_symbols > 100 * n_words OR 500 * n_dup_lines > 60 * n_words
    OR 2 * word_chars < 2 * n_words OR word_chars > 40 * n_words) AS clear_failed FROM b
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(any_failed::INT)::DOUBLE AS f FROM a GROUP BY source
), m AS (
  SELECT sum(f) / sum(n) AS mean, sum(f / n * f / n * n) / sum(n) AS sq, count(*) / sum(n) AS per FROM h
), v AS (
  SELECT mean, greatest(sq - mean * mean, 0) - mean * (1 - mean) * per AS between_hosts FROM m
), p AS (
  SELECT mean, least(greatest(CASE WHEN between_hosts <= 0 THEN 10000 ELSE mean * (1 - mean) / between_hosts - 1 END, 1), 10000) AS weight FROM v
), ab AS (
  SELECT greatest(mean, 1e-6) * weight AS a, greatest(1 - mean, 1e-6) * weight AS b FROM p
), j AS (
  SELECT source, (f + a) / (n + (a + b)) > 0.5 OR (f + a) / (n + (a + b)) > 1.25 * a / (a + b) AS distrusted FROM h, ab
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (CASE WHEN distrusted THEN any_failed ELSE clear_failed END) AS kept
FROM a JOIN j ON a.source IS NOT DISTINCT FROM j.source
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
