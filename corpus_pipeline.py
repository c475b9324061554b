"""The corpus pipeline: five stages, each written and read again by its caller.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Each stage learns and counts on the
documents that it is given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, langid, mixing, neardup, quality_rules
from webloom.llm.common import free_prefix, materialize, read_table
from webloom.llm.queries import RANK_FILE


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of the whole row, and its name; keys go by id, rows without one last."""
    name = f"{free_prefix(docs)}key"
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), mixing.fingerprint(docs).alias("fp"))
    return docs.withColumn(name, key), name


def _by_key(keyed: DataFrame, name: str) -> DataFrame:
    """The rows for an operator, the key in place of the id."""
    return keyed.withColumn("doc_id", F.col(name)).drop(name)


def _only(keyed: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The documents whose key is in ``wanted`` (doc_id)."""
    keys = wanted.select(F.col("doc_id").alias(f"{name}_wanted")).distinct()
    return keyed.join(keys, F.col(name).eqNullSafe(F.col(f"{name}_wanted")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    keyed, name = _keyed(docs)
    found = langid.predict(_by_key(keyed, name), langid.fit(docs))
    return _only(keyed, name, found.where(F.col("lang_pred") != langid.UNDETERMINED)).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    keyed, name = _keyed(docs)
    return _only(keyed, name, quality_rules.judge(_by_key(keyed, name)).where("kept")).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, and of rows that share it the smallest key.

    Rows without an id come last; those linked with nothing stay, equal rows once.
    """
    keyed, name = _keyed(docs)
    found = neardup.near_duplicates(_by_key(keyed, name))
    return _only(keyed, name, found.where("kept")).dropDuplicates([name]).drop(name)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: runs of whole blocks, repeated as often as taken."""
    return mixing.mix_pieces(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each piece of the mix."""
    return bpe.round_trip_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the language model nor the pseudorandom mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
