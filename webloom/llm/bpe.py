"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` gives each text its token ids, ``decode`` turns ids back into raw
bytes.  Long texts are cut before the pattern sees them, only where every match
ends anyway, so pieces encode to the same ids as the whole.

Cases: a null or empty text has no ids and decodes to empty bytes; repeated
rows are encoded each on its own; an empty table gives an empty table; other
columns pass through untouched.  A text of one unbroken run has no safe cut and
is encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, tune

#: Texts beyond this many characters are cut.
PIECE_CHARS = 50_000

#: Between an ASCII letter, digit or stop and a blank or line end: the pattern
#: has no match over such a place, whatever stands around it.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")


@lru_cache(maxsize=4)
def load_encoding(rank_file: str, pattern: str):
    """The encoding of a rank file; one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut at the first safe place after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, text_col: str, ids_col: str, rank_file: str, pattern: str) -> DataFrame:
    """``df`` with an array column of token ids."""
    tune(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_file, pattern)
        for batch in batches:
            ids = [np.array(encode_text(encoding, x or ""), np.int32) for x in batch.column(at).to_pylist()]
            yield _with_column(batch, ids_col, _lists(ids))

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, ids_col: str, out_col: str, rank_file: str, pattern: str) -> DataFrame:
    """``df`` with a binary column: the bytes that the ids stand for."""
    tune(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_file, pattern)
        for batch in batches:
            out = [encoding.decode_bytes(x or []) for x in batch.column(at).to_pylist()]
            yield _with_column(batch, out_col, pa.array(out, pa.binary()))

    return df.mapInArrow(lean(run), schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, text): token count, digest of the ids, digest of the decoded bytes."""
    rows = docs.select("doc_id", "text")
    rows = encode(rows, "text", "ids", rank_file, pattern).select("doc_id", "ids")
    rows = decode(rows, "ids", "decoded", rank_file, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
