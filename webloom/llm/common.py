"""Helpers shared by the training-data operators.

Everything an operator keeps between jobs goes to the folder that the session
names in ``spark.checkpoint.dir`` (see ``webloom.storage``).
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import fresh_path, materialize, release, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these bytes.  ``bytes.split()``
#: splits on exactly this set, and ``bytes.lower()`` changes A-Z only.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: long documents must not add up to a large batch.
ARROW_ROWS = 1000

def tune(spark: SparkSession) -> None:
    """The package on the workers; small Arrow batches, unless the session asks for smaller ones."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that an operator adds."""
    prefix = "__webloom_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample_order(doc_id: Column) -> Column:
    """A fixed pseudorandom order of ids, for bounded training samples."""
    return F.xxhash64(F.lit("sample"), doc_id)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lean(run: Callable) -> Callable:
    """A batch function that gives its worker's free memory back when a task ends.

    Workers outlive tasks, and the next operator runs beside what they hold.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
