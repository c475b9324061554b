"""Rows made in Python from rows, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

#: Rows of one output batch: a worker holds no more of them, however many its input makes.
OUTPUT_ROWS = 1000

TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def flat_map(df: DataFrame, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of every row's values; ``schema`` is "name type, ...".

    A worker holds one input batch, which Spark bounds in rows and bytes, as Arrow
    data, and beside it the values of one row and the rows not yet sent.
    """
    ship(df.sparkSession)
    target = pa.schema([(name, TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        while (batch := next(batches, None)) is not None:
            for i in range(batch.num_rows):
                for row in each(*(c[i].as_py() for c in batch.columns)):
                    rows.append(row)
                    if len(rows) == OUTPUT_ROWS:
                        yield packed(rows)
                        rows.clear()
            del batch  # before the next one is read
        if rows:
            yield packed(rows)

    return df.mapInArrow(run, schema)
