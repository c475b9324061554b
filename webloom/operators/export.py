"""A browsable copy on disk: every row of a table of files becomes a file."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bodies that a worker holds at a time, apart from one that is larger by itself.
BATCH_BYTES = 64 << 20


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, by the session's default filesystem where it names none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def safe_path(path: str) -> str:
    """The path without empty steps, and with ``_`` in place of those that lead out of the folder."""
    return "/".join("_" if x in (".", "..") else x for x in path.split("/") if x)


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files`` (local_path, url, body) below ``folder``; returns (local_path, bytes).

    Each task writes the files of its own rows, in batches bounded by bytes, under
    a temporary name and then renamed: a task that runs again replaces its files
    by equal ones.  Of several rows with one path that of the smallest address is
    written.  Rows without a path are left out; a null body makes an empty file.
    Every executor must see ``folder``.
    """
    spark = files.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    uri = qualified(spark, folder)
    chosen = files.where("local_path is not null").groupBy("local_path").agg(F.min_by("body", F.coalesce("url", F.lit(""))).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, target = body.as_py() or b"", f"{root}/{safe_path(path)}"
                parent, name = posixpath.split(target)
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                temporary = f"{parent}/.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                fs.move(temporary, f"{parent}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["local_path", "bytes"])

    return chosen.select("local_path", "body").mapInArrow(run, "local_path string, bytes long")
