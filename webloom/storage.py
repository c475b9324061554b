"""Tables that an operator keeps between jobs.

They go to the folder that the session names in ``spark.checkpoint.dir``; only a
single-machine session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can see."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return f"file://{_own_dir[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/webloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    The lineage is cut, lost executors lose nothing, and later uses read only
    the columns that they need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(keep: int = 0) -> None:
    """Delete what ``materialize`` has written, except the last ``keep``.

    For long sessions: call it when results that read these tables are stored.
    """
    while len(_written) > keep:
        spark, path = _written.pop(0)
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)
