"""Session helpers: a local session for tests, and the package on every worker."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers then need no installation and no PYTHONPATH of their own.
    """
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="webloom-code-")
    archive = os.path.join(folder, "webloom_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it when they start
    _shipped.add(sc.applicationId)
