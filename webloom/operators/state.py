"""Crawl state: stores, checkpoints and the manifest."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, changes: DataFrame, key: str = "url") -> DataFrame:
    """The store with the changes put in; the later write of a key wins (``changes`` after ``store``)."""
    both = store.withColumn("__order", F.lit(0)).unionByName(changes.withColumn("__order", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col("__order").desc())
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__order")


def by_ending(store: DataFrame, endings: list[str]) -> DataFrame:
    """Entries whose local path has one of the endings."""
    return store.where(F.lower(F.regexp_extract("local_path", r"(\.[^./]*)$", 1)).isin(endings))


def ordered_distinct(rows: DataFrame) -> DataFrame:
    """(path, seq): each path once, at its first place."""
    return rows.groupBy("path").agg(F.min("seq").alias("seq"))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """A small file, whole or not at all: written beside its place, then renamed."""
    fs, at = _filesystem(spark, path)
    out = fs.create(at(path + ".tmp"), True)
    out.write(bytearray(json.dumps(data, indent=2, ensure_ascii=False).encode()))
    out.close()
    # One step: there is always a whole file, the old one or the new one.
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at(path + ".tmp"), at(path), flags)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The file's content; None where it is missing or damaged."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at(path)):
        return None
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return None


def save_checkpoint(spark: SparkSession, folder: str, visited: DataFrame, frontier: DataFrame, depth: int, **more) -> None:
    """State of a finished round: tables under the round's number, then the pointer to them."""
    at = f"{folder}/round-{depth:05d}"
    visited.write.mode("overwrite").parquet(f"{at}/visited")
    frontier.write.mode("overwrite").parquet(f"{at}/frontier")
    write_json(spark, f"{folder}/checkpoint.json", {"depth": depth, "round": f"round-{depth:05d}", **more})


def load_checkpoint(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int] | None:
    """(visited, frontier, depth) of the last finished round, or None."""
    found = read_json(spark, f"{folder}/checkpoint.json")
    if not found or "round" not in found:
        return None
    at = f"{folder}/{found['round']}"
    return spark.read.parquet(f"{at}/visited"), spark.read.parquet(f"{at}/frontier"), int(found["depth"])


def manifest(site: str, pages: DataFrame, assets: DataFrame, now: datetime | None = None) -> dict:
    """The manifest of one site: pages (path, seq) and assets (path, seq), each path once, in order."""
    listed = lambda rows: [r.path for r in ordered_distinct(rows).orderBy("seq", "path").collect()]
    stamp = (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "site": site,
        "created_utc": stamp,
        "pages": listed(pages),
        "assets": listed(assets),
        "layout": {"pages_dir": "pages", "assets_dir": "assets", "vendor_dir": "assets/vendor"},
        "notes": "",
    }
