"""Netscape cookie files as a table; expiry is not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cookies(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", "^#HttpOnly_", "").alias("line"))
    parts = lines.where("line not like '#%' and line != ''").select(F.split("line", "\t").alias("p")).where(F.size("p") >= 7)
    p = F.col("p")
    return parts.select(p[0].alias("domain"), p[2].alias("path"), (F.upper(p[3]) == "TRUE").alias("secure"), p[5].alias("name"), p[6].alias("value"))
