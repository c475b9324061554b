"""Rate limiting replayed over a request log, as folds over each key's requests in time order.

A key's requests are folded in one row, as the bucket is not a sum: what a
request waits depends on all before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import backoff_seconds


def token_bucket_waits(log: DataFrame, rate: float, capacity: float) -> DataFrame:
    """(key, request, t, wait) of a log (key, request, t in seconds).

    A full bucket at the start; a request takes a token or, short of one, waits
    for the rest and leaves the bucket empty (no debt).
    """
    rate, capacity = max(rate, 0.001), max(capacity, 1.0)
    runs = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "request"))).alias("run"))
    # The bucket so far: tokens, time; and the waits, newest last.
    start = F.struct(F.lit(capacity).alias("tokens"), F.col("run")[0]["t"].cast("double").alias("at"), F.array().cast("array<double>").alias("waits"))

    def step(acc, x):
        t = x["t"].cast("double")
        now = F.least(F.lit(capacity), acc["tokens"] + F.greatest(t - acc["at"], F.lit(0.0)) * rate)
        short = now < 1.0
        wait = F.when(short, (1.0 - now) / rate).otherwise(0.0)
        return F.struct(F.when(short, 0.0).otherwise(now - 1.0).alias("tokens"), F.greatest(t, acc["at"]).alias("at"), F.concat(acc["waits"], F.array(wait)).alias("waits"))

    waits = F.aggregate("run", start, step, lambda acc: acc["waits"])
    out = runs.select("key", F.explode(F.arrays_zip("run", waits.alias("wait"))).alias("x"))
    return out.select("key", F.col("x.run.request").alias("request"), F.col("x.run.t").alias("t"), F.col("x.wait").alias("wait"))


def host_blocks(log: DataFrame, most: float = 60.0) -> DataFrame:
    """(host, t, blocked_until, count) after each response of a log (host, t, status, retry_after seconds).

    429 and 503 without a delay raise the host's count and block it for
    min(most, 2 ** min(count, 6)); with one they lower the count and block it for
    the delay; 2xx sets the count to 0.  The latest end of a block stands.
    """
    runs = log.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("t", "status", F.col("retry_after").cast("double").alias("retry_after")))).alias("run"))
    zero = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("until"), F.array().cast("array<struct<until:double,count:bigint>>").alias("out"))

    def step(acc, x):
        pushed_back = x["status"].isin(429, 503)
        plain = pushed_back & x["retry_after"].isNull()
        count = F.when(plain, acc["count"] + 1).when(pushed_back, F.greatest(acc["count"] - 1, F.lit(0).cast("long"))).when((x["status"] >= 200) & (x["status"] < 300), F.lit(0).cast("long")).otherwise(acc["count"])
        block = F.when(plain, backoff_seconds(count, most)).when(pushed_back, F.least(F.lit(most), x["retry_after"]))
        until = F.greatest(acc["until"], F.coalesce(x["t"].cast("double") + block, F.lit(0.0)))
        return F.struct(count.alias("count"), until.alias("until"), F.concat(acc["out"], F.array(F.struct(until.alias("until"), count.alias("count")))).alias("out"))

    states = F.aggregate("run", zero, step, lambda acc: acc["out"])
    out = runs.select("host", F.explode(F.arrays_zip("run", states.alias("state"))).alias("x"))
    return out.select("host", F.col("x.run.t").alias("t"), F.col("x.state.until").alias("blocked_until"), F.col("x.state.count").alias("count"))
