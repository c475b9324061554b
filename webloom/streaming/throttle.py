"""The token bucket over a stream of requests: state per key, waits as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def token_bucket_stream(log: DataFrame, rate: float, capacity: float) -> DataFrame:
    """(key, request, t, wait) of a streaming log (key string, request long, t double).

    Requests of a key are taken in time order within a batch; the bucket goes on
    from batch to batch.
    """
    ship(log.sparkSession)
    rate, capacity = max(rate, 0.001), max(capacity, 1.0)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "request"])
        tokens, at = state.get if state.exists else (capacity, float(rows["t"].iloc[0]))
        waits = []
        for t in rows["t"]:
            tokens = min(capacity, tokens + max(t - at, 0.0) * rate)
            at = max(t, at)
            waits.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
            tokens = tokens - 1 if tokens >= 1 else 0.0
        state.update((tokens, at))
        yield pd.DataFrame({"key": key[0], "request": rows["request"], "t": rows["t"], "wait": waits})

    return log.groupBy("key").applyInPandasWithState(fold, "key string, request long, t double, wait double", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)
