"""The fixed-window limiter and check() on streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def limited_stream(hits: DataFrame, limit: int, window_ms: int, sweep: bool = False) -> DataFrame:
    """(key, now_ms, allowed) of a stream of (key string, now_ms long): per key a count and the end of its window are state.

    State is two longs for each key. With sweep, a key's state goes when no
    hit has come for a window's time by the clock; the stream then runs
    batches without data for that. Of a batch's rows only the times are held.
    """

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, 0)
        times = np.sort(np.concatenate([rows["now_ms"].to_numpy() for rows in batches]), kind="stable")
        allowed = np.zeros(len(times), bool)
        i = 0
        while i < len(times):
            if not count or times[i] >= until:
                count, until = 0, int(times[i]) + window_ms
            end = int(np.searchsorted(times, until))
            allowed[i : min(end, i + max(0, limit - count))] = True
            count += end - i
            i = end
        state.update((int(count), until))
        if sweep:
            state.setTimeoutDuration(window_ms)
        yield pd.DataFrame({"key": key[0], "now_ms": times, "allowed": allowed})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if sweep else GroupStateTimeout.NoTimeout
    return hits.groupBy("key").applyInPandasWithState(update, "key string, now_ms long, allowed boolean", "count long, until long", "append", timeout)


def each_batch(rows: DataFrame, path: str, checkpoint: str):
    """A query that writes every batch of a stream as it comes, once: what a long job has made so far can be read while it runs."""
    return rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint)
