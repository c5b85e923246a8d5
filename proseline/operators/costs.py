"""Token costs, and the fixed-window limiter over a batch."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What cache writes and reads cost, in shares of the input rate.
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def cost(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, input_rate: Column, output_rate: Column) -> Column:
    """US dollars, from rates for a million tokens; null where the rates are."""
    return ((input_tokens + cache_write * CACHE_WRITE + cache_read * CACHE_READ) * input_rate + output_tokens * output_rate) / 1e6


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with cost and unknown_reason, of which one is null. A model without rates is unpriced, never free."""
    rows = usage.join(rates, "model", "left")
    rows = rows.withColumn("cost", cost(*map(F.col, ("input_tokens", "output_tokens", "cache_write", "cache_read", "input_per_mtok", "output_per_mtok"))))
    return rows.withColumn("unknown_reason", F.when(F.col("cost").isNull(), "unpriced")).drop("input_per_mtok", "output_per_mtok")


def format_cost(value: Column) -> Column:
    return F.when(value.isNull(), "unpriced").otherwise(F.concat(F.lit("$"), F.format_string("%.4f", value)))


def usage_totals(usage: DataFrame, rates: DataFrame, *by: str) -> DataFrame:
    """Tokens summed by run and model, then priced: the total can't disagree with its parts by rounding."""
    parts = ("input_tokens", "output_tokens", "cache_write", "cache_read")
    return priced(usage.groupBy(*by, "model").agg(*(F.sum(c).alias(c) for c in parts)), rates)


def retries(attempts: DataFrame, *by: str) -> DataFrame:
    """(by, calls, attempts, retries) of attempts(call, ...): a row for each attempt, several for a call that was retried."""
    out = attempts.groupBy(*by).agg(F.count_distinct("call").alias("calls"), F.count(F.lit(1)).alias("attempts"))
    return out.withColumn("retries", F.col("attempts") - F.col("calls"))


def set_cost(cost: float | None, unknown_reason: str | None) -> dict:
    """Either a cost or the reason why there is none; both, neither and what isn't a finite number raise ValueError."""
    if (cost is None) == (unknown_reason is None):
        raise ValueError("either a cost or a reason why it is unknown")
    if cost is not None and not math.isfinite(cost):
        raise ValueError(f"no cost: {cost}")
    return {"cost": cost, "unknown_reason": unknown_reason}


def is_transient(status: Column) -> Column:
    """Whether a failed call is worth another attempt: no connection (null), a timeout, a conflict, too many requests, or the server's fault."""
    return status.isNull() | status.isin(408, 409, 429) | (status >= 500)


def limited(hits: DataFrame, limit: int, window_ms: int, key: str = "key", at: str = "now_ms", order: str | None = None) -> DataFrame:
    """hits with allowed: up to `limit` in a window that starts at a key's first hit, and anew at the first one after its end.

    A window's start depends on the one before, so a key's hits are read in
    order by one task; it streams them, holds one window's count, and jumps
    from window to window. Hits without a key are one group of their own; a
    hit without a time is never allowed and counts for nothing. All columns
    stay; one that is called `allowed` is an error.
    """
    if "allowed" in (c.lower() for c in hits.columns):
        raise ValueError("a column in the way: allowed")
    rows = hits.repartition(F.col(f"`{key}`"))
    rows = rows.sortWithinPartitions(F.col(f"`{key}`"), F.col(f"`{at}`"), *([F.col(f"`{order}`")] if order else []))
    names = hits.columns

    def run(batches):
        last, count, until = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(names.index(key)), batch.column(names.index(at))
            allowed = np.zeros(batch.num_rows, bool)
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                a, b = keys.slice(0, batch.num_rows - 1), keys.slice(1)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
                new[1:] = ~same
            bounds = [*np.nonzero(new)[0].tolist(), batch.num_rows]
            for x, y in zip(bounds, bounds[1:], strict=False):
                k = (keys[x].as_py(),)
                if k != last:
                    last, count, until = k, 0, None
                x += times.slice(x, y - x).null_count  # times that are null come first
                t = times.slice(x, y - x).cast(pa.int64()).to_numpy(zero_copy_only=False)
                i = 0
                while i < len(t):
                    if until is None or t[i] >= until:
                        count, until = 0, int(t[i]) + window_ms
                    end = int(np.searchsorted(t, until))
                    allowed[x + i : x + min(end, i + max(0, limit - count))] = True
                    count += end - i
                    i = end
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(allowed)], names=[*names, "allowed"])

    schema = ", ".join(f"`{n}` {t}" for n, t in hits.dtypes) + ", allowed boolean"
    return rows.mapInArrow(run, schema)
