"""Streams: rate limiter per domain, visited gate and time-to-live cache, on Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def visited(stream: DataFrame, key: str = "url", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key; state is kept as long as the watermark allows."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def throughput(stream: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Rows per window and event type; rows later than delay are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def rate_windows(stream: DataFrame, domain: str, millis: str, max_requests: int, window_ms: int, late_ms: int = 3_600_000, bucket_ms: int = 3_600_000, idle_ms: int | None = None) -> DataFrame:
    """domain, millis, in_window, over_limit, wait_ms per request.

    in_window counts the domain's requests of [millis - window_ms, millis] among all that have arrived by then, those of the
    same batch included. A late row counts its own past, never its future; what was given out before is not revised. State
    keeps late_ms beyond the window; a row later than that counts what is left. A domain's requests are split into buckets
    of time (a request that lies in the next bucket's window goes there too), so that no domain is one task. With idle_ms, a
    bucket without requests for so long (processing time) is forgotten; a stream that is to end by itself must go without,
    as pending timeouts keep it alive. Null domains and times are left out.
    """
    out = f"{domain} string, {millis} long, in_window long, over_limit boolean, wait_ms long"
    width = max(bucket_ms, window_ms)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(parts))
        kept = np.array(state.get[0] if state.exists else [], np.int64)
        times = np.sort(np.concatenate([kept, new["_ms"].to_numpy(np.int64)]))
        own = np.sort(new["_ms"].to_numpy(np.int64)[new["_own"].to_numpy(bool)])
        state.update((times[np.searchsorted(times, times[-1] - window_ms - late_ms) :].tolist(),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        n = np.searchsorted(times, own, "right") - np.searchsorted(times, own - window_ms, "left")
        yield pd.DataFrame({domain: key[0], millis: own, "in_window": n, "over_limit": n > max_requests, "wait_ms": np.where(n > 1, window_ms // max_requests, 0)})

    ms = F.col(millis)
    first = F.floor(ms / width).cast("long")
    there = F.when(first != F.floor((ms + window_ms) / width), F.array(first, first + 1)).otherwise(F.array(first))
    rows = stream.where(F.col(domain).isNotNull() & ms.isNotNull()).select(F.col(domain), ms.alias("_ms"), first.alias("_first"), F.explode(there).alias("_bucket"))
    rows = rows.select(domain, "_bucket", "_ms", (F.col("_bucket") == F.col("_first")).alias("_own"))
    return rows.groupBy(domain, "_bucket").applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def ttl_lookup(stream: DataFrame, cache: DataFrame, key: str, time: str, ttl_seconds: int) -> DataFrame:
    """Stream rows with the newest cache row (key, value, cached_at) that was alive at their time."""
    c = cache.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct("cached_at", "value")).alias("_c"))
    age = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.col("_c.cached_at").cast("timestamp"))
    return stream.join(c, F.col(key) == F.col("_k"), "left").withColumn("value", F.when((age >= 0) & (age < ttl_seconds), F.col("_c.value"))).drop("_k", "_c")


def process_queue(spark, tasks: DataFrame, work, state: str, limit: int, rounds: int) -> DataFrame:
    """Rounds of a task queue: the best pending tasks go to work(DataFrame of id, url) -> DataFrame of id, ok; failures are
    retried or die, and each round's state is a written table. Returns the last state."""
    from tessella.common import staged
    from tessella.operators.frontier import can_retry, queue_order

    current = staged(tasks, state)
    for _ in range(rounds):
        batch = staged(queue_order(current).limit(limit).select("id", "url"), state)
        if batch.isEmpty():
            break
        done = staged(work(batch).select("id", "ok"), state)
        a, m = F.coalesce("attempt_count", F.lit(0)), F.coalesce("max_retries", F.lit(3))
        new = F.when(F.col("ok"), "Completed").when(~F.col("ok"), F.when(can_retry(a + 1, m), "Pending").otherwise("Dead")).otherwise(F.col("status"))
        current = staged(current.join(done, "id", "left").withColumn("attempt_count", (a + F.when(F.col("ok").isNotNull(), 1).otherwise(0)).cast("int")).withColumn("status", new).drop("ok"), state)
    return current
