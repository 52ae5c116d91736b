"""Crawl, performance and error events as rows, from attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of crawl event (fixed values).
KINDS = "Started Completed Failed Retrying Blocked RateLimited Cached Redirected Timeout".split()
LEAST_WAIT_MS = 100


def kind(name: Column) -> Column:
    """The kind a code of any spelling names, or null."""
    low = F.regexp_replace(F.lower(F.trim(name)), "[^a-z]", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k.lower(), k)]), low)


def of_attempts(attempts: DataFrame) -> DataFrame:
    """Two rows per attempt (url, at_ms, duration_ms, ok, allowed, wait_ms, error, attempt, retries): Started and how it ended."""
    end = (
        F.when(~F.col("allowed"), "Blocked")
        .when(F.col("wait_ms") > LEAST_WAIT_MS, "RateLimited")
        .when(F.col("ok"), "Completed")
        .when(F.lower("error").contains("timeout"), "Timeout")
        .when(F.col("attempt") < F.col("retries"), "Retrying")
        .otherwise("Failed")
    )
    both = F.array(F.struct(F.lit("Started").alias("event_type"), F.col("at_ms").alias("ts_ms")), F.struct(end.alias("event_type"), (F.col("at_ms") + F.coalesce("duration_ms", F.lit(0))).alias("ts_ms")))
    return attempts.select("url", "duration_ms", "error", F.explode(both).alias("e")).select("url", "e.event_type", "e.ts_ms", "duration_ms", "error")


def performance(events: DataFrame) -> DataFrame:
    """Of each kind the number, mean and largest duration."""
    return events.select(kind(F.col("event_type")).alias("kind"), "duration_ms").where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
