"""Aggregates over stored results and crawl events. Empty input gives zeros, not nulls; ties are broken by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.common import named
from tessella.functions.urls import domain

SUCCESS = ["completed", "cached"]
FAILURE = ["failed", "timeout", "blocked"]


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.floor(a / b)).otherwise(0).cast("long")


def _pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b * 100.0).otherwise(0.0)


def summary(results: DataFrame) -> DataFrame:
    """Totals, distinct hosts, whole means of words and milliseconds, successes and failures; a null status is neither."""
    status, host = F.col("metadata.status_code"), domain(F.col("url"))
    a = results.agg(
        F.count("*").alias("total"), F.count_distinct(host).alias("unique_domains"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("_w"), F.coalesce(F.sum("metadata.response_time_ms"), F.lit(0)).alias("_ms"),
        F.count_if(status.between(200, 299)).alias("successful"), F.count_if(status.isNotNull() & ~status.between(200, 299)).alias("failed"),
    )
    return a.select("total", "unique_domains", _div(F.col("_w"), F.col("total")).alias("average_words"), _div(F.col("_ms"), F.col("total")).alias("average_ms"), "successful", "failed")


def top_hosts(results: DataFrame, n: int = 10) -> DataFrame:
    return results.select(domain(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(n)


def languages(results: DataFrame) -> DataFrame:
    return results.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def analytics(results: DataFrame) -> DataFrame:
    """All of the above in one row: top_domains an array of struct(host, n), language_distribution a map."""
    tops = top_hosts(results).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "host", "n"))).alias("t")).select(F.transform("t", lambda x: named(host=x["host"], n=x["n"])).alias("top_domains"))
    langs = languages(results).agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("language_distribution"))
    return summary(results).crossJoin(tops).crossJoin(langs)  # one row each


def _kind(c: str = "event_type") -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(c))), "[^a-z]", "")


def domain_metrics(events: DataFrame) -> DataFrame:
    """Per host: requests, successes, failures, mean milliseconds, bytes of successes, last time."""
    k, host = _kind(), domain(F.col("url"))
    e = events.where(k.isin(*SUCCESS, *FAILURE)).withColumn("host", host)
    ok = k.isin(SUCCESS)
    return e.where("host is not null").groupBy("host").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("content_length"))), F.lit(0)).alias("bytes"), F.max("ts").alias("last_seen"),
    )


def snapshot(events: DataFrame) -> DataFrame:
    """One row over all requests: rates per whole second of uptime are 0 under one second."""
    k = _kind()
    ok, ended = k.isin(SUCCESS), k.isin(*SUCCESS, *FAILURE)
    a = events.agg(
        F.count_if(ended).alias("total_requests"), F.count_if(ok).alias("ok"), F.count_if(k == "retrying").alias("retries"), F.count_if(k == "started").alias("started"),
        F.coalesce(F.sum(F.when(ended, F.col("duration_ms"))), F.lit(0)).alias("ms"), F.coalesce(F.sum(F.when(ok, F.col("content_length"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), F.lit(0)).alias("uptime_secs"),
    )
    per = lambda c: F.when(F.col("uptime_secs") > 0, F.col(c).cast("double") / F.col("uptime_secs")).otherwise(0.0)
    mean = F.when(F.col("total_requests") > 0, F.col("ms").cast("double") / F.col("total_requests")).otherwise(0.0)
    return a.select("uptime_secs", "total_requests", "retries", _pct(F.col("ok"), F.col("total_requests")).alias("success_rate"), mean.alias("avg_ms"), per("total_requests").alias("requests_per_second"), per("bytes").alias("bytes_per_second"), _pct(F.col("ok"), F.col("started")).alias("completion_rate"))


def sessions(events: DataFrame) -> DataFrame:
    """Per session: urls, processed, successful, failed, mean milliseconds, seconds, throughput, rates, urls left and time to go."""
    k = _kind()
    ok, ended = k.isin(SUCCESS), k.isin(*SUCCESS, *FAILURE)
    ts = F.col("ts").cast("timestamp")
    a = events.where("session_id is not null").groupBy("session_id").agg(
        F.count_distinct("url").alias("total_urls"), F.count_if(ended).alias("processed"), F.count_if(ok).alias("successful"), F.coalesce(F.sum(F.when(ended, F.col("duration_ms"))), F.lit(0)).alias("ms"),
        F.coalesce(F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts)), F.lit(0)).alias("seconds"),
    )
    speed = F.when(F.col("seconds") >= 1, F.col("processed").cast("double") / F.col("seconds")).otherwise(0.0)
    left = F.greatest(F.lit(0), F.col("total_urls") - F.col("processed"))
    return a.select(
        "session_id", "total_urls", "processed", "successful", (F.col("processed") - F.col("successful")).alias("failed"), _div(F.col("ms"), F.col("processed")).alias("average_ms"), "seconds", speed.alias("throughput"),
        _pct(F.col("successful"), F.col("processed")).alias("success_rate"), _pct(F.col("processed"), F.col("total_urls")).alias("completion_rate"), left.alias("remaining"), F.when((speed > 0) & (left > 0), left / speed).alias("eta_seconds"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """How many urls have each event type last, by event_id."""
    last = events.where("url is not null").groupBy("url").agg(F.max_by(_kind(), "event_id").alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n"))
