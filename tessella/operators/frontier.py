"""The crawl frontier and task queue as tables: every step takes a state and gives the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.common import named
from tessella.operators.links import ExtensiveConfig

PRIORITIES = {"Low": 1, "Normal": 2, "Medium": 3, "High": 4, "Critical": 5}
RECRAWL_SECONDS = 3600


def priority_rank(p: Column) -> Column:
    """Higher first; names in any case, unknown and null ones last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in PRIORITIES.items() for x in (k.lower(), v)]), F.lower(F.trim(p))), F.lit(0))


def bucket(score: Column, cfg: ExtensiveConfig = ExtensiveConfig()) -> Column:
    low, normal, high = cfg.thresholds
    return F.when(score <= low, "Low").when(score <= normal, "Normal").when(score <= high, "High").otherwise("Critical")


def enqueue(links: DataFrame, seen: DataFrame | None, now_s: int, size: int, cfg: ExtensiveConfig) -> DataFrame:
    """Links (norm, seq, priority, should_crawl) that enter a queue of size entries: norm, bucket, seq, task_depth.

    seen: norm and at_s of what was queued before; within an hour it is not queued again. Of equal ones the first counts.
    """
    new = links.where("should_crawl").withColumn("_n", F.row_number().over(Window.partitionBy("norm").orderBy("seq"))).where("_n = 1").drop("_n")
    if seen is not None:
        recent = seen.where((F.lit(now_s) - F.col("at_s")) < RECRAWL_SECONDS).select("norm").distinct()
        new = new.join(recent, "norm", "left_anti")
    new = new.select("norm", "seq", bucket(F.col("priority"), cfg).alias("bucket"), F.lit(0).alias("task_depth"))
    if cfg.max_queue_size is not None:
        new = new.orderBy("seq").limit(max(0, cfg.max_queue_size - size))
    return new


def discovery_stats(links: DataFrame, pages: int) -> DataFrame:
    """total, filtered, mean priority and links per page."""
    return links.agg(F.count("*").alias("total"), F.count_if(~F.col("should_crawl")).alias("rejected"), F.avg("priority").alias("mean_priority")).withColumn("discovery_rate", F.when(F.lit(pages) > 0, F.col("total") / F.lit(float(max(pages, 1)))).otherwise(0.0))


def truncating_mean(values: Column) -> Column:
    """The running mean whose former value is cut to an integer at every step; values: an ordered array."""
    start = named(n=F.lit(0).cast("long"), mean=F.lit(0.0))
    return F.aggregate(values, start, lambda a, x: named(n=a["n"] + 1, mean=(F.floor(a["mean"]) * a["n"] + x).cast("double") / (a["n"] + 1)))["mean"]


def queue_order(tasks: DataFrame) -> DataFrame:
    """Pending tasks with place: priority first, then age, then id; a task that stands twice counts once."""
    one = tasks.where("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("created_at", "url"))).where("_n = 1 and lower(status) = 'pending'").drop("_n")
    return one.select("id", "url", priority_rank(F.col("priority")).alias("rank"), "created_at").orderBy(F.desc("rank"), F.asc_nulls_last("created_at"), "id")


def retry_delay(attempt: Column, base_ms: int = 1000, cap_ms: int = 30000, factor: float = 2.0) -> Column:
    return F.least(F.floor(F.lit(float(base_ms)) * F.pow(F.lit(factor), attempt.cast("double"))).cast("long"), F.lit(cap_ms).cast("long"))


def can_retry(attempts: Column, most: Column) -> Column:
    return attempts < most


def failed(tasks: DataFrame) -> DataFrame:
    """In-progress tasks after a failure: delay by the attempts so far, one attempt more, Retrying or Dead."""
    a, m = F.coalesce("attempt_count", F.lit(0)), F.coalesce("max_retries", F.lit(3))
    return tasks.where("lower(status) = 'inprogress'").select("id", "url", F.when(can_retry(a, m), retry_delay(a)).alias("delay_ms"), (a + 1).cast("int").alias("attempts"), F.when(a + 1 < m, "Retrying").otherwise("Dead").alias("new_status"))


def completed_stats(done: Column, dead: Column) -> Column:
    """Success in percent of what has ended."""
    return F.when(done + dead > 0, done.cast("double") / (done + dead) * 100.0).otherwise(0.0)


def task_stats(tasks: DataFrame, now: Column) -> DataFrame:
    s = F.lower("status")
    n = lambda x: F.count_if(s == x)
    return tasks.agg(
        F.count("*").alias("total"), n("pending").alias("pending"), n("inprogress").alias("in_progress"), n("completed").alias("completed"), n("failed").alias("failed"), n("retrying").alias("retrying"), n("dead").alias("dead"),
        F.count_if((s == "retrying") & (F.col("delay_until").isNull() | (F.col("delay_until") <= now))).alias("ready_retries"),
    ).withColumn("success_rate", completed_stats(F.col("completed"), F.col("dead")))


def zombies(tasks: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """In-progress tasks older than so long, with their age."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return tasks.where("lower(status) = 'inprogress'").select("id", "url", age.alias("age_s")).where(F.col("age_s") > seconds)


def release_retries(tasks: DataFrame, now: Column) -> DataFrame:
    """Retrying tasks whose time has come are pending again."""
    ready = (F.lower("status") == "retrying") & (F.col("delay_until").isNull() | (F.col("delay_until").cast("timestamp") <= now))
    return tasks.withColumn("status", F.when(ready, "Pending").otherwise(F.col("status")))


def recover(tasks: DataFrame) -> DataFrame:
    """A stored state taken up again: what was in progress is pending with no attempts."""
    was = F.coalesce(F.lower("status") == "inprogress", F.lit(False))
    return tasks.withColumn("attempt_count", F.when(was, 0).otherwise(F.col("attempt_count"))).withColumn("status", F.when(was, "Pending").otherwise(F.col("status")))


def keep_last(tasks: DataFrame, status: str, order: str, n: int) -> DataFrame:
    """The last n tasks of a status."""
    return tasks.where(F.lower("status") == status).orderBy(F.col(order).desc_nulls_last(), F.desc("id")).limit(n)


def alive(rows: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """rows with age_s in whole seconds and alive."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col(at).cast("timestamp"))
    return rows.withColumn("age_s", age).withColumn("alive", F.coalesce(F.col("age_s") < ttl_seconds, F.lit(False)))


def first_visits(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the first row: what a visited gate lets through."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def rounds(links: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """url and round over an edge table (src, dst): breadth first, each url once, every round written before the next."""
    from tessella.common import staged

    known = staged(seeds.select("url").where("url is not null").distinct().withColumn("round", F.lit(0)), "round")
    new = known
    for i in range(1, n + 1):
        nxt = links.join(new.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).where("url is not null").distinct().join(known, "url", "left_anti")
        new = staged(nxt.withColumn("round", F.lit(i)), "round")
        known = known.unionByName(new)
    return known
