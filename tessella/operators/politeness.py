"""Robots rules and rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import trimmed

DEFAULT_LIMIT = (2, 1000)


def robots_rules(robots: DataFrame, host: str = "host", text: str = "robots_txt") -> DataFrame:
    """host and rules: the directives under '*' in order, each struct(pos, kind, value, number); a later agent line ends a section.

    A value ends at a second colon. Empty values of allow and disallow are no rules. Hosts of equal name have their rules
    one after another; null text has none.
    """
    lines = robots.select(F.col(host).alias("host"), F.posexplode_outer(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n", -1)).alias("pos", "raw"))
    lines = lines.withColumn("line", trimmed(F.col("raw"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    name = F.lower(F.regexp_extract("line", r"^([A-Za-z-]+):", 1))
    value = trimmed(F.get(F.split("line", ":", -1), F.lit(1)))
    lines = lines.withColumn("name", name).withColumn("value", value)
    agent = F.last(F.when(F.col("name") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rules = lines.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("name").isin("allow", "disallow", "crawl-delay", "request-rate"))
    plain = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
    parts = F.split("value", "/", -1)
    rate = F.when((F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike(plain) & F.get(parts, F.lit(1)).rlike(plain), F.try_divide(F.get(parts, F.lit(1)).try_cast("double"), F.get(parts, F.lit(0)).try_cast("double")))
    seconds = F.when(F.col("name") == "crawl-delay", F.when(F.col("value").rlike(plain), F.col("value").try_cast("double"))).when(F.col("name") == "request-rate", rate)
    delay = F.floor(seconds * 1000).cast("long")
    kept = rules.withColumn("delay", delay).where((F.col("name").isin("allow", "disallow") & (F.col("value") != "")) | F.col("delay").isNotNull())
    return kept.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value", "delay"))).alias("rules"))


def robots_verdict(urls: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """urls with allowed and delay_ms: the last rule whose value begins the path decides; no rule or no robots text allows."""
    joined = urls.join(rules.withColumnRenamed("host", "_h"), F.col(host) == F.col("_h"), "left").drop("_h")
    hit = F.filter(F.col("rules"), lambda r: r["name"].isin("allow", "disallow") & F.col(path).startswith(r["value"]))
    delays = F.filter(F.col("rules"), lambda r: r["delay"].isNotNull())
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return joined.withColumn("allowed", F.coalesce(last(hit)["name"] == "allow", F.lit(True))).withColumn("delay_ms", last(delays)["delay"]).drop("rules")


def with_limits(rows: DataFrame, limits: DataFrame, domain: str, default: tuple[int, int] = DEFAULT_LIMIT) -> DataFrame:
    """rows with max_requests and window_ms of their domain, or the default. A repeated domain takes its smallest limit."""
    one = limits.where("domain is not null").groupBy(F.col("domain").alias("_d")).agg(F.min(F.struct("max_requests", "window_ms")).alias("_l"))
    return rows.join(one, F.col(domain) == F.col("_d"), "left").withColumn("max_requests", F.coalesce("_l.max_requests", F.lit(default[0])).cast("int")).withColumn("window_ms", F.coalesce("_l.window_ms", F.lit(default[1])).cast("long")).drop("_d", "_l")


def in_window(rows: DataFrame, domain: str, millis: str, window_ms: int, bucket_ms: int | None = None) -> DataFrame:
    """rows with in_window: requests of the domain in the window_ms up to and including each row's time.

    A hot domain is cut into time buckets no shorter than the window; each bucket also gets the rows of the bucket before,
    so no task holds a whole domain. Null times or domains count nothing and get null.
    """
    width = max(bucket_ms or 64 * window_ms, window_ms + 1)
    ok = rows.where(F.col(domain).isNotNull() & F.col(millis).isNotNull()).withColumn("_b", F.floor(F.col(millis) / width))
    own, carried = ok.withColumn("_own", F.lit(True)), ok.withColumn("_own", F.lit(False)).withColumn("_b", F.col("_b") + 1).where(F.col(millis) >= F.col("_b") * width - window_ms)
    w = Window.partitionBy(domain, "_b").orderBy(millis).rangeBetween(-window_ms, 0)
    counted = own.unionByName(carried).withColumn("in_window", F.count("*").over(w)).where("_own").drop("_b", "_own")
    return counted.unionByName(rows.where(F.col(domain).isNull() | F.col(millis).isNull()).withColumn("in_window", F.lit(None).cast("long")))


def wait_ms(tracked: Column, max_requests: Column, window_ms: Column, seed: int | None = None) -> Column:
    """0 with nothing tracked, else the window over the limit, plus up to a quarter at random if a seed is given."""
    base = F.try_divide(window_ms, max_requests).cast("long")
    jitter = F.lit(0) if seed is None else F.floor(F.rand(seed) * (F.floor(base / 4) + 1)).cast("long")
    return F.when(tracked == 0, 0).otherwise(base + jitter).cast("long")


def active_trackers(rows: DataFrame, domain: str, millis: str, now: int, max_age_ms: int = 3_600_000) -> DataFrame:
    """Domains with a request in the last hour and how many requests they have."""
    return rows.groupBy(domain).agg(F.count("*").alias("tracked"), F.max(millis).alias("last_ms")).where(F.lit(now) - F.col("last_ms") < max_age_ms)
