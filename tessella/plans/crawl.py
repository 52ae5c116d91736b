"""Whole pipelines: fetched pages through the gates to stored results, discovery, and the analytics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import staged
from tessella.functions import html as H
from tessella.functions import lang as L
from tessella.functions import urls as U
from tessella.operators import frontier, links, politeness
from tessella.plans.config import CrawlerConfig


def admitted(urls: DataFrame, robots: DataFrame, cfg: CrawlerConfig = CrawlerConfig()) -> DataFrame:
    """Each url once, valid and allowed by its host's robots text; url and delay_ms."""
    p = U.parsed(F.col("url"))
    one = urls.select("url").where(U.valid_core(F.col("url"))).distinct().withColumn("host", p.host).withColumn("path", p.path)
    return politeness.robots_verdict(one, politeness.robots_rules(robots), "host", "path").where("allowed").select("url", "delay_ms")


def extracted(pages: DataFrame, cfg: CrawlerConfig, html: str = "html") -> DataFrame:
    """pages with title, text, words and language; text is '' where a gate stops the page, kept where words reach the minimum.

    The steps are written tables, as each is used several times by the next.
    """
    least, stop = cfg.latin
    text, words = H.gated(F.col(html), least, stop)
    first = staged(pages.withColumn("title", H.title(F.col(html))).withColumn("_text", text).withColumn("_words", words), "gated")
    second = staged(first.withColumn("_code", L.detect(F.col("_text"))), "detected")
    ok = L.gate_ok(F.col("_code"), list(cfg.languages))
    out = second.withColumn("text", F.when(ok, F.col("_text")).otherwise("")).withColumn("words", F.when(ok, F.col("_words")).otherwise(0).cast("long")).withColumn("language", F.when(ok, F.col("_code")))
    return out.withColumn("kept", F.coalesce(F.col("words") >= cfg.min_words, F.lit(False))).drop("_text", "_words", "_code")


def discover(pages: DataFrame, page: str, base: str, html: str, cfg: links.ExtensiveConfig) -> DataFrame:
    """Links of pages, processed, filtered and entered into an empty frontier: norm, bucket, seq."""
    found = links.process(links.extract(pages, page, base, html), page, base, cfg)
    kept = links.filter_processed(found, page, cfg)
    ordered = kept.withColumn("seq", F.concat(F.lpad(F.col(page).cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col("rank").cast("string"), 10, "0")))
    return frontier.enqueue(ordered, None, 0, 0, cfg)
