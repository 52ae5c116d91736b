"""Fetching as a distributed map with an injected fetcher; client options, proxies, agents and language headers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.lang import HTTP_VARIANTS

#: Client defaults and the agents rotated over (fixed values).
CLIENT = {"max_redirects": 10, "timeout_s": 30, "pool_per_host": 10, "idle_s": 60}
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:89.0) Gecko/20100101 Firefox/89.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.1.1 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36",
]
FALLBACK_LANGUAGE = "en-US,en;q=0.9"

Fetcher = Callable[[str, dict], tuple[int | None, str | None, str | None]]


def fetch_all(urls: DataFrame, fetcher: Fetcher, url: str = "url", parallel: int | None = None, options: dict | None = None) -> DataFrame:
    """url, status, body, error of every row; fetcher(url, options) runs in the tasks, an exception becomes the error."""
    opts = CLIENT | (options or {})
    rows = urls.select(F.col(url).alias("url"))
    if parallel:
        rows = rows.repartition(parallel)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for u in pdf["url"]:
                try:
                    out.append((u, *fetcher(u, opts)))
                except Exception as e:  # what a page raises is its result
                    out.append((u, None, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "status", "body", "error"]).astype({"status": "Int32"})

    return rows.mapInPandas(run, "url string, status int, body string, error string")


def proxy_options(proxy: str) -> dict | None:
    """socks5 takes all traffic, http only its own; anything else is skipped."""
    if proxy.startswith("socks5://"):
        return {"all": proxy}
    if proxy.startswith(("http://", "https://")):
        return {"http": proxy}
    return None


def proxy_pool(proxies: list[str]) -> list[dict]:
    return [o for o in map(proxy_options, proxies) if o]


def round_robin(place: Column, choices: list[str]) -> Column:
    """The choice of row place (from 1), in turn; null without choices."""
    return F.get(F.array(*map(F.lit, choices)), F.pmod(place - 1, F.lit(len(choices))).cast("int")) if choices else F.lit(None).cast("string")


def random_choice(choices: list[str], seed: int) -> Column:
    return F.get(F.array(*map(F.lit, choices)), F.floor(F.rand(seed) * len(choices)).cast("int")) if choices else F.lit(None).cast("string")


def accept_language(languages: list[str]) -> str:
    """The header for languages in order of preference."""
    if not languages:
        return FALLBACK_LANGUAGE
    out = []
    for i, code in enumerate(languages):
        q = 1.0 - i / len(languages)
        for j, variant in enumerate(HTTP_VARIANTS.get(code, [code])):
            w = q if j == 0 else q - 0.1
            out.append(variant if w >= 1.0 else f"{variant};q={w:.1f}")
    return ",".join([*out, "*;q=0.1"])


def resolve_hosts(hosts: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """host and address from a cache table (host, address, cached_at) not older than its time to live, else null."""
    fresh = cache.where((F.unix_seconds(now) - F.unix_seconds(F.col("cached_at").cast("timestamp"))) < ttl_seconds).groupBy("host").agg(F.max_by("address", "cached_at").alias("address"))
    return hosts.join(fresh, "host", "left")
