"""Configurations, resolved on the driver: crawler, environment, requests, presets."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import LATIN_BASIC, LATIN_DEFAULT, LATIN_ENHANCED

Limit = tuple[int, int]  # requests, milliseconds


@dataclass(frozen=True)
class Retry:
    tries: int = 3
    base_ms: int = 1000
    cap_ms: int = 30000
    factor: float = 2.0
    jitter: float = 0.1


@dataclass(frozen=True)
class CrawlerConfig:
    seeds: tuple[str, ...] = ("https://example.com",)
    avoid_extensions: tuple[str, ...] = (".pdf", ".jpg", ".png")
    target_words: tuple[str, ...] = ("news", "article", "content", "information")
    min_words: int = 50
    proxies: tuple[str, ...] = ()
    user_agent: str = "Mozilla/5.0 (compatible; tessella/1.0)"
    languages: tuple[str, ...] = ("en",)
    default_limit: Limit = (2, 1000)
    domain_limits: dict[str, Limit] = field(default_factory=dict)
    retry: Retry = Retry()
    follow_links: bool = False
    max_depth: int = 2
    max_urls: int = 100
    filter_keywords: bool = False
    latin: tuple[int, list[str]] = LATIN_DEFAULT


#: Presets (their numbers and names are fixed values).
PRODUCTION = CrawlerConfig(
    seeds=("https://www.bbc.com", "https://news.naver.com", "https://httpbin.org", "https://example.com"), avoid_extensions=(), min_words=100, languages=("en", "ko", "de", "fr", "zh", "ja"), default_limit=(3, 1000),
    domain_limits={"bbc.com": (2, 1000), "news.naver.com": (1, 2000), "spiegel.de": (1, 2000), "httpbin.org": (5, 1000), "example.com": (3, 1000)}, retry=Retry(3, 1000, 10000, 2.0, 0.2), latin=LATIN_ENHANCED,
)
DEVELOPMENT = CrawlerConfig(
    seeds=("https://httpbin.org", "https://example.com"), avoid_extensions=(), target_words=("test", "content"), default_limit=(5, 1000), domain_limits={"httpbin.org": (10, 1000), "example.com": (5, 1000)},
    retry=Retry(2, 500, 3000, 1.5, 0.1), follow_links=True, max_depth=1, max_urls=20, latin=LATIN_BASIC,
)
DEMO = CrawlerConfig(
    seeds=("https://httpbin.org", "https://example.com"), avoid_extensions=(), target_words=("demo", "example", "test"), min_words=30, languages=("en", "fr", "de"), default_limit=(3, 1000),
    domain_limits={"httpbin.org": (5, 1000), "example.com": (2, 1000)}, retry=Retry(2, 500, 5000, 2.0, 0.2), max_depth=1, max_urls=10, filter_keywords=True, latin=LATIN_BASIC,
)
PRESETS = {"production": PRODUCTION, "development": DEVELOPMENT, "demo": DEMO}
ENVIRONMENT_LIMITS = {"development": (1, 1000), "staging": (5, 1000), "production": (10, 1000)}
ENVIRONMENT_LEVELS = {"development": "debug", "staging": "info", "production": "warn"}


@dataclass(frozen=True)
class Environment:
    name: str = "development"
    crawler: CrawlerConfig = CrawlerConfig()
    log_level: str = "info"
    log_file_mb: int = 100
    metrics_port: int = 9090
    metrics: bool = True
    checkpoint_seconds: int = 60
    persist_queue: bool = False

    def validated(self) -> Environment:
        if self.metrics_port < 1024:
            raise ValueError("the metrics port must be at least 1024")
        if self.log_file_mb <= 0 or self.checkpoint_seconds <= 0:
            raise ValueError("sizes and intervals must be positive")
        return self

    def optimized(self) -> Environment:
        out = replace(self, crawler=replace(self.crawler, default_limit=ENVIRONMENT_LIMITS[self.name]), log_level=ENVIRONMENT_LEVELS[self.name], metrics=True)
        return replace(out, persist_queue=True) if self.name == "production" else out

    def with_env(self, env: dict[str, str] | None = None) -> Environment:
        """CRAWLER_ENV, LOG_LEVEL and METRICS_PORT over the settings; values that are unknown are ignored."""
        env, out = dict(os.environ) if env is None else env, self
        if env.get("CRAWLER_ENV", "").lower() in ENVIRONMENT_LIMITS:
            out = replace(out, name=env["CRAWLER_ENV"].lower())
        if env.get("LOG_LEVEL"):
            out = replace(out, log_level=env["LOG_LEVEL"])
        if env.get("METRICS_PORT", "").isdigit() and int(env["METRICS_PORT"]) < 65536:
            out = replace(out, metrics_port=int(env["METRICS_PORT"]))
        return out


def load(path: str, env: dict[str, str] | None = None) -> Environment:
    """A TOML file of Environment's plain fields, then the environment variables."""
    import tomllib

    with open(path, "rb") as f:
        raw = tomllib.load(f)
    known = {k: v for k, v in raw.items() if k in Environment.__dataclass_fields__ and k != "crawler"}
    return Environment(**known).with_env(env)


def save(cfg: Environment, path: str) -> None:
    def text(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k} = {text(getattr(cfg, k))}\n" for k in Environment.__dataclass_fields__ if k != "crawler")


def request_error(base_url: Column, max_urls: Column, max_depth: Column, extensions: Column, strategy: Column) -> Column:
    """The first thing wrong with a crawl request, or null."""
    return (
        F.when(F.coalesce(base_url, F.lit("")) == "", "Base URL is required")
        .when(~base_url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//(?:[/?#]|$))\S"), "Invalid URL format")
        .when(F.coalesce(max_urls, F.lit(0)) == 0, "Max total URLs must be greater than 0")
        .when(F.coalesce(max_depth, F.lit(0)) == 0, "Max crawl depth must be greater than 0")
        .when(F.coalesce(F.exists(extensions, lambda e: e == ""), F.lit(False)), "URL extensions cannot be empty")
        .when(~F.coalesce(strategy, F.lit("")).isin("any", "all"), "Match strategy must be 'any' or 'all'")
    )


def clamp_form(max_urls: int, concurrency: int, delay: int, depth: int) -> tuple[int, int, int, int]:
    """The bounds a form keeps to."""
    hold = lambda v, a, b: max(a, min(b, v))
    return hold(max_urls, 1, 1000), hold(concurrency, 1, 10), hold(delay, 1, 10000), hold(depth, 1, 50)


__all__ = ["PRESETS", "CrawlerConfig", "Environment", "Retry", "clamp_form", "load", "request_error", "save"]
