"""Links of pages: extraction, classification, scope, scoring, de-duplication. One row per link; order is (page, pass, pos).

Null HTML or base gives no links. Ties are broken by seq, the place of the link on its page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.common import named, staged
from tessella.functions import urls as U

#: Extensions that tell categories apart, and those not crawled by default (fixed values).
DOCUMENT = "pdf doc docx xls xlsx ppt pptx txt rtf".split()
MEDIA = "mp3 mp4 avi mov wmv flv wav ogg".split()
RESOURCE = "jpg jpeg png gif bmp svg webp css js ico".split()
EXCLUDED = "pdf doc docx xls xlsx ppt pptx zip rar tar gz 7z jpg jpeg png gif bmp svg webp mp3 mp4 avi mov wmv flv exe msi dmg pkg".split()

_ANCHOR = r"""<a[^>]+href\s*=\s*["']([^"']+)["'][^>]*>([^<]*)</a>"""
_IMAGE = r"""<img[^>]+src\s*=\s*["']([^"']+)["'][^>]*>"""
_SHEET = r"""<link[^>]+href\s*=\s*["']([^"']+)["'][^>]*>"""


@dataclass(frozen=True)
class Scoring:
    base: int = 50
    internal: int = 20
    external: int = 10
    document: int = 15
    resource: int = 30
    media: int = 20
    other: int = 5
    anchor: int = 10
    root: int = 15
    shallow: int = 10
    deep: int = 10
    pattern: int = 30
    query: int = 5
    fragment: int = 3


@dataclass(frozen=True)
class ExtensiveConfig:
    enabled: bool = True
    max_depth: tuple[str, int] = ("limited", 3)  # or ("unlimited", 0), ("exact", n)
    scope: str = "same_domain"  # subdomains, allow_list, block_list, unrestricted
    domains: tuple[str, ...] = ()
    include_extensions: tuple[str, ...] | None = None
    exclude_extensions: tuple[str, ...] | None = tuple(EXCLUDED)
    include_patterns: tuple[str, ...] | None = None
    exclude_patterns: tuple[str, ...] | None = None
    min_url_length: int | None = 10
    max_url_length: int | None = 2048
    exclude_query_params: bool = False
    exclude_fragments: bool = True
    scoring: Scoring = Scoring()
    thresholds: tuple[int, int, int] = (50, 100, 150)
    max_queue_size: int | None = 10000
    max_links_per_page: int | None = 100
    priority_patterns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not self.enabled:
            return
        if self.max_queue_size is not None and self.max_queue_size <= 0 or self.max_links_per_page is not None and self.max_links_per_page <= 0:
            raise ValueError("sizes must be positive")
        if self.min_url_length is not None and self.max_url_length is not None and self.min_url_length > self.max_url_length:
            raise ValueError("the least URL length is above the most")
        for p in [*(self.include_patterns or ()), *(self.exclude_patterns or ()), *(self.priority_patterns or ())]:
            re.compile(p)


def same_domain(depth: int) -> ExtensiveConfig:
    return ExtensiveConfig(max_depth=("limited", depth))


def with_subdomains(depth: int) -> ExtensiveConfig:
    return ExtensiveConfig(max_depth=("limited", depth), scope="subdomains")


def unrestricted(depth: int) -> ExtensiveConfig:
    return ExtensiveConfig(max_depth=("limited", depth), scope="unrestricted")


def extract(pages: DataFrame, page: str, base: str, html: str, depth: Column | None = None, max_depth: int = 10) -> DataFrame:
    """page, base, seq, url, anchor, depth of every link that resolves: anchors without inner tags, images, link tags."""
    d = F.lit(0) if depth is None else depth
    rows = pages.where(F.col(html).isNotNull() & (d < max_depth)).select(page, base, html, (d + 1).cast("int").alias("depth"))
    h, all_of = F.col(html), lambda p, i: F.regexp_extract_all(F.col(html), F.lit(p), F.lit(i))
    one = lambda arr, text: F.transform(arr, lambda x: named(href=x, anchor=F.lit(text)))
    anchors = F.zip_with(all_of(_ANCHOR, 1), all_of(_ANCHOR, 2), lambda a, b: named(href=a, anchor=b))
    every = F.concat(anchors, one(all_of(_IMAGE, 1), "image"), one(all_of(_SHEET, 1), "stylesheet"))
    flat = rows.select(page, base, "depth", F.posexplode(every).alias("seq", "x"))
    return staged(flat.select(page, base, F.col("seq").cast("long").alias("seq"), U.resolve(F.col(base), F.col("x.href")).alias("url"), F.col("x.anchor").alias("anchor"), "depth"), "links").where("url is not null")


def link_type(url: Column, base: Column, allowed: list[str] = ()) -> Column:
    """Asset, Document, Internal, Subdomain or External, tested in this order."""
    p, b = U.parsed(url), U.parsed(base)
    path = F.lower(p.path)
    return (
        F.when(U.is_asset(path), "Asset")
        .when(U.is_document(path), "Document")
        .when(p.host == b.host, "Internal")
        .when(p.host.endswith(F.concat(F.lit("."), b.host)), "Subdomain")
        .when(p.host.isin(list(allowed)) if allowed else F.lit(False), "Internal")
        .otherwise("External")
    )


TYPE_RANK = {"Internal": 0, "Subdomain": 1, "External": 2, "Asset": 3, "Document": 4}


def process_simple(links: DataFrame, base: str, allowed: list[str] = ()) -> DataFrame:
    """Valid links with their type; external ones and assets are left out."""
    kept = links.where(U.valid_core(F.col("url"))).withColumn("link_type", link_type(F.col("url"), F.col(base), allowed))
    return kept.where(~F.col("link_type").isin("External", "Asset"))


def dedup_simple(links: DataFrame, page: str) -> DataFrame:
    """Of each page the first link per normalised URL, with its rank by type, depth and place."""
    key = U.normalize_tracking(F.col("url"))
    first = links.withColumn("norm", key).withColumn("_n", F.row_number().over(Window.partitionBy(page, "norm").orderBy("seq"))).where("_n = 1").drop("_n")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv]), F.col("link_type")), F.lit(9))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(rank, "depth", "seq")).cast("long"))


def type_counts(links: DataFrame) -> DataFrame:
    n = lambda t: F.count_if(F.col("link_type") == t)
    return links.agg(F.count("*").alias("total"), n("Internal").alias("internal"), n("External").alias("external"), n("Subdomain").alias("subdomain"), n("Asset").alias("assets"), n("Document").alias("documents"))


def category(url: Column) -> Column:
    """By the extension of the last segment, which is its own extension where it has no dot; else Internal, or Other without host."""
    p = U.parsed(url)
    ext = F.lower(F.element_at(F.split(p.last, r"\.", -1), -1))
    return F.when(ext.isin(DOCUMENT), "Document").when(ext.isin(MEDIA), "Media").when(ext.isin(RESOURCE), "Resource").when(p.host != "", "Internal").otherwise("Other")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))  # each argument stands once


def priority(url: Column, anchor: Column, cfg: ExtensiveConfig = ExtensiveConfig(), kind: Column | None = None) -> Column:
    """0..255, held within bounds after every step."""
    s, p, cat = cfg.scoring, U.parsed(url), category(url) if kind is None else kind
    v = _clamp(F.lit(s.base) + F.when(cat == "Internal", s.internal).when(cat == "External", s.external).when(cat == "Document", s.document).when(cat == "Resource", -s.resource).when(cat == "Media", -s.media).otherwise(s.other))
    v = _clamp(v + F.when(F.coalesce(anchor.rlike(r"[^\s\x{0B}\x{85}\p{Z}]"), F.lit(False)), s.anchor).otherwise(0))
    n = p.segments
    v = _clamp(v + F.when(n == 1, s.root).when(n <= 3, s.shallow).when(n > 5, -s.deep).otherwise(0))
    if cfg.priority_patterns:
        v = _clamp(v + F.when(url.rlike("|".join(f"(?:{x})" for x in cfg.priority_patterns)), s.pattern).otherwise(0))
    v = _clamp(v - F.when(p.query.isNotNull(), s.query).otherwise(0))
    return _clamp(v - F.when(p.fragment.isNotNull(), s.fragment).otherwise(0)).cast("int")


def depth_allowed(depth: Column, cfg: ExtensiveConfig) -> Column:
    kind, n = cfg.max_depth
    return F.lit(True) if kind == "unlimited" else depth == n if kind == "exact" else depth < n


def domain_allowed(url: Column, base: Column, cfg: ExtensiveConfig) -> Column:
    d, b = U.domain(url, False), U.domain(base, False)
    if cfg.scope == "same_domain":
        return d.eqNullSafe(b)
    if cfg.scope == "subdomains":
        return d.eqNullSafe(b) | F.coalesce(d.endswith(F.concat(F.lit("."), b)), F.lit(False))
    if cfg.scope == "allow_list":
        return F.coalesce(d.isin(list(cfg.domains)), F.lit(False))
    if cfg.scope == "block_list":
        return F.coalesce(~d.isin(list(cfg.domains)), F.lit(True))
    return F.lit(True)


def decision(url: Column, base: Column, depth: Column, cfg: ExtensiveConfig, kind: Column | None = None) -> Column:
    """Why a link is or is not crawled: the first test it fails, or that it passed."""
    ext = F.lower(F.element_at(F.split(U.parsed(url).last, r"\.", -1), -1))
    size = F.octet_length(url)
    out = F.when(~depth_allowed(depth, cfg), F.concat(F.lit("Depth limit exceeded: "), depth.cast("string")))
    out = out.when(~domain_allowed(url, base, cfg), "Domain not allowed")
    out = out.when((category(url) if kind is None else kind).isin("Resource", "Media"), "Resource/media link excluded")
    if cfg.min_url_length is not None:
        out = out.when(size < cfg.min_url_length, F.concat(F.lit("URL too short: "), size.cast("string"), F.lit(f" < {cfg.min_url_length}")))
    if cfg.max_url_length is not None:
        out = out.when(size > cfg.max_url_length, F.concat(F.lit("URL too long: "), size.cast("string"), F.lit(f" > {cfg.max_url_length}")))
    if cfg.include_extensions is not None:
        out = out.when(~ext.isin(list(cfg.include_extensions)), F.concat(F.lit("Extension '"), ext, F.lit("' not in include list")))
    if cfg.exclude_extensions is not None:
        out = out.when(ext.isin(list(cfg.exclude_extensions)), F.concat(F.lit("Extension '"), ext, F.lit("' in exclude list")))
    if cfg.include_patterns:
        out = out.when(~url.rlike("|".join(f"(?:{x})" for x in cfg.include_patterns)), "URL doesn't match include patterns")
    if cfg.exclude_patterns:
        out = out.when(url.rlike("|".join(f"(?:{x})" for x in cfg.exclude_patterns)), "URL matches exclude patterns")
    return out.otherwise(PASSED)


PASSED = "Passed all filters"


def process(links: DataFrame, page: str, base: str, cfg: ExtensiveConfig) -> DataFrame:
    """norm, category, priority, should_crawl, reason and rank of each link; on a page the links after the one that fills
    the limit of crawlable links are left out."""
    if not cfg.enabled:
        return links.limit(0)
    url = F.col("url")
    links = staged(links.withColumn("category", category(url)), "links")
    out = links.withColumn("norm", U.normalize_scope(url, cfg.exclude_fragments, cfg.exclude_query_params)).withColumn("priority", priority(url, F.col("anchor"), cfg, F.col("category")))
    out = out.withColumn("depth", F.col("depth") + 1).withColumn("reason", decision(url, F.col(base), F.col("depth"), cfg, F.col("category"))).withColumn("should_crawl", F.col("reason") == PASSED)
    if cfg.max_links_per_page is not None:
        before = F.sum(F.col("should_crawl").cast("int")).over(Window.partitionBy(page).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cfg.max_links_per_page).drop("_before")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("priority"), "seq")).cast("long"))


def filter_processed(links: DataFrame, page: str, cfg: ExtensiveConfig) -> DataFrame:
    """Crawlable links of a page, the first per normalised URL, up to the queue's size."""
    first = links.where("should_crawl").withColumn("_n", F.row_number().over(Window.partitionBy(page, "norm").orderBy("rank"))).where("_n = 1").drop("_n")
    if cfg.max_queue_size is None:
        return first
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy("rank"))).where(F.col("_k") <= cfg.max_queue_size).drop("_k")
