"""Error categories from messages, whether to retry, how severe, and the text of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories with severity and text; {} takes a detail (fixed values).
CATEGORIES = {
    "NetworkError": ("High", "Network error: {}"),
    "NetworkTimeout": ("High", "Network timeout"),
    "ConnectionRefused": ("High", "Connection refused"),
    "DnsResolutionFailed": ("Medium", "DNS resolution failed for {}"),
    "ProxyError": ("High", "Proxy connection error"),
    "HttpError": ("Medium", "HTTP error: {}"),
    "RedirectLoop": ("Medium", "Redirect loop detected"),
    "InvalidUrl": ("Medium", "Invalid URL: {}"),
    "ContentTooShort": ("Low", "Content too short"),
    "LanguageNotSupported": ("Low", "Language not supported"),
    "ParsingError": ("Medium", "HTML parsing error"),
    "EncodingError": ("Medium", "Text encoding error"),
    "KeywordConfigError": ("High", "Keyword configuration error: {}"),
    "KeywordNotFound": ("Low", "Target keywords not found in content"),
    "ExtensiveConfigError": ("High", "Extensive crawling configuration error: {}"),
    "CleaningConfigError": ("High", "Text cleaning configuration error: {}"),
    "CleaningRuleError": ("Medium", "Text cleaning rule error: {}"),
    "RobotsBlocked": ("Low", "Blocked by robots.txt"),
    "RateLimited": ("Low", "Rate limited"),
    "Forbidden": ("Low", "Access forbidden"),
    "UnknownError": ("Critical", "Unknown error: {}"),
}
RETRYABLE = ["NetworkError", "NetworkTimeout", "ConnectionRefused", "DnsResolutionFailed", "ProxyError", "RateLimited"]
#: What a message must hold, in the order of the tests (fixed values).
TESTS = [("timeout", "NetworkTimeout"), ("connection refused", "ConnectionRefused"), ("dns", "DnsResolutionFailed"), ("proxy", "ProxyError"), ("redirect", "RedirectLoop"), ("url", "InvalidUrl"), ("parse", "InvalidUrl")]
RANKS = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def categorize(message: Column) -> Column:
    """The first test that the message passes; UnknownError if none; null for null."""
    low = F.lower(message)
    out = F.when(message.isNull(), F.lit(None).cast("string"))
    for piece, name in TESTS:
        out = out.when(low.contains(piece), name)
    return out.otherwise("UnknownError")


def retryable(category: Column, status: Column | None = None) -> Column:
    hit = category.isin(RETRYABLE)
    return hit if status is None else hit | ((category == "HttpError") & status.between(500, 599))


def severity(category: Column) -> Column:
    return _lookup({k: v[0] for k, v in CATEGORIES.items()}, category)


def severity_rank(category: Column) -> Column:
    return _lookup(RANKS, severity(category))


def display(category: Column, detail: Column) -> Column:
    return F.replace(_lookup({k: v[1] for k, v in CATEGORIES.items()}, category), F.lit("{}"), F.coalesce(detail, F.lit("")))
