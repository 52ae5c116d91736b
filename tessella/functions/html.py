"""HTML to text, title, links and images with regular expressions only, so that it stays in generated code. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import let, named
from tessella.functions.text import count_words, latin_filter, squeezed, trimmed

_SCRIPT = r"(?is)<script\b[^>]*>.*?(?:</script[^>]*>|\z)"
_STYLE = r"(?is)<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
MIN_BYTES, MIN_WORDS = 100, 10


def without_code(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _SCRIPT, ""), _STYLE, "")


def plain(html: Column) -> Column:
    """Every tag to a space, white space squeezed; scripts stay."""
    return squeezed(F.regexp_replace(html, "<[^>]*>", " "))


def gated(html: Column, least: int, stop: list[str]) -> tuple[Column, Column]:
    """(text, words): '' and 0 below MIN_BYTES bytes or below MIN_WORDS words."""

    def judged(x: Column) -> Column:
        def counted(n: Column) -> Column:
            ok = (F.octet_length(html) >= MIN_BYTES) & (n >= MIN_WORDS)
            return named(text=F.when(ok, x).otherwise(""), words=F.when(ok, n).otherwise(F.lit(0).cast("long")))

        return let(count_words(x), counted)

    pair = let(plain(without_code(html)), lambda t: let(latin_filter(t, least, stop), judged))
    return F.when(html.isNotNull(), pair["text"]), F.when(html.isNotNull(), pair["words"])


def fallback(html: Column) -> Column:
    """As plain; null where no word is left."""
    text = plain(html)
    return F.when(count_words(text) > 0, text)


def decoded(html: Column) -> Column:
    """Without scripts and styles of one line, tags to spaces, six entities decoded in order, squeezed."""
    t = F.regexp_replace(F.regexp_replace(html, r"<script[^>]*>.*?</script>", ""), r"<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return squeezed(t)


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"<title[^>]*>([^<]+)</title>", 1)
    return F.when(html.rlike(r"<title[^>]*>([^<]+)</title>"), trimmed(found))


def description(html: Column) -> Column:
    p = r"""<meta[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']"""
    return F.when(html.rlike(p), trimmed(F.regexp_extract(html, p, 1)))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def links(html: Column) -> Column:
    """All href values that begin with http or //, in order, repeated ones kept."""
    return F.filter(hrefs(html), lambda x: x.startswith("http") | x.startswith("//"))


def images(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""<img[^>]*src\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.filter(found, lambda x: F.lower(x).rlike(r"\.(?:jpg|jpeg|png|gif|webp|svg)$"))


def is_page(html: Column) -> Column:
    return F.lower(html).rlike("<html|<body|<title")


def discovered(html: Column, origin: Column, most: int = 50) -> Column:
    """Links with http kept, those from the root completed, others dropped; sorted, each once, the first few."""
    kept = F.filter(hrefs(html), lambda x: x.startswith("http") | x.startswith("/"))
    full = F.transform(kept, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(origin, x)))
    return F.slice(F.array_sort(F.array_distinct(full)), 1, most)
