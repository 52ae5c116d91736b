"""URL parsing, resolving, normalising and judging as native expressions.

One regular split replaces java.net.URI, which rejects what browsers accept. A string that is no absolute http-like URL
gives null parts, and predicates on it are false. Null gives null parts and false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import let, named

SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
#: Lists that decide what is crawled, and how links are told apart (fixed values).
SOCIAL = ["facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com"]
BINARY = ".pdf .jpg .png .gif .mp4 .zip .exe .rar .tar .gz .doc .docx .xls .xlsx .ppt .pptx .mp3 .wav .avi .mov .flv".split()
SUSPICIOUS = "javascript: data: mailto: ftp: file: admin login signin signup register download upload api/ ajax json".split()
SHALLOW = "/api/ /ajax/ /json/ /xml/ /rss/ /admin/ /wp-admin/ /login/ /auth/ /static/ /assets/ /css/ /js/ /images/".split()
TRACKING = "utm_source utm_medium utm_campaign utm_content utm_term fbclid gclid ref source campaign".split()
ASSETS = ".css .js .jpg .jpeg .png .gif .svg .ico .woff .woff2 .ttf .eot".split()
DOCUMENTS = ".pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .tar .gz".split()
CORE_BLOCKED = [".pdf", ".zip", ".exe", ".dmg"]
REASONS = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


@dataclass(frozen=True)
class Url:
    """The parts of one URL column; query and fragment are null where absent, port is '' where default."""

    ok: Column
    scheme: Column
    host: Column
    port: Column
    path: Column
    query: Column
    fragment: Column

    def text(self, path: Column | None = None, query: Column | None = None, fragment: Column | None = None) -> Column:
        """Put together again, with other parts where given."""
        path, query, fragment = (self.path if path is None else path), (self.query if query is None else query), (self.fragment if fragment is None else fragment)
        port = F.when(self.port == "", "").otherwise(F.concat(F.lit(":"), self.port))
        opt = lambda sign, c: F.coalesce(F.concat(F.lit(sign), c), F.lit(""))
        return F.concat(self.scheme, F.lit("://"), self.host, port, path, opt("?", query), opt("#", fragment))

    @property
    def last(self) -> Column:
        """The last segment of the path."""
        return F.element_at(F.split(self.path, "/", -1), -1)

    @property
    def segments(self) -> Column:
        return F.size(F.split(F.substr(self.path, F.lit(2)), "/", -1))

    @property
    def is_ip(self) -> Column:
        return self.host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$|^\[")


def parsed(u: Column) -> Url:
    ok = F.coalesce(u.rlike(SPLIT), F.lit(False))
    part = lambda i: F.when(ok, F.regexp_extract(u, SPLIT, i))
    scheme, authority = F.lower(part(1)), F.regexp_replace(part(2), r"^[^@]*@", "")
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = part(3)
    after = lambda c: F.when(c != "", F.substr(c, F.lit(2)))
    encoded = F.when(path.rlike(r"[^\x21-\x7E]"), F.array_join(F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7E]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")).otherwise(path)
    return Url(ok, scheme, F.lower(F.regexp_replace(authority, r":\d*$", "")), F.when(default, "").otherwise(port), F.when(encoded == "", "/").otherwise(encoded), after(part(4)), after(part(5)))


def _ends(c: Column, endings: list[str]) -> Column:
    return c.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def _holds(c: Column, pieces: list[str]) -> Column:
    cond = F.lit(False)
    for p in pieces:
        cond = cond | c.contains(p)
    return cond


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_web(p: Url) -> Column:
    return _yes(p.ok & p.scheme.isin("http", "https") & (p.host != ""))


def valid_core(u: Column) -> Column:
    p = parsed(u)
    return _yes(is_web(p) & ~_ends(F.lower(p.path), CORE_BLOCKED) & ~(p.path.contains("redirect") & (F.octet_length(p.path) > 200)))


def valid_discovery(u: Column, avoid: list[str] = ()) -> Column:
    p = parsed(u)
    whole = p.text()
    return _yes(is_web(p) & (p.is_ip | ~_holds(p.host, SOCIAL)) & ~_ends(p.last, [*avoid, *BINARY]) & (F.octet_length(whole) <= 2048) & ~_holds(F.lower(whole), SUSPICIOUS))


def deep_crawl(u: Column) -> Column:
    p = parsed(u)
    return _yes(p.ok & ~_holds(p.path, SHALLOW))


def is_asset(path: Column) -> Column:
    return _yes(_ends(path, ASSETS))


def is_document(path: Column) -> Column:
    return _yes(_ends(path, DOCUMENTS))


def domain(u: Column, with_ips: bool = True) -> Column:
    p = parsed(u)
    host = F.when(p.host != "", p.host)
    return host if with_ips else F.when(~p.is_ip, host)


def same_domain(a: Column, b: Column) -> Column:
    return domain(a, False).eqNullSafe(domain(b, False))


def _unslashed(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path)


def normalize_core(u: Column) -> Column:
    """No fragment, query parameters sorted, no slashes at the end; what does not parse stays."""
    p = parsed(u)
    query = F.array_join(F.array_sort(F.split(p.query, "&", -1)), "&")
    return F.when(p.ok, p.text(_unslashed(p.path), query, F.lit(None).cast("string"))).otherwise(u)


def _decoded(part: Column) -> Column:
    """A form's key or value without percent signs and plus signs; what does not decode keeps its percent signs."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _query_encoded(query: Column) -> Column:
    """With what a query may not hold as it is in percent signs."""
    odd = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"
    each = F.transform(F.split(query, ""), lambda c: F.when(c.rlike(odd), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(query.rlike(odd), F.array_join(each, "")).otherwise(query)


def normalize_tracking(u: Column) -> Column:
    """No fragment, no tracking parameters, decoded query, no slashes at the end, all in lower case."""
    p = parsed(u)
    pairs = F.transform(F.filter(F.split(p.query, "&", -1), lambda x: x != ""), lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))
    halves = F.transform(pairs, lambda x: named(k=_decoded(F.substring_index(x, "=", 1)), v=_decoded(F.regexp_replace(x, "^[^=]*=", ""))))
    kept = F.transform(F.filter(halves, lambda x: ~x["k"].isin(TRACKING)), lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    query = F.nullif(_query_encoded(F.array_join(kept, "&")), F.lit(""))
    return F.when(p.ok, F.lower(p.text(_unslashed(p.path), F.coalesce(query, F.lit(None).cast("string")), F.lit(None).cast("string")))).otherwise(u)


def normalize_scope(u: Column, drop_fragment: bool = True, drop_query: bool = False) -> Column:
    p, none = parsed(u), F.lit(None).cast("string")
    return F.when(p.ok, p.text(None, none if drop_query else None, none if drop_fragment else None)).otherwise(u)


def _no_dots(path: Column) -> Column:
    """Without '.' and '..' segments."""
    segs = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    n = F.size(segs)
    numbered = F.transform(segs, lambda s, i: named(s=s, last=i == n - 1))

    def fold(acc: Column, x: Column) -> Column:
        s, tail = x["s"], F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", F.concat(up, tail)).when(s == ".", F.concat(acc, tail)).otherwise(F.concat(acc, F.array(s)))

    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), fold), "/"))).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of a link found on base; null if either does not parse."""
    b = parsed(base)
    href = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    absolute = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    origin = F.concat(b.scheme, F.lit("://"), b.host, F.when(b.port == "", "").otherwise(F.concat(F.lit(":"), b.port)))
    query = F.coalesce(F.concat(F.lit("?"), b.query), F.lit(""))
    rest = F.regexp_extract(href, r"([?#][\s\S]*)$", 1)
    path = F.regexp_replace(href, r"[?#][\s\S]*$", "")
    folder = F.regexp_replace(b.path, "[^/]*$", "")
    made = (
        F.when(absolute, href)
        .when(href.startswith("//"), F.concat(b.scheme, F.lit(":"), href))
        .when(href == "", F.concat(origin, b.path, query))
        .when(href.startswith("#"), F.concat(origin, b.path, query, href))
        .when(href.startswith("?"), F.concat(origin, b.path, href))
        .when(href.startswith("/"), F.concat(origin, path, rest))
        .otherwise(F.concat(origin, folder, path, rest))
    )

    def whole(m: Column) -> Column:
        p = parsed(m)
        return F.when(p.ok, p.text(let(p.path, _no_dots)))

    return F.when(b.ok, let(made, whole))


def status_text(code: Column) -> Column:
    out = F.concat(F.lit("HTTP "), code.cast("string"))
    for k, v in REASONS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


#: Languages a form may name (fixed values).
FORM_LANGUAGES = "en fr de zh ja ko es it pt ru ar hi".split()


#: White space that forms trim at both ends.
FORM_WS = r"[\t-\r\p{Z}\x{FEFF}]"


def form_trimmed(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{FORM_WS}+|{FORM_WS}+\z", "")


def sanitize_url_simple(u: Column) -> Column:
    clean = F.regexp_replace(form_trimmed(u), "[<>'\"]", "")
    return F.when(clean.rlike("^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))


def sanitize_url(u: Column) -> Column:
    clean = F.substring(F.regexp_replace(form_trimmed(u), "[<>'\"]", ""), 1, 2048)
    return F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean)).when(clean.rlike("(?i)^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))


def form_url_ok(u: Column) -> Column:
    return is_web(parsed(u))


def sanitize_text_simple(t: Column) -> Column:
    return F.substring(F.regexp_replace(form_trimmed(t), "[<>'\"&]", ""), 1, 500)


def sanitize_text(t: Column) -> Column:
    return F.substring(form_trimmed(F.regexp_replace(F.regexp_replace(t, "[<>\"'%;()&+]", ""), r"--|/\*|\*/", "")), 1, 1000)


def sanitize_language(code: Column) -> Column:
    return F.when(code.isin(FORM_LANGUAGES), code).otherwise("en")


def sanitize_keywords(t: Column) -> Column:
    each = F.transform(F.split(t, ",", -1), sanitize_text)
    return F.slice(F.filter(each, lambda x: F.length(x).between(1, 100)), 1, 50)


def sanitize_number(t: Column, low: int, high: int) -> Column:
    n = F.regexp_extract(t, r"^\s*([+-]?\d+)", 1).try_cast("long")
    n = F.when(F.coalesce(n, F.lit(0)) == 0, low).otherwise(n)
    return F.greatest(F.lit(low), F.least(F.lit(high), n)).cast("long")
