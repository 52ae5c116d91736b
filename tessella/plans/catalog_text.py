"""Queries over URLs, HTML, text, language, keywords and cleaning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import table
from tessella.functions import cleaning as C
from tessella.functions import html as H
from tessella.functions import keywords as K
from tessella.functions import lang as L
from tessella.functions import text as X
from tessella.functions import urls as U

QUERIES: dict = {}
SQL: dict[str, str] = {}

WS = X.WS
W = X.WORD.replace(r"\p{Is", r"\p{").replace("'", "''")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


# ---- SQL pieces -------------------------------------------------------------------------------------------------------

_P = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_cte(name: str, source: str, keys: str, url: str = "url") -> str:
    """A CTE with the parts of url."""
    return f"""{name}_raw AS (SELECT {keys}, {url} AS url, regexp_matches({url}, '{_P}') AS ok, lower(regexp_extract({url}, '{_P}', 1)) AS scheme,
      regexp_replace(regexp_extract({url}, '{_P}', 2), '^[^@]*@', '') AS auth, regexp_extract({url}, '{_P}', 3) AS p, regexp_extract({url}, '{_P}', 4) AS q, regexp_extract({url}, '{_P}', 5) AS f FROM {source}),
    {name} AS (SELECT {', '.join(k.split(' AS ')[-1].strip() for k in keys.split(', '))}, url, coalesce(ok, false) AS ok, CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN lower(regexp_replace(auth, ':\\d*$', '')) END AS host,
      CASE WHEN NOT ok THEN NULL WHEN (scheme = 'http' AND regexp_extract(auth, ':(\\d*)$', 1) = '80') OR (scheme = 'https' AND regexp_extract(auth, ':(\\d*)$', 1) = '443') THEN '' ELSE regexp_extract(auth, ':(\\d*)$', 1) END AS port,
      CASE WHEN ok THEN CASE WHEN p = '' THEN '/' ELSE p END END AS path, CASE WHEN ok AND q <> '' THEN substr(q, 2) END AS query, CASE WHEN ok AND f <> '' THEN substr(f, 2) END AS fragment FROM {name}_raw)"""


_ORIGIN = "scheme || '://' || host || CASE WHEN port = '' THEN '' ELSE ':' || port END"
_UNSLASHED = "CASE WHEN length(path) > 1 THEN coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') ELSE path END"
_WHOLE = f"{_ORIGIN} || path || coalesce('?' || query, '') || coalesce('#' || fragment, '')"
_LAST = "list_extract(string_split(path, '/'), -1)"
_IP = r"regexp_matches(host, '^\d{1,3}(?:\.\d{1,3}){3}$|^\[')"
ALL_URLS = "(SELECT DISTINCT url FROM (SELECT url FROM stored_results UNION ALL SELECT unnest(links_found) FROM stored_results) WHERE url IS NOT NULL)"


def _ends(c: str, endings) -> str:
    return f"regexp_matches({c}, '(?:{'|'.join(e.replace('.', chr(92) + '.') for e in endings)})$')"


def _holds(c: str, pieces) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in pieces) + ")"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored_results")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def all_urls(spark: SparkSession, d: str) -> DataFrame:
    s = _stored(spark, d)
    return s.select("url").unionByName(s.select(F.explode("links_found").alias("url"))).where("url is not null").distinct()


# ---- URLs -------------------------------------------------------------------------------------------------------------


@query(f"WITH {url_cte('u', 'stored_results', 'result_id')} SELECT result_id, scheme, host, port, path, query, fragment FROM u")
def url_parts(spark, d):
    p = U.parsed(F.col("url"))
    return _stored(spark, d).select("result_id", p.scheme.alias("scheme"), p.host.alias("host"), p.port.alias("port"), p.path.alias("path"), p.query.alias("query"), p.fragment.alias("fragment"))


@query(f"WITH {url_cte('u', 'stored_results', 'result_id')} SELECT result_id, CASE WHEN ok THEN {_ORIGIN} || {_UNSLASHED} || coalesce('?' || array_to_string(list_sort(string_split(query, '&')), '&'), '') ELSE url END AS norm FROM u")
def url_normalize_core(spark, d):
    return _stored(spark, d).select("result_id", U.normalize_core(F.col("url")).alias("norm"))


_DECODED = lambda c: f"coalesce(TRY(url_decode(replace({c}, '+', ' '))), replace({c}, '+', ' '))"
_KEY, _VALUE = "split_part(x, '=', 1)", "regexp_replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '^[^=]*=', '')"
_PAIRS = f"list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {{'k': {_DECODED(_KEY)}, 'v': {_DECODED(_VALUE)}}})"
_ODD = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"
_JOINED = f"array_to_string(list_transform(list_filter({_PAIRS}, lambda x: NOT list_contains({_list(U.TRACKING)}, x.k)), lambda x: x.k || '=' || x.v), '&')"
_KEPT = f"nullif(array_to_string(list_transform(string_split({_JOINED}, ''), lambda c: CASE WHEN regexp_matches(c, '{_ODD}') THEN url_encode(c) ELSE c END), ''), '')"


@query(f"WITH {url_cte('u', 'stored_results', 'result_id')} SELECT result_id, CASE WHEN ok THEN lower({_ORIGIN} || {_UNSLASHED} || coalesce('?' || {_KEPT}, '')) ELSE url END AS norm FROM u")
def url_normalize_tracking(spark, d):
    return _stored(spark, d).select("result_id", U.normalize_tracking(F.col("url")).alias("norm"))


@query(f"WITH {url_cte('u', 'stored_results', 'result_id')} SELECT result_id, CASE WHEN ok THEN {_ORIGIN} || path || coalesce('?' || query, '') ELSE url END AS norm, CASE WHEN ok THEN {_ORIGIN} || path ELSE url END AS bare FROM u")
def url_normalize_scope(spark, d):
    return _stored(spark, d).select("result_id", U.normalize_scope(F.col("url")).alias("norm"), U.normalize_scope(F.col("url"), True, True).alias("bare"))


_WEB = "(ok AND scheme IN ('http', 'https') AND host <> '')"


@query(f"WITH {url_cte('u', ALL_URLS, 'url AS k')} SELECT k AS url, coalesce({_WEB} AND NOT {_ends('lower(path)', U.CORE_BLOCKED)} AND NOT (contains(path, 'redirect') AND strlen(path) > 200), false) AS ok FROM u")
def url_valid_core(spark, d):
    return all_urls(spark, d).select("url", U.valid_core(F.col("url")).alias("ok"))


@query(f"WITH {url_cte('u', ALL_URLS, 'url AS k')} SELECT k AS url, coalesce({_WEB} AND ({_IP} OR NOT {_holds('host', U.SOCIAL)}) AND NOT {_ends(_LAST, ['.html', *U.BINARY])} AND strlen({_WHOLE}) <= 2048 AND NOT {_holds(f'lower({_WHOLE})', U.SUSPICIOUS)}, false) AS ok FROM u")
def url_valid_discovery(spark, d):
    return all_urls(spark, d).select("url", U.valid_discovery(F.col("url"), [".html"]).alias("ok"))


@query(f"WITH {url_cte('u', ALL_URLS, 'url AS k')} SELECT k AS url, coalesce(ok AND NOT {_holds('path', U.SHALLOW)}, false) AS ok FROM u")
def url_deep_crawl(spark, d):
    return all_urls(spark, d).select("url", U.deep_crawl(F.col("url")).alias("ok"))


@query(f"WITH {url_cte('u', ALL_URLS, 'url AS k')} SELECT k AS url, coalesce({_ends('lower(path)', U.ASSETS)}, false) AS is_asset, coalesce({_ends('lower(path)', U.DOCUMENTS)}, false) AS is_document FROM u")
def url_asset_document(spark, d):
    path = F.lower(U.parsed(F.col("url")).path)
    return all_urls(spark, d).select("url", U.is_asset(path).alias("is_asset"), U.is_document(path).alias("is_document"))


@query(f"""WITH {url_cte('u', '(SELECT result_id, url, metadata.parent_url AS parent FROM stored_results)', 'result_id, parent')}, w AS (SELECT result_id, parent, host AS a, {_IP} AS ip FROM u), {url_cte('v', 'w', 'result_id, a, ip', 'parent')}
  SELECT result_id, nullif(a, '') AS domain, CASE WHEN NOT ip THEN nullif(a, '') END AS name,
    (CASE WHEN NOT ip THEN nullif(a, '') END) IS NOT DISTINCT FROM (CASE WHEN NOT {_IP} THEN nullif(host, '') END) AS same FROM v""")
def url_domain(spark, d):
    u, p = F.col("url"), F.col("metadata.parent_url")
    return _stored(spark, d).select("result_id", U.domain(u).alias("domain"), U.domain(u, False).alias("name"), U.same_domain(u, p).alias("same"))


def _form_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{U.FORM_WS}+|{U.FORM_WS}+\\z', '', 'g')"


_C1 = f"regexp_replace({_form_trim('url')}, '[<>''\"]', '', 'g')"


@query(f"""WITH {url_cte('u', 'stored_results', 'result_id')} SELECT result_id, CASE WHEN regexp_matches({_C1}, '^https?://') THEN {_C1} ELSE 'https://' || {_C1} END AS v1,
  CASE WHEN starts_with({_C1}, '//') THEN 'https:' || substr({_C1}, 1, 2048) WHEN regexp_matches({_C1}, '(?i)^https?://') THEN substr({_C1}, 1, 2048) ELSE 'https://' || substr({_C1}, 1, 2048) END AS v2, coalesce({_WEB}, false) AS ok FROM u""")
def url_sanitize(spark, d):
    u = F.col("url")
    return _stored(spark, d).select("result_id", U.sanitize_url_simple(u).alias("v1"), U.sanitize_url(u).alias("v2"), U.form_url_ok(u).alias("ok"))


def _san(c: str) -> str:
    clean = f"regexp_replace(regexp_replace({c}, '[<>\"''%;()&+]', '', 'g'), '--|/\\*|\\*/', '', 'g')"
    return f"substr({_form_trim(clean)}, 1, 1000)"


@query(f"""SELECT doc_id, substr(regexp_replace({_form_trim('text')}, '[<>''\"&]', '', 'g'), 1, 500) AS v1, {_san('text')} AS v2, CASE WHEN list_contains({_list(U.FORM_LANGUAGES)}, lang) THEN lang ELSE 'en' END AS code,
  array_to_string(list_slice(list_filter(list_transform(string_split(text, ','), lambda x: {_san('x')}), lambda x: length(x) BETWEEN 1 AND 100), 1, 50), '|') AS keywords FROM documents""")
def text_strings_sanitize(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", U.sanitize_text_simple(t).alias("v1"), U.sanitize_text(t).alias("v2"), U.sanitize_language(F.col("lang")).alias("code"), F.array_join(U.sanitize_keywords(t), "|").alias("keywords"))


@query("""SELECT result_id, greatest(1, least(50, CASE WHEN coalesce(TRY_CAST(regexp_extract(title, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) = 0 THEN 1 ELSE TRY_CAST(regexp_extract(title, '^\\s*([+-]?\\d+)', 1) AS BIGINT) END)) AS n FROM stored_results""")
def form_number(spark, d):
    return _stored(spark, d).select("result_id", U.sanitize_number(F.col("title"), 1, 50).alias("n"))


# ---- HTML: pages are put together from the stored rows -------------------------------------------------------------------

_HEAD = "<style>p { color: red }</style>"
_SCRIPT = "<script>if (1 < 2) { x() }</script>"
PAGES = f"""pages AS (SELECT result_id AS page_id, url, '<html><head><title>' || coalesce(title, '') || '</title>{_HEAD}<meta name="description" content="' || coalesce(language, '') || ' page"></head><body>{_SCRIPT}<p>'
  || coalesce(content, '') || '</p>' || coalesce(array_to_string(list_transform(links_found, lambda x: '<a href="' || x || '">link</a>'), ''), '') || '<img src="/i/' || result_id || '.jpg"><link href="/s.css"></body></html>' AS html FROM stored_results)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    anchors = F.array_join(F.transform("links_found", lambda x: F.concat(F.lit('<a href="'), x, F.lit('">link</a>'))), "")
    html = F.concat(
        F.lit("<html><head><title>"), empty("title"), F.lit(f'</title>{_HEAD}<meta name="description" content="'), empty("language"), F.lit(f' page"></head><body>{_SCRIPT}<p>'), empty("content"), F.lit("</p>"), F.coalesce(anchors, F.lit("")),
        F.lit('<img src="/i/'), F.col("result_id").cast("string"), F.lit('.jpg"><link href="/s.css"></body></html>'),
    )
    return _stored(spark, d).select(F.col("result_id").alias("page_id"), "url", html.alias("html"))


_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
_PLAIN = lambda c: _SQUEEZE(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")
_NOCODE = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?(?:</script[^>]*>|\z)', '', 'g'), '(?is)<style\b[^>]*>.*?(?:</style[^>]*>|\z)', '', 'g')"
_WORDS = lambda c: f"regexp_extract_all({c}, '{W}')"
_COUNT = lambda c: rf"len(list_filter({_WORDS(c)}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')))"


def _latin(c: str, least: int, stop) -> str:
    return rf"CASE WHEN len({_WORDS(c)}) = 0 THEN {c} ELSE array_to_string(list_filter({_WORDS(c)}, lambda w: strlen(w) >= {least} AND NOT list_contains({_list(stop)}, lower(w)) AND NOT regexp_matches(w, '^\p{{N}}+$')), ' ') END"


@query(f"""WITH {PAGES}, plain AS (SELECT page_id, html, {_PLAIN(_NOCODE)} AS t FROM pages), both_ AS (SELECT page_id, html, {_latin('t', *X.LATIN_DEFAULT)} AS a, {_latin('t', *X.LATIN_ENHANCED)} AS b FROM plain),
  n AS (SELECT *, {_COUNT('a')} AS na, {_COUNT('b')} AS nb FROM both_)
  SELECT page_id, CASE WHEN strlen(html) >= 100 AND na >= 10 THEN a ELSE '' END AS text, CASE WHEN strlen(html) >= 100 AND na >= 10 THEN na ELSE 0 END AS words,
    CASE WHEN strlen(html) >= 100 AND nb >= 10 THEN b ELSE '' END AS text_enhanced, CASE WHEN strlen(html) >= 100 AND nb >= 10 THEN nb ELSE 0 END AS words_enhanced FROM n""")
def html_gate(spark, d):
    a, na = H.gated(F.col("html"), *X.LATIN_DEFAULT)
    b, nb = H.gated(F.col("html"), *X.LATIN_ENHANCED)
    return pages(spark, d).select("page_id", a.alias("text"), na.alias("words"), b.alias("text_enhanced"), nb.alias("words_enhanced"))


@query(f"WITH {PAGES}, t AS (SELECT page_id, {_PLAIN('html')} AS text, {_PLAIN(_NOCODE)} AS stripped FROM pages) SELECT page_id, text, stripped, {_COUNT('text')} AS words, CASE WHEN {_COUNT('text')} > 0 THEN text END AS fallback FROM t")
def html_plain(spark, d):
    h = F.col("html")
    return pages(spark, d).select("page_id", H.plain(h).alias("text"), H.plain(H.without_code(h)).alias("stripped"), X.count_words(H.plain(h)).alias("words"), H.fallback(h).alias("fallback"))


_DEC = r"regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'g'), '<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _DEC = f"replace({_DEC}, '{_a}', '{_b}')"


@query(f"WITH {PAGES} SELECT page_id, {_SQUEEZE(_DEC)} AS text FROM pages")
def html_decoded(spark, d):
    return pages(spark, d).select("page_id", H.decoded(F.col("html")).alias("text"))


_TITLE, _META = r"<title[^>]*>([^<]+)</title>", r"""<meta[^>]*name\s*=\s*["'']description["''][^>]*content\s*=\s*["'']([^"'']*)["'']"""
_TRIM = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query(f"""WITH {PAGES} SELECT page_id, CASE WHEN regexp_matches(html, '{_TITLE}') THEN {_TRIM(f"regexp_extract(html, '{_TITLE}', 1)")} END AS title,
  CASE WHEN regexp_matches(html, '{_META}') THEN {_TRIM(f"regexp_extract(html, '{_META}', 1)")} END AS description, regexp_matches(lower(html), '<html|<body|<title') AS valid FROM pages""")
def html_meta(spark, d):
    h = F.col("html")
    return pages(spark, d).select("page_id", H.title(h).alias("title"), H.description(h).alias("description"), H.is_page(h).alias("valid"))


_HREFS = r"""regexp_extract_all(html, 'href\s*=\s*["'']([^"'']+)["'']', 1)"""


@query(f"WITH {PAGES}, x AS (SELECT page_id, list_filter({_HREFS}, lambda x: starts_with(x, 'http') OR starts_with(x, '//')) AS l FROM pages) SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS link FROM x")
def html_links(spark, d):
    return pages(spark, d).select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(f"""WITH {PAGES}, x AS (SELECT page_id, list_filter(regexp_extract_all(html, '<img[^>]*src\\s*=\\s*["'']([^"'']+)["'']', 1), lambda x: regexp_matches(lower(x), '\\.(?:jpg|jpeg|png|gif|webp|svg)$')) AS l FROM pages)
  SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS link FROM x""")
def html_images(spark, d):
    return pages(spark, d).select("page_id", F.posexplode(H.images(F.col("html"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(f"""WITH {PAGES}, o AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, {_HREFS} AS h FROM pages),
  x AS (SELECT page_id, list_slice(list_sort(list_distinct(list_transform(list_filter(h, lambda x: starts_with(x, 'http') OR starts_with(x, '/')), lambda x: CASE WHEN starts_with(x, 'http') THEN x ELSE o || x END))), 1, 50) AS l FROM o)
  SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS link FROM x""")
def html_discover(spark, d):
    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    return pages(spark, d).select("page_id", F.posexplode(H.discovered(F.col("html"), origin)).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


# ---- text and language ----------------------------------------------------------------------------------------------------

_TOK = lambda c: f"list_filter(string_split(regexp_replace({c}, '{WS}+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id, strlen(text) AS length, {_TOK('text')} AS k, lower(text) AS low FROM documents),
  m AS (SELECT doc_id, length, len(k) AS n, len(list_distinct(k)) AS u, CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda x: strlen(x)))::DOUBLE / len(k) ELSE 0.0::DOUBLE END AS a, {' + '.join(f"CASE WHEN contains(low, '{p}') THEN 1 ELSE 0 END" for p in X.SPAM_PHRASES)} AS spam FROM t WHERE length IS NOT NULL)
  SELECT doc_id, length, n AS word_count, u AS unique_words, CAST(spam AS BIGINT) AS spam_indicators, round(a, 6) AS avg_word_length, round(s, 6) AS quality_score, s > 0.6::DOUBLE AS high FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    CASE WHEN length > 100 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length > 500 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length > 1000 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n > 20 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n > 50 THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN n > 0 THEN u::DOUBLE / n ELSE 0 END * 0.3::DOUBLE + CASE WHEN a > 4.0::DOUBLE THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN a > 5.0::DOUBLE THEN 0.1::DOUBLE ELSE 0 END - spam * 0.2::DOUBLE)) AS s FROM m)""")
def text_quality(spark, d):
    q = X.quality(F.col("text"))
    return _docs(spark, d).where("text is not null").select(
        "doc_id", q["length"].alias("length"), q["word_count"].alias("word_count"), q["unique_words"].alias("unique_words"), q["spam_indicators"].alias("spam_indicators"),
        F.round(q["avg_word_length"], 6).alias("avg_word_length"), F.round(q["quality_score"], 6).alias("quality_score"), (q["quality_score"] > 0.6).alias("high"),
    )


@query(f"""WITH t AS (SELECT doc_id, text, {_TOK('text')} AS k FROM documents), m AS (SELECT doc_id, text, len(k) AS n, list_sum(list_transform(k, lambda x: length(x)))::DOUBLE / len(k) AS a FROM t)
  SELECT doc_id, n AS words, round(n::DOUBLE / 225.0::DOUBLE * 60.0::DOUBLE, 6) AS seconds, {_COUNT('text')} AS unicode_words,
    CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 'Unknown' WHEN a < 4.0 THEN 'Easy' WHEN a < 5.5 THEN 'Medium' WHEN a < 7.0 THEN 'Hard' ELSE 'VeryHard' END AS difficulty FROM m WHERE text IS NOT NULL""")
def text_readability(spark, d):
    t, n = F.col("text"), F.size(X.tokens(F.col("text"))).cast("long")
    return _docs(spark, d).where("text is not null").select("doc_id", n.alias("words"), F.round(X.reading_seconds(n), 6).alias("seconds"), X.count_words(t).alias("unicode_words"), X.difficulty(t).alias("difficulty"))


def _scores_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    hits = ", ".join(f"{{'n': len(list_filter(low, lambda w: list_contains({_list(ws.split())}, w))), 'i': {-i}, 'c': '{c}'}}" for i, (c, ws) in enumerate(L.PROFILES.items()))
    return rf"""low AS (SELECT doc_id, lang, text, list_transform({_TOK('text')}, lambda w: regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) AS low FROM documents WHERE text IS NOT NULL),
      cnt AS (SELECT doc_id, lang, low, len(low) AS total, {n(chr(92) + 'p{L}')} AS letters, {n('[' + chr(92) + 'p{Hiragana}' + chr(92) + 'p{Katakana}]')} AS kana, {n(chr(92) + 'p{Hangul}')} AS hangul, {n(chr(92) + 'p{Han}')} AS han,
        {n(chr(92) + 'p{Cyrillic}')} AS ru, {n(chr(92) + 'p{Arabic}')} AS ar, {n(chr(92) + 'p{Devanagari}')} AS hi, list_sort([{hits}], 'DESC') AS rank FROM low),
      det AS (SELECT *, CASE WHEN letters = 0 THEN NULL WHEN (kana + han) * 5 >= letters THEN CASE WHEN kana * 10 >= han THEN 'ja' ELSE 'zh' END WHEN hangul * 5 >= letters THEN 'ko' WHEN ru * 2 >= letters THEN 'ru' WHEN ar * 2 >= letters THEN 'ar' WHEN hi * 2 >= letters THEN 'hi'
        WHEN rank[1].n >= {L.LEAST_HITS} THEN rank[1].c END AS code FROM cnt),
      conf AS (SELECT *, CASE WHEN code IS NULL THEN NULL WHEN code IN ('ja', 'zh', 'ko', 'ru', 'ar', 'hi') THEN 1.0::DOUBLE ELSE (rank[1].n::DOUBLE / total - rank[2].n::DOUBLE / total) / (rank[1].n::DOUBLE / total) END AS confidence FROM det)"""


_NAMES = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.NAMES.items()) + " ELSE 'Unknown' END"


@query(f"""WITH {_scores_sql()} SELECT doc_id, code, {_NAMES} AS name, CASE WHEN code IN ('en', 'zh', 'fr', 'de', 'ja', 'ko') THEN code END AS typed, coalesce(code IN ('en', 'de', 'ko'), false) AS supported, code IS NULL OR code IN ('en', 'de', 'ko') AS gate, coalesce(code IN ('zh', 'ja', 'ko'), false) AS cjk,
  CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.HTTP_CODES.items())} END AS http FROM conf""")
def lang_detect(spark, d):
    code = F.col("code")
    base = _docs(spark, d).where("text is not null").select("doc_id", L.detect(F.col("text")).alias("code"))
    return base.select("doc_id", "code", L.name_of(code).alias("name"), L.typed(code).alias("typed"), L.supported(code, ["en", "de", "ko"]).alias("supported"), L.gate_ok(code, ["en", "de", "ko"]).alias("gate"), F.coalesce(code.isin(L.CJK), F.lit(False)).alias("cjk"), L.http_code(code).alias("http"))


@query(f"WITH {_scores_sql()} SELECT doc_id, round(confidence, 6) AS confidence FROM conf")
def lang_confidence(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.round(L.confidence(F.col("text")), 6).alias("confidence"))


@query(f"WITH {_scores_sql()} SELECT lang, code AS detected, count(*) AS n FROM conf GROUP BY lang, code")
def lang_confusion(spark, d):
    return _docs(spark, d).where("text is not null").select("lang", L.detect(F.col("text")).alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("n"))


# ---- keywords -------------------------------------------------------------------------------------------------------------

KEYS = ("the", "court", "Bank", "de la", "中央银行", "market", "は")
REGEX = (r"[0-9]+ (?:people|Menschen|personas)", r"[Tt]he [a-z]+")


def _pos(t: str, k: str) -> str:
    k2 = k.replace("'", "''")
    return f"CASE WHEN contains({t}, '{k2}') THEN list_transform(range(1, len(string_split({t}, '{k2}'))), lambda i: CAST(list_sum(list_transform(list_slice(string_split({t}, '{k2}'), 1, i), lambda x: length(x))) AS BIGINT) + (i - 1) * {len(k)}) ELSE [] END"


def _count_sql(t: str, keys) -> list[str]:
    return [f"(len(string_split({t}, '{k}')) - 1)" for k in keys]


def _kw_sql(counts: list[str], keys, cond: str = "true") -> str:
    n = " + ".join(counts)
    names = "list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN '{k}' END" for c, k in zip(counts, keys)) + "], lambda x: x IS NOT NULL)"
    return f"SELECT doc_id, CASE WHEN {cond} THEN {n} ELSE 0 END > 0 AS found, CAST(CASE WHEN {cond} THEN {n} ELSE 0 END AS BIGINT) AS match_count, CASE WHEN {cond} THEN array_to_string({names}, '|') ELSE '' END AS matched_keywords FROM documents WHERE text IS NOT NULL"


def _kw(spark, d, cfg: K.KeywordConfig) -> DataFrame:
    base = _docs(spark, d).where("text is not null").select("doc_id", K.matches(F.col("text"), cfg).alias("m"))
    return base.select("doc_id", (F.size("m") > 0).alias("found"), F.size("m").cast("long").alias("match_count"), F.array_join(F.array_distinct(F.transform("m", lambda x: x["keyword"])), "|").alias("matched_keywords"))


@query(_kw_sql(_count_sql("text", KEYS), KEYS))
def kw_any(spark, d):
    return _kw(spark, d, K.KeywordConfig(KEYS))


@query(_kw_sql(_count_sql("lower(text)", [k.lower() for k in KEYS]), [k.lower() for k in KEYS]))
def kw_ci(spark, d):
    return _kw(spark, d, K.KeywordConfig(KEYS, "ci"))


_ALL = ("the", "of", "was")


@query(_kw_sql(_count_sql("text", _ALL), _ALL, " AND ".join(f"contains(text, '{k}')" for k in _ALL)))
def kw_all(spark, d):
    return _kw(spark, d, K.KeywordConfig(_ALL, "all"))


_EXACT = ("the", "court", "Bank")
_EDGE = r"[\p{L}\p{N}]"


def _exact_sql(k: str) -> str:
    n = len(k)
    return f"len(list_filter({_pos('text', k)}, lambda p: NOT (p > 0 AND regexp_matches(substr(text, p, 1), '{_EDGE}')) AND NOT regexp_matches(substr(text, p + {n} + 1, 1), '{_EDGE}')))"


@query(_kw_sql([_exact_sql(k) for k in _EXACT], _EXACT))
def kw_exact(spark, d):
    return _kw(spark, d, K.KeywordConfig(_EXACT, "exact"))


@query(_kw_sql([f"len(regexp_extract_all(text, '{p}'))" for p in REGEX], REGEX))
def kw_regex(spark, d):
    return _kw(spark, d, K.KeywordConfig(REGEX, "regex"))


_TWO = ("court", "Bank")
_MATCHES = f"list_concat(list_transform({_pos('text', _TWO[0])}, lambda p: {{'k': 0, 'kw': '{_TWO[0]}', 'pos': p, 'len': {len(_TWO[0])}}}), list_transform({_pos('text', _TWO[1])}, lambda p: {{'k': 1, 'kw': '{_TWO[1]}', 'pos': p, 'len': {len(_TWO[1])}}}))"
_M = f"m AS (SELECT doc_id, text, {_MATCHES} AS m FROM documents WHERE text IS NOT NULL)"
_GAPS = "list_transform(range(1, len(m)), lambda i: m[i + 1].pos - (m[i].pos + m[i].len))"


@query(f"""WITH {_M}, x AS (SELECT doc_id, text, unnest(m) AS e FROM m) SELECT doc_id, e.kw AS keyword, e.pos AS pos, CAST(e.len AS BIGINT) AS len, substr(text, greatest(e.pos - 20, 0) + 1, e.pos - greatest(e.pos - 20, 0)) || '**' || substr(text, e.pos + 1, e.len) || '**' || substr(text, e.pos + e.len + 1, 20) AS context FROM x""")
def kw_context(spark, d):
    cfg = K.KeywordConfig(_TWO, include_context=True, context_window=20, highlight=True)
    flat = _docs(spark, d).where("text is not null").select("doc_id", "text", F.explode(K.matches(F.col("text"), cfg)).alias("m"))
    return flat.select("doc_id", F.col("m.keyword").alias("keyword"), F.col("m.pos").cast("long").alias("pos"), F.col("m.len").cast("long").alias("len"), K.context(F.col("text"), F.col("m.pos"), F.col("m.len"), 20, True).alias("context"))


@query(f"""WITH {_M} SELECT doc_id, strlen(text) AS text_bytes, round(len(list_distinct(list_transform(m, lambda x: x.k)))::DOUBLE / 2.0::DOUBLE * 100.0::DOUBLE, 6) AS match_percentage,
  CASE WHEN len(m) = 0 THEN NULL WHEN len(list_filter(m, lambda x: x.k = 0)) >= len(list_filter(m, lambda x: x.k = 1)) THEN '{_TWO[0]}' ELSE '{_TWO[1]}' END AS top_keyword,
  CASE WHEN len(m) > 1 THEN round(list_sum({_GAPS})::DOUBLE / (len(m) - 1), 6) END AS mean_gap, coalesce(len(list_filter({_GAPS}, lambda g: g > 300)) = 0, true) AS near, len(m) >= 3 AS enough FROM m""")
def kw_stats(spark, d):
    cfg = K.KeywordConfig(_TWO)
    base = _docs(spark, d).where("text is not null").select("doc_id", "text", K.matches(F.col("text"), cfg).alias("m"))
    s = K.statistics(F.col("text"), F.col("m"), cfg)
    return base.select("doc_id", s["text_bytes"].alias("text_bytes"), F.round(s["match_percentage"], 6).alias("match_percentage"), s["top_keyword"].alias("top_keyword"), F.round(s["mean_gap"], 6).alias("mean_gap"), K.proximity_ok(F.col("m"), 300).alias("near"), (F.size("m") >= 3).alias("enough"))


@query(f"""WITH {_M}, p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '{WS}+', '', 'g') <> '' AND len(list_filter(m, lambda x: x.pos >= strpos(text, p) - 1 AND x.pos < strpos(text, p) - 1 + length(p))) > 0) AS k FROM m)
  SELECT doc_id, array_to_string(k, chr(10) || chr(10)) AS filtered, strlen(array_to_string(k, chr(10) || chr(10))) AS filtered_bytes, strlen(text) AS original_bytes, CASE WHEN strlen(text) > 0 THEN round(strlen(array_to_string(k, chr(10) || chr(10)))::DOUBLE / strlen(text), 6) ELSE 0 END AS ratio, len(k) AS paragraphs FROM p""")
def kw_paragraphs(spark, d):
    cfg = K.KeywordConfig(_TWO)
    base = _docs(spark, d).where("text is not null").select("doc_id", "text", K.matches(F.col("text"), cfg).alias("m"))
    f = K.filtered(F.col("text"), F.col("m"))
    return base.select("doc_id", *[(F.round(v, 6) if k == "ratio" else v).alias(k) for k, v in f.items()])


@query()
def kw_sentences(spark, d):
    cfg = K.KeywordConfig(_TWO)
    base = _docs(spark, d).where("text is not null").select("doc_id", "text", K.matches(F.col("text"), cfg).alias("m")).where("size(m) > 0")
    return base.select("doc_id", F.posexplode(K.sentences_around(F.col("text"), F.col("m"))).alias("pos", "sentence"))


# ---- cleaning -------------------------------------------------------------------------------------------------------------


def _stats_sql(c: str, stages: int) -> str:
    w = lambda x: f"coalesce(len({_TOK(x)}), 0)"
    return f"SELECT doc_id, cleaned, strlen(text) AS original_bytes, coalesce(strlen(cleaned), 0) AS cleaned_bytes, {w('text')} AS original_words, {w('cleaned')} AS cleaned_words, round(CASE WHEN strlen(text) > 0 THEN coalesce(strlen(cleaned), 0)::DOUBLE / strlen(text) ELSE 1.0 END, 6) AS ratio, CAST({stages} AS BIGINT) AS stages FROM (SELECT doc_id, text, nullif({c}, '') AS cleaned FROM documents WHERE text IS NOT NULL)"


def _clean(spark, d, cfg: C.CleaningConfig) -> DataFrame:
    base = _docs(spark, d).where("text is not null").select("doc_id", "text", C.cleaned(F.col("text"), cfg).alias("cleaned"))
    s = C.statistics(F.col("text"), F.col("cleaned"), cfg)
    return base.select("doc_id", "cleaned", *[(F.round(v, 6) if k == "ratio" else v).alias(k) for k, v in s.items()])


_FILTERED = lambda c, cond: f"array_to_string(list_filter({_TOK(c)}, lambda w: {cond}), ' ')"


@query(_stats_sql(_SQUEEZE("text"), 1))
def clean_basic(spark, d):
    return _clean(spark, d, C.BASIC)


@query(_stats_sql(_SQUEEZE(_FILTERED(r"translate(regexp_replace(text, '[^\x00-\x7F]+', '', 'g'), chr(10) || chr(13), '  ')", r"NOT regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '[^\p{L}\p{N}]')")), 2))
def clean_aggressive(spark, d):
    return _clean(spark, d, C.AGGRESSIVE)


def _ranges_sql(c: str, scripts) -> str:
    for s in scripts:
        for a, b in C.SCRIPTS[s]:
            c = f"regexp_replace({c}, '[\\x{{{a:x}}}-\\x{{{b:x}}}]+', '', 'g')"
    return c


@query(_stats_sql(_SQUEEZE(_ranges_sql("text", ("cjk", "japanese", "korean", "arabic", "cyrillic"))), 1))
def clean_cjk(spark, d):
    return _clean(spark, d, C.CleaningConfig(remove_scripts=("cjk", "japanese", "korean", "arabic", "cyrillic")))


_LEN = _FILTERED("text", "strlen(w) >= 3 AND strlen(w) <= 12")


@query(_stats_sql(_SQUEEZE(f"array_to_string(list_filter(string_split({_LEN}, '.'), lambda s: strlen(trim(s)) >= 5 AND strlen(trim(s)) <= 200), '.')"), 1))
def clean_length(spark, d):
    return _clean(spark, d, C.CleaningConfig(lengths=C.LengthFilter(3, 12, 5, 200)))


@query(_stats_sql(_SQUEEZE(_FILTERED("text", "NOT list_contains(['the', 'and', 'der', 'la'], lower(w)) AND NOT regexp_matches(w, '^[A-Z]+$') AND NOT regexp_matches(w, '[0-9]')")), 1))
def clean_words(spark, d):
    return _clean(spark, d, C.CleaningConfig(words=C.WordFilter(("The", "and", "der", "la"), ("^[A-Z]+$",), False, True, False)))


@query(_stats_sql(_SQUEEZE(r"translate(regexp_replace(regexp_replace(translate(text, '#*', ''), '[\x{2018}-\x{201f}]+', '', 'g'), '[^\p{L}\p{N}\s\x{0B}\x{85}\p{Z}]+', '', 'g'), chr(10) || chr(13), '  ')"), 1))
def clean_chars(spark, d):
    return _clean(spark, d, C.CleaningConfig(characters=C.CharacterFilter("#*", ((0x2018, 0x201F),), False, True, True)))


@query(_stats_sql(_SQUEEZE("regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '([a-z])-([a-z])', '\\1 \\2', 'g')"), 1))
def clean_custom(spark, d):
    return _clean(spark, d, C.CleaningConfig(custom_rules=("remove:[0-9]+", "replace:([a-z])-([a-z]):$1 $2")))


def _rules_sql(rules, c: str = "text") -> str:
    for r in rules:
        c = f"regexp_replace({c}, '{r.pattern.replace(chr(39), chr(39) * 2)}', '{(r.replacement or '').replace(chr(39), chr(39) * 2)}', 'g')"
    return f"SELECT doc_id, {c} AS cleaned FROM documents"


def _rules(spark, d, rules) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.apply_rules(F.col("text"), rules).alias("cleaned"))


@query(_rules_sql(C.DEFAULT_RULES))
def rules_default(spark, d):
    return _rules(spark, d, C.DEFAULT_RULES)


@query(_rules_sql(C.SAFE_RULES))
def rules_safe(spark, d):
    return _rules(spark, d, C.SAFE_RULES)


@query(_rules_sql(C.CJK_RULES))
def rules_cjk(spark, d):
    return _rules(spark, d, C.CJK_RULES)


@query(_rules_sql(C.AGGRESSIVE_RULES))
def rules_aggressive(spark, d):
    return _rules(spark, d, C.AGGRESSIVE_RULES)


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ' ') AS cleaned FROM documents")
def rules_keep_only(spark, d):
    return _rules(spark, d, [C.Rule("names", "keep_only", "[A-Z][a-z]+")])


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '[aeiou]', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS cleaned FROM documents")
def rules_transform(spark, d):
    return _rules(spark, d, [C.Rule("ends", "transform", "trim", priority=10), C.Rule("vowels", "remove", "[aeiou]", priority=50), C.Rule("off", "remove", ".", priority=99, enabled=False)])
