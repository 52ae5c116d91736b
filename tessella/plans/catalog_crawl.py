"""Queries over links, the frontier, politeness, analytics, errors, storage and streams, each with its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import shared_dir, staged, table
from tessella.functions import errors as E
from tessella.functions import urls as U
from tessella.operators import analytics as A
from tessella.operators import events as V
from tessella.operators import frontier as Q
from tessella.operators import links as L
from tessella.operators import politeness as P
from tessella.plans import config as CFG
from tessella.plans import crawl
from tessella.plans.catalog_text import _ORIGIN, _UNSLASHED, PAGES, _ends, _KEPT, all_urls, pages, url_cte
from tessella.sources import fetch as FE
from tessella.sources import results as R
from tessella.streaming import stateful as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored_results")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_events")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks")


# ---- links ------------------------------------------------------------------------------------------------------------

_A = r"""<a[^>]+href\s*=\s*["'']([^"'']+)["''][^>]*>([^<]*)</a>"""
_I = r"""<img[^>]+src\s*=\s*["'']([^"'']+)["''][^>]*>"""
_S = r"""<link[^>]+href\s*=\s*["'']([^"'']+)["''][^>]*>"""
_LINKS = f"""{PAGES}, found AS (SELECT page_id, url AS base, list_concat(list_concat(list_transform(list_zip(regexp_extract_all(html, '{_A}', 1), regexp_extract_all(html, '{_A}', 2)), lambda x: {{'href': x[1], 'anchor': x[2]}}),
    list_transform(regexp_extract_all(html, '{_I}', 1), lambda x: {{'href': x, 'anchor': 'image'}})), list_transform(regexp_extract_all(html, '{_S}', 1), lambda x: {{'href': x, 'anchor': 'stylesheet'}})) AS l FROM pages),
  flat AS (SELECT page_id, base, CAST(unnest(range(len(l))) AS BIGINT) AS seq, unnest(l) AS x FROM found),
  {url_cte('b', 'flat', "page_id, base, seq, x", 'base')},
  res AS (SELECT page_id, base, seq, x.anchor AS anchor, host AS base_host, CASE WHEN regexp_matches(x.href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN x.href WHEN starts_with(x.href, '/') THEN {_ORIGIN} || x.href END AS made FROM b WHERE ok),
  {url_cte('r', 'res', 'page_id, base, seq, anchor, base_host', 'made')},
  links AS (SELECT page_id, base, base_host, seq, {_ORIGIN} || path || coalesce('?' || query, '') || coalesce('#' || fragment, '') AS url, scheme, host, port, path, query, fragment, anchor, 1 AS depth FROM r WHERE ok)"""


def _found(spark, d) -> DataFrame:
    return L.extract(pages(spark, d).withColumnRenamed("url", "base"), "page_id", "base", "html")


@query(f"WITH {_LINKS} SELECT page_id, seq, url, anchor, depth FROM links")
def link_extract(spark, d):
    return _found(spark, d).select("page_id", "seq", "url", "anchor", "depth")


_TYPE = f"CASE WHEN {_ends('lower(path)', U.ASSETS)} THEN 'Asset' WHEN {_ends('lower(path)', U.DOCUMENTS)} THEN 'Document' WHEN host = base_host THEN 'Internal' WHEN ends_with(host, '.' || base_host) THEN 'Subdomain' WHEN host = 'cobalt-times.example' THEN 'Internal' ELSE 'External' END"
_VALID = f"(scheme IN ('http', 'https') AND host <> '' AND NOT {_ends('lower(path)', U.CORE_BLOCKED)} AND NOT (contains(path, 'redirect') AND strlen(path) > 200))"
_TYPED = f"typed AS (SELECT *, {_TYPE} AS link_type FROM links WHERE {_VALID}), simple AS (SELECT * FROM typed WHERE link_type NOT IN ('External', 'Asset'))"
_ALLOWED = ["cobalt-times.example"]


@query(f"WITH {_LINKS}, {_TYPED} SELECT page_id, seq, url, link_type FROM typed")
def link_classify(spark, d):
    return _found(spark, d).where(U.valid_core(F.col("url"))).select("page_id", "seq", "url", L.link_type(F.col("url"), F.col("base"), _ALLOWED).alias("link_type"))


_NORM = f"lower({_ORIGIN} || {_UNSLASHED} || coalesce('?' || {_KEPT}, ''))"


@query(f"""WITH {_LINKS}, {_TYPED}, n AS (SELECT *, {_NORM} AS norm FROM simple), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY seq) AS k FROM n) WHERE k = 1)
  SELECT page_id, seq, norm, link_type, row_number() OVER (PARTITION BY page_id ORDER BY CASE link_type WHEN 'Internal' THEN 0 WHEN 'Subdomain' THEN 1 WHEN 'External' THEN 2 WHEN 'Asset' THEN 3 ELSE 4 END, depth, seq) AS rank FROM one""")
def link_dedup(spark, d):
    return L.dedup_simple(L.process_simple(_found(spark, d), "base", _ALLOWED), "page_id").select("page_id", "seq", "norm", "link_type", "rank")


@query(f"WITH {_LINKS}, {_TYPED} SELECT count(*) AS total, count(*) FILTER (link_type = 'Internal') AS internal, count(*) FILTER (link_type = 'External') AS external, count(*) FILTER (link_type = 'Subdomain') AS subdomain, count(*) FILTER (link_type = 'Asset') AS assets, count(*) FILTER (link_type = 'Document') AS documents FROM simple")
def link_stats(spark, d):
    return L.type_counts(L.process_simple(_found(spark, d), "base", _ALLOWED))


_EXT = "lower(list_extract(string_split(list_extract(string_split(path, '/'), -1), '.'), -1))"
_q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CAT = f"CASE WHEN {_EXT} IN ({_q(L.DOCUMENT)}) THEN 'Document' WHEN {_EXT} IN ({_q(L.MEDIA)}) THEN 'Media' WHEN {_EXT} IN ({_q(L.RESOURCE)}) THEN 'Resource' WHEN host <> '' THEN 'Internal' ELSE 'Other' END"
_CLAMP = lambda c: f"greatest(0, least(255, {c}))"


def _prio_sql(pattern: str) -> str:
    v = _CLAMP(f"50 + CASE {_CAT} WHEN 'Internal' THEN 20 WHEN 'External' THEN 10 WHEN 'Document' THEN 15 WHEN 'Resource' THEN -30 WHEN 'Media' THEN -20 ELSE 5 END")
    v = _CLAMP(f"{v} + CASE WHEN coalesce(regexp_matches(anchor, '[^\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]'), false) THEN 10 ELSE 0 END")
    n = "len(string_split(substr(path, 2), '/'))"
    v = _CLAMP(f"{v} + CASE WHEN {n} = 1 THEN 15 WHEN {n} <= 3 THEN 10 WHEN {n} > 5 THEN -10 ELSE 0 END")
    v = _CLAMP(f"{v} + CASE WHEN regexp_matches(url, '{pattern}') THEN 30 ELSE 0 END")
    v = _CLAMP(f"{v} - CASE WHEN query IS NOT NULL THEN 5 ELSE 0 END")
    return f"CAST({_CLAMP(f'{v} - CASE WHEN fragment IS NOT NULL THEN 3 ELSE 0 END')} AS INTEGER)"


_CFG = L.ExtensiveConfig(scope="subdomains", priority_patterns=("/news/",), exclude_patterns=(r"\?page=",), max_links_per_page=100)
_BASE_IP = r"regexp_matches(base_host, '^\d{1,3}(?:\.\d{1,3}){3}$|^\[')"
_DOM = lambda h: f"CASE WHEN {h} <> '' AND NOT regexp_matches({h}, '^\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}$|^\\[') THEN {h} END"
_REASON = f"""CASE WHEN NOT (depth + 1 < 3) THEN 'Depth limit exceeded: ' || (depth + 1) WHEN NOT (({_DOM('host')}) IS NOT DISTINCT FROM ({_DOM('base_host')}) OR coalesce(ends_with(host, '.' || base_host), false)) THEN 'Domain not allowed'
  WHEN category IN ('Resource', 'Media') THEN 'Resource/media link excluded' WHEN strlen(url) < 10 THEN 'URL too short: ' || strlen(url) || ' < 10' WHEN strlen(url) > 2048 THEN 'URL too long: ' || strlen(url) || ' > 2048'
  WHEN {_EXT} IN ({_q(L.EXCLUDED)}) THEN 'Extension ''' || {_EXT} || ''' in exclude list' WHEN regexp_matches(url, '\\?page=') THEN 'URL matches exclude patterns' ELSE '{L.PASSED}' END"""
_PROC = f"""cat AS (SELECT *, {_CAT} AS category FROM links), proc0 AS (SELECT page_id, seq, url, {_ORIGIN} || path || coalesce('?' || query, '') AS norm, category, {_prio_sql('/news/')} AS priority, {_REASON} AS reason, depth + 1 AS depth FROM cat),
  proc1 AS (SELECT *, reason = '{L.PASSED}' AS should_crawl, coalesce(sum(CASE WHEN reason = '{L.PASSED}' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM proc0),
  proc AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, seq) AS rank FROM proc1 WHERE before < 100)"""


@query(f"WITH {_LINKS}, {_PROC} SELECT page_id, seq, norm, category, priority, depth, should_crawl, reason, rank FROM proc")
def link_process(spark, d):
    return L.process(_found(spark, d), "page_id", "base", _CFG).select("page_id", "seq", "norm", "category", "priority", "depth", "should_crawl", "reason", "rank")


_FILTER = f"{_PROC}, flt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY rank) AS k FROM proc WHERE should_crawl) WHERE k = 1)"


@query(f"WITH {_LINKS}, {_FILTER} SELECT page_id, norm, priority, rank FROM flt")
def link_filter(spark, d):
    return L.filter_processed(L.process(_found(spark, d), "page_id", "base", _CFG), "page_id", _CFG).select("page_id", "norm", "priority", "rank")


@query(f"""WITH {_LINKS}, one AS (SELECT DISTINCT host, base_host FROM links) SELECT host, base_host, ({_DOM('host')}) IS NOT DISTINCT FROM ({_DOM('base_host')}) AS same_domain,
  coalesce(host IN ('cobalt-times.example', 'harbor-desk.example'), false) AS allow_list, coalesce(host NOT IN ('cobalt-times.example', 'harbor-desk.example'), true) AS block_list, true AS unrestricted FROM one""")
def link_scopes(spark, d):
    u, b = F.col("url"), F.col("base")
    domains = ("cobalt-times.example", "harbor-desk.example")
    ok = lambda scope: L.domain_allowed(u, b, L.ExtensiveConfig(scope=scope, domains=domains))
    return _found(spark, d).select(U.domain(u).alias("host"), U.domain(b).alias("base_host"), ok("same_domain").alias("same_domain"), ok("allow_list").alias("allow_list"), ok("block_list").alias("block_list"), ok("unrestricted").alias("unrestricted")).distinct()


# ---- frontier and queue -------------------------------------------------------------------------------------------------

_BUCKET = "CASE WHEN priority <= 50 THEN 'Low' WHEN priority <= 100 THEN 'Normal' WHEN priority <= 150 THEN 'High' ELSE 'Critical' END"
_ENQ = f"{_FILTER}, one AS (SELECT * FROM (SELECT norm, page_id * 100000 + rank AS seq, priority, row_number() OVER (PARTITION BY norm ORDER BY page_id * 100000 + rank) AS j FROM flt) WHERE j = 1)"


def _ordered(spark, d) -> DataFrame:
    return L.filter_processed(L.process(_found(spark, d), "page_id", "base", _CFG), "page_id", _CFG).withColumn("seq", F.col("page_id") * 100000 + F.col("rank"))


@query(f"WITH {_LINKS}, {_ENQ}, seen AS (SELECT DISTINCT url FROM crawl_events WHERE url IS NOT NULL AND epoch_ms(ts) // 1000 > (SELECT max(epoch_ms(ts)) // 1000 FROM crawl_events) - 3600) SELECT norm, seq, {_BUCKET} AS bucket, CAST(0 AS INTEGER) AS task_depth FROM one WHERE norm NOT IN (SELECT url FROM seen) ORDER BY seq LIMIT 10000")
def frontier_enqueue(spark, d):
    e = _events(spark, d).select(F.col("url").alias("norm"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"))
    now = e.agg(F.coalesce(F.max("at_s"), F.lit(0))).first()[0]
    return Q.enqueue(_ordered(spark, d), e.where("norm is not null"), now, 0, _CFG)


@query(f"WITH {_LINKS}, {_ENQ} SELECT {_BUCKET} AS bucket, count(*) AS n FROM one GROUP BY 1")
def frontier_status(spark, d):
    return Q.enqueue(_ordered(spark, d), None, 0, 0, L.ExtensiveConfig(max_queue_size=None)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS}, {_ENQ} SELECT norm, seq, {_BUCKET} AS bucket FROM one ORDER BY seq LIMIT 1")
def frontier_next(spark, d):
    return Q.enqueue(_ordered(spark, d), None, 0, 0, L.ExtensiveConfig(max_queue_size=None)).select("norm", "seq", "bucket").orderBy("seq").limit(1)


@query(f"WITH {_LINKS}, {_PROC} SELECT count(*) AS total, count(*) FILTER (NOT should_crawl) AS rejected, round(avg(priority), 6) AS mean_priority, round(count(*)::DOUBLE / (SELECT count(*) FROM stored_results), 6) AS discovery_rate FROM proc")
def discovery_stats(spark, d):
    p = L.process(_found(spark, d), "page_id", "base", _CFG)
    s = Q.discovery_stats(p, _stored(spark, d).count())
    return s.select("total", "rejected", F.round("mean_priority", 6).alias("mean_priority"), F.round("discovery_rate", 6).alias("discovery_rate"))


@query(f"WITH RECURSIVE {_LINKS}, {_PROC}, o AS (SELECT page_id, priority, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY page_id) AS n FROM proc), w AS (SELECT page_id, i, n, priority::DOUBLE AS mean FROM o WHERE i = 1 UNION ALL SELECT o.page_id, o.i, o.n, (floor(w.mean) * w.i + o.priority)::DOUBLE / o.i FROM w JOIN o ON o.page_id = w.page_id AND o.i = w.i + 1) SELECT page_id, round(mean, 6) AS running_mean FROM w WHERE i = n")
def discovery_running_mean(spark, d):
    p = L.process(_found(spark, d), "page_id", "base", _CFG).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "priority"))).alias("x"))
    return p.select("page_id", F.round(Q.truncating_mean(F.transform("x", lambda e: e["priority"])), 6).alias("running_mean"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT url AS src, unnest(links_found) AS dst FROM stored_results), k AS (SELECT DISTINCT url, 0 AS round FROM stored_results WHERE url IS NOT NULL AND coalesce(metadata.parent_url, '') = ''
  UNION SELECT e.dst, k.round + 1 FROM k JOIN e ON e.src = k.url WHERE k.round < 3) SELECT url, CAST(min(round) AS INTEGER) AS round FROM k WHERE url IS NOT NULL GROUP BY url""")
def frontier_rounds(spark, d):
    s = _stored(spark, d)
    edges = s.select(F.col("url").alias("src"), F.explode("links_found").alias("dst")).distinct()
    return Q.rounds(edges, s.where("url is not null and coalesce(metadata.parent_url, '') = ''").select("url").distinct(), 3)


_RANKS = "CASE lower(trim(priority)) WHEN 'low' THEN 1 WHEN 'normal' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 0 END"
_NOW = "(SELECT max(created_at) FROM tasks)"


def _now(spark, d):
    at = _tasks(spark, d).agg(F.max(F.col("created_at").cast("timestamp"))).first()[0]
    return F.lit(at).cast("timestamp")


@query(f"SELECT id, url, CAST({_RANKS} AS INTEGER) AS rank, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, url NULLS FIRST) AS k FROM tasks WHERE id IS NOT NULL) WHERE k = 1 AND lower(status) = 'pending'")
def queue_order(spark, d):
    return Q.queue_order(_tasks(spark, d))


@query("""SELECT id, url, CASE WHEN a < m THEN CAST(least(floor(1000 * pow(2, a)), 30000) AS BIGINT) END AS delay_ms, CAST(a + 1 AS INTEGER) AS attempts, CASE WHEN a + 1 < m THEN 'Retrying' ELSE 'Dead' END AS new_status
  FROM (SELECT id, url, status, coalesce(attempt_count, 0) AS a, coalesce(max_retries, 3) AS m FROM tasks) WHERE lower(status) = 'inprogress'""")
def queue_retry(spark, d):
    return Q.failed(_tasks(spark, d))


@query(f"""SELECT *, round(CASE WHEN completed + dead > 0 THEN completed::DOUBLE / (completed + dead) * 100 ELSE 0 END, 6) AS success_rate FROM (SELECT count(*) AS total, count(*) FILTER (lower(status) = 'pending') AS pending, count(*) FILTER (lower(status) = 'inprogress') AS in_progress, count(*) FILTER (lower(status) = 'completed') AS completed,
  count(*) FILTER (lower(status) = 'failed') AS failed, count(*) FILTER (lower(status) = 'retrying') AS retrying, count(*) FILTER (lower(status) = 'dead') AS dead, count(*) FILTER (lower(status) = 'retrying' AND (delay_until IS NULL OR delay_until <= {_NOW})) AS ready_retries FROM tasks)""")
def queue_stats(spark, d):
    return Q.task_stats(_tasks(spark, d), _now(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@query(f"SELECT id, url, (epoch_us({_NOW}) // 1000000) - (epoch_us(started_at) // 1000000) AS age_s FROM tasks WHERE lower(status) = 'inprogress' AND (epoch_us({_NOW}) // 1000000) - (epoch_us(started_at) // 1000000) > 300")
def queue_zombies(spark, d):
    return Q.zombies(_tasks(spark, d), _now(spark, d))


@query("SELECT id, created_at FROM (SELECT id, created_at FROM tasks WHERE lower(status) = 'completed' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1000)")
def queue_history(spark, d):
    return Q.keep_last(_tasks(spark, d), "completed", "created_at", 1000).select("id", "created_at")


@query("SELECT id, url, CASE WHEN lower(status) = 'inprogress' THEN 'Pending' ELSE status END AS status, CASE WHEN lower(status) = 'inprogress' THEN CAST(0 AS INTEGER) ELSE attempt_count END AS attempt_count FROM tasks")
def queue_recover(spark, d):
    return Q.recover(_tasks(spark, d)).select("id", "url", "status", "attempt_count")


@query(f"SELECT id, CASE WHEN lower(status) = 'retrying' AND (delay_until IS NULL OR delay_until <= {_NOW}) THEN 'Pending' ELSE status END AS status FROM tasks")
def queue_release(spark, d):
    return Q.release_retries(_tasks(spark, d), _now(spark, d)).select("id", "status")


@query("SELECT DISTINCT coalesce(attempt_count, 0) AS attempt, CAST(least(floor(500 * pow(1.5, coalesce(attempt_count, 0))), 3000) AS BIGINT) AS delay_ms FROM tasks")
def retry_backoff(spark, d):
    a = F.coalesce("attempt_count", F.lit(0))
    return _tasks(spark, d).select(a.alias("attempt"), Q.retry_delay(a, 500, 3000, 1.5).alias("delay_ms")).distinct()


@query("SELECT url, min(event_id) AS event_id FROM crawl_events WHERE url IS NOT NULL GROUP BY url")
def dedup_visited(spark, d):
    return Q.first_visits(_events(spark, d), "url", "event_id")


_NOW_E = "(SELECT max(ts) FROM crawl_events)"


@query(f"SELECT url, last, (epoch_us({_NOW_E}) // 1000000) - (epoch_us(last) // 1000000) AS age_s, coalesce((epoch_us({_NOW_E}) // 1000000) - (epoch_us(last) // 1000000) < 86400, false) AS alive FROM (SELECT url, max(ts) AS last FROM crawl_events WHERE url IS NOT NULL GROUP BY url)")
def ttl_lookup(spark, d):
    e = _events(spark, d)
    now = F.lit(e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]).cast("timestamp")
    return Q.alive(e.where("url is not null").groupBy("url").agg(F.max("ts").alias("last")), "last", now, 86400)


# ---- robots and rates -----------------------------------------------------------------------------------------------------

_NUM = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
_T = lambda c: f"regexp_replace({c}, '^[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"
_ROBOTS = f"""lines AS (SELECT host, unnest(range(len(string_split(t, chr(10))))) AS pos, {_T("unnest(string_split(t, chr(10)))")} AS line FROM (SELECT host, replace(robots_txt, chr(13) || chr(10), chr(10)) AS t FROM robots)),
  named AS (SELECT host, pos, lower(regexp_extract(line, '^([A-Za-z-]+):', 1)) AS name, {_T("string_split(line, ':')[2]")} AS value FROM lines WHERE line <> '' AND NOT starts_with(line, '#')),
  agents AS (SELECT *, last_value(CASE WHEN name = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY host ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM named),
  rules AS (SELECT host, pos, name, value, CAST(floor(1000 * CASE WHEN name = 'crawl-delay' AND regexp_matches(value, '{_NUM}') THEN TRY_CAST(value AS DOUBLE)
    WHEN name = 'request-rate' AND len(string_split(value, '/')) = 2 AND regexp_matches(string_split(value, '/')[1], '{_NUM}') AND regexp_matches(string_split(value, '/')[2], '{_NUM}') AND TRY_CAST(string_split(value, '/')[1] AS DOUBLE) <> 0 THEN TRY_CAST(string_split(value, '/')[2] AS DOUBLE) / TRY_CAST(string_split(value, '/')[1] AS DOUBLE) END) AS BIGINT) AS delay
    FROM agents WHERE agent = '*' AND name IN ('allow', 'disallow', 'crawl-delay', 'request-rate'))"""


@query(f"""WITH {_ROBOTS}, {url_cte('u', '(SELECT DISTINCT url FROM stored_results)', 'url AS k')}, p AS (SELECT DISTINCT host, path FROM u WHERE ok),
  v AS (SELECT p.host, p.path, arg_max(r.name, r.pos) FILTER (r.name IN ('allow', 'disallow') AND r.value <> '' AND starts_with(p.path, r.value)) AS verdict, arg_max(r.delay, r.pos) FILTER (r.delay IS NOT NULL) AS delay_ms FROM p LEFT JOIN rules r ON r.host = p.host GROUP BY p.host, p.path)
  SELECT host, path, coalesce(verdict = 'allow', true) AS allowed, delay_ms FROM v""")
def robots_eval(spark, d):
    p = U.parsed(F.col("url"))
    paths = _stored(spark, d).where(p.ok).select(p.host.alias("host"), p.path.alias("path")).distinct()
    return P.robots_verdict(paths, P.robots_rules(table(spark, d, "robots")), "host", "path").select("host", "path", "allowed", "delay_ms")


_EV = f"{url_cte('e', 'crawl_events', 'event_id, epoch_us(ts) // 1000 AS ms')}"
_LIMITS = "lim AS (SELECT domain, min({'a': max_requests, 'b': window_ms}) AS l FROM domain_limits WHERE domain IS NOT NULL GROUP BY domain)"


def _requests(spark, d) -> DataFrame:
    return _events(spark, d).select("event_id", U.parsed(F.col("url")).host.alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN host IS NULL OR ms IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY host ORDER BY ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) END AS in_window FROM e")
def rate_window(spark, d):
    return P.in_window(_requests(spark, d), "host", "ms", 60000).select("event_id", "in_window")


@query(f"""WITH {_EV}, {_LIMITS}, c AS (SELECT host, count(*) AS tracked FROM e WHERE host IS NOT NULL GROUP BY host) SELECT host, tracked, CAST(coalesce(l.a, 2) AS INTEGER) AS max_requests, CAST(coalesce(l.b, 1000) AS BIGINT) AS window_ms,
  CASE WHEN tracked = 0 THEN 0 ELSE CAST(floor(coalesce(l.b, 1000) / coalesce(l.a, 2)) AS BIGINT) END AS wait_ms FROM c LEFT JOIN lim ON lim.domain = c.host""")
def rate_limit_lookup(spark, d):
    c = _requests(spark, d).where("host is not null").groupBy("host").agg(F.count("*").alias("tracked"))
    return P.with_limits(c, table(spark, d, "domain_limits"), "host").withColumn("wait_ms", P.wait_ms(F.col("tracked"), F.col("max_requests"), F.col("window_ms")))


@query(f"WITH {_EV} SELECT host, count(*) AS tracked, max(ms) AS last_ms FROM e WHERE host IS NOT NULL GROUP BY host HAVING (SELECT max(epoch_us(ts) // 1000) FROM crawl_events) - max(ms) < 3600000")
def rate_trackers(spark, d):
    r = _requests(spark, d)
    now = r.agg(F.coalesce(F.max("ms"), F.lit(0))).first()[0]
    return P.active_trackers(r.where("host is not null"), "host", "ms", now)


# ---- analytics, errors, configuration ---------------------------------------------------------------------------------------

_SR = url_cte("s", "(SELECT * FROM stored_results)", "result_id, word_count, language, metadata")


@query(f"""WITH {_SR} SELECT count(*) AS total, count(DISTINCT nullif(host, '')) AS unique_domains, CASE WHEN count(*) > 0 THEN CAST(floor(coalesce(sum(word_count), 0) / count(*)) AS BIGINT) ELSE 0 END AS average_words,
  CASE WHEN count(*) > 0 THEN CAST(floor(coalesce(sum(metadata.response_time_ms), 0) / count(*)) AS BIGINT) ELSE 0 END AS average_ms, count(*) FILTER (metadata.status_code BETWEEN 200 AND 299) AS successful, count(*) FILTER (metadata.status_code NOT BETWEEN 200 AND 299) AS failed FROM s""")
def analytics_summary(spark, d):
    return A.summary(_stored(spark, d))


@query(f"WITH {_SR} SELECT host, count(*) AS n FROM s WHERE host <> '' GROUP BY host ORDER BY n DESC, host LIMIT 10")
def analytics_top_hosts(spark, d):
    return A.top_hosts(_stored(spark, d))


@query("SELECT language, count(*) AS n FROM stored_results WHERE language IS NOT NULL GROUP BY language")
def analytics_languages(spark, d):
    return A.languages(_stored(spark, d))


_K = "regexp_replace(lower(trim(event_type)), '[^a-z]', '', 'g')"
_OK, _BAD = _q(A.SUCCESS), _q(A.FAILURE)
_EVK = url_cte("e", f"(SELECT *, {_K} AS kind FROM crawl_events)", "event_id, kind, duration_ms, content_length, ts, session_id")


@query(f"""WITH {_EVK} SELECT host, count(*) AS requests, count(*) FILTER (kind IN ({_OK})) AS successes, count(*) FILTER (kind NOT IN ({_OK})) AS failures, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms,
  CAST(coalesce(sum(content_length) FILTER (kind IN ({_OK})), 0) AS BIGINT) AS bytes, max(ts) AS last_seen FROM e WHERE kind IN ({_OK}, {_BAD}) AND host <> '' GROUP BY host""")
def domain_metrics(spark, d):
    return A.domain_metrics(_events(spark, d))


_SPAN = "coalesce((epoch_us(max(ts)) // 1000000) - (epoch_us(min(ts)) // 1000000), 0)"


@query(f"""WITH {_EVK}, a AS (SELECT {_SPAN} AS up, count(*) FILTER (kind IN ({_OK}, {_BAD})) AS n, count(*) FILTER (kind IN ({_OK})) AS ok, count(*) FILTER (kind = 'retrying') AS retries, count(*) FILTER (kind = 'started') AS started, CAST(coalesce(sum(duration_ms) FILTER (kind IN ({_OK}, {_BAD})), 0) AS BIGINT) AS ms, CAST(coalesce(sum(content_length) FILTER (kind IN ({_OK})), 0) AS BIGINT) AS b FROM e)
  SELECT up AS uptime_secs, n AS total_requests, retries, round(CASE WHEN n > 0 THEN ok::DOUBLE / n * 100 ELSE 0 END, 6) AS success_rate, round(CASE WHEN n > 0 THEN ms::DOUBLE / n ELSE 0 END, 6) AS avg_ms, round(CASE WHEN up > 0 THEN n::DOUBLE / up ELSE 0 END, 6) AS requests_per_second,
    round(CASE WHEN up > 0 THEN b::DOUBLE / up ELSE 0 END, 6) AS bytes_per_second, round(CASE WHEN started > 0 THEN ok::DOUBLE / started * 100 ELSE 0 END, 6) AS completion_rate FROM a""")
def metrics_snapshot(spark, d):
    s = A.snapshot(_events(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"""WITH {_EVK}, a AS (SELECT session_id, count(DISTINCT url) AS u, count(*) FILTER (kind IN ({_OK}, {_BAD})) AS n, count(*) FILTER (kind IN ({_OK})) AS ok, coalesce(sum(duration_ms) FILTER (kind IN ({_OK}, {_BAD})), 0) AS ms, {_SPAN} AS secs FROM e WHERE session_id IS NOT NULL GROUP BY session_id)
  SELECT session_id, u AS total_urls, n AS processed, ok AS successful, n - ok AS failed, CASE WHEN n > 0 THEN CAST(floor(ms / n) AS BIGINT) ELSE 0 END AS average_ms, secs AS seconds, round(CASE WHEN secs >= 1 THEN n::DOUBLE / secs ELSE 0 END, 6) AS throughput, round(CASE WHEN n > 0 THEN ok::DOUBLE / n * 100 ELSE 0 END, 6) AS success_rate,
    round(CASE WHEN u > 0 THEN n::DOUBLE / u * 100 ELSE 0 END, 6) AS completion_rate, greatest(0, u - n) AS remaining, CASE WHEN secs >= 1 AND n > 0 AND u > n THEN round((u - n) / (n::DOUBLE / secs), 6) END AS eta_seconds FROM a""")
def session_stats(spark, d):
    s = A.sessions(_events(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"SELECT status, count(*) AS n FROM (SELECT url, arg_max({_K}, event_id) AS status FROM crawl_events WHERE url IS NOT NULL GROUP BY url) GROUP BY status")
def status_counts(spark, d):
    return A.latest_status(_events(spark, d))


@query(f"SELECT kind, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM (SELECT CASE {_K} {' '.join(f'WHEN {chr(39)}{k.lower()}{chr(39)} THEN {chr(39)}{k}{chr(39)}' for k in V.KINDS)} END AS kind, duration_ms FROM crawl_events) WHERE kind IS NOT NULL GROUP BY kind")
def event_performance(spark, d):
    return V.performance(_events(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


_CASE = lambda pairs, key, other="NULL": f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {other} END"


@query(f"""WITH m AS (SELECT DISTINCT error_message AS message FROM crawl_events WHERE error_message IS NOT NULL), c AS (SELECT message, CASE {' '.join(f"WHEN contains(lower(message), '{p}') THEN '{n}'" for p, n in E.TESTS)} ELSE 'UnknownError' END AS category FROM m)
  SELECT message, category, category IN ({_q(E.RETRYABLE)}) AS retryable, {_CASE({k: v[0] for k, v in E.CATEGORIES.items()}, 'category')} AS severity, replace({_CASE({k: v[1] for k, v in E.CATEGORIES.items()}, 'category')}, '{{}}', message) AS text FROM c""")
def error_categorize(spark, d):
    base = _events(spark, d).where("error_message is not null").select(F.col("error_message").alias("message")).distinct().withColumn("category", E.categorize(F.col("message")))
    c = F.col("category")
    return base.select("message", "category", E.retryable(c).alias("retryable"), E.severity(c).alias("severity"), E.display(c, F.col("message")).alias("text"))


@query(f"SELECT DISTINCT metadata.status_code AS code, CASE metadata.status_code {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in U.REASONS.items())} ELSE 'HTTP ' || metadata.status_code END AS text FROM stored_results")
def http_status_text(spark, d):
    c = F.col("metadata.status_code")
    return _stored(spark, d).select(c.alias("code"), U.status_text(c).alias("text")).distinct()


@query(r"""SELECT id, CASE WHEN coalesce(url, '') = '' THEN 'Base URL is required' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:\S') OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[/?#]|$)') THEN 'Invalid URL format' WHEN coalesce(max_retries, 0) = 0 THEN 'Max total URLs must be greater than 0'
  WHEN coalesce(depth, 0) = 0 THEN 'Max crawl depth must be greater than 0' WHEN lower(coalesce(status, '')) NOT IN ('pending', 'completed') THEN 'Match strategy must be ''any'' or ''all''' END AS error FROM tasks""")
def config_validate(spark, d):
    strategy = F.when(F.lower("status") == "pending", "any").when(F.lower("status") == "completed", "all").otherwise("none")
    return _tasks(spark, d).select("id", CFG.request_error(F.col("url"), F.col("max_retries"), F.col("depth"), F.array(F.lit(".pdf")), strategy).alias("error"))


# ---- sources and sinks -----------------------------------------------------------------------------------------------------

_REQ = "url IS NOT NULL AND word_count IS NOT NULL AND links_found IS NOT NULL AND metadata.response_time_ms IS NOT NULL AND metadata.depth IS NOT NULL AND metadata.crawl_session_id IS NOT NULL AND timestamp.secs_since_epoch IS NOT NULL"


@query(f"SELECT url, content, word_count, len(links_found) AS n_links, metadata.status_code AS status, timestamp.secs_since_epoch AS secs FROM stored_results WHERE {_REQ}")
def storage_roundtrip(spark, d):
    """Written as JSON lines and read back; rows without a required field do not come back."""
    folder = os.path.join(shared_dir(spark), "tessella", f"results-{uuid.uuid4().hex}")
    R.write_results(_stored(spark, d).select([f.name for f in R.RESULT.fields]), folder)
    return R.read_results(spark, folder).select("url", "content", "word_count", F.size("links_found").cast("long").alias("n_links"), F.col("metadata.status_code").alias("status"), F.col("timestamp.secs_since_epoch").alias("secs"))


@query("SELECT url, coalesce(title, '') AS title, word_count AS words, coalesce(language, '') AS language, metadata.response_time_ms AS ms, coalesce(metadata.status_code, 0) AS status FROM stored_results")
def storage_csv(spark, d):
    return R.csv_rows(_stored(spark, d))


@query("SELECT result_id, 'crawl_' || timestamp.secs_since_epoch || '_' || substr(sha256(url), 1, 8) || '.json' AS name FROM stored_results")
def storage_file_name(spark, d):
    return _stored(spark, d).select("result_id", R.file_name(F.col("url"), F.col("timestamp.secs_since_epoch")).alias("name"))


@query(f"SELECT id, list_extract([{', '.join(f'{chr(39)}{a}{chr(39)}' for a in FE.USER_AGENTS)}], CAST((r - 1) % 5 + 1 AS BIGINT)) AS agent FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT DISTINCT id FROM tasks WHERE id IS NOT NULL))")
def fetch_agents(spark, d):
    """Agents in turn over the tasks; the places are numbered by range partition, not in one task."""
    ids = staged(_tasks(spark, d).where("id is not null").select("id").distinct().sort("id").withColumn("part", F.spark_partition_id()), "ids")
    sizes = {r[0]: r[1] for r in ids.groupBy("part").count().collect()}  # one row per partition
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p] = at
        at += sizes[p]
    from pyspark.sql import Window

    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part")) if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) + offset
    return ids.select("id", FE.round_robin(place, FE.USER_AGENTS).alias("agent"))


@query()
def fetch_pages(spark, d):
    """Every stored page through the fetch operator, with a fetcher that answers from the url alone."""

    def answer(url: str, options: dict):
        if len(url) % 7 == 0:
            raise ValueError("connection refused")
        return 200, f"<title>{url}</title>", None

    return FE.fetch_all(_stored(spark, d).where("url is not null").select("url"), answer)


# ---- streams ------------------------------------------------------------------------------------------------------------


def _run_stream(spark: SparkSession, d: str, build) -> DataFrame:
    """Replays crawl_events through a file stream until nothing is left; the sink is a folder, read back."""
    base = os.path.join(shared_dir(spark), "tessella", f"stream-{uuid.uuid4().hex}")
    schema = _events(spark, d).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/crawl_events.parquet*")
    out = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    q = out.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(base + "/out")


@query("SELECT DISTINCT url FROM crawl_events WHERE url IS NOT NULL AND ts IS NOT NULL")
def stream_dedup(spark, d):
    return _run_stream(spark, d, lambda s: S.visited(s.where("url is not null and ts is not null").select("url", "ts"), delay="3650 days").select("url"))


@query(f"WITH {_EV}, w AS (SELECT host, ms, count(*) OVER (PARTITION BY host ORDER BY ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS in_window FROM e WHERE host IS NOT NULL AND ms IS NOT NULL) SELECT host, ms, in_window, in_window > 2 AS over_limit, CAST(CASE WHEN in_window > 1 THEN 500 ELSE 0 END AS BIGINT) AS wait_ms FROM w")
def stream_rate_window(spark, d):
    """The stream's limiter over one batch; as a batch it equals rate windows computed with a range frame."""
    host = U.parsed(F.col("url")).host
    return _run_stream(spark, d, lambda s: S.rate_windows(s.select(host.alias("host"), F.unix_millis("ts").alias("ms")), "host", "ms", 2, 1000))


# ---- pipelines ------------------------------------------------------------------------------------------------------------


@query()
def crawl_extract(spark, d):
    """Fetched pages to stored rows: gates, title, language, words."""
    return crawl.extracted(pages(spark, d), CFG.PRODUCTION).where("kept").select("page_id", "title", "words", "language")


@query(f"""WITH {_ROBOTS}, {url_cte('u', '(SELECT DISTINCT url FROM stored_results)', 'url AS k')}, p AS (SELECT k, host, path FROM u WHERE ok AND {_VALID}),
  v AS (SELECT p.k, arg_max(r.name, r.pos) FILTER (r.name IN ('allow', 'disallow') AND r.value <> '' AND starts_with(p.path, r.value)) AS verdict, arg_max(r.delay, r.pos) FILTER (r.delay IS NOT NULL) AS delay_ms FROM p LEFT JOIN rules r ON r.host = p.host GROUP BY p.k)
  SELECT k AS url, delay_ms FROM v WHERE coalesce(verdict = 'allow', true)""")
def crawl_admitted(spark, d):
    return crawl.admitted(_stored(spark, d), table(spark, d, "robots"))


@query()
def analytics_full(spark, d):
    return A.analytics(_stored(spark, d))


__all__ = ["QUERIES", "SQL", "all_urls"]
