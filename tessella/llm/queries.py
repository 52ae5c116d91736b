"""The queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import table
from tessella.llm import body, bpe, leakage, seen, sitelines, subjects

Query = Callable[[SparkSession, str], DataFrame]


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored_results")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d).select("result_id", "url", "content")
    return sitelines.repeated_lines(rows, sitelines.first_state(rows).verdicts())


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d).select("result_id", "url", "content")
    return sitelines.cleaned(rows, sitelines.first_state(rows).verdicts())


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the arrivals merged as a delta: what must be rebuilt."""
    rows = _stored(spark, d).select("result_id", "url", "content")
    middle = rows.agg(F.coalesce(F.avg("result_id"), F.lit(0.0))).first()[0]
    old = sitelines.first_state(rows.where(F.col("result_id") <= middle))
    new = sitelines.merged(old, rows.where(F.col("result_id") > middle))
    return sitelines.rebuilt(rows, old, new)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("result_id", "url", "title", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return body.spam_pages(_pages(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return body.not_body(_pages(spark, d))


def p4_body(spark: SparkSession, d: str) -> DataFrame:
    """The contents with their main body only."""
    return body.main_body(_pages(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return body.residue_pages(_pages(spark, d))


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    """The message templates of the corpus with their verdicts."""
    return body.residue_templates(_pages(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(_stored(spark, d), "url", "result_id", "result_id")


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, with the arrivals in two batches: the later one is held against what the earlier one left sealed."""
    rows = _stored(spark, d)
    middle = rows.agg(F.coalesce(F.avg("result_id"), F.lit(0.0))).first()[0]
    early, late = rows.where(F.col("result_id") <= middle), rows.where(F.col("result_id") > middle)
    first, known = seen.arrived(early, "url", "result_id")
    second, _ = seen.arrived(late, "url", "result_id", known)
    return seen.repeats(early, "result_id", "url", first, "result_id").unionByName(seen.repeats(late, "result_id", "url", second, "result_id"))


def p3_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rate(_stored(spark, d), "url", "result_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items have leaked, and into how many documents."""
    return leakage.leaked_items(p8_found(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject."""
    return p9_found(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clean, p1_rebuilt, p2_found, p3_found, p3_batches, p3_rate, p4_found, p4_body, p6_found, p6_templates, p7_ids, p8_found, p8_items, p9_found, p9_composition)}


_LINES = r"""
hosts AS (SELECT result_id, url, content, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host
  FROM stored_results WHERE url IS NOT NULL AND regexp_matches(content, '[^\s\x0B\x{85}\p{Z}]')),
each AS (SELECT result_id, url, host, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM hosts),
keyed AS (SELECT result_id, url, host, line_no, regexp_replace(lower(line), '\P{L}+', '', 'g') AS key FROM each),
bad AS (SELECT k.host, k.key FROM (SELECT host, key, count(DISTINCT url) AS n FROM keyed WHERE key <> '' GROUP BY host, key) k
  JOIN (SELECT host, count(DISTINCT url) AS urls FROM hosts GROUP BY host) t ON k.host = t.host WHERE n >= 3 AND n * 20 >= urls)
"""


def oracle_sql() -> dict[str, str]:
    again = "SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY url ORDER BY result_id) AS r FROM stored_results WHERE url IS NOT NULL) WHERE r > 1"
    return {
        "p1_found": f"WITH {_LINES} SELECT result_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN bad USING (host, key)",
        "p3_found": again,
        "p3_batches": again,
    }
