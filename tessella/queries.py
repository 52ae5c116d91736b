"""The queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import table
from tessella.operators.hierarchy import hierarchy
from tessella.plans import catalog_crawl, catalog_text

Query = Callable[[SparkSession, str], DataFrame]


def _tree(spark: SparkSession, d: str, with_paths: bool = False) -> DataFrame:
    rows = table(spark, d, "stored_results").select("result_id", "url", F.col("metadata.parent_url").alias("parent_url"))
    return hierarchy(rows, "url", "parent_url", "result_id", with_paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("name").alias("url"), F.col("root").alias("root_url"), F.col("depth").alias("tree_depth"), "ring_state", "n_below")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every url outside rings, root first."""
    return _tree(spark, d, True).where("ring_state = 0").select(F.col("name").alias("url"), F.array_join("path", "\n").alias("path"), F.size("path").cast("long").alias("n_path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a url outside rings and a url under it, with the steps between them."""
    steps = _tree(spark, d, True).where("ring_state = 0").select("name", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
    return steps.where("at < n - 1").select("ancestor", F.col("name").alias("url"), (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p5_found, p5_paths, p5_descendants)} | catalog_text.QUERIES | catalog_crawl.QUERIES


_PARENTS = """
first AS (SELECT url, min(result_id) AS id FROM stored_results WHERE url IS NOT NULL GROUP BY url),
par AS (SELECT f.url, nullif(s.metadata.parent_url, '') AS up FROM first f JOIN stored_results s ON s.result_id = f.id),
walk AS (SELECT url, url AS cur, CAST(0 AS BIGINT) AS d, [url] AS seen, false AS ring FROM par
  UNION ALL SELECT w.url, p.up, w.d + 1, list_append(w.seen, p.up), list_contains(w.seen, p.up) FROM walk w JOIN par p ON p.url = w.cur WHERE p.up IS NOT NULL AND NOT w.ring),
fin AS (SELECT url, arg_max(cur, d) AS root, max(d) AS d, bool_or(ring) AS ring, arg_max(seen, d) AS seen FROM walk GROUP BY url),
below AS (SELECT w.cur AS url, count(*) AS n FROM walk w JOIN fin l ON l.url = w.url WHERE NOT l.ring AND w.d > 0 GROUP BY w.cur)
"""


def oracle_sql() -> dict[str, str]:
    return catalog_text.SQL | catalog_crawl.SQL | {
        "p5_found": f"""WITH RECURSIVE {_PARENTS}
            SELECT l.url, CASE WHEN l.ring THEN '' ELSE l.root END AS root_url, CASE WHEN l.ring THEN -1 ELSE l.d END AS tree_depth,
              CAST(CASE WHEN NOT l.ring THEN 0 WHEN l.root = l.url THEN 1 ELSE 2 END AS BIGINT) AS ring_state,
              CASE WHEN l.ring THEN -1 ELSE coalesce(b.n, 0) END AS n_below
            FROM fin l LEFT JOIN below b ON b.url = l.url""",
        "p5_descendants": f"""WITH RECURSIVE {_PARENTS}
            SELECT w.cur AS ancestor, w.url, w.d AS distance FROM walk w JOIN fin l ON l.url = w.url WHERE NOT l.ring AND w.d > 0""",
        "p5_paths": f"""WITH RECURSIVE {_PARENTS}
            SELECT url, array_to_string(list_reverse(seen), chr(10)) AS path, CAST(len(seen) AS BIGINT) AS n_path FROM fin WHERE NOT ring""",
    }
