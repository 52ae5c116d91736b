"""Problem 1: lines that one site repeats over many of its pages.

State per source, kept as tables and merged by deltas:
  postings (source, line, url)   each once; what makes the count of *different* urls exact across deltas
  counts   (source, line) -> n   different urls with the line
  pages    (source, url)         urls with some non-blank content
A delta adds the postings not yet there, raises the counts of the lines it touches and moves the sources' totals; lines
whose verdict differs between two states are the crossings, and only documents that hold one are rebuilt.

Sources, lines and urls stand in the state as 64-bit hashes (a line's is salted with its source), so a false match needs
two lines of one source to collide. Null or empty content has no lines; a null url has no host and takes no part;
repeated rows count once for the threshold and each in the result; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import host_of, letters_key, lines_of, not_blank, small_side, staged

MIN_URLS = 3
#: A line must stand on at least one in ONE_IN of the source's urls (5 %).
ONE_IN = 20


@dataclass(frozen=True)
class LineState:
    postings: DataFrame
    counts: DataFrame
    pages: DataFrame

    def verdicts(self, min_urls: int = MIN_URLS, one_in: int = ONE_IN) -> DataFrame:
        """(source, line) of the lines repeated excessively now."""
        totals = self.pages.groupBy("source").agg(F.count("*").alias("urls"))
        return self.counts.where(F.col("n") >= min_urls).join(totals, "source").where(F.col("n") * one_in >= F.col("urls")).select("source", "line")


def _base(rows: DataFrame) -> DataFrame:
    ok = rows.where("url is not null and content is not null").where(not_blank(F.col("content")))
    return ok.withColumn("_host", host_of(F.col("url"))).withColumn("_source", F.xxhash64("_host"))


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per line with letters: keep..., line_no, source, line."""
    each = _base(rows).select(*keep, "_host", "_source", F.posexplode(lines_of(F.col("content"))).alias("line_no", "_text"))
    key = each.withColumn("_key", letters_key(F.col("_text"))).where("_key <> ''")
    return key.select(*keep, F.col("line_no").cast("long").alias("line_no"), F.col("_source").alias("source"), F.xxhash64("_key", "_host").alias("line"))


def first_state(rows: DataFrame) -> LineState:
    postings = staged(exploded(rows, "url").select("source", "line", F.xxhash64("url").alias("url")).distinct(), "postings")
    counts = staged(postings.groupBy("source", "line").agg(F.count("*").alias("n")), "counts")
    pages = staged(_base(rows).select(F.col("_source").alias("source"), F.xxhash64("url").alias("url")).distinct(), "pages")
    return LineState(postings, counts, pages)


def merged(state: LineState, delta: DataFrame) -> LineState:
    """The state with the rows of delta; rows and urls it has already do not count again."""
    d = first_state(delta)
    new = staged(d.postings.join(state.postings, ["source", "line", "url"], "left_anti"), "postings")
    raised = new.groupBy("source", "line").agg(F.count("*").alias("n"))
    counts = staged(state.counts.unionByName(raised).groupBy("source", "line").agg(F.sum("n").alias("n")), "counts")
    pages = staged(state.pages.unionByName(d.pages).distinct(), "pages")
    return LineState(state.postings.unionByName(new), counts, pages)


def crossings(old: LineState, new: LineState) -> DataFrame:
    """(source, line, now): lines whose verdict changed; now is 1 if newly repeated, 0 if no longer."""
    a, b = old.verdicts(), new.verdicts()
    gained = b.join(a, ["source", "line"], "left_anti").withColumn("now", F.lit(1))
    return gained.unionByName(a.join(b, ["source", "line"], "left_anti").withColumn("now", F.lit(0)))


def repeated_lines(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """result_id, line_no of every line that a verdict names."""
    bad = small_side(staged(verdicts, "verdicts"))
    return exploded(rows, "result_id").join(bad, ["source", "line"], "left_semi").select("result_id", "line_no")


def cleaned(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """result_id and content without the lines named; rows that hold none keep their content, null stays null."""
    drop = repeated_lines(rows, verdicts).groupBy("result_id").agg(F.collect_set("line_no").alias("drop"))
    base = rows.select("result_id", "content")
    kept = F.array_join(F.filter(lines_of(F.col("content")), lambda x, i: ~F.array_contains(F.col("drop"), i.cast("long"))), "\n")
    return base.join(drop, "result_id", "left").select("result_id", F.when(F.col("drop").isNull(), F.col("content")).otherwise(kept).alias("content"))


def rebuilt(rows: DataFrame, old: LineState, new: LineState) -> DataFrame:
    """cleaned() for only those rows that hold a line whose verdict changed."""
    changed = small_side(staged(crossings(old, new).select("source", "line"), "crossed"))
    touched = exploded(rows, "result_id").join(changed, ["source", "line"], "left_semi").select("result_id").distinct()
    return cleaned(rows.join(touched, "result_id", "left_semi"), new.verdicts())
