"""Stored results on disk: JSON lines, JSON, CSV and Parquet, file names, queue snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("word_count", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("links_found", T.ArrayType(T.StringType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("status_code", T.IntegerType()),
                    T.StructField("content_type", T.StringType()),
                    T.StructField("content_length", T.LongType()),
                    T.StructField("response_time_ms", T.LongType()),
                    T.StructField("depth", T.LongType()),
                    T.StructField("parent_url", T.StringType()),
                    T.StructField("crawl_session_id", T.StringType()),
                ]
            ),
        ),
        T.StructField("timestamp", T.StructType([T.StructField("secs_since_epoch", T.LongType()), T.StructField("nanos_since_epoch", T.IntegerType())])),
    ]
)
REQUIRED = ["url", "word_count", "links_found", "metadata.response_time_ms", "metadata.depth", "metadata.crawl_session_id", "timestamp.secs_since_epoch"]


def read_results(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """All results of a folder's .json and .jsonl files, compressed or not. A file holds one result a line, or one object or
    array over many lines: it is read by line, and as a whole if no line of it is a result. What does not parse, or lacks a
    required field, is left out, so session summaries are; other files and subfolders are not read. pattern must occur in
    the path. An empty folder gives no rows."""

    def results(whole: bool) -> DataFrame:
        rows = spark.read.schema(RESULT).option("mode", "DROPMALFORMED").option("multiLine", whole).option("pathGlobFilter", "*.json*").json(folder)
        rows = rows.withColumn("_file", F.col("_metadata.file_path"))
        rows = rows.where(F.col("_file").contains(pattern)) if pattern else rows
        for c in REQUIRED:
            rows = rows.where(F.col(c).isNotNull())
        return rows

    lines = results(False)
    return lines.unionByName(results(True).join(lines.select("_file").distinct(), "_file", "left_anti")).drop("_file")


def write_results(rows: DataFrame, folder: str, kind: str = "jsonl", compressed: bool = False) -> None:
    """kind: jsonl (a result a line; read_results reads it back), csv (quoted, no header) or parquet."""
    out = rows.write.mode("append")
    if compressed:
        out = out.option("compression", "gzip")
    if kind == "jsonl":
        out.json(folder)
    elif kind == "csv":
        csv = csv_rows(rows).write.mode("append").option("header", False).option("quoteAll", True).option("escape", '"')
        (csv.option("compression", "gzip") if compressed else csv).csv(folder)
    elif kind == "parquet":
        out.parquet(folder)
    else:
        raise ValueError(f"unknown kind {kind}")


def csv_rows(rows: DataFrame) -> DataFrame:
    """url, title, words, language, ms, status; null texts are '' and a null status 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("url", text("title").alias("title"), F.col("word_count").alias("words"), text("language").alias("language"), F.col("metadata.response_time_ms").alias("ms"), F.coalesce("metadata.status_code", F.lit(0)).alias("status"))


def file_name(url: Column, at: Column, extension: str = "json") -> Column:
    return F.concat_ws("_", F.lit("crawl"), at.cast("string"), F.concat(F.substring(F.sha2(url, 256), 1, 8), F.lit("." + extension)))


def write_session(summary: DataFrame, folder: str) -> None:
    """A session's summary: one row, one file."""
    summary.coalesce(1).write.mode("append").json(folder)


def save_queue(tasks: DataFrame, folder: str) -> None:
    tasks.write.mode("overwrite").parquet(folder)


def load_queue(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.operators.frontier import recover

    return recover(spark.read.parquet(folder))


def import_queue(tasks: DataFrame, most: int | None) -> DataFrame:
    """A frontier taken over in its order, cut at the largest size."""
    ordered = tasks.orderBy("seq")
    return ordered if most is None else ordered.limit(most)


def export_queue(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("seq")
