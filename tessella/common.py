"""Helpers shared by all operators: tables, staging, size-checked broadcast, hosts and lines."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown that it has at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000

_OWN_DIRS: list[str] = []


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(**fields: Column) -> Column:
    """A struct with the given names; inside lambdas, aliases of fields are lost."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where that is unset, a temporary one if the
    session is local, so that its executors have it too; an error on a cluster, where no folder of this machine will do."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIRS:
            _OWN_DIRS.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
            atexit.register(_drop_own)
        given = _OWN_DIRS[0]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(given)
    return given


def _drop_own() -> None:
    import shutil

    for d in _OWN_DIRS:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tessella", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast only if it is counted to be within limit; beyond that Spark shuffles it."""
    return F.broadcast(df) if df.count() <= limit else df


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a leading www.; '' where there is none."""
    raw = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(raw, r"^www\.", ""), F.lit(""))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def letters_key(line: Column) -> Column:
    """What is compared of a line: its letters, in lower case."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
