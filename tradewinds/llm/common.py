"""Helpers shared by the corpus operators: cutting lineage, sizing joins, joins on uneven keys, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast; beyond, Spark shuffles it.
BROADCAST_ROWS = 50_000
#: A key is frequent if it has more than this part of all rows; so there are at most this many, which are broadcast.
FREQUENT = 20_000
#: Folders written within the present scopes, innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a session without one gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tradewinds-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that :func:`materialize` wrote."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is materialized within, but for what is taken out of the list that this gives."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        discard(spark, *_SCOPES.pop())


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``rows`` rows; else left for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_uneven(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each ``key`` and how many of the ``total`` rows hold it.

    Keys with more than 1 / FREQUENT of all rows are joined by broadcast (they are fewer than FREQUENT), so that no task
    gathers the rows of one; the others by a shuffle.
    """
    often = F.col(n) > total / FREQUENT
    frequent = F.broadcast(keyed.where(often).drop(n))
    rare = rows.join(frequent.select(key), key, "left_anti").join(keyed.where(~often).drop(n), key)
    return rows.join(frequent, key).unionByName(rare)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) in the order of columns that differ between rows.

    Rows are dealt out by ranges; sums run within a range, and start from those of the ranges before.
    """
    spark = df.sparkSession
    dealt = df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "running")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    totals = dealt.groupBy("_range").agg(*(F.sum(f"_{k}").alias(k) for k in sums))
    base = totals.select(F.col("_range"), *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_base_{k}") for k in sums))
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.withColumns({k: F.sum(f"_{k}").over(within) for k in sums}).join(F.broadcast(base), "_range")
    return out.select(*df.columns, *((F.col(k) + F.col(f"_base_{k}")).alias(k) for k in sums))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
