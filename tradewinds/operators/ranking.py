"""Places within groups that may be too large for one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tradewinds-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` to so many tasks, which Spark doesn't gather into fewer; None leaves it to Spark."""
    return rows.repartition(tasks, *keys) if tasks else rows


def place(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the order of their group.

    Rows are dealt out by ranges over all groups and sorted there, once; a place is that within the range plus what the ranges
    before hold of the group, so no group is one task's. The sorted rows are written with their numbers, as ranges chosen again
    could be others; all else is known by range and group, which is written too, so that it is sent to the rows where it is small.
    """
    numbered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(numbered.withColumn("_range", F.shiftright("_at", 33)))  # below are the rows of a range, numbered from 0
    counts = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    base = written(counts.select(c("_range").alias("_r"), *(c(k).alias(f"_of_{k}") for k in keys), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - c("_first") + 1).alias("_base")))
    same = c("_range") == c("_r")
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_of_{k}"))
    return dealt.join(base, same).select(*rows.columns, (c("_at") + c("_base")).alias(name))
