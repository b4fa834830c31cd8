"""A knowledge pack: pages of a wiki staged, their redirects followed to the end, and published as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import plain
from .ranking import written

c = F.col


def staged(pages: DataFrame) -> DataFrame:
    """One row for each title, read without case and marks: that fetched last (then of the greater page id). Pages without a
    title are left out; other columns stay as they are."""
    order = W.partitionBy("_title").orderBy(F.desc_nulls_last("fetched_at"), F.desc_nulls_last("pageid"))
    rows = pages.withColumn("_title", plain(c("title"))).where("_title <> ''")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_title")


def followed(redirects: DataFrame) -> DataFrame:
    """(source, target, steps): where each redirect (source, target) ends; a null target if it runs in a circle.

    Pointers are doubled each round, so a chain of n redirects takes about log2 n rounds; rows are joined with themselves by an
    equi-join and written each round, so that nothing is computed twice. Of several targets of one source the least counts;
    nulls are left out, and a source that redirects to itself is a circle.
    """
    start = redirects.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))
    now = written(start.withColumn("steps", F.lit(1).cast("long")))
    longest = now.count()  # a chain that is longer runs in a circle
    while True:
        ahead = now.select(c("source").alias("_s"), c("target").alias("_t"), c("steps").alias("_n"))
        met = now.join(ahead.hint("merge"), c("target") == c("_s"), "left")  # written files look small enough to be broadcast by way of the driver
        now = written(met.select("source", F.coalesce("_t", "target").alias("target"), (c("steps") + F.coalesce("_n", F.lit(0))).alias("steps"), c("_s").isNotNull().alias("_moved")))
        moving = now.where("_moved AND steps <= %d" % longest).limit(1).count()
        circle = c("steps") > longest
        now = now.drop("_moved")
        if not moving:
            return now.select("source", F.when(~circle, c("target")).alias("target"), F.when(~circle, c("steps")).alias("steps"))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is published now."""
    at, files = _files(spark, f"{root}/published/*")
    names = [s.getPath().getName() for s in files.globStatus(at) or []]
    return f"{root}/versions/{max(names).split('-', 1)[1]}" if names else None


def write_version(df: DataFrame, root: str) -> str:
    """Write a version beside the others; nobody reads it until it is published."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{name}")
    return name


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the one that is read: one rename, which fails if another was published meanwhile."""
    done, files = _files(spark, f"{root}/versions/{version}/_SUCCESS")
    if not files.exists(done):
        raise ValueError(f"version {version} isn't written in full")
    at, _ = _files(spark, f"{root}/published/*")
    numbers = [int(s.getPath().getName().split("-")[0]) for s in files.globStatus(at) or []]
    made, _ = _files(spark, f"{root}/staging-{uuid.uuid4().hex}")
    entry, _ = _files(spark, f"{root}/published/{max(numbers, default=0) + 1:012d}-{version}")
    files.mkdirs(made)
    files.mkdirs(entry.getParent())
    if not files.rename(made, entry):
        raise OSError("another version was published meanwhile")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The published version; a reader that has begun goes on with the version that it began with."""
    at = published(spark, root)
    if at is None:
        raise ValueError("nothing is published")
    return spark.read.parquet(at)


def pack(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Staged pages with ``aliases``: the titles that redirect to them, near or far, in order."""
    ends = followed(redirects.select(plain(c("source")).alias("source"), plain(c("target")).alias("target"))).where("target IS NOT NULL")
    found = ends.groupBy(c("target").alias("_t")).agg(F.array_sort(F.collect_set("source")).alias("aliases"))
    rows = staged(pages).withColumn("_title", plain(c("title"))).join(found.hint("merge"), c("_title") == c("_t"), "left")
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("_title", "_t")
