"""Parsing again: all messages, or only those that a change of the rules can touch, with the same result.

Offers lie in partitions by a hash of their message, markets in partitions by a hash of their key. A targeted run parses the
candidates, finds the messages whose offers differ and the markets that these had or have, and replaces only the partitions
that hold one of them; the files of all others stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
Step = Callable[[DataFrame], DataFrame]
#: Partitions of a table at most; their numbers are all that the driver gets.
PARTS = 64


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, files = _at(spark, path)
        files.delete(at, True)


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Targeted runs that wrote what they touch and weren't finished."""
    found, files = _at(spark, f"{path}/run-*-moved/_SUCCESS")
    return [str(s.getPath().getParent()).removesuffix("-moved") for s in files.globStatus(found) or []]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of this module; one that isn't there is empty."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return spark.createDataFrame([], f"{schema}, part int")
    return spark.read.schema(f"{schema}, part int").parquet(path)


def full(messages: DataFrame, parse: Step, summarise: Step, path: str) -> None:
    """Parse every message and write both tables anew. ``parse`` gives message_id, market and more; ``summarise`` a row a market."""
    parse(messages).withColumn("part", part_of(c("message_id"))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/offers")
    offers = messages.sparkSession.read.parquet(f"{path}/offers")
    summarise(offers.drop("part")).withColumn("part", part_of(c("market"))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/markets")


def changed_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(message_id): messages whose offers differ, in any column or number."""
    columns = [x for x in new.columns if x != "part"]
    signed = lambda df, side: df.select("message_id", F.xxhash64(*columns, *(F.isnull(x) for x in columns)).alias("_h"), F.lit(side).alias("_n"))
    each = signed(old.select(columns), -1).unionByName(signed(new.select(columns), 1)).groupBy("message_id", "_h").agg(F.sum("_n").alias("_n"))
    return each.where("_n <> 0").select("message_id").distinct()


def targeted(messages: DataFrame, candidates: DataFrame, parse: Step, summarise: Step, path: str, offer_schema: str, market_schema: str) -> dict[str, list[int]]:
    """Parse the ``candidates`` (message_id) again; returns the numbers of the partitions replaced in each table.

    Messages that aren't candidates keep their offers. A candidate that no longer is a message loses them. Running it again
    changes nothing. The new offers, and which messages and markets they touch, are written beside the tables before any
    partition is replaced; a run that was broken off is found by that, and the next one finishes its markets too.
    """
    spark = messages.sparkSession
    table, markets, run = f"{path}/offers", f"{path}/markets", uuid.uuid4().hex
    fresh_at, moved_at, unfinished = f"{path}/run-{run}-fresh", f"{path}/run-{run}-moved", _runs(spark, path)
    wanted = candidates.select("message_id").distinct()
    parse(messages.join(wanted, "message_id", "left_semi")).withColumn("part", part_of(c("message_id"))).write.mode("overwrite").parquet(fresh_at)
    fresh, stored = read(spark, fresh_at, offer_schema), read(spark, table, offer_schema)
    before = stored.join(wanted, "message_id", "left_semi")
    moved = changed_messages(before, fresh)
    touched = stored.select("message_id", "market").unionByName(fresh.select("message_id", "market")).join(moved, "message_id", "left_semi")
    touched.select("message_id", "market", part_of(c("message_id")).alias("offer_part"), part_of(c("market")).alias("market_part")).distinct().write.parquet(moved_at)
    touched = spark.read.parquet(moved_at, *(f"{at}-moved" for at in unfinished))
    parts = {k: sorted(r[0] for r in touched.select(f"{k}_part").distinct().collect()) for k in ("offer", "market")}
    made = [f"{at}-{kind}" for at in (f"{path}/run-{run}", *unfinished) for kind in ("fresh", "moved")]
    if not parts["offer"]:
        _delete(spark, *made)
        return {"offers": [], "markets": []}
    ids = touched.select("message_id").distinct().join(wanted, "message_id", "left_semi")
    columns = stored.columns
    rows = stored.where(c("part").isin(parts["offer"])).join(ids, "message_id", "left_anti").select(columns).unionByName(fresh.join(ids, "message_id", "left_semi").select(columns))
    _replace(spark, rows, table, parts["offer"])
    spark.catalog.refreshByPath(table)
    keys = touched.select(c("market").alias("_key")).distinct()
    again = summarise(read(spark, table, offer_schema).drop("part").join(keys, c("market").eqNullSafe(c("_key")), "left_semi")).withColumn("part", part_of(c("market")))
    old = read(spark, markets, market_schema)
    kept = old.where(c("part").isin(parts["market"])).join(keys, c("market").eqNullSafe(c("_key")), "left_anti")
    _replace(spark, kept.unionByName(again.select(kept.columns)), markets, parts["market"])
    spark.catalog.refreshByPath(markets)
    _delete(spark, *made)
    return {"offers": parts["offer"], "markets": parts["market"]}


def _replace(spark: SparkSession, rows: DataFrame, path: str, parts: list[int]) -> None:
    """Put ``rows`` in the place of the partitions; those without rows any more are deleted."""
    filled = {r[0] for r in rows.select("part").distinct().collect()}
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    _delete(spark, *(f"{path}/part={p}" for p in parts if p not in filled))
