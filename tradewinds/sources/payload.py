"""Reading chat payloads and catalogs, and writing results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import written

c = F.col
_ENTRY = "array<struct<m:string,message:string,s:string,player:string,t:string,h:string>>"


def sane_timestamp(value: Column, fallback: Column) -> Column:
    """Epoch seconds, milliseconds or finer, or an ISO time, from 2000 to 2100; else ``fallback``."""
    number = value.try_cast("double")
    for _ in range(3):
        number = F.when(number > 2e10, number / 1000).otherwise(number)
    epoch = F.when((number > 946684800) & (number < 4102444800), F.timestamp_seconds(number))
    iso = F.when(value.rlike(r"^20\d\d-[01]\d-[0-3]\d"), value.try_cast("timestamp"))
    return F.coalesce(epoch, iso, fallback)


def messages(payloads: DataFrame, column: str, collected_at: Column, source: str = "chat") -> DataFrame:
    """Messages of JSON payloads: a list, or an object with a list under ``messages`` or ``results``."""
    body = c(column)
    entries = F.coalesce(F.from_json(F.get_json_object(body, "$.messages"), _ENTRY), F.from_json(F.get_json_object(body, "$.results"), _ENTRY), F.from_json(body, _ENTRY))
    rows = payloads.select(F.explode(entries).alias("e"), collected_at.alias("collected_at"))
    message, player = F.trim(F.coalesce("e.m", "e.message")), F.trim(F.coalesce("e.s", "e.player", F.lit("")))
    key = F.coalesce("e.h", F.sha2(F.concat_ws("|", player, message, F.coalesce("e.t", F.lit(""))), 256))
    rows = rows.select(F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), key).alias("source_key"), player.alias("player"), message.alias("message"), sane_timestamp(c("e.t"), c("collected_at")).alias("posted_at"), "collected_at")
    return rows.where("message IS NOT NULL AND message <> ''")


def new_messages(found: DataFrame, known: DataFrame) -> DataFrame:
    """Messages whose source key is neither known nor repeated."""
    return found.dropDuplicates(["source_key"]).join(known.select("source_key"), "source_key", "left_anti")


def rows_of(body: Column, schema: str) -> Column:
    """The list in an import: under items, data, results or catalog, or the document itself."""
    kind = f"array<{schema}>"
    probes = [F.from_json(F.get_json_object(body, f"$.{k}"), kind) for k in ("items", "data", "results", "catalog")]
    return F.coalesce(*probes, F.from_json(body, kind))


def flat_catalog(bodies: DataFrame, column: str) -> DataFrame:
    """(type, name, aliases) of catalogs whose groups are {type, items: [...]}."""
    group = "struct<type:string,items:array<struct<name:string,aliases:array<string>>>>"
    rows = bodies.select(F.explode(rows_of(c(column), group)).alias("g")).select("g.type", F.explode("g.items").alias("i"))
    return rows.select("type", "i.name", F.coalesce("i.aliases", F.array().cast("array<string>")).alias("aliases"))


#: Where a group of a catalog keeps its members.
MEMBERS = ("items", "groups", "children", "data", "results", "catalog")


def nested_catalog(bodies: DataFrame, column: str) -> DataFrame:
    """(type, name, aliases) of catalogs whose groups hold groups, however deep.

    A list's elements are its members; an object with a list under one of ``MEMBERS`` is a group, whose ``type`` its members have
    unless they say another; an object with a name is an item, and so is a text within a list. Anything else, and what is no
    JSON, is passed over. Groups are opened level by level until none is left; each level is written, so that a document is
    parsed once, whatever its depth.
    """
    level = bodies.select(F.lit(None).cast("string").alias("type"), F.try_parse_json(c(column)).alias("v")).where("v IS NOT NULL")
    level, items, depth = written(level), [], 0
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    while level.limit(1).count():
        own = F.coalesce(get("$.type"), c("type"))
        lists = F.coalesce(*(F.try_variant_get("v", f"$.{m}", "array<variant>") for m in MEMBERS), F.try_variant_get("v", "$", "array<variant>"))
        opened = level.select(own.alias("type"), "v", lists.alias("_members"))
        name = F.coalesce(get("$.name"), F.when(F.schema_of_variant("v") == "STRING", get("$")) if depth else F.lit(None).cast("string"))
        found = opened.where(c("_members").isNull()).select("type", F.trim(name).alias("name"), F.coalesce(get("$.aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"))
        items.append(found.where("name <> ''"))
        level, depth = written(opened.select("type", F.explode("_members").alias("v")).where("v IS NOT NULL")), depth + 1
    none = bodies.sparkSession.createDataFrame([], "type string, name string, aliases array<string>")
    return reduce(DataFrame.unionByName, items, none)


def write_training_set(messages_: DataFrame, offers: DataFrame, path: str) -> None:
    """NDJSON of every message with its offers."""
    own = offers.groupBy("message_id").agg(F.collect_list(F.struct("trade_type", "item", "requirement", "price_amount", "price_currency")).alias("offers"))
    messages_.join(own, messages_["id"] == own["message_id"], "left").drop("message_id").write.mode("overwrite").json(path)


def append_snapshot(summary: DataFrame, captured_at: str, path: str) -> None:
    """Add one snapshot to a table partitioned by its time; the same capture again takes the place of the former."""
    at = F.lit(captured_at).cast("timestamp_ntz")
    rows = summary.withColumn("captured_at", at).withColumn("capture", F.date_format(at, "yyyyMMddHHmmss"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A full refresh, also from the table itself: the new rows are written beside it and then put in its place."""
    spark = df.sparkSession
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(new), at(path))
    files.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): the JSON files of a folder, whole (catalogs, modifiers, reject patterns, taxonomies)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), c("value").alias("body"))
