"""The driver's tables as a market: order lines are offers, orders messages, customers traders, parts items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import dealt

#: The moment that age and windows are counted from; never the clock.
AS_OF, EVENTS_AS_OF = "2001-08-01 00:00:00", "2024-01-31 00:00:00"
#: Rows for one task where tables meet; a table of no more than FEW_TASKS times as many may be broadcast and is left to Spark.
TASK_ROWS, FEW_TASKS = 500_000, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int | None:
    """How many tasks a table's rows are dealt out to, so that one has about TASK_ROWS however large it is; None leaves it to Spark."""
    n = table(spark, sf_dir, name).count() // TASK_ROWS  # read from the files' footers
    return max(n, spark.sparkContext.defaultParallelism) if n > FEW_TASKS else None


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, with every status that the operators distinguish."""
    t = lambda name: table(spark, sf_dir, name)
    wide = tasks(spark, sf_dir)
    large = lambda name: wide and tasks(spark, sf_dir, name)
    # customers meet the orders, not the many lines; the lines come last to their order, so a message's rows are already together
    ordered = dealt(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), large("customer") and large("orders"), "o_custkey")
    ordered = ordered.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    lines = dealt(t("lineitem"), large("part") and wide, "l_partkey")
    lines = lines.join(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    lines = dealt(lines, large("orders") and wide, "l_orderkey").join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return lines.select(
        F.md5(F.concat_ws("|", *key, cents.cast("string"), F.col("l_quantity").cast("long").cast("string"))).alias("offer_id"),
        F.col("o_orderkey").alias("message_id"), F.col("c_name").alias("player"), F.col("o_orderdate").alias("posted_at"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'N' THEN 'sell' ELSE 'trade' END").alias("trade_type"),
        F.col("p_brand").alias("item"), F.expr("lower(replace(p_brand, '#', '_'))").alias("item_key"),
        F.expr("CASE WHEN l_suppkey % 17 = 0 AND l_partkey % 2 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '_')) || ':' || p_type END").alias("market_key"),
        F.expr("CASE l_suppkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(replace(p_brand, '#', '_')) || '|q:' || cast(p_size as string) END").alias("normalized_market_key"),
        F.col("p_size").alias("requirement"), F.expr("CASE WHEN l_partkey % 3 = 0 THEN lower(p_type) ELSE '' END").alias("attribute_key"),
        F.expr("l_partkey % 5 = 0").alias("is_oldschool"), F.expr("l_partkey % 7 = 0").alias("is_inscribable"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price_amount"),
        F.expr("CASE l_orderkey % 11 WHEN 0 THEN 'a' WHEN 1 THEN 'k' WHEN 2 THEN NULL ELSE 'e' END").alias("price_currency"),
        F.expr("CASE WHEN l_orderkey % 11 = 2 THEN NULL ELSE l_extendedprice / l_quantity END").alias("unit_price"),
        F.expr("CASE l_orderkey % 13 WHEN 0 THEN 'stack' WHEN 1 THEN 'exchange' WHEN 2 THEN 'unknown' WHEN 3 THEN 'total' WHEN 4 THEN 'uncertain' ELSE 'each' END").alias("price_basis"),
        F.expr("CASE l_partkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'review' WHEN 2 THEN NULL ELSE 'accepted' END").alias("quality_status"),
        F.expr("(50 + l_suppkey % 50) / 100.0D").alias("confidence"), F.col("p_name").alias("raw_segment"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'active' WHEN l_linenumber % 3 = 0 THEN 'superseded' WHEN l_linenumber % 3 = 1 THEN 'expired' ELSE 'active' END").alias("lifecycle_status"),
        F.expr("CASE l_suppkey % 19 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'outlier' WHEN 2 THEN NULL ELSE 'trusted' END").alias("price_quality_status"),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, player, message, posted_at): trade messages written from order lines."""
    return offers(spark, sf_dir).select(
        "offer_id", "message_id", "player", "posted_at",
        F.concat(
            F.expr("CASE trade_type WHEN 'buy' THEN 'WTB ' WHEN 'sell' THEN 'WTS ' ELSE 'WTT ' END"), F.col("raw_segment"), F.lit(" q"), F.col("requirement").cast("string"),
            F.when(F.col("is_oldschool"), F.lit(" OS")).otherwise(F.lit("")), F.when(F.col("is_inscribable"), F.lit(" insc")).otherwise(F.lit("")), F.lit(" "),
            F.col("quantity").cast("int").cast("string"), F.expr("CASE cast(quantity as int) % 4 WHEN 0 THEN '/' WHEN 1 THEN ':' WHEN 2 THEN '=' ELSE ' for ' END"),
            F.floor("price_amount").cast("string"), F.expr("CASE requirement % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'e' ELSE 'k' END"),
        ).alias("message"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as offers: user is player, value price, props.k modulo 20 the item."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("player"), F.col("ts").alias("posted_at"),
        F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'buy' WHEN event_type IN ('signup', 'purchase') THEN 'sell' ELSE 'trade' END").alias("trade_type"),
        F.concat(F.lit("item_"), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("item_key"), F.col("value").alias("unit_price"),
    )
