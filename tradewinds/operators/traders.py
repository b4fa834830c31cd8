"""Trader profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, scores
from .ranking import dealt

c = F.col
SORTS = {
    "offers": ["-offers"], "activity": ["-activity"], "reliability": ["-reliability"], "markets": ["-markets"], "buys": ["-buys"], "sells": ["-sells"], "recent": ["-last_posted"],
}


def directory(offers: DataFrame) -> DataFrame:
    """Ten aggregates and three scores per trader."""
    rows = offers.where("player IS NOT NULL AND trim(player) <> ''").withColumn("market", exprs.market())
    found = rows.groupBy("player").agg(
        F.count("*").alias("offers"), F.count_distinct("message_id").alias("messages"), F.count_distinct(exprs.blank_to_null(c("market"))).alias("markets"), F.count_if(c("trade_type") == "buy").alias("buys"),
        F.count_if(c("trade_type") == "sell").alias("sells"), F.count("unit_price").alias("priced"), F.count_if(c("lifecycle_status") == "active").alias("active"),
        F.sum(F.round(c("confidence") * 100).cast("long")).alias("_conf"), F.min("posted_at").alias("first_posted"), F.max("posted_at").alias("last_posted"),
    )
    mean = c("_conf") / 100.0 / c("offers")
    return found.select(
        "player", "offers", "messages", "markets", "buys", "sells", "priced", "active", "first_posted", "last_posted", scores.activity(c("offers"), c("markets"), c("priced")).alias("activity"),
        scores.reliability(mean, c("priced"), c("offers")).alias("reliability"), scores.side_label(c("buys"), c("offers")).alias("side"),
    )


def search(offers: DataFrame, query: str = "", sort: str = "offers", limit: int = 100) -> DataFrame:
    order = [F.desc(x[1:]) for x in SORTS.get(sort, SORTS["offers"])]
    found = directory(offers)
    return (found.where(exprs.matches(query, "player")) if query else found).orderBy(*order, "player").limit(exprs.clamp_limit(limit, 500))


def top_markets(offers: DataFrame, most: int = 3, tasks: int | None = None) -> DataFrame:
    """The markets that each trader lists most in, whatever became of the offers."""
    from pyspark.sql import Window as W

    rows = offers.select("player", exprs.market().alias("market"), "posted_at").where("market IS NOT NULL")
    rows = dealt(rows, tasks, "player", "market").groupBy("player", "market").agg(F.count("*").alias("offers"), F.max("posted_at").alias("last_posted"))
    place = F.row_number().over(W.partitionBy("player").orderBy(F.desc("offers"), F.desc("last_posted"), "market"))
    return dealt(rows, tasks, "player").withColumn("place", place).where(c("place") <= most)


def counts(offers: DataFrame, as_of: str) -> DataFrame:
    recent = c("posted_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL 30 DAYS")
    return offers.agg(
        F.count_distinct("player").alias("traders"), F.count_distinct(F.when(recent, c("player"))).alias("recent_traders"),
        F.count_distinct(F.when(c("trade_type") == "buy", c("player"))).alias("buyers"), F.count_distinct(F.when(c("trade_type") == "sell", c("player"))).alias("sellers"),
    )
