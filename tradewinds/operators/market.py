"""Counters, directories, summaries and order books over offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs
from . import ranking

c = F.col


def _when(side: str, x: Column | None = None) -> Column:
    return F.when(c("trade_type") == side, exprs.shown_price() if x is None else x)


def counters(offers: DataFrame) -> DataFrame:
    """All counters in one aggregate."""
    return offers.agg(
        F.count("*").alias("offers"), F.count_distinct("message_id").alias("messages"), F.count_distinct("player").alias("players"), F.count("unit_price").alias("priced"),
        F.count_if(c("quality_status") == "accepted").alias("accepted"), F.count_if(F.coalesce(c("quality_status"), F.lit("review")) == "review").alias("review"), F.max("posted_at").alias("last_posted"),
    )


def item_directory(offers: DataFrame) -> DataFrame:
    """Per item (case-insensitive): counts by side, averages of trusted prices, last activity."""
    return offers.groupBy(F.lower("item").alias("item_norm")).agg(
        F.min("item").alias("item"), F.min("item_key").alias("item_key"), F.count("*").alias("offers"), F.count_if(c("trade_type") == "buy").alias("buys"),
        F.count_if(c("trade_type") == "sell").alias("sells"), F.round(F.avg(_when("buy")), 0).alias("avg_buy"), F.round(F.avg(_when("sell")), 0).alias("avg_sell"), F.max("posted_at").alias("last_posted"),
    )


def item_summary(offers: DataFrame) -> DataFrame:
    """Thirteen conditional aggregates per item."""
    active = c("lifecycle_status") == "active"
    return offers.groupBy("item").agg(
        F.count("*").alias("offers"), F.count_distinct("player").alias("traders"), F.count_distinct("message_id").alias("messages"), F.count_if(active).alias("active"),
        F.count_if(active & (c("trade_type") == "buy")).alias("active_buys"), F.count_if(active & (c("trade_type") == "sell")).alias("active_sells"), F.count_if(exprs.trusted_price()).alias("trusted"),
        F.min(_when("sell")).alias("lowest_sell"), F.max(_when("buy")).alias("highest_buy"), F.min("unit_price").alias("lowest"), F.max("unit_price").alias("highest"),
        F.min("posted_at").alias("first_posted"), F.max("posted_at").alias("last_posted"),
    )


def variants(offers: DataFrame) -> DataFrame:
    return offers.groupBy("item", exprs.variant().alias("variant")).agg(F.count("*").alias("offers"), F.median(exprs.shown_price()).alias("median_price"), F.max("posted_at").alias("last_posted"))


def item_analytics(offers: DataFrame, newest: int = 100) -> DataFrame:
    """Medians, extremes and spread over the ``newest`` offers of each item."""
    order = W.partitionBy("item").orderBy(F.desc("posted_at"), F.desc("offer_id"))
    rows = offers.withColumn("_n", F.row_number().over(order)).where(c("_n") <= newest)
    return rows.groupBy("item").agg(
        F.count("*").alias("points"), F.count_distinct("player").alias("traders"), F.median(_when("buy")).alias("median_buy"), F.median(_when("sell")).alias("median_sell"),
        F.min(_when("sell")).alias("lowest_sell"), F.max(_when("buy")).alias("highest_buy"),
    ).withColumn("spread", c("median_buy") - c("median_sell"))


def active_markets(offers: DataFrame) -> DataFrame:
    """Markets with active, not rejected offers (a missing quality counts as accepted)."""
    rows = offers.where("lifecycle_status = 'active' AND coalesce(quality_status, 'accepted') = 'accepted'").withColumn("market", exprs.market()).where("market IS NOT NULL")
    return rows.groupBy("market").agg(F.count("*").alias("offers"), F.count_distinct("player").alias("traders"), F.min("item").alias("item"), F.max("posted_at").alias("last_posted"))


def market_summary(offers: DataFrame) -> DataFrame:
    """Best and median of each side of every market, in one plan for all markets."""
    rows = offers.where("lifecycle_status = 'active' AND coalesce(quality_status, 'accepted') = 'accepted' AND unit_price > 0").withColumn("market", exprs.market()).where("market IS NOT NULL")
    p = c("unit_price")
    return rows.groupBy("market").agg(
        F.max(_when("buy", p)).alias("best_wtb"), F.median(_when("buy", p)).alias("median_wtb"), F.min(_when("sell", p)).alias("best_wts"), F.median(_when("sell", p)).alias("median_wts"),
        F.count("*").alias("active_offers"), F.count_distinct("player").alias("unique_traders"),
    )


def structured_directory(offers: DataFrame) -> DataFrame:
    """Per market: sides, medians and the dominant price basis (ties: the least)."""
    rows = offers.withColumn("market", exprs.market()).where("market IS NOT NULL")
    sums = rows.groupBy("market").agg(F.count("*").alias("offers"), F.median(_when("buy")).alias("median_buy"), F.median(_when("sell")).alias("median_sell"), F.min("item").alias("item"))
    bases = rows.groupBy("market", "price_basis").agg(F.count("*").alias("n")).groupBy("market").agg(F.min_by("price_basis", F.struct(-c("n"), "price_basis")).alias("dominant_basis"))
    return sums.join(bases, "market")


def biggest_spreads(offers: DataFrame, limit: int = 50) -> DataFrame:
    found = structured_directory(offers).select("market", "median_buy", "median_sell", (c("median_buy") - c("median_sell")).alias("spread")).where("spread > 0")
    return found.orderBy(F.desc("spread"), "market").limit(exprs.clamp_limit(limit, 250))


def histogram(offers: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """How often each value of ``domain`` occurs, zeros included."""
    known = offers.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return known.join(offers.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _book(offers: DataFrame) -> tuple[DataFrame, list[Column]]:
    rows = offers.where("lifecycle_status = 'active' AND trade_type IN ('buy', 'sell')").withColumn("price", exprs.shown_price())
    signed = F.when(c("trade_type") == "buy", -c("price")).otherwise(c("price"))
    return rows.select("item", "trade_type", "offer_id", "player", "price", "posted_at"), [F.asc_nulls_last(signed), F.desc("posted_at"), F.asc("offer_id")]


def order_book(offers: DataFrame, top: int | None = None) -> DataFrame:
    """Active offers of every item, ranked on their side: priced first, purchases dear to cheap, sales cheap to dear.

    With ``top`` only so many of each side; Spark then drops others before they are shuffled. The whole book is sorted by ranges
    over all items, so no side is one task's.
    """
    rows, order = _book(offers)
    side = ["item", "trade_type"]
    if top is not None:
        ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(*side).orderBy(*order))).where(c("place") <= top)
        return ranked.drop("posted_at")
    return ranking.place(rows, side, order).select(*side, "offer_id", "player", "price", c("place").cast("int").alias("place"))


def best_offers(offers: DataFrame) -> DataFrame:
    return order_book(offers, 1).where("price IS NOT NULL").drop("place")


def structured_summary(offers: DataFrame) -> DataFrame:
    return offers.agg(F.count("*").alias("total"), F.count_if(c("quality_status") == "accepted").alias("accepted"), F.count_if(c("quality_status") == "review").alias("review"), F.count_distinct("market_key").alias("markets"), F.count_distinct("message_id").alias("parsed_messages"))


def structured_markets(offers: DataFrame, limit: int = 100) -> DataFrame:
    """The markets with most accepted offers, with their sides."""
    found = offers.where("quality_status = 'accepted'").groupBy("market_key").agg(
        F.min("item").alias("item"), F.count("*").alias("samples"), F.count_if(c("trade_type") == "buy").alias("buys"), F.count_if(c("trade_type") == "sell").alias("sells")
    )
    return found.orderBy(F.desc("samples"), F.asc_nulls_first("market_key")).limit(exprs.clamp_limit(limit, 500))


def canonical_spelling(names: DataFrame, column: str) -> DataFrame:
    """For each spelling without regard to case: the most frequent, then the longest, then the first."""
    counted = names.groupBy(F.lower(F.trim(column)).alias("norm"), c(column).alias("name")).agg(F.count("*").alias("n"))
    return counted.groupBy("norm").agg(F.min_by("name", F.struct(-c("n"), -F.length("name"), "name")).alias("name"), F.sum("n").alias("n"))


def page_after(rows: DataFrame, key: str, cursor: str, size: int) -> DataFrame:
    """Keyset paging: the next ``size`` rows after ``cursor``."""
    return rows.where(c(key) > cursor).orderBy(key).limit(exprs.clamp_limit(size, 5000))


def page_at(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(exprs.clamp_limit(size, 1000))


def latest_listings(offers: DataFrame) -> DataFrame:
    """The newest listing of each trader, side and variant of an item."""
    order = W.partitionBy(F.lower(F.trim("player")), "trade_type", "item", exprs.variant()).orderBy(F.desc("posted_at"), F.desc("offer_id"))
    return offers.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("offer_id", "player", "trade_type", "item", "posted_at")
