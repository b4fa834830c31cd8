"""Market intelligence: best and median prices, spread, liquidity, confidence and deals per market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAX_PRICE
from ..functions import exprs, scores

c = F.col


def latest_per_trader(offers: DataFrame) -> DataFrame:
    """Accepted buy and sell offers with their ``market``, the newest of each trader, side and market."""
    rows = offers.withColumn("market", exprs.intelligence_market()).where("market IS NOT NULL AND coalesce(quality_status, 'review') = 'accepted' AND trade_type IN ('buy', 'sell')")
    trader = F.coalesce(exprs.blank_to_null(F.lower("player")), F.concat(F.lit("message:"), c("message_id").cast("string")))
    newest = W.partitionBy("market", "trade_type", "trader").orderBy(F.desc("message_id"), F.desc("offer_id"))
    return rows.withColumn("trader", trader).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def intelligence(offers: DataFrame) -> DataFrame:
    """One row per market. Prices far outside the quartiles of their side are trimmed where it has five or more."""
    rows = latest_per_trader(offers).withColumn("p", F.when((c("unit_price") > 0) & (c("unit_price") <= MAX_PRICE), c("unit_price")))
    # quartiles are grouped and joined back: as windows they would put all of a large market's side into one task
    quartiles = rows.groupBy(c("market").alias("_m"), c("trade_type").alias("_t")).agg(F.count("p").alias("_n"), F.percentile("p", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    rows = rows.join(quartiles, (c("market") == c("_m")) & (c("trade_type") == c("_t"))).withColumn("_q1", c("_q")[0]).withColumn("_q3", c("_q")[1]).withColumn("_iqr", c("_q3") - c("_q1"))
    inside = c("p").between(F.greatest(F.lit(0.0), c("_q1") - 1.5 * c("_iqr")), c("_q3") + 1.5 * c("_iqr"))
    rows = rows.withColumn("p", F.when((c("_n") < 5) | (c("_iqr") <= 0) | inside, c("p")))
    of = lambda s: F.when(c("trade_type") == s, c("p"))
    newest = F.struct("message_id", "offer_id")
    found = rows.groupBy("market").agg(
        F.max_by("item", newest).alias("item"), F.max(of("buy")).alias("best_wtb"), F.min(of("sell")).alias("best_wts"), F.min(of("buy")).alias("_lb"), F.max(of("sell")).alias("_hs"),
        F.median(of("buy")).alias("median_wtb"), F.median(of("sell")).alias("median_wts"), F.count(of("buy")).alias("_nb"), F.count(of("sell")).alias("_ns"),
        F.count_if(c("trade_type") == "buy").alias("buyers"), F.count("*").alias("total"), F.count_distinct(exprs.blank_to_null(F.lower("player"))).alias("traders"),
        F.max("posted_at").alias("last_activity"),
    )
    penalty = scores.spread_penalty(c("_lb"), c("best_wtb"), c("median_wtb"), c("_nb")) + scores.spread_penalty(c("best_wts"), c("_hs"), c("median_wts"), c("_ns"))
    found = found.withColumn("spread", c("best_wtb") - c("best_wts")).withColumn("liquidity_score", scores.liquidity(c("traders"), c("total")))
    found = found.withColumn("demand_score", scores.demand(c("buyers"), c("total")))
    found = found.withColumn("confidence_score", scores.confidence(c("_nb") + c("_ns"), c("traders"), penalty, (c("_nb") > 0) & (c("_ns") > 0)))
    found = found.withColumn("deal_score", F.coalesce(scores.deal_score(c("best_wtb"), c("best_wts"), c("confidence_score"), c("liquidity_score")), F.lit(0)))
    return found.select(
        "market", "item", "best_wtb", "median_wtb", "best_wts", "median_wts", "spread", "buyers", (c("total") - c("buyers")).alias("sellers"), "traders", "last_activity",
        "liquidity_score", "demand_score", "confidence_score", "deal_score", scores.quality_label(c("confidence_score")).alias("quality_label"),
        scores.liquidity_label(c("liquidity_score")).alias("liquidity_label"), scores.demand_label(c("demand_score")).alias("demand_label"),
    )


def sort_columns(mode: str) -> list:
    """The explorer's orders; an unknown mode is 'deal'. The market breaks ties."""
    modes = {
        "spread": [F.desc_nulls_last("spread")], "liquidity": [F.desc("liquidity_score")], "confidence": [F.desc("confidence_score")], "demand": [F.desc("demand_score")],
        "name": [F.asc(F.lower("item"))], "recent": [F.desc("last_activity")],
    }
    return [*modes.get(mode, [F.desc("deal_score"), F.desc("confidence_score")]), F.asc("market")]


def explore(markets: DataFrame, query: str = "", sort: str = "deal", least_confidence: int = 0, least_liquidity: int = 0, side: str = "", limit: int = 250) -> DataFrame:
    """Markets by substring, score and side, in one of the orders of :func:`sort_columns`."""
    found = markets.where((c("confidence_score") >= max(0, min(100, least_confidence))) & (c("liquidity_score") >= max(0, min(100, least_liquidity))))
    if query:
        found = found.where(exprs.matches(query, "item", "market"))
    if side in ("buy", "sell"):
        found = found.where("best_wtb IS NOT NULL" if side == "buy" else "best_wts IS NOT NULL")
    return found.orderBy(*sort_columns(sort)).limit(exprs.clamp_limit(limit, 1000))


def watched_flags(markets: DataFrame, watched: DataFrame) -> DataFrame:
    """``markets`` with ``is_watched``: whether any row of ``watched`` has the market."""
    known = watched.select("market").distinct().withColumn("_w", F.lit(True))
    return markets.join(known, "market", "left").withColumn("is_watched", F.coalesce("_w", F.lit(False))).drop("_w")


def explorer_counts(markets: DataFrame) -> DataFrame:
    return markets.agg(
        F.count("*").alias("markets"), F.count_if(c("best_wtb").isNotNull() & c("best_wts").isNotNull()).alias("two_sided"),
        F.count_if(c("deal_score") >= 60).alias("deals"), F.count_if(c("confidence_score") >= 80).alias("confident"),
    )


def live_feed(offers: DataFrame, markets: DataFrame, limit: int = 300) -> DataFrame:
    """The newest active offers with a label of how their price compares with the median of their side."""
    rows = offers.where("lifecycle_status = 'active' AND trade_type IN ('buy', 'sell')").withColumn("market", exprs.market())
    newest = rows.orderBy(F.desc("posted_at"), F.desc("offer_id")).limit(exprs.clamp_limit(limit, 300))
    joined = newest.join(markets.select("market", "median_wtb", "median_wts"), "market", "left")
    median = F.when(c("trade_type") == "buy", c("median_wtb")).otherwise(c("median_wts"))
    price = exprs.shown_price()
    return joined.select("offer_id", "market", "trade_type", "player", "posted_at", price.alias("price"), median.alias("median"), exprs.deal(price, median, c("trade_type")).alias("deal"))
