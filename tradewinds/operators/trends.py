"""Trust, averages, daily movers and exchange quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs, scores

c = F.col


def _flagged():
    return F.coalesce(c("price_quality_status"), F.lit("trusted")).isin("uncertain", "outlier") | (F.coalesce(c("quality_status"), F.lit("review")) != "accepted")


def market_trust(offers: DataFrame, least: int = 2) -> DataFrame:
    rows = offers.withColumn("market", exprs.market()).where("market IS NOT NULL")
    found = rows.groupBy("market").agg(F.count("*").alias("offers"), F.count_if(exprs.trusted_price()).alias("trusted"), F.count_distinct("player").alias("traders"), F.count_if(_flagged()).alias("flagged")).where(c("offers") >= least)
    score = scores.trust(c("trusted"), c("offers"), c("traders"), c("flagged"))
    return found.withColumn("coverage", scores.coverage(c("trusted"), c("offers"))).withColumn("trust", score).withColumn("label", scores.trust_label(c("trust")))


def weakest_markets(offers: DataFrame, among: int = 250, limit: int = 50) -> DataFrame:
    """Of the ``among`` markets with most offers, those with the least trust."""
    largest = market_trust(offers).orderBy(F.desc("offers"), "market").limit(among)
    return largest.orderBy("trust", F.desc("offers"), "market").limit(exprs.clamp_limit(limit, 250)).select("market", "offers", "trusted", "traders", "trust")


def case_counts(offers: DataFrame) -> DataFrame:
    """(kind, n) for each of the CASES, all in one pass."""
    flags = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.expr(test), F.lit(False)).alias("is")) for k, test in CASES.items()])
    return offers.select(F.explode(flags).alias("f")).groupBy("f.kind").agg(F.count_if(c("f.is")).alias("n"))


def issues(offers: DataFrame) -> DataFrame:
    """How many offers have which first issue."""
    status = F.coalesce(c("price_quality_status"), F.lit("trusted"))
    issue = (
        F.when(F.coalesce(c("quality_status"), F.lit("review")) == "rejected", "rejected").when(status == "outlier", "outlier").when(c("unit_price").isNull(), "no_price")
        .when(F.coalesce(c("price_basis"), F.lit("unknown")) == "unknown", "unknown_basis").when(status == "uncertain", "uncertain").when(c("confidence") < 0.6, "low_confidence").otherwise("none")
    )
    return offers.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"), F.count_distinct("player").alias("traders"))


CASES = {
    "no_price": "unit_price IS NULL", "unknown_basis": "coalesce(price_basis, 'unknown') = 'unknown'", "outlier": "price_quality_status = 'outlier'", "uncertain": "price_quality_status = 'uncertain'",
    "review": "coalesce(quality_status, 'review') = 'review'", "low_confidence": "confidence < 0.6", "no_market": "coalesce(normalized_market_key, '') = '' AND coalesce(market_key, '') = ''",
}


def cases(offers: DataFrame, kind: str) -> DataFrame:
    """Offers of one of the CASES; all if ``kind`` is none of them."""
    return offers.where(CASES[kind]) if kind in CASES else offers


def average_prices(offers: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    recent = offers.where(c("posted_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(days)} DAYS")).withColumn("p", exprs.shown_price())
    return recent.where("p IS NOT NULL").groupBy("item").agg(F.median("p").alias("median_price"), F.count("*").alias("n"))


def movers(offers: DataFrame, as_of: str) -> DataFrame:
    """Markets whose median of trader medians moved by 1 to 300 percent from one day to the next, with two traders in both."""
    rows = offers.where(f"unit_price > 0 AND posted_at >= TIMESTAMP_NTZ '{as_of}' - INTERVAL 48 HOURS AND posted_at < TIMESTAMP_NTZ '{as_of}'")
    rows = rows.withColumn("day", F.when(c("posted_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL 24 HOURS"), "now").otherwise("before"))
    by_trader = rows.groupBy("item_key", "day", "player").agg(F.median("unit_price").alias("p"))
    of = lambda d, x="p": F.when(c("day") == d, c(x))
    found = by_trader.groupBy("item_key").agg(
        F.median(of("now")).alias("price"), F.median(of("before")).alias("price_before"), F.count(of("now")).alias("traders"), F.count(of("before")).alias("traders_before")
    ).where("traders >= 2 AND traders_before >= 2")
    return found.withColumn("percent", (c("price") - c("price_before")) / c("price_before") * 100).where("abs(percent) BETWEEN 1 AND 300")


def exchange_quotes(offers: DataFrame, pairs: DataFrame, as_of: str, newest: int = 250, days: int = 7) -> DataFrame:
    """Median of trader medians over the newest offers of the last ``days`` of each pair (item_key, factor, low, high), two
    traders at least."""
    order = W.partitionBy("item_key").orderBy(F.desc("posted_at"), F.desc("offer_id"))
    recent = offers.where(c("posted_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(days)} DAYS"))
    rows = recent.join(F.broadcast(pairs), "item_key").where("unit_price > 0").withColumn("_n", F.row_number().over(order)).where(c("_n") <= newest)  # pairs: a table of four settings
    rows = rows.withColumn("quote", c("unit_price") * c("factor")).where(c("quote").between(c("low"), c("high")))
    traders = rows.groupBy("item_key", "player").agg(F.median("quote").alias("q"))
    return traders.groupBy("item_key").agg(F.median("q").alias("quote"), F.count("*").alias("traders")).where("traders >= 2")
