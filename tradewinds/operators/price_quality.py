"""Price quality: an ordered cascade of checks, then robust outliers per market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CURRENCIES, UNSURE_BASES
from ..functions import exprs
from .ranking import written

c = F.col


def semantic_status(offers: DataFrame) -> DataFrame:
    """``offers`` with ``status`` (trusted, uncertain, unpriced) and ``reason``; the first check that applies decides."""
    basis = F.coalesce(exprs.blank_to_null(F.lower(F.trim("price_basis"))), F.lit("unknown"))
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), (reason if not isinstance(reason, str) else F.lit(reason)).alias("reason"))
    no_unit = c("unit_price").isNull() | (c("unit_price") <= 0)
    guard = (c("item_key") == "armbrace_of_truth") & ~F.coalesce((F.lower("price_currency") == "e") & c("price_amount").between(0, 100) & (F.abs(c("unit_price") - c("price_amount")) < 0.001), F.lit(False))
    found = (
        F.when(~F.coalesce(c("trade_type").isin("buy", "sell"), F.lit(False)), say("unpriced", "trade_offer"))
        .when(c("price_amount").isNull() & no_unit, say("unpriced", "no_price"))
        .when(no_unit, say("uncertain", "no_unit_price"))
        .when(~F.coalesce(F.lower(F.trim("price_currency")).isin(*CURRENCIES), F.lit(False)), say("uncertain", "unknown_currency"))
        .when(basis.isin(*UNSURE_BASES), say("uncertain", F.concat(F.lit("unsure_basis: "), basis)))
        .when(guard, say("uncertain", "armbrace_price"))
        .otherwise(say("trusted", "ok"))
    )
    return offers.withColumn("_s", found).withColumn("status", c("_s.status")).withColumn("reason", c("_s.reason")).drop("_s")


def outliers(offers: DataFrame, least_prices: int = 5, least_traders: int = 3) -> DataFrame:
    """Trusted offers with their market's median, a robust z score and whether they are outliers.

    A price is one if it is four times the median or a quarter of it, or if its z score is 8 or more and it is 2.5 times
    the median or 0.4 of it; groups with few prices or traders have none.
    """
    rows = semantic_status(offers).where("status = 'trusted'").withColumn("market", F.coalesce(exprs.blank_to_null(c("normalized_market_key")), c("item_key")))
    # written once, as medians, deviations and traders each read all offers; medians are grouped and joined back: as windows they
    # would put all of a large market's offers into one task
    rows = written(rows.where("market IS NOT NULL").select("offer_id", "market", "unit_price", F.lower("player").alias("_p")))
    traders = rows.groupBy("market", "_p").agg(F.lit(1).alias("_1")).groupBy("market").agg(F.count("_p").alias("_traders"))
    found = written(rows.groupBy("market").agg(F.median("unit_price").alias("baseline"), F.count("*").alias("_n")))
    dev = F.abs(c("unit_price") - c("baseline"))
    mads = rows.join(found, "market").groupBy("market").agg(F.median(dev).alias("_mad"))
    markets = written(found.join(mads, "market").join(traders, "market"))  # few beside the offers, whose rows then need no shuffle
    rows = rows.drop("_p").join(markets, "market").withColumn("_dev", dev)
    ratio, z = c("unit_price") / c("baseline"), c("_dev") / (1.4826 * c("_mad"))
    far = (ratio >= 4) | (ratio <= 0.25) | ((c("_mad") > 1e-6) & (z >= 8) & ((ratio >= 2.5) | (ratio <= 0.4)))
    enough = (c("_n") >= least_prices) & (c("_traders") >= least_traders) & (c("baseline") > 0)
    return rows.select("offer_id", "market", "unit_price", "baseline", F.when(c("_mad") > 1e-6, F.round(z, 0)).alias("robust_z"), (enough & far).alias("is_outlier"))


def rebuilt(offers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(offer_id, price_quality_status) computed anew: of the items in ``keys``, or of all if it is None."""
    scope = offers if keys is None else offers.where(c("item_key").isin(keys))
    far = outliers(scope).where("is_outlier").select("offer_id", F.lit("outlier").alias("_o"))
    new = semantic_status(scope).join(far, "offer_id", "left").select("offer_id", F.coalesce("_o", "status").alias("price_quality_status"))
    if keys is None:
        return new
    return new.unionByName(offers.where(~F.coalesce(c("item_key").isin(keys), F.lit(False))).select("offer_id", "price_quality_status"))
