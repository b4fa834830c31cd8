"""Offer lifecycle: the newest listing of a trader's variant wins; older ones are superseded, stale ones expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import HISTORY_CAP, MESSAGE_CAP, RETENTION_DAYS, TTL_HOURS
from ..functions import exprs
from .ranking import place

c = F.col


def _before(as_of: str, amount: int, unit: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(amount)} {unit}")


def reconcile(offers: DataFrame, as_of: str, hours: int = TTL_HOURS, years: tuple[int, int] = (2005, 2100)) -> DataFrame:
    """(offer_id, status, superseded_by): a pure function of the offers, so running it twice changes nothing.

    Times outside ``years`` are mistaken and never expire an offer.
    """
    order = W.partitionBy(F.lower(F.trim("player")), "trade_type", exprs.identity()).orderBy(F.desc("posted_at"), F.desc("offer_id"))
    rows = offers.where("coalesce(quality_status, 'review') <> 'rejected'").withColumn("_n", F.row_number().over(order)).withColumn("_winner", F.first("offer_id").over(order))
    stale = (c("posted_at") < _before(as_of, hours, "HOURS")) & F.year("posted_at").between(*years)
    status = F.when(c("_n") > 1, "superseded").when(stale, "expired").otherwise("active")
    return rows.select("offer_id", status.alias("status"), F.when(c("_n") > 1, c("_winner")).alias("superseded_by"))


def heal(offers: DataFrame) -> DataFrame:
    """Active offers that another active one of the same identity supersedes."""
    order = W.partitionBy(F.lower(F.trim("player")), "trade_type", exprs.identity()).orderBy(F.desc("posted_at"), F.desc("offer_id"))
    rows = offers.where("lifecycle_status = 'active'").withColumn("_n", F.row_number().over(order)).withColumn("superseded_by", F.first("offer_id").over(order))
    return rows.where("_n > 1").select("offer_id", "superseded_by")


def expire(offers: DataFrame, as_of: str, hours: int = TTL_HOURS) -> DataFrame:
    stale = (c("lifecycle_status") == "active") & (c("posted_at") < _before(as_of, hours, "HOURS"))
    return offers.select("offer_id", F.when(stale, "expired").otherwise(c("lifecycle_status")).alias("lifecycle_status"))


def age_histogram(offers: DataFrame, as_of: str) -> DataFrame:
    """Active offers by age; those over 48 hours are stale."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(c("posted_at").cast("timestamp"))) / 3600
    bucket = F.when(age < 6, "0-6").when(age < 12, "6-12").when(age < 24, "12-24").when(age < 48, "24-48").otherwise(">48")
    return offers.where("lifecycle_status = 'active'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("posted_at").alias("oldest"))


def duplicates(offers: DataFrame) -> DataFrame:
    """Groups of more than one offer that agree in seven columns."""
    keys = ["player", "trade_type", "item_key", "requirement", "price_currency", "price_basis", "lifecycle_status"]
    return offers.groupBy(*keys).agg(F.count("*").alias("n"), F.min("offer_id").alias("first_offer"), F.max("posted_at").alias("last_posted")).where("n > 1")


def over_cap(offers: DataFrame, reviewed: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """Ids of inactive offers without a review beyond the newest ``cap`` of their market and side."""
    rows = offers.where("lifecycle_status <> 'active'").join(reviewed.select("offer_id"), "offer_id", "left_anti").withColumn("_m", exprs.market())
    # only sides beyond the cap are ranked, dealt out by ranges
    full = rows.groupBy("_m", "trade_type").agg(F.count("*").alias("_c")).where(c("_c") > cap).select(c("_m").alias("_fm"), c("trade_type").alias("_ft"))
    rows = rows.join(full, c("_m").eqNullSafe(c("_fm")) & (c("trade_type") == c("_ft")), "left_semi")
    placed = place(rows.select("offer_id", "_m", "trade_type", "posted_at"), ["_m", "trade_type"], [F.desc("posted_at"), F.desc("offer_id")], "_n")
    return placed.where(c("_n") > cap).select("offer_id")


def prune(offers: DataFrame, reviewed: DataFrame, as_of: str, cap: int = HISTORY_CAP, days: int = RETENTION_DAYS) -> DataFrame:
    """Offers that stay: within the history cap, young enough or reviewed."""
    kept = offers.join(over_cap(offers, reviewed, cap), "offer_id", "left_anti").join(reviewed.select("offer_id", F.lit(True).alias("_r")), "offer_id", "left")
    return kept.where(c("_r") | (c("posted_at") >= _before(as_of, days, "DAYS"))).drop("_r")


def cap_messages(offers: DataFrame, reviewed: DataFrame, cap: int = MESSAGE_CAP) -> DataFrame:
    """Offers of the newest ``cap`` messages (by their last offer, then by id), and of older ones those with a review."""
    order = [F.desc("_at"), F.desc("message_id")]
    newest = offers.groupBy("message_id").agg(F.max("posted_at").alias("_at")).orderBy(*order).limit(cap).select("message_id")
    protected = reviewed.select("offer_id").distinct().withColumn("_r", F.lit(True))
    rows = offers.join(newest.withColumn("_k", F.lit(True)), "message_id", "left").join(protected, "offer_id", "left")
    return rows.where(c("_k") | c("_r")).drop("_k", "_r")


def retention_report(offers: DataFrame, reviewed: DataFrame, as_of: str, days: int = RETENTION_DAYS, cap: int = MESSAGE_CAP) -> DataFrame:
    rows = offers.join(reviewed.select("offer_id", F.lit(True).alias("_r")), "offer_id", "left")
    old = c("posted_at") < _before(as_of, days, "DAYS")
    return rows.agg(
        F.count("*").alias("offers"), F.count("_r").alias("protected"), F.count_if(old & c("_r").isNull()).alias("eligible"), F.greatest(F.lit(0), F.count_distinct("message_id") - cap).cast("long").alias("overflow"),
    )
