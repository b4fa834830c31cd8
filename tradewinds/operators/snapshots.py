"""Price history: snapshots by hour or day, and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def by_window(offers: DataFrame, key: str = "item_key", size: str = "1 hour") -> DataFrame:
    """Tumbling windows of ``posted_at``: count, traders, best and median prices."""
    of = lambda s: F.when(c("trade_type") == s, c("unit_price"))
    found = offers.groupBy(F.window("posted_at", size).alias("w"), key).agg(
        F.count("*").alias("n"), F.count_distinct("player").alias("traders"), F.max(of("buy")).alias("best_wtb"), F.median(of("buy")).alias("median_wtb"), F.min(of("sell")).alias("best_wts"), F.median(of("sell")).alias("median_wts"),
    )
    return found.select(c("w.start").alias("captured_at"), key, "n", "traders", "best_wtb", "median_wtb", "best_wts", "median_wts")


def changes(snapshots: DataFrame, key: str = "item_key") -> DataFrame:
    """Snapshots with the difference from the same market's one before."""
    before = W.partitionBy(key).orderBy("captured_at")
    return snapshots.select(
        key, "captured_at", "median_wts", (c("median_wts") - F.lag("median_wts").over(before)).alias("change"), F.row_number().over(before).alias("place"),
    )
