"""Score and label formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def liquidity(traders: Column, offers: Column) -> Column:
    return F.least(F.lit(100), F.round(9 * traders + 3 * offers).cast("int"))


def demand(buyers: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * buyers / total)).otherwise(50).cast("int")


def spread_penalty(low: Column, high: Column, median: Column, samples: Column) -> Column:
    return F.when((samples >= 2) & (median > 0), F.least(F.lit(22.0), F.round((high - low) / median * 22))).otherwise(0.0)


def confidence(samples: Column, traders: Column, penalty: Column, both: Column) -> Column:
    return clamp(F.least(F.lit(72), 6 * samples + 5 * traders) - penalty + F.when(both, 18).otherwise(0)).cast("int")


def deal_score(bid: Column, ask: Column, conf: Column, liquid: Column) -> Column:
    margin = clamp(F.round(4 * (bid - ask) / ask * 100))
    return F.when((bid > ask) & (ask > 0), F.round(0.5 * margin + 0.3 * conf + 0.2 * liquid)).otherwise(0).cast("int")


def quality_label(score: Column) -> Column:
    return F.when(score >= 80, "Hoog").when(score >= 55, "Redelijk").when(score >= 30, "Laag").otherwise("Onvoldoende data")


def liquidity_label(score: Column) -> Column:
    return F.when(score >= 75, "Hoog").when(score >= 45, "Gemiddeld").otherwise("Laag")


def demand_label(score: Column) -> Column:
    return F.when(score >= 70, "Veel vraag").when(score <= 30, "Veel aanbod").otherwise("Neutraal")


def coverage(trusted: Column, offers: Column) -> Column:
    return F.when(offers > 0, F.round(F.least(F.lit(1.0), trusted / offers) * 100)).otherwise(0).cast("int")


def trust(trusted: Column, offers: Column, traders: Column, flagged: Column) -> Column:
    one = F.lit(1.0)
    raw = 45 * coverage(trusted, offers) / 100 + 25 * F.least(one, traders / 8) + 15 * F.least(one, trusted / 12) + 15 - 25 * F.least(one, flagged / F.greatest(offers, F.lit(1)))
    return F.round(clamp(raw)).cast("int")


def trust_label(score: Column) -> Column:
    return F.when(score >= 85, "Zeer hoog").when(score >= 70, "Hoog").when(score >= 50, "Redelijk").when(score >= 30, "Laag").otherwise("Zeer laag")


def activity(offers: Column, markets: Column, priced: Column) -> Column:
    return F.round(clamp(1.6 * offers + 4 * markets + 0.8 * priced)).cast("int")


def reliability(average_confidence: Column, priced: Column, offers: Column) -> Column:
    return F.round(clamp(0.65 * average_confidence + 25 * F.least(F.lit(1.0), priced / offers) + F.least(F.lit(10.0), offers / 5))).cast("int")


def side_label(buys: Column, total: Column) -> Column:
    share = buys / total
    return F.when(share >= 0.7, "Koper").when(share <= 0.3, "Verkoper").otherwise("Beide")
