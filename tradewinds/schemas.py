"""Schemas of the market tables, and defaults for columns that older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = (
    "id long, source string, source_key string, player string, message string, posted_at timestamp, collected_at timestamp, "
    "parser_status string, parser_summary string, parser_offer_count int, raw_payload string, collector_version string"
)
OFFERS = (
    "offer_id string, message_id long, player string, posted_at timestamp_ntz, trade_type string, item string, item_key string, market_key string, "
    "normalized_market_key string, requirement int, attribute_key string, is_oldschool boolean, is_inscribable boolean, quantity double, price_amount double, "
    "price_currency string, unit_price double, price_basis string, quality_status string, confidence double, raw_segment string, lifecycle_status string, "
    "price_quality_status string"
)
DEFAULTS = {"lifecycle_status": "active", "price_quality_status": "trusted", "quality_status": "review", "is_oldschool": False, "is_inscribable": False}


def with_defaults(df: DataFrame, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """``df`` with the columns of ``defaults`` that it lacks, at their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
