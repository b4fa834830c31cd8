"""Queries of :mod:`..operators.upkeep` and of message rules over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import intelligence, lifecycle, market, review, trends, upkeep
from ..sources.market import offers, table
from .oracle import ORACLE_SQL as _TRUST_SQL
from .oracle import _INTEL, _REVIEWED, _WATCHED, _q
from .queries import Query, _markets, _reviewed, _watched

c = F.col
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, (k, *r))) + ")" for k, r in enumerate(rows))


def _sampled(spark: SparkSession, sf_dir: str, samples: list) -> DataFrame:
    """Offers with one of some texts each, by the message's number."""
    return offers(spark, sf_dir).withColumn("said", F.element_at(F.array(*map(F.lit, samples)), (c("message_id") % len(samples) + 1).cast("int")))


# Segments with {a} amount, {c} coin and {q} quantity, and what they mean: unit price and basis in SQL.
SEGMENTS = [
    ("{q} gott {a}{c}", "ecto / q", "'total'"), ("stacks {a}{c}/ea", "ecto / 250", "'stack'"), ("Flower {a}{c}/stk", "ecto / 250", "'stack'"),
    ("Flower {a}{c}/ea", "CASE WHEN quoted = 'stack' THEN ecto / size ELSE ecto END", "CASE WHEN quoted = 'stack' THEN 'stack_inferred' ELSE 'each' END"), ("Flower stack {a}{c}", "ecto / 250", "'stack'"),
    ("Flower {a}{c}", "CASE quoted WHEN 'stack' THEN ecto / size WHEN 'each' THEN ecto END", "CASE quoted WHEN 'stack' THEN 'stack_inferred' WHEN 'each' THEN 'each_inferred' END"), ("Flower bundle {a}{c}", "NULL", "NULL"),
    ("Flower {q}:{a}{c}", "ecto / q", "'ratio'"), ("Flower {a}{c} or {q}k", "NULL", "NULL"), ("Flower x{q} {a}{c}", "ecto / q", "'total'"), ("Flower 5-{a}{c}", "NULL", "NULL"), ("just a flower", "NULL", "NULL"),
]
_CASE = lambda k: " ".join(f"WHEN {n} THEN {row[k]}" for n, row in enumerate(SEGMENTS))


@_add("price_recovery", _q(f"""SELECT offer_id, CASE message_id % {len(SEGMENTS)} {_CASE(1)} END AS unit, CASE message_id % {len(SEGMENTS)} {_CASE(2)} END AS basis FROM (
  SELECT *, CASE brand % 4 WHEN 0 THEN 'stack' WHEN 1 THEN 'each' WHEN 2 THEN 'each' END AS quoted, CASE WHEN brand % 8 = 0 THEN 100.0 ELSE 250.0 END::DOUBLE AS size, quantity::BIGINT::DOUBLE AS q,
    floor(price_amount)::DOUBLE * CASE requirement % 3 WHEN 0 THEN 27.0 WHEN 1 THEN 1.0 ELSE 1 / 15.0::DOUBLE END::DOUBLE AS ecto FROM (SELECT *, substr(item_key, 7)::INT AS brand FROM offers))"""))
def price_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of many forms; brands are quoted by the stack, each, by default or not at all."""
    coin = F.expr("CASE requirement % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'e' ELSE 'k' END")
    rows = _sampled(spark, sf_dir, [s for s, _, _ in SEGMENTS])
    said = F.replace(F.replace(F.replace("said", F.lit("{a}"), F.floor("price_amount").cast("string")), F.lit("{c}"), coin), F.lit("{q}"), c("quantity").cast("long").cast("string"))
    brand = F.substring("item_key", 7, 9).cast("int")
    items = rows.select("item_key").distinct().select(
        "item_key", F.when(brand % 4 == 0, "Stack").when(brand % 4 == 1, "each").alias("basis"), F.when(brand % 4 == 3, "material").otherwise("weapon").alias("category"), F.when(brand % 8 == 0, 100).otherwise(0).alias("size"))
    return upkeep.recovered(rows.select("offer_id", "item_key", said.alias("raw_segment")), upkeep.quote_semantics(items))


# Segments of items that are quoted both ways, and whether a stored unit price is stale.
MIXED = [("gott 2e, materials 2k s", True), ("gott 2e/ea", False), ("gott stack 20a", False), ("gott 2e ~", True), ("gott 5:2e", False), ("gott 2e or 3e", False), ("gott", False), ("gott 2e per stk; x 3e", False)]


@_add("stale_units", _q(f"SELECT offer_id FROM offers JOIN (VALUES {_values([(s, int(x)) for s, x in MIXED])}) s(k, said, stale) ON message_id % {len(MIXED)} = k WHERE stale = 1 AND item_key IN ('brand_1', 'brand_2') AND requirement % 5 <> 0"))
def stale_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("CASE item_key WHEN 'brand_1' THEN 'gift_of_the_traveler' WHEN 'brand_2' THEN 'tengu_support_flare' ELSE item_key END")
    rows = _sampled(spark, sf_dir, [s for s, _ in MIXED]).withColumn("item_key", key).withColumn("raw_segment", c("said"))
    return upkeep.stale_units(rows.withColumn("price_quality_reason", F.when(c("requirement") % 5 == 0, "approved_by_hand")))


# Messages of offers without a side, whether they have a price, and the reason that the last check gives.
BARE = [("Zodiac Staff", "bare_market_intent_unresolved"), ("W.T.S Zodiac Staff", "trade_direction_unresolved"), ("Zodiac Staff 12e", "trade_direction_unresolved"), ("a long message that says nothing of sides", "trade_direction_unresolved"), ("selling staff", "trade_direction_unresolved")]


@_add("final_check", _q(f"""SELECT offer_id, CASE WHEN trade_type = 'trade' AND quality_status = 'accepted' THEN 'review' ELSE quality_status END AS quality_status, CASE WHEN trade_type = 'trade' AND quality_status = 'accepted' THEN
  CASE WHEN quantity % 2 = 0 THEN 'trade_direction_unresolved' ELSE reason END END AS quality_reason FROM offers JOIN (VALUES {_values(BARE)}) s(k, said, reason) ON message_id % {len(BARE)} = k"""))
def final_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sampled(spark, sf_dir, [m for m, _ in BARE]).withColumn("message", c("said")).withColumn("price_amount", F.when(c("quantity") % 2 == 0, c("price_amount")))
    return upkeep.final_check(rows.withColumn("trade_type", F.when(c("trade_type") == "trade", "unknown").otherwise(c("trade_type"))))


_REVIEWS = """, rs AS (SELECT offer_id, CASE message_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'corrected' ELSE 'pending' END AS review_status, CASE WHEN message_id % 3 = 0 THEN upper(item) || ' X' ELSE item END AS expected_item
  FROM offers WHERE requirement % 4 = 0)"""


def _reviews(o: DataFrame) -> DataFrame:
    """Reviews of the offers with a requirement divisible by four."""
    return o.where("requirement % 4 = 0").select("offer_id", F.expr("CASE message_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'corrected' ELSE 'pending' END").alias("review_status"), F.expr("CASE WHEN message_id % 3 = 0 THEN upper(item) || ' X' ELSE item END").alias("expected_item"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages; some have no offers of their own, some are no market."""
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("message_id"), F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'hello' WHEN 1 THEN 'need a runner' ELSE 'WTS things' END").alias("message"))


_MESSAGES = ", ms AS (SELECT o_orderkey AS message_id, CASE o_orderkey % 6 WHEN 0 THEN 'hello' WHEN 1 THEN 'need a runner' ELSE 'WTS things' END AS message FROM orders)"


@_add("review_export", _q("SELECT rs.offer_id, review_status, expected_item, trade_type, item, market_key, raw_segment, message, player FROM rs JOIN offers USING (offer_id) JOIN ms USING (message_id) WHERE review_status <> 'pending'", _REVIEWS + _MESSAGES))
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return upkeep.export_reviews(_reviews(o), o, _messages(spark, sf_dir))


@_add("messages_to_review", _q("SELECT DISTINCT ms.message_id FROM ms LEFT JOIN o2 ON ms.message_id = o2.message_id LEFT JOIN rs ON rs.offer_id = o2.offer_id WHERE o2.offer_id IS NULL OR review_status = 'pending' OR coalesce(quality_status, 'review') = 'review'", ", o2 AS (SELECT * FROM offers WHERE message_id % 7 <> 0)" + _REVIEWS + _MESSAGES))
def messages_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return upkeep.to_review_again(_messages(spark, sf_dir), o.where("message_id % 7 <> 0"), _reviews(o))


@_add("batch_review", _q("""SELECT message_id, kind, CASE WHEN kind <> 'market' THEN 'ignored' WHEN n = 0 THEN 'empty' WHEN open > 0 THEN 'review' ELSE 'parsed' END AS status, CASE WHEN kind = 'market' THEN n ELSE 0 END AS offers,
  CASE WHEN kind = 'market' THEN pending ELSE all_reviews END AS reviews_dropped FROM (SELECT ms.message_id, CASE ms.message_id % 6 WHEN 0 THEN 'noise' WHEN 1 THEN 'service' ELSE 'market' END AS kind, count(o2.offer_id) AS n,
  count(*) FILTER (o2.offer_id IS NOT NULL AND coalesce(quality_status, 'review') = 'review' OR o2.offer_id IS NULL) AS open, count(review_status) AS all_reviews, count(*) FILTER (review_status = 'pending') AS pending
  FROM ms LEFT JOIN o2 ON ms.message_id = o2.message_id LEFT JOIN rs ON rs.offer_id = o2.offer_id GROUP BY ALL)""", ", o2 AS (SELECT * FROM offers WHERE message_id % 7 <> 0)" + _REVIEWS + _MESSAGES))
def batch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return upkeep.review_again(_messages(spark, sf_dir), o.where("message_id % 7 <> 0"), _reviews(o))


@_add("review_save", _q("""SELECT offers.offer_id, CASE WHEN d IN ('approved', 'corrected') THEN 'trusted' ELSE price_quality_status END AS price_quality_status, CASE WHEN d IN ('approved', 'corrected') THEN 'approved_by_hand' END AS price_quality_reason
  FROM offers LEFT JOIN (SELECT offer_id, CASE WHEN requirement % 8 = 0 OR requirement % 4 <> 0 THEN CASE WHEN message_id % 2 = 0 THEN 'corrected' ELSE 'pending' END ELSE review_status END AS d FROM (SELECT o.*, review_status FROM offers o LEFT JOIN rs USING (offer_id)) WHERE requirement % 8 = 0 OR requirement % 4 = 0 OR requirement % 9 = 0) t USING (offer_id)""", _REVIEWS))
def review_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on some offers with and some without a review; an unknown status counts as pending."""
    o = offers(spark, sf_dir)
    decisions = o.where("requirement % 8 = 0 OR (requirement % 9 = 0 AND requirement % 4 <> 0)").select("offer_id", F.expr("CASE WHEN message_id % 2 = 0 THEN 'corrected' ELSE 'whatever' END").alias("review_status"), F.concat(c("item"), F.lit(" ")).alias("expected_item"))
    return upkeep.with_decisions(o, upkeep.saved_reviews(_reviews(o), decisions))


@_add("learned_aliases", _q("SELECT trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g'), ' ') AS alias, upper(item) || ' X' AS item, count(*) AS n FROM offers JOIN rs USING (offer_id) WHERE review_status = 'corrected' AND message_id % 3 = 0 GROUP BY ALL", _REVIEWS))
def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return upkeep.learned_aliases(_reviews(o), o)


_ALERTS = ", aa AS (SELECT market || '/' || condition_type AS alert_id, market, condition_type, target FROM wt, (VALUES ('wts_below'), ('wtb_above')) t(condition_type))"
_ALERT_EVENTS = ", ae AS (SELECT event_id, user_id % 3 = 0 AS is_read, CASE WHEN event_id % 2 = 0 THEN 'brand_' || (1 + event_id % 30) || '|q:' || (1 + user_id % 50) || '/wts_below' ELSE 'gone' END AS alert_id FROM events)"


def _alerts(o: DataFrame) -> DataFrame:
    return review.watch_alerts(_watched(o)).select(F.concat_ws("/", "market", "condition_type").alias("alert_id"), "market", "condition_type", "target")


def _alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('brand_', 1 + event_id % 30, '|q:', 1 + user_id % 50, '/wts_below') ELSE 'gone' END")
    return table(spark, sf_dir, "events").select("event_id", (c("user_id") % 3 == 0).alias("is_read"), alert.alias("alert_id"))


@_add("alert_feed", _q("SELECT alert_id, event_id, is_read, market, condition_type FROM ae LEFT JOIN aa USING (alert_id)", _INTEL + _WATCHED + _ALERTS + _ALERT_EVENTS))
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.alert_feed(_alert_events(spark, sf_dir), _alerts(offers(spark, sf_dir)))


@_add("unread_alerts", _q("SELECT market, count(*) AS n FROM ae JOIN aa USING (alert_id) WHERE NOT is_read GROUP BY market", _INTEL + _WATCHED + _ALERTS + _ALERT_EVENTS))
def unread_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.unread(_alert_events(spark, sf_dir), _alerts(offers(spark, sf_dir)))


@_add("target_alerts", _q("SELECT market, condition_type, target, coalesce(length(market) % 2 = 0 AND condition_type = 'wts_below', false) AS was_met FROM aa", _INTEL + _WATCHED + _ALERTS))
def target_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _alerts(offers(spark, sf_dir))
    old = wanted.where("condition_type = 'wts_below'").select("market", "condition_type", F.lit(1.0).alias("target"), (F.length("market") % 2 == 0).alias("was_met"))
    gone = old.limit(1).withColumn("market", F.lit("nobody's"))
    return upkeep.synced_alerts(old.unionByName(gone), wanted)


def _simple(name: str, f, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: f(offers(spark, sf_dir))), sql


_simple("watched_markets", lambda o: intelligence.watched_flags(_markets(o), _watched(o)).select("market", "is_watched"), _q("SELECT market, market IN (SELECT market FROM wt) AS is_watched FROM markets", _INTEL + _WATCHED))
_simple("busy_items", lambda o: upkeep.of_busy_items(o, 30).select("offer_id", "item_key"), _q("SELECT offer_id, item_key FROM offers WHERE item_key IN (SELECT item_key FROM offers WHERE quality_status = 'accepted' GROUP BY item_key HAVING count(*) >= 30)"))
_simple("structured_summary", market.structured_summary, _q("SELECT count(*) AS total, count(*) FILTER (quality_status = 'accepted') AS accepted, count(*) FILTER (quality_status = 'review') AS review, count(DISTINCT market_key) AS markets, count(DISTINCT message_id) AS parsed_messages FROM offers"))
_simple("structured_markets", market.structured_markets, _q("SELECT market_key, min(item) AS item, count(*) AS samples, count(*) FILTER (trade_type = 'buy') AS buys, count(*) FILTER (trade_type = 'sell') AS sells FROM offers WHERE quality_status = 'accepted' GROUP BY market_key ORDER BY samples DESC, market_key NULLS FIRST LIMIT 100"))
_simple("case_counts", trends.case_counts, _q(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM offers WHERE {test}" for k, test in trends.CASES.items())))
_simple("message_cap", lambda o: lifecycle.cap_messages(o, _reviewed(o), 500).select("offer_id"), _q("SELECT offer_id FROM offers WHERE offer_id IN (SELECT offer_id FROM rv) OR message_id IN (SELECT message_id FROM (SELECT message_id, max(posted_at) AS newest FROM offers GROUP BY 1) ORDER BY newest DESC, message_id DESC LIMIT 500)", _REVIEWED))
_simple(
    "weakest_markets", lambda o: trends.weakest_markets(o, 100, 20),
    f"SELECT market, offers, trusted, traders, trust FROM (SELECT * FROM ({_TRUST_SQL['market_trust']}) ORDER BY offers DESC, market LIMIT 100) ORDER BY trust, offers DESC, market LIMIT 20",
)
_simple(
    "shown_texts", lambda o: o.select(
        "offer_id", exprs.price_text(F.floor(c("unit_price") * 2) / 2).alias("price"), exprs.mover_market().alias("mover"),
        exprs.relative_time(F.lit("2001-08-01").cast("timestamp_ntz") - F.make_dt_interval(secs=c("message_id") * 7), F.lit("2001-08-01").cast("timestamp_ntz")).alias("since"),
        exprs.market_identity(c("item_key"), c("requirement"), c("attribute_key"), c("is_oldschool"), c("is_inscribable"), F.create_map(F.lit("z"), F.lit("1"), F.lit("b"), c("trade_type"))).alias("identity")),
    _q("""SELECT offer_id, replace(regexp_replace(regexp_replace(printf('%.2f', CASE WHEN p >= 500 THEN round(p / 26, 2) ELSE p END), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '.', ',') || CASE WHEN p >= 500 THEN 'a' ELSE 'e' END AS price,
      coalesce(nullif(normalized_market_key, ''), market_key, item_key) AS mover, CASE WHEN s < 60 THEN 'nu' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' uur' ELSE s // 86400 || ' d' END AS since,
      concat_ws('|', item_key, 'q:' || requirement, 'attribute:' || nullif(trim(regexp_replace(attribute_key, '[^a-z0-9]+', '_', 'g'), '_'), ''), CASE WHEN is_oldschool THEN 'oldschool:1' END, CASE WHEN is_inscribable THEN 'inscribable:1' END, 'b:' || trade_type, 'z:1') AS identity
      FROM (SELECT *, floor(unit_price * 2) / 2 AS p, message_id * 7 AS s FROM offers)"""),
)
