"""The operators as queries over the driver's tables; :mod:`.oracle` has the equivalent SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIFECYCLE
from ..functions import exprs, text
from ..operators import catalog, intelligence, lifecycle, market, price_quality, review, search, snapshots, traders, trends
from ..sources import payload
from ..sources.market import AS_OF, EVENTS_AS_OF, chat, events, offers, table, tasks

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _over_offers(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(offers(spark, sf_dir))


def _markets(o: DataFrame) -> DataFrame:
    return intelligence.intelligence(o)


def _reviewed(o: DataFrame) -> DataFrame:
    """Offers with a review: those of every fortieth message."""
    return o.where("message_id % 40 = 0").select("offer_id")


def _noted(o: DataFrame) -> DataFrame:
    """Offers of which some state their price in a complex way."""
    return o.withColumn("raw_segment", F.expr("CASE WHEN requirement % 7 = 0 THEN raw_segment || ' 3=1e' ELSE raw_segment END"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names as a catalog."""
    return table(spark, sf_dir, "part").groupBy(c("p_name").alias("name")).agg(F.concat(F.lit("item_"), F.min("p_partkey").cast("string")).alias("item_key"), F.min("p_type").alias("category"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as aliases of the items that bear them."""
    p = table(spark, sf_dir, "part").select("p_name", c("p_brand").alias("alias")).distinct()
    return p.join(_items(spark, sf_dir), c("p_name") == c("name")).select("alias", "item_key")


QUERIES["market_intelligence"] = lambda spark, sf_dir: _markets(offers(spark, sf_dir))
_over_offers("explorer_counts", lambda o: intelligence.explorer_counts(_markets(o)))
_over_offers("explorer_search", lambda o: intelligence.explore(_markets(o), query="brand_1", sort="liquidity", least_liquidity=20, limit=100).select("market", "item", "liquidity_score", "confidence_score"))
_over_offers("top_deals", lambda o: intelligence.explore(_markets(o), sort="deal", limit=25).select("market", "deal_score", "confidence_score", "spread"))
_over_offers("live_feed", lambda o: intelligence.live_feed(o, _markets(o)))
_over_offers("counters", market.counters)
_over_offers("item_directory", market.item_directory)
_over_offers("item_summary", market.item_summary)
_over_offers("item_variants", market.variants)
_over_offers("item_analytics", market.item_analytics)
_over_offers("active_markets", market.active_markets)
_over_offers("market_summary", market.market_summary)
_over_offers("structured_directory", market.structured_directory)
_over_offers("biggest_spreads", market.biggest_spreads)
_over_offers("lifecycle_histogram", lambda o: market.histogram(o, "lifecycle_status", LIFECYCLE))
_over_offers("order_book", market.order_book)
_over_offers("best_offers", market.best_offers)
_over_offers("keyset_page", lambda o: market.page_after(o.select("offer_id", "item", "player"), "offer_id", "8", 250))
_over_offers("offset_page", lambda o: market.page_at(o.select("offer_id", "item", "unit_price"), [F.desc_nulls_last("unit_price"), "offer_id"], 500, 100))
_over_offers("latest_listings", market.latest_listings)
_over_offers("lifecycle_reconcile", lambda o: lifecycle.reconcile(o, AS_OF, years=(1996, 2100)))
_over_offers("lifecycle_heal", lifecycle.heal)
_over_offers("lifecycle_expire", lambda o: lifecycle.expire(o, AS_OF).groupBy("lifecycle_status").agg(F.count("*").alias("n")))
_over_offers("offer_age_histogram", lambda o: lifecycle.age_histogram(o, AS_OF))
_over_offers("duplicate_listings", lifecycle.duplicates)
_over_offers("history_over_cap", lambda o: lifecycle.over_cap(o, _reviewed(o), 5))
_over_offers("retention_prune", lambda o: lifecycle.prune(o, _reviewed(o), AS_OF, 5, 700).select("offer_id", "market_key", "posted_at"))
_over_offers("retention_report", lambda o: lifecycle.retention_report(o, _reviewed(o), AS_OF, 700, 1000))
_over_offers("price_semantics", lambda o: price_quality.semantic_status(o).select("offer_id", "status", "reason"))
_over_offers("price_outliers", price_quality.outliers)
_over_offers("price_rebuild_items", lambda o: price_quality.rebuilt(o, ["brand_1", "brand_2"]))
_over_offers("trader_directory", traders.directory)
_over_offers("trader_search", lambda o: traders.search(o, "0001", "reliability", 50))
QUERIES["trader_top_markets"] = lambda spark, sf_dir: traders.top_markets(offers(spark, sf_dir), tasks=tasks(spark, sf_dir))
_over_offers("trader_counts", lambda o: traders.counts(o, AS_OF))
_over_offers("market_trust", trends.market_trust)
_over_offers("quality_issues", trends.issues)
_over_offers("quality_cases", lambda o: trends.cases(o, "no_market").select("offer_id", "item_key"))
_over_offers("average_prices", lambda o: trends.average_prices(o, AS_OF, 400))
_over_offers("review_reasons", review.review_reasons)
_over_offers("review_seed", lambda o: review.seed_reviews(o, _reviewed(o)))
_over_offers("offer_risk", lambda o: review.risk(_noted(o)))
_over_offers("market_context", review.market_context)
_over_offers("global_search", lambda o: search.global_search(o, "brand#1"))
_over_offers("search_summary", lambda o: search.search_summary(search.global_search(o, "red")))
_over_offers("canonical_spelling", lambda o: market.canonical_spelling(o.select(F.expr("CASE WHEN message_id % 3 = 0 THEN upper(item) ELSE item END").alias("item")), "item"))
_over_offers("impossible_variants", lambda o: catalog.variant_gate(o, "brand_7", 9, 13, ("small", "large")).select("offer_id", "requirement", "is_oldschool"))
_over_offers("variant_labels", lambda o: o.select("offer_id", exprs.variant().alias("variant"), exprs.identity().alias("identity"), exprs.shown_price().alias("price"), exprs.money_per_item().alias("per_item")))


@query
def daily_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.movers(events(spark, sf_dir).where("trade_type <> 'trade'"), EVENTS_AS_OF).withColumn("percent", F.round("percent", 0))


@query
def exchange_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("brand_1", 1.0, 1.0, 1e9), ("brand_2", 100.0, 1.0, 1e9), ("brand_3", 0.01, 1.0, 1e5), ("brand_4", 0.5, 10.0, 1e6)], "item_key string, factor double, low double, high double")
    return trends.exchange_quotes(offers(spark, sf_dir), pairs, AS_OF, days=300)


@query
def hourly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.by_window(events(spark, sf_dir), size="6 hours")


@query
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(snapshots.by_window(events(spark, sf_dir), size="1 day"))


def _watched(o: DataFrame) -> DataFrame:
    """All items' markets are watched, at a target that depends on the requirement."""
    return o.select(exprs.intelligence_market().alias("market"), "requirement").where("market LIKE '%|q:%'").groupBy("market").agg((F.max("requirement") * 40.0).alias("target"))


_over_offers("watchlist", lambda o: review.watchlist(_watched(o), _markets(o)))


@query
def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of which half were met before, a third of them with the signature of the present price."""
    o = offers(spark, sf_dir)
    markets = _markets(o)
    best = F.when(c("condition_type") == "wts_below", c("best_wts")).otherwise(c("best_wtb"))
    now = F.concat_ws("|", "condition_type", F.round(best).cast("long").cast("string"))
    alerts = review.watch_alerts(_watched(o)).join(markets.select("market", "best_wtb", "best_wts"), "market", "left").select(
        F.concat_ws("/", "market", "condition_type").alias("alert_id"), "market", "condition_type", "target", (F.length("market") % 2 == 0).alias("was_met"),
        F.when((F.length("market") % 3 == 0) & best.isNotNull(), now).otherwise(F.when(F.length("market") % 3 == 1, "old")).alias("signature"),
    )
    return review.evaluate_alerts(alerts, markets)


@query
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.dataset_summary(table(spark, sf_dir, "conversations"), "role", "text")


@query
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.repeated_texts(table(spark, sf_dir, "documents"), "text").select(F.md5("norm").alias("norm"), "n")


@query
def common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.common_terms(table(spark, sf_dir, "conversations"), "text", [F.desc("conv_id"), F.desc("turn")])


@query
def item_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    traded = offers(spark, sf_dir).select(c("raw_segment").alias("name")).distinct()
    known = _items(spark, sf_dir).select("name")
    brands = table(spark, sf_dir, "part").select(c("p_brand").alias("name")).distinct()
    return search.by_priority(traded, known, brands)


@query
def either_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nation_"), (c("s_suppkey") % 30).cast("string")).alias("s_label"))
    return search.either_key(s, n, ("s_suppkey", "n_nationkey"), ("s_label", "n_name"))


@query
def unlisted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no active offer lists."""
    listed = offers(spark, sf_dir).where("lifecycle_status = 'active' AND quality_status = 'accepted'").select(c("raw_segment").alias("p_name"), c("item").alias("p_brand"))
    return table(spark, sf_dir, "part").join(listed, ["p_name", "p_brand"], "left_anti").select("p_partkey", "p_name", "p_brand")


@query
def item_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type, its brands as one text."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return p.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_brand")), " · ").alias("brands"), F.count("*").alias("n"))


@query
def unique_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unique_alias(_items(spark, sf_dir), _aliases(spark, sf_dir))


@query
def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).select("offer_id", c("raw_segment").alias("item"), "item_key")
    some = o.withColumn("item", F.expr("CASE substr(offer_id, 1, 1) WHEN '0' THEN 'unknown' WHEN '1' THEN upper(item) WHEN '2' THEN item || ' x' ELSE item END"))
    return catalog.strict_gate(some, _items(spark, sf_dir), _aliases(spark, sf_dir)).groupBy("gate").agg(F.count("*").alias("n"))


@query
def profile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    own = items.where("length(name) % 5 = 0").select("item_key", F.concat(F.lit("p_"), "name").alias("profile"), F.array(F.lit("requirement")).alias("track"))
    by_category = items.select("category").distinct().where("category <> 'SMALL'").select("category", F.lower("category").alias("profile"), F.array(F.lit("attribute"), F.lit("oldschool")).alias("track"))
    return catalog.profiles(items, own, by_category).select("item_key", "profile", F.array_join("track", ",").alias("track"))


@query
def chat_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages parsed into offers."""
    parsed = catalog.parse(chat(spark, sf_dir), "offer_id")
    return parsed.select(c("message_id").alias("offer_id"), "trade_type", "item", "requirement", "price_amount", "price_currency", "price_basis", "quantity", "unit_price")


@query
def message_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and reasons of conversation turns as trade messages."""
    t = table(spark, sf_dir, "conversations").select(text.gate(text.normalise(c("text"))).alias("g"))
    return t.groupBy("g.kind", "g.reason").agg(F.count("*").alias("n"))


@query
def payload_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as chat payloads, read back as messages and deduplicated."""
    e = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("WTS "), "event_type").alias("m"), c("user_id").cast("string").alias("s"), F.unix_millis(c("ts").cast("timestamp")).cast("string").alias("t"), (c("event_id") % 7000).cast("string").alias("h"))).alias("messages"))).alias("body")
    )
    found = payload.messages(e, "body", F.lit("2024-02-01").cast("timestamp"))
    return found.groupBy("source_key").agg(F.count("*").alias("n"))


@query
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(c("p_name").alias("item_key")).agg(F.min("p_brand").alias("name"), F.array_sort(F.collect_set("p_type")).alias("aliases"))
    old = p.withColumn("name", F.lower("name"))
    new = p.where("length(item_key) % 2 = 0").withColumn("aliases", F.array(c("name")))
    return search.merged_catalog(old, new).select("item_key", "name", F.array_join("aliases", ",").alias("aliases"))


@query
def cached_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names over three sources."""
    p, n, r = table(spark, sf_dir, "part").select(c("p_brand").alias("name")), table(spark, sf_dir, "nation").select(c("n_name").alias("name")), table(spark, sf_dir, "region").select(c("r_name").alias("name"))
    return p.union(n).union(r).distinct()


@query
def platform_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers and traders per month."""
    return offers(spark, sf_dir).groupBy(F.date_format("posted_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("offers"), F.count_distinct("player").alias("traders"), F.max("posted_at").alias("last_posted"))


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and link counts of pages."""
    h = c("html")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract(h, "<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all(h, F.lit("<a href="), 0)).alias("links"))


@query
def validation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue that holds the offers of every fifth message, synced with all offers' risks."""
    o = offers(spark, sf_dir)
    queue = o.where("message_id % 5 = 0").select("offer_id", F.expr("CASE message_id % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'queued' ELSE 'failed' END").alias("status"), F.lit(0).alias("risk"))
    return review.sync_queue(queue, review.risk(_noted(o)))


@query
def alias_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as aliases of parts' types, in two spellings."""
    p = table(spark, sf_dir, "part").select(c("p_type").alias("item_key"), F.expr("CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', ' ') END").alias("alias"))
    return catalog.alias_repeats(p)


@query
def group_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the brands that suppliers ask for."""
    requests = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("BRAND "), (c("s_suppkey") % 60).cast("string")).alias("alias"))
    groups = _aliases(spark, sf_dir).select("alias", c("alias").alias("group"), "item_key")
    return catalog.expand_groups(requests, groups, _items(spark, sf_dir))


@query
def item_encyclopedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.encyclopedia(_items(spark, sf_dir), offers(spark, sf_dir), tasks=tasks(spark, sf_dir))


@query
def sane_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written as seconds, milliseconds, microseconds, ISO times or junk, read back."""
    at = F.date_trunc("second", c("ts").cast("timestamp"))
    n = F.unix_seconds(at)
    raw = F.when(c("event_id") % 5 == 0, n.cast("string")).when(c("event_id") % 5 == 1, (n * 1000).cast("string")).when(c("event_id") % 5 == 2, (n * 1000000).cast("string"))
    raw = raw.when(c("event_id") % 5 == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("58567-01-01"))
    return table(spark, sf_dir, "events").select("event_id", payload.sane_timestamp(raw, F.lit("2024-02-01").cast("timestamp")).cast("timestamp_ntz").alias("at"))
