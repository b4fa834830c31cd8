"""SQL (DuckDB) for the queries of :mod:`.queries`, over views named as the driver's tables."""

from __future__ import annotations

_OFFERS = """offers AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT)) AS offer_id,
    o_orderkey AS message_id, c_name AS player, o_orderdate AS posted_at,
    CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'N' THEN 'sell' ELSE 'trade' END AS trade_type,
    p_brand AS item, lower(replace(p_brand, '#', '_')) AS item_key,
    CASE WHEN l_suppkey % 17 = 0 AND l_partkey % 2 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '_')) || ':' || p_type END AS market_key,
    CASE l_suppkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(replace(p_brand, '#', '_')) || '|q:' || p_size::VARCHAR END AS normalized_market_key,
    p_size AS requirement, CASE WHEN l_partkey % 3 = 0 THEN lower(p_type) ELSE '' END AS attribute_key, l_partkey % 5 = 0 AS is_oldschool, l_partkey % 7 = 0 AS is_inscribable,
    l_quantity AS quantity, l_extendedprice AS price_amount, CASE l_orderkey % 11 WHEN 0 THEN 'a' WHEN 1 THEN 'k' WHEN 2 THEN NULL ELSE 'e' END AS price_currency,
    CASE WHEN l_orderkey % 11 = 2 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
    CASE l_orderkey % 13 WHEN 0 THEN 'stack' WHEN 1 THEN 'exchange' WHEN 2 THEN 'unknown' WHEN 3 THEN 'total' WHEN 4 THEN 'uncertain' ELSE 'each' END AS price_basis,
    CASE l_partkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'review' WHEN 2 THEN NULL ELSE 'accepted' END AS quality_status,
    (50 + l_suppkey % 50) / 100.0::DOUBLE AS confidence, p_name AS raw_segment,
    CASE WHEN l_linestatus = 'O' THEN 'active' WHEN l_linenumber % 3 = 0 THEN 'superseded' WHEN l_linenumber % 3 = 1 THEN 'expired' ELSE 'active' END AS lifecycle_status,
    CASE l_suppkey % 19 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'outlier' WHEN 2 THEN NULL ELSE 'trusted' END AS price_quality_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
_TRUST = """(coalesce(price_currency IN ('a', 'e', 'k') AND unit_price > 0
  AND coalesce(price_basis, 'unknown') NOT IN ('bundle', 'currency_exchange', 'unknown', 'currency_conversion', 'unqualified', 'uncertain', 'range')
  AND coalesce(price_quality_status, 'trusted') = 'trusted', false))"""
_SHOWN = f"(CASE WHEN {_TRUST} THEN unit_price END)"
_MARKET = "coalesce(nullif(normalized_market_key, ''), market_key)"
_VARIANT = "concat_ws(' ', 'q' || requirement::VARCHAR, nullif(attribute_key, ''), CASE WHEN is_oldschool THEN 'OS' END, CASE WHEN is_inscribable THEN 'inscribable' END)"
_IDENTITY = """(CASE WHEN split_part(normalized_market_key, '|', 1) = item_key THEN normalized_market_key
  ELSE concat_ws('|', item_key, coalesce(requirement::VARCHAR, ''), coalesce(attribute_key, ''), is_oldschool::INT::VARCHAR, is_inscribable::INT::VARCHAR) END)"""
_CLAMP = "least(100.0, greatest(0.0, {}))"
_TIDY = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"


def _q(body: str, ctes: str = "") -> str:
    return f"WITH {_OFFERS}{ctes} {body}"


_INTEL = """, r0 AS (
  SELECT *, coalesce(nullif(normalized_market_key, ''), nullif(market_key, ''), nullif(item_key, '')) AS market,
         coalesce(nullif(lower(player), ''), 'message:' || message_id::VARCHAR) AS trader
  FROM offers WHERE coalesce(quality_status, 'review') = 'accepted' AND trade_type IN ('buy', 'sell')),
r1 AS (SELECT *, row_number() OVER (PARTITION BY market, trade_type, trader ORDER BY message_id DESC, offer_id DESC) AS rn FROM r0 WHERE market IS NOT NULL),
r2 AS (SELECT * EXCLUDE (rn), CASE WHEN unit_price > 0 AND unit_price <= 1e8 THEN unit_price END AS p FROM r1 WHERE rn = 1),
q AS (SELECT market, trade_type, count(p) AS n, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM r2 GROUP BY ALL),
r3 AS (SELECT r2.*, CASE WHEN n < 5 OR q3 - q1 <= 0 OR (p >= greatest(0, q1 - 1.5 * (q3 - q1)) AND p <= q3 + 1.5 * (q3 - q1)) THEN p END AS pp
       FROM r2 JOIN q USING (market, trade_type)),
m0 AS (SELECT market, arg_max(item, (message_id, offer_id)) AS item,
  max(pp) FILTER (trade_type = 'buy') AS best_wtb, min(pp) FILTER (trade_type = 'sell') AS best_wts, min(pp) FILTER (trade_type = 'buy') AS lb, max(pp) FILTER (trade_type = 'sell') AS hs,
  median(pp) FILTER (trade_type = 'buy') AS median_wtb, median(pp) FILTER (trade_type = 'sell') AS median_wts,
  count(pp) FILTER (trade_type = 'buy') AS nb, count(pp) FILTER (trade_type = 'sell') AS ns,
  count(*) FILTER (trade_type = 'buy') AS buyers, count(*) AS total, count(DISTINCT nullif(lower(player), '')) AS traders, max(posted_at) AS last_activity
  FROM r3 GROUP BY market),
m1 AS (SELECT *, best_wtb - best_wts AS spread, least(100, 9 * traders + 3 * total)::INT AS liquidity_score, round(100.0 * buyers / total)::INT AS demand_score,
  least(100.0, greatest(0.0, least(72, 6 * (nb + ns) + 5 * traders)
    - (CASE WHEN nb >= 2 AND median_wtb > 0 THEN least(22.0, round((best_wtb - lb) / median_wtb * 22)) ELSE 0 END
       + CASE WHEN ns >= 2 AND median_wts > 0 THEN least(22.0, round((hs - best_wts) / median_wts * 22)) ELSE 0 END)
    + CASE WHEN nb > 0 AND ns > 0 THEN 18 ELSE 0 END))::INT AS confidence_score FROM m0),
markets AS (SELECT market, item, best_wtb, median_wtb, best_wts, median_wts, spread, buyers, total - buyers AS sellers, traders, last_activity, liquidity_score, demand_score, confidence_score,
  coalesce(CASE WHEN best_wtb > best_wts AND best_wts > 0
    THEN round(0.5::DOUBLE * least(100.0, greatest(0.0, round(4 * (best_wtb - best_wts) / best_wts * 100))) + 0.3::DOUBLE * confidence_score + 0.2::DOUBLE * liquidity_score) ELSE 0 END, 0)::INT AS deal_score,
  CASE WHEN confidence_score >= 80 THEN 'Hoog' WHEN confidence_score >= 55 THEN 'Redelijk' WHEN confidence_score >= 30 THEN 'Laag' ELSE 'Onvoldoende data' END AS quality_label,
  CASE WHEN liquidity_score >= 75 THEN 'Hoog' WHEN liquidity_score >= 45 THEN 'Gemiddeld' ELSE 'Laag' END AS liquidity_label,
  CASE WHEN demand_score >= 70 THEN 'Veel vraag' WHEN demand_score <= 30 THEN 'Veel aanbod' ELSE 'Neutraal' END AS demand_label FROM m1)"""
_EVENTS = """events_v AS (SELECT event_id, user_id::VARCHAR AS player, ts AS posted_at,
  CASE WHEN event_type IN ('view', 'click') THEN 'buy' WHEN event_type IN ('signup', 'purchase') THEN 'sell' ELSE 'trade' END AS trade_type,
  'item_' || ((props::JSON ->> '$.k')::INT % 20)::VARCHAR AS item_key, value AS unit_price FROM events)"""
_SEMANTIC = """, sem AS (SELECT *, coalesce(nullif(lower(trim(price_basis)), ''), 'unknown') AS basis FROM offers),
st AS (SELECT *, CASE WHEN trade_type NOT IN ('buy', 'sell') THEN 'unpriced' WHEN price_amount IS NULL AND coalesce(unit_price, 0) <= 0 THEN 'unpriced' WHEN coalesce(unit_price, 0) <= 0 THEN 'uncertain'
    WHEN coalesce(lower(trim(price_currency)), '') NOT IN ('a', 'e', 'k') THEN 'uncertain'
    WHEN basis IN ('bundle', 'currency_exchange', 'unknown', 'currency_conversion', 'unqualified', 'uncertain', 'range') THEN 'uncertain' ELSE 'trusted' END AS status,
  CASE WHEN trade_type NOT IN ('buy', 'sell') THEN 'trade_offer' WHEN price_amount IS NULL AND coalesce(unit_price, 0) <= 0 THEN 'no_price' WHEN coalesce(unit_price, 0) <= 0 THEN 'no_unit_price'
    WHEN coalesce(lower(trim(price_currency)), '') NOT IN ('a', 'e', 'k') THEN 'unknown_currency'
    WHEN basis IN ('bundle', 'currency_exchange', 'unknown', 'currency_conversion', 'unqualified', 'uncertain', 'range') THEN 'unsure_basis: ' || basis ELSE 'ok' END AS reason FROM sem),
tr AS (SELECT *, coalesce(nullif(normalized_market_key, ''), item_key) AS market FROM st WHERE status = 'trusted'),
md AS (SELECT market, median(unit_price) AS baseline, count(*) AS n, count(DISTINCT lower(player)) AS traders FROM tr GROUP BY market),
dv AS (SELECT tr.*, baseline, n, traders, abs(unit_price - baseline) AS dev FROM tr JOIN md USING (market)),
mm AS (SELECT market, median(dev) AS mad FROM dv GROUP BY market),
outl AS (SELECT offer_id, market, unit_price, baseline, CASE WHEN mad > 1e-6 THEN round(dev / (1.4826::DOUBLE * mad), 0) END AS robust_z,
  n >= 5 AND traders >= 3 AND baseline > 0 AND (unit_price / baseline >= 4 OR unit_price / baseline <= 0.25
    OR (mad > 1e-6 AND dev / (1.4826::DOUBLE * mad) >= 8 AND (unit_price / baseline >= 2.5 OR unit_price / baseline <= 0.4))) AS is_outlier FROM dv JOIN mm USING (market))"""
_TRADERS = f""", tv AS (SELECT *, {_MARKET} AS market FROM offers WHERE player IS NOT NULL AND trim(player) <> ''),
ta AS (SELECT player, count(*) AS offers, count(DISTINCT message_id) AS messages, count(DISTINCT nullif(market, '')) AS markets, count(*) FILTER (trade_type = 'buy') AS buys,
  count(*) FILTER (trade_type = 'sell') AS sells, count(unit_price) AS priced, count(*) FILTER (lifecycle_status = 'active') AS active, sum(round(confidence * 100)::BIGINT)::BIGINT AS conf,
  min(posted_at) AS first_posted, max(posted_at) AS last_posted FROM tv GROUP BY player),
td AS (SELECT * EXCLUDE (conf), round({_CLAMP.format('1.6::DOUBLE * offers + 4 * markets + 0.8::DOUBLE * priced')})::INT AS activity,
  round({_CLAMP.format('0.65::DOUBLE * (conf / 100.0::DOUBLE / offers) + 25 * least(1.0::DOUBLE, priced / offers) + least(10.0::DOUBLE, offers / 5)')})::INT AS reliability,
  CASE WHEN buys / offers >= 0.7 THEN 'Koper' WHEN buys / offers <= 0.3 THEN 'Verkoper' ELSE 'Beide' END AS side FROM ta)"""
_REVIEWED = ", rv AS (SELECT offer_id FROM offers WHERE message_id % 40 = 0)"
_CAP = f"""{_REVIEWED}, cap AS (SELECT offer_id FROM (SELECT offer_id, row_number() OVER (PARTITION BY {_MARKET}, trade_type ORDER BY posted_at DESC, offer_id DESC) AS rn
  FROM offers WHERE lifecycle_status <> 'active' AND offer_id NOT IN (SELECT offer_id FROM rv)) WHERE rn > 5)"""
_BOOK = f""", ob AS (SELECT item, trade_type, offer_id, player, {_SHOWN} AS price, posted_at FROM offers WHERE lifecycle_status = 'active' AND trade_type IN ('buy', 'sell')),
book AS (SELECT item, trade_type, offer_id, player, price,
  row_number() OVER (PARTITION BY item, trade_type ORDER BY CASE WHEN trade_type = 'buy' THEN -price ELSE price END NULLS LAST, posted_at DESC, offer_id)::INT AS place FROM ob)"""
_ITEMS = """items AS (SELECT p_name AS name, 'item_' || min(p_partkey)::VARCHAR AS item_key, min(p_type) AS category FROM part GROUP BY p_name)"""
_ALIAS = f"""{_ITEMS}, al AS (SELECT DISTINCT p_brand AS alias, item_key FROM part JOIN items ON p_name = name),
ua AS (SELECT alias, min(item_key) AS item_key FROM (SELECT {_TIDY('name')} AS alias, item_key FROM items UNION ALL SELECT {_TIDY('alias')}, item_key FROM al)
  WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT item_key) = 1)"""
_WATCHED = f""", wt AS (SELECT coalesce(nullif(normalized_market_key, ''), nullif(market_key, ''), nullif(item_key, '')) AS market, max(requirement) * 40.0::DOUBLE AS target FROM offers
  WHERE coalesce(nullif(normalized_market_key, ''), nullif(market_key, ''), nullif(item_key, '')) LIKE '%|q:%' GROUP BY 1)"""


def _search(q: str) -> str:
    parts = []
    for kind, column in (("item", "item"), ("market", _MARKET), ("trader", "player"), ("text", "raw_segment")):
        parts.append(
            f"(SELECT '{kind}' AS kind, name, count(*) AS offers FROM (SELECT {column} AS name FROM offers) WHERE contains(lower(name), '{q}') GROUP BY name "
            f"ORDER BY CASE WHEN lower(name) = '{q}' THEN 0 ELSE 1 END, count(*) DESC, name LIMIT 50)"
        )
    return " UNION ALL ".join(parts)


def _sides(x: str) -> str:
    return f"median(CASE WHEN trade_type = 'buy' THEN {x} END) AS median_buy, median(CASE WHEN trade_type = 'sell' THEN {x} END) AS median_sell"


_RISK = f"""WITH {_OFFERS}, w AS (SELECT *, count(*) OVER (PARTITION BY message_id) AS siblings, count(unit_price) OVER (PARTITION BY {_MARKET}) AS n, median(unit_price) OVER (PARTITION BY {_MARKET}) AS md FROM offers),
x AS (SELECT *, CASE WHEN n >= 3 THEN unit_price / md END AS ratio FROM w),
f AS (SELECT offer_id, coalesce(quality_status, 'review') <> 'accepted' AS a, confidence < 0.90 AS b, confidence BETWEEN 0.90 AND 0.9499999 AS c, price_amount IS NOT NULL AND unit_price IS NULL AS d,
  coalesce(price_basis, 'unknown') IN ('unknown', 'total') AND price_amount IS NOT NULL AS e, requirement % 7 = 0 AS cn, siblings > 1 AS s, coalesce(ratio >= 4 OR ratio <= 0.25, false) AS g,
  coalesce((ratio >= 2 AND ratio < 4) OR (ratio <= 0.5 AND ratio > 0.25), false) AS h FROM x),
y AS (SELECT offer_id, least(100, 45 * a::INT + 25 * b::INT + 10 * c::INT + 35 * d::INT + 15 * e::INT + 8 * cn::INT + 12 * s::INT + 45 * g::INT + 20 * h::INT)::INT AS risk,
  concat_ws(',', CASE WHEN a THEN 'not_accepted' END, CASE WHEN b THEN 'low_confidence' END, CASE WHEN c THEN 'medium_confidence' END, CASE WHEN d THEN 'no_unit_price' END,
    CASE WHEN e THEN 'unsure_basis' END, CASE WHEN cn THEN 'complex_notation' END, CASE WHEN s THEN 'siblings' END, CASE WHEN g THEN 'far_from_market' END, CASE WHEN h THEN 'off_market' END) AS reasons FROM f)
SELECT *, risk >= 20 AS risky FROM y"""

ORACLE_SQL: dict[str, str] = {
    "market_intelligence": _q("SELECT * FROM markets", _INTEL),
    "explorer_counts": _q("SELECT count(*) AS markets, count(*) FILTER (best_wtb IS NOT NULL AND best_wts IS NOT NULL) AS two_sided, count(*) FILTER (deal_score >= 60) AS deals, count(*) FILTER (confidence_score >= 80) AS confident FROM markets", _INTEL),
    "explorer_search": _q("SELECT market, item, liquidity_score, confidence_score FROM markets WHERE liquidity_score >= 20 AND (contains(lower(item), 'brand_1') OR contains(lower(market), 'brand_1')) ORDER BY liquidity_score DESC, market LIMIT 100", _INTEL),
    "top_deals": _q("SELECT market, deal_score, confidence_score, spread FROM markets ORDER BY deal_score DESC, confidence_score DESC, market LIMIT 25", _INTEL),
    "live_feed": _q(f"""SELECT offer_id, market, trade_type, player, posted_at, price, md AS median,
      CASE WHEN price IS NULL OR md IS NULL OR NOT (price > 0 AND md > 0) THEN 'unknown' WHEN r <= 0.85 THEN 'great' WHEN r <= 0.95 THEN 'good' WHEN r < 1.05 THEN 'fair' WHEN r < 1.15 THEN 'poor' ELSE 'bad' END AS deal
      FROM (SELECT *, CASE WHEN trade_type = 'sell' THEN price / md ELSE md / price END AS r FROM (SELECT n.*, CASE WHEN trade_type = 'buy' THEN median_wtb ELSE median_wts END AS md FROM
        (SELECT offer_id, {_MARKET} AS market, trade_type, player, posted_at, {_SHOWN} AS price FROM offers WHERE lifecycle_status = 'active' AND trade_type IN ('buy', 'sell') ORDER BY posted_at DESC, offer_id DESC LIMIT 300) n
        LEFT JOIN markets m ON n.market = m.market))""", _INTEL),
    "counters": _q("SELECT count(*) AS offers, count(DISTINCT message_id) AS messages, count(DISTINCT player) AS players, count(unit_price) AS priced, count(*) FILTER (quality_status = 'accepted') AS accepted, count(*) FILTER (coalesce(quality_status, 'review') = 'review') AS review, max(posted_at) AS last_posted FROM offers"),
    "item_directory": _q(f"SELECT lower(item) AS item_norm, min(item) AS item, min(item_key) AS item_key, count(*) AS offers, count(*) FILTER (trade_type = 'buy') AS buys, count(*) FILTER (trade_type = 'sell') AS sells, round(avg(CASE WHEN trade_type = 'buy' THEN {_SHOWN} END), 0) AS avg_buy, round(avg(CASE WHEN trade_type = 'sell' THEN {_SHOWN} END), 0) AS avg_sell, max(posted_at) AS last_posted FROM offers GROUP BY lower(item)"),
    "item_summary": _q(f"""SELECT item, count(*) AS offers, count(DISTINCT player) AS traders, count(DISTINCT message_id) AS messages, count(*) FILTER (lifecycle_status = 'active') AS active,
      count(*) FILTER (lifecycle_status = 'active' AND trade_type = 'buy') AS active_buys, count(*) FILTER (lifecycle_status = 'active' AND trade_type = 'sell') AS active_sells, count(*) FILTER ({_TRUST}) AS trusted,
      min(CASE WHEN trade_type = 'sell' THEN {_SHOWN} END) AS lowest_sell, max(CASE WHEN trade_type = 'buy' THEN {_SHOWN} END) AS highest_buy, min(unit_price) AS lowest, max(unit_price) AS highest,
      min(posted_at) AS first_posted, max(posted_at) AS last_posted FROM offers GROUP BY item"""),
    "item_variants": _q(f"SELECT item, {_VARIANT} AS variant, count(*) AS offers, median({_SHOWN}) AS median_price, max(posted_at) AS last_posted FROM offers GROUP BY 1, 2"),
    "item_analytics": _q(f"""SELECT *, median_buy - median_sell AS spread FROM (SELECT item, count(*) AS points, count(DISTINCT player) AS traders, {_sides(_SHOWN)}, min(CASE WHEN trade_type = 'sell' THEN {_SHOWN} END) AS lowest_sell,
      max(CASE WHEN trade_type = 'buy' THEN {_SHOWN} END) AS highest_buy FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY posted_at DESC, offer_id DESC) AS rn FROM offers) WHERE rn <= 100 GROUP BY item)"""),
    "active_markets": _q(f"SELECT {_MARKET} AS market, count(*) AS offers, count(DISTINCT player) AS traders, min(item) AS item, max(posted_at) AS last_posted FROM offers WHERE lifecycle_status = 'active' AND coalesce(quality_status, 'accepted') = 'accepted' AND {_MARKET} IS NOT NULL GROUP BY 1"),
    "market_summary": _q(f"""SELECT {_MARKET} AS market, max(CASE WHEN trade_type = 'buy' THEN unit_price END) AS best_wtb, median(CASE WHEN trade_type = 'buy' THEN unit_price END) AS median_wtb,
      min(CASE WHEN trade_type = 'sell' THEN unit_price END) AS best_wts, median(CASE WHEN trade_type = 'sell' THEN unit_price END) AS median_wts, count(*) AS active_offers, count(DISTINCT player) AS unique_traders
      FROM offers WHERE lifecycle_status = 'active' AND coalesce(quality_status, 'accepted') = 'accepted' AND unit_price > 0 AND {_MARKET} IS NOT NULL GROUP BY 1"""),
    "structured_directory": _q(f"""SELECT s.*, b.dominant_basis FROM (SELECT {_MARKET} AS market, count(*) AS offers, {_sides(_SHOWN)}, min(item) AS item FROM offers WHERE {_MARKET} IS NOT NULL GROUP BY 1) s
      JOIN (SELECT market, arg_min(price_basis, (-n, price_basis)) AS dominant_basis FROM (SELECT {_MARKET} AS market, price_basis, count(*) AS n FROM offers WHERE {_MARKET} IS NOT NULL GROUP BY 1, 2) GROUP BY market) b USING (market)"""),
    "biggest_spreads": _q(f"SELECT market, median_buy, median_sell, median_buy - median_sell AS spread FROM (SELECT {_MARKET} AS market, {_sides(_SHOWN)} FROM offers WHERE {_MARKET} IS NOT NULL GROUP BY 1) WHERE median_buy - median_sell > 0 ORDER BY spread DESC, market LIMIT 50"),
    "lifecycle_histogram": _q("SELECT s AS lifecycle_status, count(offer_id) AS n FROM (VALUES ('active'), ('superseded'), ('expired'), ('rejected')) t(s) LEFT JOIN offers ON lifecycle_status = s GROUP BY s"),
    "order_book": _q("SELECT * FROM book", _BOOK),
    "best_offers": _q("SELECT * EXCLUDE (place) FROM book WHERE place = 1 AND price IS NOT NULL", _BOOK),
    "keyset_page": _q("SELECT offer_id, item, player FROM offers WHERE offer_id > '8' ORDER BY offer_id LIMIT 250"),
    "offset_page": _q("SELECT offer_id, item, unit_price FROM offers ORDER BY unit_price DESC NULLS LAST, offer_id LIMIT 100 OFFSET 500"),
    "latest_listings": _q(f"SELECT offer_id, player, trade_type, item, posted_at FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(player)), trade_type, item, {_VARIANT} ORDER BY posted_at DESC, offer_id DESC) AS rn FROM offers) WHERE rn = 1"),
    "lifecycle_reconcile": _q(f"""SELECT offer_id, CASE WHEN rn > 1 THEN 'superseded' WHEN posted_at < TIMESTAMP '2001-08-01' - INTERVAL 200 HOUR AND year(posted_at) BETWEEN 1996 AND 2100 THEN 'expired' ELSE 'active' END AS status,
      CASE WHEN rn > 1 THEN winner END AS superseded_by FROM (SELECT *, row_number() OVER w AS rn, first_value(offer_id) OVER w AS winner FROM offers WHERE coalesce(quality_status, 'review') <> 'rejected'
      WINDOW w AS (PARTITION BY lower(trim(player)), trade_type, {_IDENTITY} ORDER BY posted_at DESC, offer_id DESC))"""),
    "lifecycle_heal": _q(f"""SELECT offer_id, winner AS superseded_by FROM (SELECT offer_id, row_number() OVER w AS rn, first_value(offer_id) OVER w AS winner FROM offers WHERE lifecycle_status = 'active'
      WINDOW w AS (PARTITION BY lower(trim(player)), trade_type, {_IDENTITY} ORDER BY posted_at DESC, offer_id DESC)) WHERE rn > 1"""),
    "lifecycle_expire": _q("SELECT CASE WHEN lifecycle_status = 'active' AND posted_at < TIMESTAMP '2001-08-01' - INTERVAL 200 HOUR THEN 'expired' ELSE lifecycle_status END AS lifecycle_status, count(*) AS n FROM offers GROUP BY 1"),
    "offer_age_histogram": _q("""SELECT CASE WHEN age < 6 THEN '0-6' WHEN age < 12 THEN '6-12' WHEN age < 24 THEN '12-24' WHEN age < 48 THEN '24-48' ELSE '>48' END AS bucket, count(*) AS n, min(posted_at) AS oldest
      FROM (SELECT *, (epoch(TIMESTAMP '2001-08-01') - epoch(posted_at)) / 3600 AS age FROM offers WHERE lifecycle_status = 'active') GROUP BY 1"""),
    "duplicate_listings": _q("SELECT player, trade_type, item_key, requirement, price_currency, price_basis, lifecycle_status, count(*) AS n, min(offer_id) AS first_offer, max(posted_at) AS last_posted FROM offers GROUP BY ALL HAVING count(*) > 1"),
    "history_over_cap": _q("SELECT offer_id FROM cap", _CAP),
    "retention_prune": _q("SELECT offer_id, market_key, posted_at FROM offers WHERE offer_id NOT IN (SELECT offer_id FROM cap) AND (offer_id IN (SELECT offer_id FROM rv) OR posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY)", _CAP),
    "retention_report": _q("""SELECT count(*) AS offers, count(rv.offer_id) AS protected, count(*) FILTER (rv.offer_id IS NULL AND posted_at < TIMESTAMP '2001-08-01' - INTERVAL 700 DAY) AS eligible,
      greatest(0, count(DISTINCT message_id) - 1000)::BIGINT AS overflow FROM offers LEFT JOIN rv USING (offer_id)""", _REVIEWED),
    "price_semantics": _q("SELECT offer_id, status, reason FROM st", _SEMANTIC),
    "price_outliers": _q("SELECT * FROM outl", _SEMANTIC),
    "price_rebuild_items": f"""WITH {_OFFERS} SELECT a.offer_id, CASE WHEN o.is_outlier THEN 'outlier' ELSE a.status END AS price_quality_status
      FROM (WITH offers AS (SELECT * FROM offers WHERE item_key IN ('brand_1', 'brand_2')){_SEMANTIC} SELECT * FROM st) a
      LEFT JOIN (WITH offers AS (SELECT * FROM offers WHERE item_key IN ('brand_1', 'brand_2')){_SEMANTIC} SELECT * FROM outl) o USING (offer_id)
      UNION ALL SELECT offer_id, price_quality_status FROM offers WHERE item_key NOT IN ('brand_1', 'brand_2')""",
    "trader_directory": _q("SELECT * FROM td", _TRADERS),
    "trader_search": _q("SELECT * FROM td WHERE contains(lower(player), '0001') ORDER BY reliability DESC, player LIMIT 50", _TRADERS),
    "trader_top_markets": _q(f"""SELECT * FROM (SELECT player, market, offers, last_posted, row_number() OVER (PARTITION BY player ORDER BY offers DESC, last_posted DESC, market)::INT AS place
      FROM (SELECT player, {_MARKET} AS market, count(*) AS offers, max(posted_at) AS last_posted FROM offers WHERE {_MARKET} IS NOT NULL GROUP BY 1, 2)) WHERE place <= 3"""),
    "trader_counts": _q("""SELECT count(DISTINCT player) AS traders, count(DISTINCT CASE WHEN posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN player END) AS recent_traders,
      count(DISTINCT CASE WHEN trade_type = 'buy' THEN player END) AS buyers, count(DISTINCT CASE WHEN trade_type = 'sell' THEN player END) AS sellers FROM offers"""),
    "market_trust": _q(f"""SELECT *, CASE WHEN trust >= 85 THEN 'Zeer hoog' WHEN trust >= 70 THEN 'Hoog' WHEN trust >= 50 THEN 'Redelijk' WHEN trust >= 30 THEN 'Laag' ELSE 'Zeer laag' END AS label
      FROM (SELECT *, round({_CLAMP.format("45 * coverage / 100::DOUBLE + 25 * least(1.0::DOUBLE, traders / 8) + 15 * least(1.0::DOUBLE, trusted / 12) + 15 - 25 * least(1.0::DOUBLE, flagged / greatest(offers, 1))")})::INT AS trust
        FROM (SELECT *, round(least(1.0::DOUBLE, trusted / offers) * 100)::INT AS coverage
          FROM (SELECT {_MARKET} AS market, count(*) AS offers, count(*) FILTER ({_TRUST}) AS trusted, count(DISTINCT player) AS traders,
            count(*) FILTER (coalesce(price_quality_status, 'trusted') IN ('uncertain', 'outlier') OR coalesce(quality_status, 'review') <> 'accepted') AS flagged FROM offers WHERE {_MARKET} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)))"""),
    "quality_issues": _q("""SELECT CASE WHEN coalesce(quality_status, 'review') = 'rejected' THEN 'rejected' WHEN coalesce(price_quality_status, 'trusted') = 'outlier' THEN 'outlier' WHEN unit_price IS NULL THEN 'no_price'
      WHEN coalesce(price_basis, 'unknown') = 'unknown' THEN 'unknown_basis' WHEN coalesce(price_quality_status, 'trusted') = 'uncertain' THEN 'uncertain' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'none' END AS issue,
      count(*) AS n, count(DISTINCT player) AS traders FROM offers GROUP BY 1"""),
    "quality_cases": _q("SELECT offer_id, item_key FROM offers WHERE coalesce(normalized_market_key, '') = '' AND coalesce(market_key, '') = ''"),
    "average_prices": _q(f"SELECT item, median(p) AS median_price, count(*) AS n FROM (SELECT item, {_SHOWN} AS p FROM offers WHERE posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY) WHERE p IS NOT NULL GROUP BY item"),
    "review_reasons": _q("""SELECT reason, count(*) AS n, count(DISTINCT item_key) AS items FROM (SELECT item_key, CASE WHEN coalesce(quality_status, 'review') = 'review' THEN 'review' WHEN confidence < 0.85 THEN 'low_confidence'
      WHEN price_quality_status IN ('uncertain', 'outlier') THEN 'price' END AS reason FROM offers) WHERE reason IS NOT NULL GROUP BY reason"""),
    "review_seed": _q("SELECT offer_id, 'pending' AS review_status FROM offers WHERE (coalesce(quality_status, 'review') = 'review' OR confidence < 0.85 OR price_quality_status IN ('uncertain', 'outlier')) AND offer_id NOT IN (SELECT offer_id FROM rv)", _REVIEWED),
    "offer_risk": _RISK,
    "market_context": _q(f"""SELECT offer_id, others, CASE WHEN others > 0 THEN round((total - coalesce(cents, 0)) / others / 100) END AS mean_price, CASE WHEN others > 0 THEN md END AS median_price FROM (SELECT *, n - (unit_price IS NOT NULL)::BIGINT AS others FROM (
      SELECT offer_id, unit_price, round(unit_price * 100)::BIGINT AS cents, count(unit_price) OVER (PARTITION BY {_MARKET}) AS n, sum(round(unit_price * 100)::BIGINT) OVER (PARTITION BY {_MARKET})::BIGINT AS total,
      median(unit_price) OVER (PARTITION BY {_MARKET} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS md FROM offers))"""),
    "global_search": _q(_search("brand#1")),
    "search_summary": _q(f"SELECT kind, count(*) AS results, sum(offers)::BIGINT AS offers FROM ({_search('red')}) GROUP BY kind"),
    "canonical_spelling": _q("""SELECT norm, arg_min(name, (-n, -length(name), name)) AS name, sum(n)::BIGINT AS n FROM (SELECT lower(trim(x)) AS norm, x AS name, count(*) AS n FROM (SELECT CASE WHEN message_id % 3 = 0 THEN upper(item) ELSE item END AS x FROM offers) GROUP BY 1, 2) GROUP BY norm"""),
    "impossible_variants": _q("SELECT offer_id, requirement, is_oldschool FROM offers WHERE item_key = 'brand_7' AND (requirement NOT BETWEEN 9 AND 13 OR is_oldschool OR (attribute_key <> '' AND attribute_key NOT IN ('small', 'large')))"),
    "variant_labels": _q(f"""SELECT offer_id, {_VARIANT} AS variant, {_IDENTITY} AS identity, {_SHOWN} AS price,
      CASE WHEN price_basis IN ('total', 'ratio', 'exchange', 'stack', 'stack_total', 'set') AND quantity > 0 THEN price_amount / quantity ELSE price_amount END AS per_item FROM offers"""),
    "daily_movers": f"""WITH {_EVENTS}, d AS (SELECT *, CASE WHEN posted_at >= TIMESTAMP '2024-01-30' THEN 'now' ELSE 'before' END AS day FROM events_v WHERE trade_type <> 'trade' AND unit_price > 0 AND posted_at >= TIMESTAMP '2024-01-29' AND posted_at < TIMESTAMP '2024-01-31'),
      t AS (SELECT item_key, day, player, median(unit_price) AS p FROM d GROUP BY ALL),
      m AS (SELECT item_key, median(p) FILTER (day = 'now') AS price, median(p) FILTER (day = 'before') AS price_before, count(*) FILTER (day = 'now') AS traders, count(*) FILTER (day = 'before') AS traders_before FROM t GROUP BY item_key)
      SELECT item_key, price, price_before, traders, traders_before, round((price - price_before) / price_before * 100, 0) AS percent FROM m
      WHERE traders >= 2 AND traders_before >= 2 AND abs((price - price_before) / price_before * 100) BETWEEN 1 AND 300""",
    "exchange_quotes": _q("""SELECT item_key, median(q) AS quote, count(*) AS traders FROM (SELECT item_key, player, median(quote) AS q FROM (SELECT item_key, player, unit_price * factor AS quote, low, high,
      row_number() OVER (PARTITION BY item_key ORDER BY posted_at DESC, offer_id DESC) AS rn FROM offers JOIN (VALUES ('brand_1', 1.0::DOUBLE, 1.0, 1e9), ('brand_2', 100.0::DOUBLE, 1.0, 1e9), ('brand_3', 0.01::DOUBLE, 1.0, 1e5), ('brand_4', 0.5::DOUBLE, 10.0, 1e6)) t(item_key, factor, low, high) USING (item_key)
      WHERE unit_price > 0 AND posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 300 DAY) WHERE rn <= 250 AND quote BETWEEN low AND high GROUP BY 1, 2) GROUP BY item_key HAVING count(*) >= 2"""),
    "hourly_snapshots": f"""WITH {_EVENTS} SELECT time_bucket(INTERVAL 6 HOUR, posted_at, TIMESTAMP '1970-01-01') AS captured_at, item_key, count(*) AS n, count(DISTINCT player) AS traders, max(unit_price) FILTER (trade_type = 'buy') AS best_wtb,
      median(unit_price) FILTER (trade_type = 'buy') AS median_wtb, min(unit_price) FILTER (trade_type = 'sell') AS best_wts, median(unit_price) FILTER (trade_type = 'sell') AS median_wts FROM events_v GROUP BY 1, 2""",
    "snapshot_changes": f"""WITH {_EVENTS}, s AS (SELECT date_trunc('day', posted_at)::TIMESTAMP AS captured_at, item_key, median(unit_price) FILTER (trade_type = 'sell') AS median_wts FROM events_v GROUP BY 1, 2)
      SELECT item_key, captured_at, median_wts, median_wts - lag(median_wts) OVER w AS change, (row_number() OVER w)::INT AS place FROM s WINDOW w AS (PARTITION BY item_key ORDER BY captured_at)""",
    "watchlist": _q("SELECT wt.market, target, item, best_wtb, best_wts, coalesce(best_wts <= target, false) AS hit FROM wt LEFT JOIN markets ON wt.market = markets.market", _INTEL + _WATCHED),
    "alert_evaluation": _q("""SELECT alert_id, market, condition_type, met, new_signature, met AND (length(market) % 2 <> 0 OR length(market) % 3 <> 0 OR new_signature IS NULL) AS fires FROM (
      SELECT *, CASE WHEN met THEN condition_type || '|' || round(v)::BIGINT::VARCHAR END AS new_signature FROM (
      SELECT *, coalesce(CASE WHEN condition_type = 'wts_below' THEN v <= target ELSE v >= target END, false) AS met FROM (SELECT wt.market || '/' || condition_type AS alert_id, wt.market, condition_type, target,
      CASE WHEN condition_type = 'wts_below' THEN best_wts ELSE best_wtb END AS v FROM wt, (VALUES ('wts_below'), ('wtb_above')) t(condition_type) LEFT JOIN markets m ON wt.market = m.market)))""", _INTEL + _WATCHED),
    "dataset_summary": """SELECT sum(n)::BIGINT AS messages, count(*) AS unique_messages, max(n) AS most_repeated, round(100 * count(*) / sum(n))::INT AS coverage
      FROM (SELECT lower(trim(role)) AS p, lower(trim(text)) AS t, count(*) AS n FROM conversations GROUP BY 1, 2)""",
    "repeated_texts": "SELECT md5(norm) AS norm, n FROM (SELECT lower(trim(text)) AS norm, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "common_terms": """SELECT term, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500))
      WHERE term NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'was', 'are', 'wtb', 'wts', 'wtt', 'each', 'von', 'der', 'die', 'das', 'les', 'des', 'que', 'los') GROUP BY term ORDER BY n DESC, term LIMIT 20""",
    "item_priority_union": _q(f"""SELECT name, priority FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY priority, name) AS rn FROM (SELECT DISTINCT raw_segment AS name, 0::INT AS priority FROM offers
      UNION ALL SELECT DISTINCT p_name, 1 FROM part UNION ALL SELECT DISTINCT p_brand, 2 FROM part)) WHERE rn = 1"""),
    "either_key_join": "SELECT DISTINCT s_suppkey, s_label, n_nationkey, n_name FROM (SELECT s_suppkey, 'nation_' || (s_suppkey % 30)::VARCHAR AS s_label FROM supplier) s JOIN nation ON s_suppkey = n_nationkey OR lower(s_label) = lower(n_name)",
    "unlisted_items": _q("SELECT p_partkey, p_name, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM offers WHERE lifecycle_status = 'active' AND quality_status = 'accepted' AND raw_segment = p_name AND item = p_brand)"),
    "item_kinds": "SELECT p_type, string_agg(p_brand, ' · ' ORDER BY p_brand) AS brands, count(*) AS n FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type",
    "unique_aliases": f"WITH {_ALIAS} SELECT * FROM ua",
    "strict_gate": f"""WITH {_OFFERS}, {_ALIAS}, o AS (SELECT offer_id, item_key, CASE substr(offer_id, 1, 1) WHEN '0' THEN 'unknown' WHEN '1' THEN upper(raw_segment) WHEN '2' THEN raw_segment || ' x' ELSE raw_segment END AS item FROM offers)
      SELECT CASE WHEN item = 'unknown' THEN 'placeholder' WHEN lower(trim(item)) IN (SELECT lower(trim(name)) FROM items) THEN 'name' WHEN item_key IN (SELECT item_key FROM items) THEN 'key'
      WHEN {_TIDY('item')} IN (SELECT alias FROM ua) THEN 'alias' ELSE 'missing' END AS gate, count(*) AS n FROM o GROUP BY 1""",
    "profile_cascade": f"""WITH {_ITEMS} SELECT item_key, CASE WHEN length(name) % 5 = 0 THEN 'p_' || name WHEN category <> 'SMALL' THEN lower(category) ELSE 'generic' END AS profile,
      CASE WHEN length(name) % 5 = 0 THEN 'requirement' WHEN category <> 'SMALL' THEN 'attribute,oldschool' ELSE '' END AS track FROM items""",
    "chat_offers": _q("""SELECT offer_id, trade_type, raw_segment AS item, 'q' || requirement::VARCHAR AS requirement, floor(price_amount) AS price_amount, cur AS price_currency,
      CASE qn % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'ratio' WHEN 2 THEN 'exchange' ELSE 'total' END AS price_basis, qn::DOUBLE AS quantity,
      CASE cur WHEN 'a' THEN floor(price_amount) * 27 WHEN 'e' THEN floor(price_amount) ELSE floor(price_amount) / 15 END / qn AS unit_price
      FROM (SELECT *, quantity::INT AS qn, CASE requirement % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'e' ELSE 'k' END AS cur FROM offers)"""),
    "payload_ingest": "SELECT 'chat:' || (event_id % 7000)::VARCHAR AS source_key, count(*) AS n FROM events GROUP BY 1",
    "catalog_merge": """SELECT item_key, CASE WHEN length(item_key) % 2 = 0 THEN name ELSE lower(name) END AS name,
      array_to_string(CASE WHEN length(item_key) % 2 = 0 THEN list_sort(list_distinct(list_append(types, name))) ELSE list_sort(types) END, ',') AS aliases
      FROM (SELECT p_name AS item_key, min(p_brand) AS name, list(DISTINCT p_type) AS types FROM part GROUP BY p_name)""",
    "cached_names": "SELECT p_brand AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region",
    "platform_trends": _q("SELECT strftime(posted_at, '%Y-%m') AS month, count(*) AS offers, count(DISTINCT player) AS traders, max(posted_at) AS last_posted FROM offers GROUP BY 1"),
    "page_text": "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href='))::INT AS links FROM pages",
    "validation_queue": f"""SELECT offer_id, CASE WHEN message_id % 5 = 0 AND message_id % 3 = 0 THEN 'validated' WHEN risky THEN 'queued' ELSE 'skipped' END AS status, risk
      FROM ({_RISK}) JOIN ({_q("SELECT offer_id, message_id FROM offers")}) USING (offer_id)""",
    "alias_repeats": f"""SELECT p_type AS item_key, {_TIDY("alias")} AS alias, min(alias) AS kept, count(*) AS n
      FROM (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', ' ') END AS alias FROM part) GROUP BY 1, 2""",
    "group_items": f"""WITH {_ITEMS} SELECT DISTINCT s_suppkey AS id, p_brand AS "group", item_key, name
      FROM supplier JOIN part ON {_TIDY("p_brand")} = 'brand ' || (s_suppkey % 60)::VARCHAR JOIN items ON p_name = name""",
    "item_encyclopedia": f"""WITH {_OFFERS}, {_ITEMS}, f AS (SELECT lower(trim(raw_segment)) AS k, count(*) AS n, count(*) FILTER (lifecycle_status = 'active') AS a, count(DISTINCT player) AS t, max(posted_at) AS last_posted FROM offers GROUP BY 1)
      SELECT item_key, name, category, coalesce(n, 0) AS offers, coalesce(a, 0) AS active, coalesce(t, 0) AS traders, last_posted FROM items LEFT JOIN f ON lower(trim(name)) = k""",
    "sane_times": "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2024-02-01' ELSE date_trunc('second', ts)::TIMESTAMP END AS at FROM events",
}


def _gate_sql() -> str:
    """The gate's table as one CASE over the words of a conversation's turns."""
    from ..functions.values import GATE

    quoted = lambda p: "'" + p.strip("^$").replace("'", "''") + "'"
    test = lambda p: f"w = ' ' || {quoted(p)} || ' '" if p[0] == "^" and p[-1] == "$" else f"starts_with(w, ' ' || {quoted(p)} || ' ')" if p[0] == "^" else f"contains(w, ' ' || {quoted(p)} || ' ')"
    stated = " OR ".join(f"contains(w, ' {x} ')" for x in ("wtb", "buying", "wts", "selling", "wtt", "trading"))
    whens = "".join(f" WHEN ({' OR '.join(map(test, ps))}){'' if always else f' AND NOT ({stated})'} THEN {{'kind': '{kind}', 'reason': '{reason}'}}" for kind, reason, always, ps in GATE)
    return f"""SELECT g.kind AS kind, g.reason AS reason, count(*) AS n FROM (SELECT CASE WHEN trim(w) = '' THEN {{'kind': 'noise', 'reason': 'empty'}}{whens} ELSE {{'kind': 'market', 'reason': 'market_candidate'}} END AS g
      FROM (SELECT ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+|[:?]'), ' ') || ' ' AS w FROM conversations)) GROUP BY ALL"""


ORACLE_SQL["message_gate"] = _gate_sql()
