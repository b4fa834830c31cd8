"""Queries over messages: lists in them, rewriting, parsing again; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewriting
from ..operators import catalog, knowledge, lists, reparse
from ..operators.ranking import shared_dir
from ..sources import payload
from ..sources.market import table
from .oracle import _ITEMS
from .queries import Query, _items

c = F.col

#: Every order as a list of its goods, in one of seven ways to write one; the SQL states what each way means.
_ORDERED = "SELECT o_orderkey AS id, p_name AS name, max(p_size) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, p_name"
_WRITTEN = """CASE id % 7
  WHEN 0 THEN concat('WTS ', array_join(transform(goods, g -> concat(g.name, ' q', g.q)), ', '))
  WHEN 1 THEN concat('WTB Q', high, ' | ', array_join(transform(goods, g -> g.name), ' | '))
  WHEN 2 THEN concat('WTS ', goods[0].name, ' | Air Q9/11 | Blood Q', goods[0].q)
  WHEN 3 THEN concat('WTS unded minis: ', array_join(transform(goods, g -> g.name), ', '), ' & red ring 5e each')
  WHEN 4 THEN concat('WTB Q8 Staves | ', array_join(transform(goods, (g, i) -> concat(g.name, if(i = 0, ' (OS)', ''))), ' | '))
  WHEN 5 THEN concat('WTS ', array_join(transform(goods, g -> concat('q', g.q, ' ', g.name)), ' '))
  ELSE concat('WTT ', goods[0].name, ' // q', goods[0].q, ' Heal 6e, Fire 4e/ea ~ q5-7 sr') END"""


def written_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, message): orders as lists."""
    for name in ("orders", "lineitem", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_lists_{name}")
    rows = spark.sql(_ORDERED.replace("FROM orders", "FROM _lists_orders AS orders").replace("JOIN lineitem", "JOIN _lists_lineitem AS lineitem").replace("JOIN part", "JOIN _lists_part AS part"))
    goods = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "q"))).alias("goods"), F.max("q").alias("high"))
    return goods.select(c("id").alias("message_id"), F.expr(_WRITTEN).alias("message"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names, as they are, as miniatures and as staves."""
    items = _items(spark, sf_dir)
    made = [items.select(F.lower("name").alias("alias"), "item_key", "name")]
    made.append(items.select(F.concat(F.lit("miniature "), F.lower("name")).alias("alias"), F.concat(F.lit("mini_"), "item_key").alias("item_key"), F.concat(F.lit("Miniature "), "name").alias("name")))
    made.append(items.select(F.concat(F.lower("name"), F.lit(" staff")).alias("alias"), F.concat(F.lit("staff_"), "item_key").alias("item_key"), F.concat("name", F.lit(" Staff")).alias("name")))
    return made[0].unionByName(made[1]).unionByName(made[2])


def list_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers read from lists of seven shapes: own and common requirements, variants of one item, headings, no separators."""
    found = lists.list_offers(written_lists(spark, sf_dir), _known(spark, sf_dir))
    return found.select("message_id", "trade_type", "item_key", "requirement", "attribute", "dedication", "oldschool", c("price.amount").alias("amount"), c("price.basis").alias("basis"))


_LIST_OFFERS = f"""WITH {_ITEMS}, o AS ({_ORDERED}), k AS (SELECT o.*, item_key, row_number() OVER (PARTITION BY id ORDER BY name) AS nth, max(q) OVER (PARTITION BY id) AS high FROM o JOIN items USING (name)),
  ring AS (SELECT item_key AS ring FROM items WHERE name = 'red ring'),
  f AS (SELECT * FROM k WHERE nth = 1),
  v(way, requirement, attribute, amount, basis) AS (VALUES (2, 'q9', 'air magic', NULL, 'unknown'), (2, 'q11', 'air magic', NULL, 'unknown'), (2, '', 'blood magic', NULL, 'unknown'), (6, '', 'healing prayers', 6.0, 'unqualified'), (6, '', 'fire magic', 4.0, 'each'),
    (6, 'q5', 'soul reaping', NULL, 'unknown'), (6, 'q6', 'soul reaping', NULL, 'unknown'), (6, 'q7', 'soul reaping', NULL, 'unknown'))
  SELECT id AS message_id, 'sell' AS trade_type, item_key, 'q' || q AS requirement, NULL AS attribute, NULL AS dedication, false AS oldschool, NULL::DOUBLE AS amount, 'unknown' AS basis FROM k WHERE id % 7 IN (0, 5)
  UNION ALL SELECT id, 'buy', item_key, 'q' || high, NULL, NULL, false, NULL, 'unknown' FROM k WHERE id % 7 = 1
  UNION ALL SELECT id, CASE way WHEN 2 THEN 'sell' ELSE 'trade' END, item_key, CASE requirement WHEN '' THEN 'q' || q ELSE requirement END, attribute, NULL, false, amount, basis FROM f JOIN v ON id % 7 = way
  UNION ALL SELECT id, 'sell', 'mini_' || item_key, NULL, NULL, 'undedicated', false, 5.0, 'each' FROM k WHERE id % 7 = 3
  UNION ALL SELECT DISTINCT id, 'sell', 'mini_' || ring, NULL, NULL, 'undedicated', false, 5.0, 'each' FROM k, ring WHERE id % 7 = 3
  UNION ALL SELECT id, 'buy', 'staff_' || item_key, 'q8', NULL, NULL, nth = 1, NULL, 'unknown' FROM k WHERE id % 7 = 4"""

QUERIES: dict[str, Query] = {"list_offers": list_offers}
ORACLE_SQL: dict[str, str] = {"list_offers": _LIST_OFFERS}


#: Messages with a part's name turned round, a requirement, and goods in the trade's own words.
_SHORT = "CASE l_linenumber % 3 WHEN 0 THEN 'zkeys' WHEN 1 THEN 'stack of obi shards' ELSE 'elite ele tomes' END"
_LONG = "CASE l_linenumber % 3 WHEN 0 THEN 'Zaishen Key' WHEN 1 THEN 'Obsidian Shard' ELSE 'Elite Elementalist Tome' END"
_TURNED = "split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)"
_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def rewritten_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages rewritten by the standard table, by learned aliases (pass 0) and by the parts' names (pass 2)."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    names = parts.select("p_name").distinct()
    rules = spark.createDataFrame(rewriting.standard(), "pass int, phrase string, replacement string")
    rules = rules.unionByName(rewriting.learned(names.select(F.expr(_TURNED).alias("alias"), c("p_name").alias("name"))))
    rules = rules.unionByName(names.select(F.lit(2).alias("pass"), c("p_name").alias("phrase"), F.upper("p_name").alias("replacement")))
    lines = table(spark, sf_dir, "lineitem").join(parts, c("l_partkey") == c("p_partkey"))
    said = lines.select(*_LINES.split(", "), F.expr(f"'WTS ' || {_TURNED} || ' req ' || p_size || ' insc, ' || {_SHORT} || ' ' || cast(l_quantity AS int) || 'e'").alias("message"))
    return said.withColumn("message", rewriting.rewritten(c("message"), rules))


_MARKET_SCHEMA = "market string, n long, low double, high double"
_OFFER_SCHEMA = "message_id long, market string, price double"


def _prices(rate: float):
    """A parser of the messages of ``reparsed_markets``: what stands before the price is the market, armbraces cost ``rate``."""

    def parse(messages: DataFrame) -> DataFrame:
        market, amount, coin = (F.regexp_extract("message", r"^WT[SB] (.*) (\d+)([aek])$", k) for k in (1, 2, 3))
        price = amount.try_cast("double") * F.when(coin == "a", rate).when(coin == "k", 1 / 16).otherwise(1.0)
        return messages.where("message LIKE 'WT%'").select("message_id", market.alias("market"), price.alias("price"))

    return parse


def _summary(offers: DataFrame) -> DataFrame:
    return offers.groupBy("market").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


def reparsed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets after a full parse at one rate and a targeted one at another, of the messages that name armbraces."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    text = "concat('WTS ', c_mktsegment, ' ', o_orderkey % 97, ' ', cast(floor(o_totalprice) AS bigint), element_at(array('a', 'e', 'k', 'e', 'e'), cast(o_orderkey % 5 AS int) + 1))"
    messages = o.select(c("o_orderkey").alias("message_id"), F.expr(text).alias("message"))
    at = f"{shared_dir(spark)}/reparse-{uuid.uuid4().hex}"
    reparse.full(messages, _prices(26.0), _summary, at)
    reparse.targeted(messages, messages.where("message LIKE '%a' AND message_id % 2 = 0"), _prices(27.0), _summary, at, _OFFER_SCHEMA, _MARKET_SCHEMA)
    return reparse.read(spark, f"{at}/markets", _MARKET_SCHEMA).drop("part")


QUERIES |= {"rewritten_messages": rewritten_messages, "reparsed_markets": reparsed_markets}
ORACLE_SQL |= {
    "rewritten_messages": f"SELECT {_LINES}, 'WTS ' || upper(p_name) || ' q' || p_size::VARCHAR || ' inscribable, ' || {_LONG} || ' ' || l_quantity::INT::VARCHAR || 'e' AS message FROM lineitem JOIN part ON l_partkey = p_partkey",
    "reparsed_markets": """SELECT c_mktsegment || ' ' || (o_orderkey % 97)::VARCHAR AS market, count(*) AS n, min(price) AS low, max(price) AS high FROM (SELECT *, floor(o_totalprice)::DOUBLE *
      CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 27.0 ELSE 26.0 END WHEN 2 THEN 1 / 16.0 ELSE 1.0 END::DOUBLE AS price FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
}


def knowledge_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: numbers redirect to their half until one that is a page of its own; some run in circles. Published, then read."""
    p = table(spark, sf_dir, "part")
    page = c("p_size") % 7 == 0
    number = lambda k: F.concat(F.lit("part "), k.cast("string"))
    to = F.when(c("p_size") % 11 == 0, c("p_partkey")).otherwise(F.floor(c("p_partkey") / 2))
    pages = p.where(page).select(number(c("p_partkey")).alias("title"), c("p_partkey").alias("pageid"), c("p_size").alias("fetched_at"), "p_name")
    root = f"{shared_dir(spark)}/pack-{uuid.uuid4().hex}"
    packed = knowledge.pack(pages, p.where(~page).select(number(c("p_partkey")).alias("source"), number(to).alias("target")))
    knowledge.publish(spark, root, knowledge.write_version(packed, root))
    return knowledge.read(spark, root).select("title", "p_name", F.size("aliases").cast("long").alias("n"), F.array_join("aliases", ",").alias("aliases"))


QUERIES |= {"knowledge_pack": knowledge_pack}
ORACLE_SQL |= {
    "knowledge_pack": """WITH RECURSIVE r AS (SELECT p_partkey AS source, CASE WHEN p_size % 11 = 0 THEN p_partkey ELSE p_partkey // 2 END AS target FROM part WHERE p_size % 7 <> 0),
      walk AS (SELECT source, target, 1 AS n FROM r WHERE source <> target UNION ALL SELECT walk.source, r.target, n + 1 FROM walk JOIN r ON walk.target = r.source WHERE r.source <> r.target),
      ends AS (SELECT source, target FROM walk WHERE target NOT IN (SELECT source FROM r))
      SELECT 'part ' || p_partkey::VARCHAR AS title, p_name, count(source) AS n, coalesce(string_agg('part ' || source::VARCHAR, ',' ORDER BY 'part ' || source::VARCHAR), '') AS aliases
      FROM part LEFT JOIN ends ON target = p_partkey WHERE p_size % 7 = 0 GROUP BY p_partkey, p_name""",
}


def nested_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as catalogs of one to three levels, whose inner groups say their type or leave it, and read back."""
    names = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    groups = names.groupBy("p_type").agg(F.collect_list(F.struct(c("p_name").alias("name"), "aliases")).alias("items"), F.length("p_type").alias("n"))
    one, inner = F.struct(c("p_type").alias("type"), "items"), F.struct("items")
    two = F.struct(F.lit("outer").alias("type"), F.array(one).alias("groups"))
    three = F.struct(c("p_type").alias("type"), F.array(F.struct(F.array(inner).alias("children"))).alias("items"))
    body = F.when(c("n") % 3 == 0, F.to_json(one)).when(c("n") % 3 == 1, F.to_json(F.array(two))).otherwise(F.to_json(three))
    found = payload.nested_catalog(groups.select(body.alias("body")), "body")
    return found.select("type", "name", F.array_join("aliases", ",").alias("aliases"))


QUERIES |= {"nested_import": nested_import}
ORACLE_SQL |= {"nested_import": "SELECT p_type AS type, p_name AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS aliases FROM part GROUP BY p_type, p_name"}


_SAID_TIGHT = "'WTS ' || CASE l_linenumber % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN 'fake ' || p_name ELSE p_name || ' set' END || ' now'"


def compact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names in messages, with and without a blank; not after 'fake' nor before 'set'."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    said = lines.select(F.concat_ws("|", *_LINES.split(", "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("id"), F.expr(_SAID_TIGHT).alias("message"))
    names = _items(spark, sf_dir).select(c("name").alias("alias"), "item_key")
    vetoes = names.select("alias", F.lit("before").alias("side"), F.lit("fake").alias("word")).unionByName(names.select("alias", F.lit("after").alias("side"), F.lit("set").alias("word")))
    return catalog.compact_join(said, names, "message", "id", vetoes)


QUERIES |= {"compact_matches": compact_matches}
ORACLE_SQL |= {
    "compact_matches": f"""WITH {_ITEMS} SELECT concat_ws('|', {_LINES}, l_extendedprice::DECIMAL(18,2), l_quantity::INT) AS id, p_name AS alias, item_key, 1::INT AS start, CASE l_linenumber % 4 WHEN 0 THEN 2 ELSE 1 END::INT AS words
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN items ON name = p_name WHERE l_linenumber % 4 IN (0, 1)""",
}
