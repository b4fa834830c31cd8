"""The query of the resolver's strategies, with its SQL: order lines as clauses of ten shapes over a catalog made from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import strategies
from ..sources.market import offers, table
from .oracle import _OFFERS, _TIDY
from .queries import Query

c = F.col
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ONE, _TWO = "split_part({0}, ' ', 1)", "split_part({0}, ' ', 2)"
_PROFESSION = "CASE {0} WHEN 'small' THEN 'monk' WHEN 'red' THEN 'mesmer' WHEN 'blue' THEN 'warrior' WHEN 'hot' THEN 'ranger' WHEN 'old' THEN 'ritualist' WHEN 'large' THEN 'dervish' WHEN 'new' THEN 'paragon' ELSE 'assassin' END"


def _name(part: str) -> str:
    """An item's name from a part's: weapons of four families, miniatures, tomes, and others of four words."""
    a, noun = _ONE.format(part), _TWO.format(part)
    return f"""CASE {noun} WHEN 'ring' THEN {a} || 'crest sword' WHEN 'widget' THEN {a} || 'gold shield' WHEN 'bolt' THEN {a} || 'ember staff' WHEN 'gear' THEN {a} || ' demon axe' WHEN 'rod' THEN 'miniature ' || {a} || ' drake'
      WHEN 'plate' THEN 'elite ' || {_PROFESSION.format(a)} || ' tome' ELSE 'great ' || {a} || ' ' || {noun} || ' stone' END"""


def _alias(part: str) -> str:
    return f"substr({_ONE.format(part)}, 1, 1) || {_TWO.format(part)}"


_LAST = "CASE WHEN split_part(name, ' ', 3) = '' THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 3) END"
_A = _ONE.format("raw_segment")
_ITEM = f"""CASE message_id % 10 WHEN 0 THEN name WHEN 1 THEN {_LAST} WHEN 2 THEN 'Axe' WHEN 3 THEN {_LAST} WHEN 4 THEN 'Elite Tomes' WHEN 5 THEN 'Minis' WHEN 6 THEN name || ', great ' || {_A} || ' anvil stone'
  WHEN 7 THEN name || ' and unheard of' WHEN 8 THEN name ELSE 'stuff' END"""
_SEGMENT = f"""CASE message_id % 10 WHEN 0 THEN 'q9 ' || name || ' insc 5e' WHEN 1 THEN 'Q9 ' || name WHEN 2 THEN CASE WHEN requirement % 2 = 0 THEN name ELSE {_alias("raw_segment")} END || ' 12e' WHEN 3 THEN substr(name, 1, length(name) - 2) || ' os'
  WHEN 4 THEN 'elite tomes ' || requirement || ' mes monk' WHEN 5 THEN CASE requirement % 3 WHEN 0 THEN 'unded ' WHEN 1 THEN 'ded ' ELSE '' END || {_A} || ' drake' || CASE WHEN requirement % 5 = 0 THEN ' tonic' ELSE '' END
  WHEN 8 THEN 'cheap 5e' WHEN 9 THEN 'great ' || {_A} || ' ' || {_TWO.format("raw_segment")} ELSE '' END"""

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_says = lambda at, xs: "(" + " OR ".join(f"contains({at}, ' {x} ')" for x in xs) + ")"
_GENERIC = _quoted(strategies.GENERIC)
_STATES = strategies.UNDEDICATED + strategies.DEDICATED
_TELLING = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_quoted(strategies.PLAIN_WORDS)}, {_GENERIC}) AND NOT regexp_full_match(w, '[qrx]?\\d+')))"
_STARTS = lambda x, y: f"(length({y}) >= 4 AND starts_with({x}, {y}))"

SQL = f"""WITH {_OFFERS}, items AS (SELECT name, 'item_' || min(p_partkey)::VARCHAR AS item_key FROM (SELECT *, {_name("p_name")} AS name FROM part) GROUP BY name),
  al AS (SELECT DISTINCT {_alias("p_name")} AS alias, item_key FROM part JOIN items ON name = {_name("p_name")}),
  lab AS (SELECT alias, min(item_key) AS item_key FROM (SELECT name AS alias, item_key FROM items UNION ALL FROM al) WHERE alias NOT IN ({_GENERIC}) GROUP BY alias HAVING count(DISTINCT item_key) = 1),
  l AS MATERIALIZED (SELECT alias, item_key, name, {_TELLING("alias")} AS lw, replace(alias, ' ', '') AS joined FROM lab JOIN items USING (item_key)),
  o AS (SELECT offer_id, {_ITEM} AS item, {_SEGMENT} AS seg FROM (SELECT *, {_name("raw_segment")} AS name FROM offers)),
  whole AS (SELECT DISTINCT item, seg FROM o),
  lists AS (SELECT *, contains(item, 'miniature') AS mini, regexp_extract({_TIDY("parts[-1]")}, '[a-z0-9]+$') AS tail FROM (SELECT item AS list_item, seg AS list_seg, item, string_split(replace(item, ' and ', ', '), ', ') AS parts FROM whole) WHERE len(parts) > 1),
  parts AS (SELECT *, unnest(range(len(parts)))::INT AS pos FROM lists), bare AS (SELECT *, CASE WHEN mini THEN trim(replace(' ' || parts[pos + 1] || ' ', ' miniature ', ' ')) ELSE parts[pos + 1] END AS b, CASE WHEN mini THEN trim(replace(' ' || parts[1] || ' ', ' miniature ', ' ')) ELSE parts[1] END AS one FROM parts),
  forms AS (SELECT list_item, list_seg, pos, mini, 0 AS form, b AS said FROM bare UNION ALL SELECT list_item, list_seg, pos, mini, 1, string_split(one, ' ')[1] || ' ' || b FROM bare WHERE contains(one, ' ') UNION ALL SELECT list_item, list_seg, pos, mini, 2, b || ' ' || tail FROM bare WHERE NOT mini AND tail IN ({_GENERIC})),
  readings AS (SELECT * REPLACE (CASE WHEN mini THEN 'miniature ' || said ELSE said END AS said) FROM forms),
  t AS MATERIALIZED (SELECT item, seg, {_TIDY("item")} AS it, {_TIDY("CASE WHEN seg <> '' THEN seg ELSE item END")} AS cl FROM (FROM whole UNION SELECT said, said FROM readings)),
  prof(x, p) AS (VALUES {", ".join(f"('{w}', '{p}')" for w, p in strategies.profession_words())}),
  tomes AS (SELECT item, seg, item_key, min(coalesce(try_cast(w[i - 1] AS INT), try_cast(w[i + 1] AS INT))) AS quantity FROM (SELECT *, string_split(cl, ' ') AS w, unnest(range(1, len(string_split(cl, ' ')) + 1)) AS i FROM t WHERE it IN ({_quoted(strategies.TOMES)}))
    JOIN prof ON w[i] = x JOIN l ON alias = CASE WHEN starts_with(it, 'elite') THEN 'elite ' ELSE '' END || p || ' tome' GROUP BY ALL),
  short AS (SELECT alias, item_key FROM l WHERE name LIKE 'miniature %' AND length(alias) >= 4 UNION SELECT regexp_replace(alias, '^miniature ', ''), item_key FROM l WHERE name LIKE 'miniature %'), shorts AS (FROM short WHERE length(alias) >= 4),
  mi AS (SELECT *, ' ' || it || ' ' || cl || ' ' AS every, ' ' || cl || ' ' AS own, (SELECT count(DISTINCT item_key) FROM shorts WHERE contains(' ' || it || ' ' || cl || ' ', ' ' || alias || ' ')) AS n,
    (SELECT min(item_key) FROM shorts WHERE contains(' ' || it || ' ' || cl || ' ', ' ' || alias || ' ')) AS k FROM t WHERE {_says("' ' || it || ' ' || cl || ' '", strategies.MINI_WORDS)} OR it IN (SELECT alias FROM short WHERE alias NOT LIKE 'miniature %')),
  minis AS (SELECT item, seg, k, CASE WHEN {_says("every", strategies.UNDEDICATED)} THEN 'unded' WHEN {_says("every", strategies.DEDICATED)} THEN 'ded' END AS variant,
    CASE WHEN {_says("own", ["potion", "tonic"])} AND NOT {_says("own", strategies.MINI_WORDS + _STATES)} THEN 'miniature_context_conflict' WHEN NOT {_says("every", _STATES)} THEN 'miniature_variant_unresolved' WHEN n = 0 THEN 'catalog_first_unresolved' WHEN n > 1 THEN 'miniature_bundle_unresolved' END AS reason FROM mi),
  e AS (SELECT item, seg, it IN ({_GENERIC}) AS kind, item_key, max(length(alias)) AS len, max(length(alias)) FILTER (CASE WHEN it NOT IN ({_GENERIC}) THEN true ELSE contains(' ' || name || ' ', ' ' || CASE it WHEN 'staves' THEN 'staff' ELSE regexp_replace(string_split(it, ' ')[1], 's$', '') END) END) AS fit
    FROM t, l WHERE length(alias) >= 4 AND contains(' ' || cl || ' ', ' ' || alias || ' ') GROUP BY ALL),
  longest AS (SELECT item, seg, min(item_key) AS item_key FROM e WHERE fit = (SELECT max(fit) FROM e e2 WHERE e2.item = e.item AND e2.seg = e.seg) GROUP BY ALL HAVING count(*) = 1),
  lone AS (SELECT item, seg, min(item_key) AS item_key FROM e WHERE kind AND len >= 6 GROUP BY ALL HAVING count(*) = 1),
  cw AS MATERIALIZED (SELECT *, {_TELLING("cl")} AS cw FROM t),
  ev AS (SELECT item, seg, it, item_key, max({{'s': CASE WHEN len(lw) > 1 THEN 100 + least(20, 5 * len(list_intersect(lw, cw))) + least(10, 2 * len(lw)) WHEN length(lw[1]) < 7 THEN 0 WHEN len(list_intersect(lw, cw)) = 1 THEN 105 ELSE 90 END, 'n': length(alias)}}) AS s FROM cw, l
    WHERE len(lw) > 0 AND len(cw) > 0 AND length(alias) >= 5 AND len(list_filter(lw, lambda x: len(list_filter(cw, lambda y: x = y OR {_STARTS("x", "y")} OR {_STARTS("y", "x")} OR (length(y) >= 6 AND contains(joined, y)))) > 0)) = len(lw) GROUP BY ALL),
  words AS (SELECT item, seg, item_key FROM ev QUALIFY rank() OVER (PARTITION BY item, seg ORDER BY s DESC) = 1 AND count(*) OVER (PARTITION BY item, seg, s) = 1 AND s.s >= CASE WHEN it IN ({_GENERIC}) THEN 80 ELSE 100 END),
  pr AS (SELECT item, seg, item_key, v, max(CASE WHEN w = v THEN 3 WHEN starts_with(w, v) OR starts_with(v, w) THEN 2 ELSE 0 END) AS p FROM (SELECT *, unnest(list_distinct(string_split(cl, ' '))) AS w FROM t), (SELECT item_key, unnest(list_distinct(string_split(name, ' '))) AS v FROM items) WHERE length(w) >= 4 AND length(v) >= 4 GROUP BY ALL),
  pf AS (SELECT item, seg, item_key FROM (SELECT item, seg, item_key, sum(p) AS s FROM pr GROUP BY ALL HAVING sum(p) >= 5) QUALIFY rank() OVER (PARTITION BY item, seg ORDER BY s DESC) = 1 AND count(*) OVER (PARTITION BY item, seg, s) = 1),
  f AS (SELECT t.item, t.seg, 1 AS r, 'tome' AS strategy, item_key, NULL AS variant, quantity, CASE WHEN item_key IS NULL THEN 'insufficient_item_identity' END AS reason FROM t LEFT JOIN tomes USING (item, seg) WHERE it IN ({_quoted(strategies.TOMES)})
    UNION ALL SELECT item, seg, 2, 'miniature', CASE WHEN reason IS NULL THEN k END, CASE WHEN reason IS NULL THEN variant END, NULL, reason FROM minis UNION ALL SELECT item, seg, 3, 'longest_label', item_key, NULL, NULL, NULL FROM longest UNION ALL SELECT item, seg, 4, 'only_label', item_key, NULL, NULL, NULL FROM lone
    UNION ALL SELECT item, seg, 5, 'all_words', item_key, NULL, NULL, NULL FROM words UNION ALL SELECT item, seg, 6, 'name', item_key, NULL, NULL, NULL FROM t JOIN l ON it = alias UNION ALL SELECT item, seg, 7, 'evidence', item_key, NULL, NULL, NULL FROM pf),
  found AS MATERIALIZED (SELECT * FROM f QUALIFY r = min(r) OVER (PARTITION BY item, seg)),
  best AS (SELECT list_item, list_seg, pos, min(form) FILTER (item_key IS NOT NULL) AS form FROM readings LEFT JOIN found ON said = item AND said = seg GROUP BY ALL),
  known AS (SELECT list_item, list_seg FROM best GROUP BY ALL HAVING count(*) = count(form)),
  means AS (SELECT k.list_item AS item, k.list_seg AS seg, pos, true AS in_list, found.item_key, strategy, variant, quantity, reason FROM known k JOIN best USING (list_item, list_seg) JOIN readings USING (list_item, list_seg, pos, form) JOIN found ON said = found.item AND said = found.seg WHERE item_key IS NOT NULL
    UNION ALL SELECT item, seg, 0, false, item_key, strategy, variant, quantity, reason FROM found WHERE NOT EXISTS (SELECT 1 FROM known WHERE list_item = item AND list_seg = seg))
  SELECT o.offer_id, coalesce(pos, 0)::INT AS pos, item_key, strategy, coalesce(in_list, false) AS in_list, variant, quantity::INT AS quantity, CASE WHEN item_key IS NULL THEN coalesce(reason, CASE WHEN {_TIDY("item")} IN ({_GENERIC}) THEN 'insufficient_item_identity' ELSE 'catalog_first_unresolved' END) END AS reason
  FROM o LEFT JOIN means USING (item, seg)"""


def resolver_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of every order line's clause, or of every part of its list, and the strategy that found it."""
    named = table(spark, sf_dir, "part").withColumn("name", F.expr(_name("p_name")))
    items = named.groupBy("name").agg(F.concat(F.lit("item_"), F.min("p_partkey").cast("string")).alias("item_key"))
    aliases = named.select("name", F.expr(_alias("p_name")).alias("alias")).distinct().join(items, "name").select("alias", "item_key")
    said = offers(spark, sf_dir).withColumn("name", F.expr(_name("raw_segment")))
    return strategies.resolve(said.select("offer_id", F.expr(_ITEM).alias("item"), F.expr(_SEGMENT).alias("segment")), items, aliases)


QUERIES["resolver_strategies"], ORACLE_SQL["resolver_strategies"] = resolver_strategies, SQL
