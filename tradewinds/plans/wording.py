"""Queries of the rules on words, over texts composed from order lines and the rules' own phrases; each SQL states the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import upkeep
from ..sources.market import offers
from .oracle import _OFFERS
from .queries import Query

c = F.col
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _quote(x) -> str:
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)


#: The k-th word of a line is the one at this place, modulo the number of words.
_PLACE = "(message_id * {a} + requirement * {b} + cast(quantity AS bigint))"


def _worded(spark: SparkSession, sf_dir: str, *lists: list[str]) -> DataFrame:
    """Offers with a word w0, w1, ... from each list, by numbers of the line."""
    o = offers(spark, sf_dir)
    for k, xs in enumerate(lists):
        o = o.withColumn(f"w{k}", F.get(F.array(*map(F.lit, xs)), F.expr(f"cast({_PLACE.format(a=2 * k + 1, b=k + 3)} % {len(xs)} AS int)")))
    return o


def _worded_sql(*lists: list[str]) -> str:
    return f"{_OFFERS}, s AS (SELECT *, " + ", ".join(f"[{', '.join(map(_quote, xs))}][1 + {_PLACE.format(a=2 * k + 1, b=k + 3)} % {len(xs)}] AS w{k}" for k, xs in enumerate(lists)) + " FROM offers)"


_W = lambda x: f"' ' || array_to_string(regexp_extract_all(lower({x}), '[a-z0-9'']+|[:?]'), ' ') || ' '"
#: Whether words ``w`` hold ``phrase``, which ^ and $ tie to the ends.
_HOLDS = "CASE WHEN starts_with(phrase, '^') AND ends_with(phrase, '$') THEN w = ' ' || phrase[2:-2] || ' ' WHEN starts_with(phrase, '^') THEN starts_with(w, ' ' || phrase[2:] || ' ') ELSE contains(w, ' ' || phrase || ' ') END"

_KINDS = [(k, kind, x) for k, (kind, xs) in enumerate(values.FAMILY_WORDS.items()) for x in xs]
_KIND_WORDS = [x for _, _, x in _KINDS]
_GENERIC = ", ".join(map(_quote, _KIND_WORDS))
_NAMED = "CASE message_id % 4 WHEN 0 THEN raw_segment || ' ' || w0 WHEN 1 THEN w0 WHEN 2 THEN upper(w0) || '-' || raw_segment ELSE raw_segment END"


@_add("item_taxonomy", f"""WITH {_worded_sql(_KIND_WORDS)}, t AS (SELECT {_W(_NAMED)} AS w FROM s), k(k, kind, phrase) AS (VALUES {_rows(_KINDS)}), u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
  f AS (SELECT w, n, arg_min(kind, k) AS kind FROM u LEFT JOIN k ON contains(w, ' ' || phrase || ' ') GROUP BY ALL) SELECT kind, trim(w) IN ({_GENERIC}) AS generic, sum(n)::BIGINT AS n FROM f GROUP BY ALL""")
def item_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of goods of names with and without a word of a kind."""
    said = _worded(spark, sf_dir, _KIND_WORDS).select(F.expr(_NAMED).alias("said"))
    return said.groupBy(upkeep.kind_of(c("said")).alias("kind"), upkeep.is_generic(c("said")).alias("generic")).agg(F.count("*").alias("n"))


_OPEN = [(k, reason, x) for k, (reason, xs) in enumerate(values.RESIDUALS) for x in xs]
_OPEN_WORDS = [x for _, _, x in _OPEN]
_OPEN_ITEM = "CASE message_id % 3 WHEN 0 THEN w1 ELSE raw_segment END"
_OPEN_SEGMENT = "CASE requirement % 4 WHEN 0 THEN raw_segment || ' 5e' WHEN 1 THEN 'WTB ' || w0 WHEN 2 THEN w0 || ', ' || w2 || ' ' || raw_segment ELSE 'x' || w0 || 's' END"


@_add("residual_reasons", f"""WITH {_worded_sql(_OPEN_WORDS, _KIND_WORDS, _OPEN_WORDS)}, t AS (SELECT {_W(_OPEN_ITEM)} AS item, {_W(f"({_OPEN_ITEM}) || ' ' || ({_OPEN_SEGMENT})")} AS w FROM s), u AS (SELECT item, w, count(*) AS n FROM t GROUP BY ALL),
  k(k, reason, phrase) AS (VALUES {_rows(_OPEN)}), f AS (SELECT item, w, n, arg_min(reason, k) AS found FROM u LEFT JOIN k ON contains(w, ' ' || phrase || ' ') GROUP BY ALL)
  SELECT CASE WHEN trim(item) IN ({_GENERIC}) THEN 'insufficient_item_identity' ELSE coalesce(found, 'catalog_first_unresolved') END AS reason, sum(n)::BIGINT AS n FROM f GROUP BY ALL""")
def residual_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why clauses of names, kinds and telling phrases, up to two of them, stay without an item."""
    rows = _worded(spark, sf_dir, _OPEN_WORDS, _KIND_WORDS, _OPEN_WORDS).select(F.expr(_OPEN_ITEM).alias("item"), F.expr(_OPEN_SEGMENT).alias("segment"))
    clauses = rows.groupBy("item", "segment").agg(F.count("*").alias("n"))  # each distinct one is judged once, in as many tasks as there are
    clauses = clauses.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item", "segment")
    return clauses.groupBy(upkeep.residual_reason(c("item"), c("segment")).alias("reason")).agg(F.sum("n").alias("n"))


_ATTRIBUTES = sorted({(alias, name) for name, short in values.ATTRIBUTES.items() for alias in (name, *short)})
_ATTRIBUTE_WORDS = [a for a, _ in _ATTRIBUTES]
_LABEL = "CASE message_id % 5 WHEN 0 THEN upper(w0) WHEN 1 THEN replace(w0, ' ', '-') WHEN 2 THEN '  ' || w0 || '.' WHEN 3 THEN raw_segment ELSE w0 END"
_OLD_NAMES, _OLD_KEYS = sorted(values.LEGACY_NAMES), sorted(values.LEGACY_KEYS)
_OLD = "CASE requirement % 3 WHEN 0 THEN raw_segment WHEN 1 THEN upper(w1) ELSE replace(w1, ' ', '  ') END"
_KEY = "CASE WHEN message_id % 4 = 0 THEN ' ' || w2 ELSE item_key END"


@_add("canonical_labels", f"""WITH {_worded_sql(_ATTRIBUTE_WORDS, _OLD_NAMES, _OLD_KEYS)}, t AS (SELECT trim(regexp_replace(lower({_LABEL}), '[^a-z]+', ' ', 'g')) AS label, {_OLD} AS old, trim({_KEY}) AS key FROM s),
  a(alias, attribute) AS (VALUES {_rows(_ATTRIBUTES)}), o(old_name, name) AS (VALUES {_rows(sorted(values.LEGACY_NAMES.items()))}), k(old_key, name) AS (VALUES {_rows(sorted(values.LEGACY_KEYS.items()))})
  SELECT replace(coalesce(attribute, label), ' ', '_') AS attribute, coalesce(k.name, o.name, trim(old)) AS name, count(*) AS n FROM t LEFT JOIN a ON alias = label LEFT JOIN k ON old_key = key LEFT JOIN o ON old_name = trim(regexp_replace(lower(old), '\\s+', ' ', 'g')) GROUP BY ALL""")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by any of their names and short forms, and names that items have now."""
    rows = _worded(spark, sf_dir, _ATTRIBUTE_WORDS, _OLD_NAMES, _OLD_KEYS).select(F.expr(_LABEL).alias("label"), F.expr(_OLD).alias("old"), F.expr(_KEY).alias("key"))
    return rows.groupBy(text.canonical_attribute(c("label")).alias("attribute"), text.canonical_name(c("old"), c("key")).alias("name")).agg(F.count("*").alias("n"))


_SIDES = [x for xs in text.SIDES.values() for x in xs]
_GATE = [(k, kind, reason, int(always), p) for k, (kind, reason, always, ps) in enumerate(values.GATE) for p in ps]
_GATE += [(100 + k, kind, reason, 1, p) for k, (kind, reason, ps) in enumerate(values.CLASSES) for p in ps]
_GATE_WORDS = [p.strip("^$") for *_, p in _GATE]
_MESSAGE = """CASE message_id % 7 WHEN 0 THEN w0 WHEN 1 THEN w0 || ' ' || raw_segment WHEN 2 THEN w2 || ' ' || raw_segment || ' ' || w0 WHEN 3 THEN w1 || ' ' || raw_segment || ' and ' || w3 || ' 5a' WHEN 4 THEN raw_segment || ' | ' || upper(w0)
  WHEN 5 THEN w2 || ' ' || w1 || ' run ' || requirement || 'a' ELSE w2 || ' ' || raw_segment || ' 12e' END"""
_PAID = ["mission", "missions", "quest", "quests", "dungeon", "dungeons", "run", "runs", "rush", "service", "services"]


@_add("message_classes", f"""WITH {_worded_sql(_GATE_WORDS, values.SERVICE_WORDS, _SIDES, values.SERVICE_WORDS)}, u AS (SELECT {_W(_MESSAGE)} AS w, count(*) AS n FROM s GROUP BY 1),
  r(k, kind, reason, always, phrase) AS (VALUES {_rows(_GATE)}), side(x) AS (VALUES {_rows([(x,) for x in _SIDES])}), service(x) AS (VALUES {_rows([(x,) for x in values.SERVICE_WORDS])}), paid(x) AS (VALUES {_rows([(x,) for x in _PAID])}),
  v AS (SELECT *, EXISTS (FROM side WHERE contains(w, ' ' || x || ' ')) AS stated, (SELECT count(*) FROM service WHERE contains(w, x)) >= 2 OR EXISTS (FROM paid WHERE contains(w, ' ' || x || ' ')) AND regexp_matches(w, ' [0-9]+a ') AS serves FROM u),
  f AS (SELECT w, n, serves, min({{'k': k, 'kind': r.kind, 'reason': r.reason}}) FILTER (phrase IS NOT NULL) AS m FROM v LEFT JOIN r ON (always = 1 OR NOT stated) AND {_HOLDS} GROUP BY ALL)
  SELECT CASE WHEN m IS NOT NULL THEN m.kind WHEN serves THEN 'service' ELSE 'market' END AS kind, CASE WHEN m IS NOT NULL THEN m.reason WHEN serves THEN 'service_advertisement' ELSE 'market_candidate' END AS reason, sum(n)::BIGINT AS n FROM f GROUP BY ALL""")
def message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of messages made from sides, names, phrases that decide and words of services."""
    said = _worded(spark, sf_dir, _GATE_WORDS, values.SERVICE_WORDS, _SIDES, values.SERVICE_WORDS).select(text.classify(F.expr(_MESSAGE)).alias("v"))
    return said.groupBy("v.kind", "v.reason").agg(F.count("*").alias("n"))


_FORMS = ["bow", "Swords", "axe", "hammers", "staff", "staves", "wand", "focus", "foci", "shields", "spear", "scythe", "dagger", "minis", "tome", "tonics", "dye", "bowstring", "thing"]
_STATES = ["", "insc", "OS", "old school", "unded", "ded", "inscribable", "undedicated OS", "insc oldschool", "osx"]
_NEEDS = ["q9", "req 12", "r8", "q 10", "requirement 7", "rq11", "", "req", "no"]
_SEGMENT = "CASE message_id % 3 WHEN 0 THEN raw_segment || ' ' || w0 || ' ' || w2 || ' ' || w3 || ' ' || w1 WHEN 1 THEN w2 || ' ' || w3 || ', ' || w0 || ' (' || w1 || ')' ELSE w0 || ' not ' || w3 || ' ' || w2 || ' ' || w1 END"
_SAID_ATTRIBUTES = [(a, n) for a, n in _ATTRIBUTES if a not in values.WEAPON_WORDS]
_STEMS = [(k, f, {"staff": "sta(?:ff|ffs|ves)", "focus": "foc(?:us|i|uses)", "daggers": "daggers?", "miniature": "mini(?:ature)?s?"}.get(f, f"{f}s?")) for k, f in enumerate(text.FAMILIES)]
_WORD = lambda *xs: "(" + " OR ".join(f"contains(w, ' {x} ')" for x in xs) + ")"


@_add("segment_labels", f"""WITH {_worded_sql(_FORMS, _STATES, _NEEDS, _ATTRIBUTE_WORDS)}, u AS (SELECT said, {_W("said")} AS w, count(*) AS n FROM (SELECT {_SEGMENT} AS said FROM s) GROUP BY ALL),
  a(alias, attribute) AS (VALUES {_rows(_SAID_ATTRIBUTES)}), st(k, family, stem) AS (VALUES {_rows(_STEMS)}), v AS (SELECT *, regexp_replace(w, ' (no|not) [a-z'']+ ', '  ', 'g') AS kept, regexp_extract(w, ' (rq|req|requirement|q|r) ?([0-9]{{1,2}}) ', 2) AS q FROM u),
  b AS (SELECT v.*, min({{'len': -length(alias), 'alias': alias, 'attribute': a.attribute}}) FILTER (alias IS NOT NULL) AS m FROM v LEFT JOIN a ON contains(kept, ' ' || alias || ' ') GROUP BY ALL),
  d AS (SELECT b.*, m.attribute AS attribute, arg_min(st.family, k) AS family FROM b LEFT JOIN st ON regexp_matches(said, '(?i)\\b' || stem || '\\b') GROUP BY ALL)
  SELECT family, concat_ws(',', 'attribute=' || attribute, CASE WHEN {_WORD("unded", "undedicated")} THEN 'dedication=undedicated' WHEN {_WORD("ded", "dedicated")} THEN 'dedication=dedicated' END, CASE WHEN {_WORD("insc", "inscr", "inscribable", "inscriptable")} THEN 'inscribable=insc' END,
    CASE WHEN {_WORD("os", "old school", "oldschool")} THEN 'oldschool=OS' END, CASE WHEN q <> '' THEN 'requirement=q' || q WHEN attribute IS NOT NULL AND regexp_matches(w, ' (req|requirement) [a-z]') THEN 'requirement=any' END) AS modifiers, sum(n)::BIGINT AS n FROM d GROUP BY ALL""")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weapon families and modifiers of segments composed of names, families, states, requirements and attributes."""
    rows = _worded(spark, sf_dir, _FORMS, _STATES, _NEEDS, _ATTRIBUTE_WORDS).select(F.expr(_SEGMENT).alias("said")).select(text.family(c("said")).alias("family"), text.modifiers(c("said")).alias("m"))
    shown: Column = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.groupBy("family", shown.alias("modifiers")).agg(F.count("*").alias("n"))
