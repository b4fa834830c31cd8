"""Queries that find items in texts, hold parses against what was written, and import, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leftovers, text
from ..operators import catalog, review
from ..sources import payload
from ..sources.market import chat, offers, table
from ..streaming import jobs
from .oracle import _ALIAS, _ITEMS, _OFFERS, _TIDY, _q
from .queries import Query, _aliases, _items

c = F.col
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


_NOUN = "split_part(p_name, ' ', 2)"
#: Aliases that overlap the names: the last word, that word with a requirement, and a requirement with what may follow it.
_OVERLAPS = [(_NOUN, "'noun_'"), (f"{_NOUN} || ' q' || p_size::STRING", "'sized_'"), ("'q' || p_size::STRING || ' insc'", "'insc_'"), ("p_name || ' q' || p_size::STRING || ' os insc'", "'long_'")]
_CHAT = """chat AS (SELECT offer_id AS id, CASE trade_type WHEN 'buy' THEN 'WTB ' WHEN 'sell' THEN 'WTS ' ELSE 'WTT ' END || raw_segment || ' q' || requirement::VARCHAR || CASE WHEN is_oldschool THEN ' OS' ELSE '' END
  || CASE WHEN is_inscribable THEN ' insc' ELSE '' END || ' ' || quantity::INT::VARCHAR || ' ' || floor(price_amount)::BIGINT::VARCHAR AS said FROM offers)"""


@_add("dictionary_matches", f"""WITH RECURSIVE {_OFFERS}, {_ALIAS}, {_CHAT},
  known AS (SELECT * FROM ua {' '.join(f"UNION SELECT {a}, {k} || {a} FROM part" for a, k in _OVERLAPS).replace("STRING", "VARCHAR")}),
  w AS (SELECT id, string_split({_TIDY("said")}, ' ') AS w FROM chat), starts AS (SELECT id, w, unnest(range(0, len(w)))::INT AS start FROM w),
  spans AS (SELECT id, w, start, unnest([1, 2, 3, 4, 5])::INT AS words FROM starts), found AS (SELECT id, start, words, array_to_string(w[start + 1:start + words], ' ') AS alias FROM spans WHERE start + words <= len(w)),
  hit AS (SELECT id, start, max(words) AS words FROM found SEMI JOIN known USING (alias) GROUP BY id, start),
  after AS (SELECT a.id, a.start, a.words, min(b.start) AS next FROM hit a LEFT JOIN hit b ON a.id = b.id AND b.start >= a.start + a.words GROUP BY ALL),
  walk AS (SELECT * FROM after WHERE (id, start) IN (SELECT id, min(start) FROM hit GROUP BY id) UNION ALL SELECT a.* FROM walk JOIN after a ON a.id = walk.id AND a.start = walk.next)
  SELECT id, alias, item_key, start, words FROM walk JOIN found USING (id, start, words) JOIN known USING (alias)""")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named in the chat messages, by names and aliases of which some overlap."""
    known = catalog.unique_alias(_items(spark, sf_dir), _aliases(spark, sf_dir)).select("alias", "item_key")
    for alias, kind in _OVERLAPS:
        known = known.union(table(spark, sf_dir, "part").select(F.expr(alias).alias("alias"), F.expr(f"{kind} || {alias}")))
    return catalog.dictionary_join(chat(spark, sf_dir), known.distinct(), "message", "offer_id")


_EDITS = "(CASE WHEN greatest(length({0}), length({1})) > 0 THEN 1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) ELSE 0.0 END)"
_STEM = "regexp_replace({0}, '(es|s)$', '')"
_SIM = f"CASE WHEN {{0}} = {{1}} THEN 1.0::DOUBLE WHEN length({_STEM.format('{0}')}) >= 4 AND {_STEM.format('{0}')} = {_STEM.format('{1}')} THEN 0.98::DOUBLE ELSE {_EDITS} END"


# names have one word or two here, items two: the first word takes the nearer of both, the second what is left
@_add("fuzzy_matches", f"""WITH {_ITEMS}, n AS (SELECT DISTINCT substr(name, 1, k - 1) || substr(name, k + 1) AS name FROM (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM items)),
  p AS (SELECT n.name, item_key, {_TIDY("n.name")} AS n, {_TIDY("items.name")} AS a, string_split({_TIDY("n.name")}, ' ') AS xs, string_split({_TIDY("items.name")}, ' ') AS ys FROM n, items),
  w AS (SELECT *, xs[1] AS x1, coalesce(xs[2], '') AS x2, ys[1] AS y1, ys[2] AS y2 FROM p),
  m AS (SELECT *, {_SIM.format("x1", "y1")} AS s11, {_SIM.format("x1", "y2")} AS s12, CASE WHEN x2 = '' THEN 0.0 ELSE {_SIM.format("x2", "y1")} END::DOUBLE AS s21, CASE WHEN x2 = '' THEN 0.0 ELSE {_SIM.format("x2", "y2")} END::DOUBLE AS s22 FROM w),
  f AS (SELECT *, greatest(s11, s12) AS first, CASE WHEN greatest(s11, s12) < 0.72 THEN greatest(s21, s22) WHEN s11 >= s12 THEN s22 ELSE s21 END AS second FROM m),
  s AS (SELECT name, item_key, max(0.72::DOUBLE * 2 * (CASE WHEN first >= 0.72 THEN first ELSE 0 END + CASE WHEN second >= 0.72 THEN second ELSE 0 END) / (len(xs) + len(ys)) + 0.28::DOUBLE * {_EDITS.format("replace(n, ' ', '')", "replace(a, ' ', '')")}) AS score FROM f GROUP BY ALL),
  o AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY name ORDER BY score DESC, item_key))
  SELECT name, item_key, round(score, 6) AS score FROM o WHERE k = 1 AND score >= 0.88 AND score - coalesce(next, 0) >= 0.08""")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a letter dropped, at every place, matched to the catalog."""
    items = _items(spark, sf_dir)
    places = items.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("k"))
    wrong = places.select(F.concat(F.substring("name", F.lit(1), c("k") - 1), F.substring("name", c("k") + 1, F.length("name"))).alias("name"))
    return catalog.fuzzy_join(wrong, items.select(catalog.plain(c("name")).alias("alias"), "item_key")).withColumn("score", F.round("score", 6))


def _written_and_parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What chat messages were written from, with some fields changed, and what is parsed from them."""
    expected = offers(spark, sf_dir).select(
        c("offer_id").alias("message_id"), F.lit(0).alias("k"), F.expr("CASE WHEN message_id % 5 = 0 THEN 'other' ELSE trade_type END").alias("trade_type"), F.expr("CASE WHEN message_id % 3 = 0 THEN raw_segment || ' x' ELSE raw_segment END").alias("item"),
        F.expr("CASE WHEN message_id % 7 = 0 THEN 'q99' ELSE 'q' || requirement END").alias("requirement"), F.lit(None).cast("string").alias("attribute"),
    )
    return expected, catalog.parse(chat(spark, sf_dir), "offer_id").select("message_id", c("segment_no").alias("k"), "trade_type", "item", "requirement", "attribute")


@_add("parser_evaluation", _q("""SELECT (CASE WHEN message_id % 5 = 0 THEN 0 ELSE 20 END + CASE WHEN message_id % 7 = 0 THEN 0 ELSE 40 END + 35 + CASE WHEN message_id % 3 = 0 THEN 10 ELSE 50 END)::INT AS score, count(*) AS n FROM offers GROUP BY 1"""))
def parser_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of parsed chat messages paired with the offers that they were written from."""
    return review.best_matching(*_written_and_parsed(spark, sf_dir)).groupBy("score").agg(F.count("*").alias("n"))


@_add("parser_field_rates", _q("""SELECT field, count(*) FILTER (ok) AS correct, count(*) AS total FROM (SELECT unnest(['trade_type', 'item', 'requirement', 'attribute']) AS field,
  unnest([message_id % 5 <> 0, message_id % 3 <> 0, message_id % 7 <> 0, true]) AS ok FROM offers) GROUP BY field"""))
def parser_field_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.field_rates(*_written_and_parsed(spark, sf_dir))


#: What a resolver reads, by the message's number: the whole name, one with its last letter dropped, its last word, junk.
_SAID = "CASE message_id % 4 WHEN 0 THEN raw_segment WHEN 1 THEN substr(raw_segment, 1, length(raw_segment) - 1) WHEN 2 THEN 'some ' || split_part(raw_segment, ' ', 2) ELSE raw_segment || CASE WHEN requirement % 2 = 0 THEN '' ELSE ' zz' END END"
_EVIDENCE = f"""t AS (SELECT DISTINCT said FROM o), wd AS (SELECT said, unnest(list_distinct(string_split({_TIDY("said")}, ' '))) AS w FROM t), iw AS (SELECT item_key, unnest(list_distinct(string_split({_TIDY("name")}, ' '))) AS v FROM items),
  ev AS (SELECT said, item_key, v, max(CASE WHEN w = v THEN 3 WHEN starts_with(w, v) OR starts_with(v, w) THEN 2 ELSE 0 END) AS p FROM wd, iw WHERE length(w) >= 4 AND length(v) >= 4 GROUP BY ALL),
  sc AS (SELECT said, item_key, sum(p)::INT AS score FROM ev GROUP BY ALL HAVING sum(p) >= 5), tk AS (SELECT said, item_key, score FROM sc QUALIFY rank() OVER (PARTITION BY said ORDER BY score DESC) = 1 AND count(*) OVER (PARTITION BY said, score) = 1)"""
_O = f"o AS (SELECT offer_id, message_id, {_SAID} AS said FROM offers)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("offer_id", "message_id", F.expr(_SAID).alias("said"))


@_add("token_evidence", f"WITH {_OFFERS}, {_ITEMS}, {_O}, {_EVIDENCE} SELECT offer_id AS id, item_key, score FROM o JOIN tk USING (said)")
def token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.token_evidence(_said(spark, sf_dir).select(c("offer_id").alias("id"), c("said").alias("text")), _items(spark, sf_dir))


@_add("resolver_cascade", f"""WITH {_OFFERS}, {_ALIAS}, {_O}, {_EVIDENCE}, e AS (SELECT o.*, ua.item_key AS exact, tk.item_key AS token FROM o LEFT JOIN ua ON ua.alias = {_TIDY("o.said")} LEFT JOIN tk USING (said)),
  l AS (SELECT *, bool_and(exact IS NOT NULL) OVER (PARTITION BY message_id) AS whole FROM e)
  SELECT offer_id, coalesce(exact, token) AS item_key, CASE WHEN whole THEN 0 WHEN exact IS NOT NULL THEN 1 ELSE 2 END::INT AS strategy FROM l WHERE coalesce(exact, token) IS NOT NULL""")
def resolver_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of each offer's text: by a list of which every part is known, else by itself, else by the evidence of its words."""
    said = _said(spark, sf_dir)
    known = catalog.unique_alias(_items(spark, sf_dir), _aliases(spark, sf_dir))
    lists = catalog.all_or_nothing(said.select(c("message_id").alias("offer_id"), c("offer_id").alias("pos"), c("said").alias("part")), known).select(c("pos").alias("offer_id"), "item_key")
    exact = said.withColumn("alias", catalog.plain(c("said"))).join(known, "alias").select("offer_id", "item_key")
    return catalog.first_strategy(lists, exact, token_evidence(spark, sf_dir).select(c("id").alias("offer_id"), "item_key"))


_ECTO = "(price_amount * CASE price_currency WHEN 'a' THEN 27.0 WHEN 'e' THEN 1.0 WHEN 'k' THEN 1 / 15.0::DOUBLE END::DOUBLE)"


@_add("set_prices", _q(f"""SELECT offer_id, CASE WHEN fits THEN {_ECTO} / n ELSE unit_price END AS unit_price, CASE WHEN fits THEN n::DOUBLE ELSE quantity::DOUBLE END AS quantity, CASE WHEN fits THEN 'set' ELSE price_basis END AS price_basis
  FROM (SELECT *, message_id % 3 <> 2 AND n IS NOT NULL AND price_basis IN ('unknown', 'total') AS fits FROM (SELECT *, CASE WHEN substr(item_key, 7)::INT % 2 = 0 THEN 2 + substr(item_key, 7)::INT END AS n FROM offers))"""))
def set_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of whole sets, two of three texts saying 'set' or 'sets', sizes known of every other brand."""
    o = offers(spark, sf_dir).withColumn("raw_segment", F.expr("CASE message_id % 3 WHEN 0 THEN item || ' set 5a' WHEN 1 THEN 'Sets of ' || item ELSE item || ' settled' END")).withColumn("quantity", c("quantity").cast("double"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    sizes = table(spark, sf_dir, "part").select(c("p_brand").alias("item"), (brand + 2).alias("n")).where(brand % 2 == 0)
    return catalog.with_sets(o, sizes).select("offer_id", "unit_price", "quantity", "price_basis")


@_add("parse_confidence", _q("""SELECT offer_id, round(r.confidence, 6) AS confidence, r.status AS status, r.reason AS reason FROM (SELECT offer_id, CASE WHEN quality_status = 'rejected' THEN {'confidence': 0.05::DOUBLE, 'status': 'rejected', 'reason': 'reject_pattern'}
  WHEN m IS NULL THEN {'confidence': CASE WHEN amount IS NOT NULL THEN 0.35 ELSE 0.2 END::DOUBLE, 'status': 'review', 'reason': 'no_catalog_item'}
  WHEN lifecycle_status <> 'expired' AND m >= 0.86 AND is_oldschool THEN {'confidence': greatest(0.86, m)::DOUBLE, 'status': 'accepted', 'reason': 'catalog_match'}
  WHEN lifecycle_status = 'expired' AND requirement IS NOT NULL THEN {'confidence': 0.86::DOUBLE, 'status': 'accepted', 'reason': 'catalog_match'}
  WHEN s >= 0.82 THEN {'confidence': s, 'status': 'accepted', 'reason': 'catalog_match'} ELSE {'confidence': s, 'status': 'review', 'reason': 'low_confidence'} END AS r
  FROM (SELECT *, least(0.99, greatest(0.0, m + CASE WHEN amount IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN is_inscribable THEN 0.04 ELSE 0 END - CASE WHEN price_basis = 'unknown' THEN 0.02 ELSE 0 END))::DOUBLE AS s
  FROM (SELECT *, CASE WHEN message_id % 9 <> 0 THEN confidence END AS m, CASE WHEN message_id % 4 <> 0 THEN price_amount END AS amount FROM offers)))"""))
def parse_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, status and reason of offers, some without a match or an amount."""
    match, amount = F.expr("CASE WHEN message_id % 9 <> 0 THEN confidence END"), F.expr("CASE WHEN message_id % 4 <> 0 THEN price_amount END")
    rejected = F.coalesce(c("quality_status") == "rejected", F.lit(False))
    score = text.parse_score(match, c("is_oldschool"), c("requirement"), amount, c("price_basis"), c("is_inscribable"), rejected, c("lifecycle_status") == "expired")
    return offers(spark, sf_dir).select("offer_id", score.alias("r")).select("offer_id", F.round("r.confidence", 6).alias("confidence"), "r.status", "r.reason")


@_add("catalog_import", "SELECT DISTINCT p_type AS type, p_name AS name, p_brand AS alias FROM part")
def catalog_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as catalog documents of three shapes, and read back."""
    names = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.collect_set("p_brand").alias("aliases"))
    groups = names.groupBy("p_type").agg(F.collect_list(F.struct(c("p_name").alias("name"), "aliases")).alias("items")).select(F.array(F.struct(c("p_type").alias("type"), "items")).alias("g"), F.length("p_type").alias("n"))
    body = F.when(c("n") % 3 == 0, F.to_json(F.struct(c("g").alias("items")))).when(c("n") % 3 == 1, F.to_json(F.struct(c("g").alias("catalog")))).otherwise(F.to_json("g"))
    return payload.flat_catalog(groups.select(body.alias("body")), "body").select("type", "name", F.explode("aliases").alias("alias"))


@_add("message_insert", "SELECT DISTINCT 'chat:' || (event_id % 7000)::VARCHAR AS source_key FROM events WHERE event_id % 7000 >= 1000")
def message_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the messages that an insert adds, where those below 1000 are known."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("chat:"), (c("event_id") % 7000).cast("string")).alias("source_key"), "event_type", (c("event_id") % 7000).alias("k"))
    return payload.new_messages(e, e.where("k < 1000").select("source_key").distinct()).select("source_key")


@_add("user_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, which end after six hours of silence; the stream operator on a table."""
    found = jobs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return found.select("user_id", "start", c("end").alias("until"), "n")


#: What is left of segments: two to four words of the table, by the numbers of an order line, some with a part's name; and what people say.
_WORDS = sorted(leftovers.known_words()) + ["12", "250", "5e", "q9", "w", "xyz"]
_LEFT = f"""element_at(w, CAST(l_partkey % {len(_WORDS)} AS INT) + 1) || CASE WHEN l_linenumber > 1 THEN ' ' || element_at(w, CAST((l_suppkey * 7 + l_partkey) % {len(_WORDS)} AS INT) + 1) ELSE '' END
  || CASE WHEN l_linenumber > 3 THEN ', ' || element_at(w, CAST(l_orderkey % {len(_WORDS)} AS INT) + 1) ELSE '' END || CASE WHEN l_quantity % 10 = 0 THEN ' ' || p_name ELSE '' END"""
_LISTED = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@_add("review_candidates", f"""WITH kinds(word, kind) AS (VALUES {', '.join(f"('{w}', '{k}')" for w, k in sorted(leftovers.known_words().items()))}),
  rules(n, kind, reason, must, may, least, most) AS (VALUES {', '.join(f"({n}, '{k}', '{r}', {_LISTED(must)}::VARCHAR[], {_LISTED(may)}::VARCHAR[], {a}, {b})" for n, (k, r, must, may, a, b) in enumerate(leftovers.RULES))}),
  said AS (SELECT DISTINCT {_LEFT.replace("element_at(w, ", "list_extract(w, ")} AS said FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT {_LISTED(_WORDS)} AS w) UNION SELECT DISTINCT text FROM conversations),
  each AS (SELECT said, unnest(regexp_extract_all(lower(said), '[a-z0-9'']+')) AS word FROM said),
  found AS (SELECT said, count(*) AS n, list(DISTINCT coalesce(kind, CASE {' '.join(f"WHEN regexp_matches(word, '{form}') THEN '{k}'" for k, form in leftovers.FORMS)} ELSE 'name' END)) AS kinds FROM each LEFT JOIN kinds USING (word) GROUP BY said),
  fits AS (SELECT said, min(rules.n) AS n FROM found JOIN rules ON list_has_all(kinds, must) AND (list_contains(may, '*') OR list_has_all(list_concat(must, may), kinds)) AND found.n BETWEEN least AND most GROUP BY said),
  spoken AS (SELECT said, ' ' || array_to_string(regexp_extract_all(lower(said), '[a-z0-9'']+|[:?]'), ' ') || ' ' AS w FROM said)
  SELECT said, CASE WHEN said IS NULL OR trim(said) = '' OR lower(trim(said)) = 'unknown' THEN 'noise' WHEN found.n IS NULL THEN 'noise' WHEN rules.kind IS NOT NULL THEN rules.kind WHEN {' OR '.join(f"contains(w, ' {p} ')" for _, ps in leftovers.SERVICES for p in ps)} THEN 'service' ELSE 'item' END AS kind,
    CASE WHEN said IS NULL OR trim(said) = '' OR lower(trim(said)) = 'unknown' THEN 'empty' WHEN found.n IS NULL THEN 'punctuation' WHEN rules.reason IS NOT NULL THEN rules.reason {' '.join(f"WHEN contains(w, ' {p} ') THEN '{r}'" for r, ps in leftovers.SERVICES for p in ps)} ELSE 'concrete_candidate' END AS reason
  FROM said LEFT JOIN found USING (said) LEFT JOIN fits USING (said) LEFT JOIN rules ON fits.n = rules.n JOIN spoken USING (said)""")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is left of segments may be an item: combinations of the trade's words, and turns of conversations."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    made = lines.select(F.expr(_LEFT.replace("element_at(w, ", f"element_at(array({', '.join(repr(w) for w in _WORDS)}), ")).alias("said"))
    rows = made.union(table(spark, sf_dir, "conversations").select("text")).where("said IS NOT NULL").distinct()
    return rows.select("said", leftovers.judge(c("said"), c("said")).alias("r")).select("said", "r.kind", "r.reason")
