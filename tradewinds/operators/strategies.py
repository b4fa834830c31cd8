"""Which catalog item an offer's clause means: strategies, the surest first, and lists that are split only if every part is known.

Work is done once per distinct (item, clause). Every strategy is an equi-join of a clause's words or word spans with the
catalog, so that no clause is held against the whole catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, values
from ..functions.rewriting import PROFESSIONS
from . import catalog, upkeep
from .ranking import written

c = F.col
#: In this order the first strategy that has an answer, or that claims a clause without one, decides.
STRATEGIES = ("tome", "miniature", "longest_label", "only_label", "all_words", "name", "evidence")
# Further short forms of professions; words of miniatures and of their state; words that name no item.
MORE_PROFESSIONS = {"Assassin": "assa", "Necromancer": "nec", "Ranger": "rng"}
MINI_WORDS = ["mini", "minis", "minipet", "minipets", "miniature", "miniatures"]
UNDEDICATED, DEDICATED = ["unded", "uded", "undedicated", "un ded", "un dedicated"], ["ded", "dedicated"]
PLAIN_WORDS = (
    "req insc inscribable oldschool old school skin each wts wtb wtt buy sell trade only high gold value mods mod for with and weapon weapons wpns str tac tactics strength fast casting energy storage soul reaping divine favor dom "
    "domination insp inspiration illu illusion heal healing fire smite smiting chan channeling death curses earth blood prot protection"
).split()

GENERIC = sorted({x for names in values.FAMILY_WORDS.values() for x in names} | {"weapon", "weapons", "mods", "weapon mods", "items", "normal tome", "normal tomes"})
TOMES = ["tome", "tomes", "elite tome", "elite tomes", "normal tome", "normal tomes"]
_SIDES, _TAIL = r"(?i)^\s*(?:wts|wtb|wtt|selling|buying)\b\s*", r"(?i)\s+(?:obo|pm|trade me)\b.*$"
_PRICE = r"(?i)\s+\d+(?:[.,]\d+)?\s*[aek]\s*(?:/\s*)?(?:ea|each)?\s*$"
_EDGES = " \t\n\r,;|"


def _plain(x: Column) -> Column:
    return catalog.plain(x)


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def _telling(x: Column) -> Column:
    """The distinct words of a plain text that can tell items apart: three letters or more, no number, nothing generic."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*PLAIN_WORDS, *GENERIC) & ~w.rlike(r"^[qrx]?\d+$")))


def labels_of(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, item_key, name): names and aliases that mean one item and aren't a mere kind of goods; name is the item's, plain."""
    known = catalog.unique_alias(items, aliases).where(~c("alias").isin(*GENERIC))
    names = items.groupBy("item_key").agg(F.min(_plain(c("name"))).alias("name")).where(~c("name").isin(*GENERIC))
    return known.join(names, "item_key").select("alias", "item_key", "name")


def split_list(item: Column, segment: Column) -> Column:
    """The parts of a list, without sides and prices; an empty array if there are fewer than two.

    An item that only names a kind is read from its segment. Parts end at commas, bars, ampersands, 'and', and slashes between
    blanks; '20/20' stays whole. Any number of parts is read.
    """
    source = F.when(_plain(item).isin(*GENERIC) & (segment != ""), segment).otherwise(item)
    clean = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _SIDES, ""), _TAIL, ""), _PRICE, ""), F.lit(_EDGES))
    parts = F.filter(F.transform(F.split(source, r"(?i)\s*[,|&]\s*|\s+and\s+|\s+/\s+"), clean), lambda p: p != "")
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def part_readings(lists: DataFrame) -> DataFrame:
    """(t, pos, form, said): for each part of the lists (t, parts) what it may mean, the likeliest first: itself, with what the
    first part begins with, and with the last part's family. Where a list speaks of miniatures, every part is one, in its state."""
    states = "|".join(sorted(MINI_WORDS + UNDEDICATED + DEDICATED, key=len, reverse=True))
    w = text.words(F.array_join("parts", " , "))
    rows = lists.withColumn("_mini", text.says(w, MINI_WORDS + UNDEDICATED + DEDICATED)).withColumn("_state", F.when(text.says(w, UNDEDICATED), " unded").when(text.says(w, DEDICATED), " ded").otherwise(""))
    rows = rows.withColumn("_tail", F.split_part(_plain(F.element_at("parts", -1)), F.lit(" "), F.lit(-1)))
    rows = rows.select("t", "_mini", "_state", "_tail", F.col("parts")[0].alias("_one"), F.posexplode("parts").alias("pos", "part"))
    bare = lambda x: F.when(c("_mini"), F.btrim(F.regexp_replace(_plain(c(x)), rf"\b(?:{states})\b ?", ""))).otherwise(c(x))
    rows = rows.withColumn("_one", bare("_one")).withColumn("_bare", bare("part"))
    head = F.when(F.contains("_one", F.lit(" ")), F.concat_ws(" ", F.split_part("_one", F.lit(" "), F.lit(1)), "_bare"))
    kind = F.when(~c("_mini") & c("_tail").isin(*GENERIC), F.concat_ws(" ", "_bare", "_tail"))
    read = rows.select("t", "pos", "_mini", "_state", F.posexplode(F.array("_bare", head, kind)).alias("form", "said")).where("said IS NOT NULL")
    return read.select("t", "pos", "form", F.when(c("_mini"), F.concat(F.lit("miniature "), "said", "_state")).otherwise(c("said")).alias("said"))


def profession_words() -> list[tuple[str, str]]:
    """(word, profession), in lower case."""
    return sorted({(w, name.lower()) for table in (PROFESSIONS, MORE_PROFESSIONS) for name, short in table.items() for w in (*short.split(), name.lower())})


def _tomes(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Generic tomes: one item per profession named in the clause that the catalog has, with the number beside it."""
    spoken = F.create_map(*[F.lit(x) for row in profession_words() for x in row])
    claimed = texts.where(c("_item").isin(*TOMES))
    w = _words(c("_clause"))
    at = claimed.select("t", F.startswith("_item", F.lit("elite")).alias("elite"), w.alias("w"), F.posexplode(w).alias("pos", "x")).withColumn("p", spoken[c("x")]).where("p IS NOT NULL")
    beside = lambda i: F.expr(f"try_cast(nullif(regexp_extract(get(w, pos + {i}), '^x?([0-9]{{1,9}})x?$', 1), '') AS int)")
    named = at.withColumn("alias", F.concat(F.when(c("elite"), "elite ").otherwise(""), "p", F.lit(" tome"))).withColumn("quantity", F.coalesce(beside(-1), beside(1)))
    found = named.join(catalog._small(labels), "alias").groupBy("t", "item_key").agg(F.min_by("quantity", "pos").alias("quantity"))
    known = claimed.join(found, "t", "left")
    return known.select("t", F.lit("tome").alias("strategy"), "item_key", F.lit(None).cast("string").alias("variant"), "quantity", F.when(c("item_key").isNull(), "insufficient_item_identity").alias("reason"))


def _miniatures(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Miniatures: state and name must stand in the clause itself, and only one miniature may be named there."""
    minis = labels.where("name LIKE 'miniature %'")
    short = minis.unionByName(minis.withColumn("alias", F.regexp_replace("alias", "^miniature ", ""))).where((F.length("alias") >= 4) & ~c("alias").isin(*GENERIC, *MINI_WORDS, *UNDEDICATED, *DEDICATED)).distinct()
    w = F.concat(F.lit(" "), c("_item"), F.lit(" "), c("_clause"), F.lit(" "))
    named = minis.select(F.regexp_replace("alias", "^miniature ", "").alias("_item")).distinct()
    bare = texts.join(catalog._small(named), "_item", "left_semi").select("t", F.lit(True).alias("_bare"))
    rows = texts.join(bare, "t", "left").where(text.says(w, MINI_WORDS) | c("_bare"))
    clause = F.concat(F.lit(" "), c("_clause"), F.lit(" "))
    conflict = text.says(clause, ["potion", "tonic"]) & ~text.says(clause, MINI_WORDS + UNDEDICATED + DEDICATED)
    state = F.when(text.says(w, UNDEDICATED), "unded").when(text.says(w, DEDICATED), "ded")
    hits = catalog.embedded(rows.withColumn("_all", F.concat_ws(" ", "_item", "_clause")), short, "_all", "t").groupBy(c("id").alias("t")).agg(F.count_distinct("item_key").alias("_n"), F.min("item_key").alias("_key"))
    rows = rows.join(hits, "t", "left").withColumn("variant", state)
    reason = F.when(conflict, "miniature_context_conflict").when(c("variant").isNull(), "miniature_variant_unresolved").when(c("_n").isNull(), "catalog_first_unresolved").when(c("_n") > 1, "miniature_bundle_unresolved")
    return rows.withColumn("reason", reason).select("t", F.lit("miniature").alias("strategy"), F.when(c("reason").isNull(), c("_key")).alias("item_key"), F.when(c("reason").isNull(), c("variant")).alias("variant"), F.lit(None).cast("int").alias("quantity"), "reason")


def _by_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The longest label in the clause, if of the item's family and if no other item's is as long; for mere kinds also the only one."""
    stem = {"staves": "staff", "foci": "focus"}
    family = F.when(c("_item").isin(*GENERIC), F.regexp_replace(F.split_part("_item", F.lit(" "), F.lit(1)), "s$", ""))
    family = F.when(family.isin(*stem), F.create_map(*[F.lit(x) for kv in stem.items() for x in kv])[family]).when(family.isin("weapon", "mod", "item"), None).otherwise(family)
    found = catalog.embedded(texts, labels.where(F.length("alias") >= 4), "_clause", "t").join(catalog._small(labels.select("alias", "name")), "alias")
    found = found.withColumnRenamed("id", "t").join(texts.select("t", family.alias("_family"), c("_item").isin(*GENERIC).alias("_kind")), "t")
    fits = c("_family").isNull() | F.contains(F.concat(F.lit(" "), c("name"), F.lit(" ")), F.concat(F.lit(" "), c("_family")))
    each = found.groupBy("t", "item_key", "_kind").agg(F.max(F.when(fits, F.length("alias"))).alias("fit"), F.max(F.length("alias")).alias("any"))
    top = each.groupBy("t", "_kind").agg(
        F.max("fit").alias("fit"), F.max_by("item_key", F.struct("fit", "item_key")).alias("fit_key"), F.count_if(c("any") >= 6).alias("n"), F.max(F.when(c("any") >= 6, c("item_key"))).alias("only_key"), F.collect_list("fit").alias("fits"))
    ties = F.size(F.filter("fits", lambda x: x == c("fit")))
    longest = top.where(c("fit").isNotNull() & (ties == 1)).select("t", F.lit("longest_label").alias("strategy"), c("fit_key").alias("item_key"))
    return longest.unionByName(top.where("_kind AND n = 1").select("t", F.lit("only_label").alias("strategy"), c("only_key").alias("item_key")))


def _all_words(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The item of a label whose telling words are all in the clause: whole, cut off after four letters or more, or joined.

    A label is looked up by one word, that which the fewest labels hold, so words that many labels share bring no candidates. The
    best score wins, then the longer label; a tie gives none. An item that isn't a mere kind needs a score of 100.
    """
    rows = labels.select("alias", "item_key", _telling(c("alias")).alias("lw"), F.replace("alias", F.lit(" "), F.lit("")).alias("joined")).where((F.size("lw") > 0) & (F.length("alias") >= 5))
    held = rows.select("alias", F.explode("lw").alias("x"))
    often = held.groupBy("x").agg(F.count("*").alias("n"))
    anchor = held.join(often, "x").groupBy("alias").agg(F.min_by("x", F.struct("n", "x")).alias("x"))
    said = texts.select("t", _telling(c("_clause")).alias("cw")).where("size(cw) > 0")
    word = said.select("t", F.explode("cw").alias("y"))
    four = anchor.select("alias", F.substring("x", 1, 4).alias("k"))
    grams = rows.where("length(joined) >= 6").select("alias", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("joined") - 5), lambda i: F.substr("joined", i, F.lit(6))))).alias("k"))
    keys = catalog._small(four.unionByName(grams).distinct())
    met = word.select("t", F.explode(F.array(F.substring("y", 1, 4), F.substring("y", 1, 6))).alias("k")).distinct().join(keys, "k").select("t", "alias").distinct()
    pairs = met.join(catalog._small(rows), "alias").join(said, "t")
    starts = lambda x, y: (F.length(y) >= 4) & F.startswith(x, y)
    near = lambda x: F.exists("cw", lambda y: (x == y) | starts(x, y) | starts(y, x) | ((F.length(y) >= 6) & F.contains(c("joined"), y)))
    exact = F.size(F.array_intersect("lw", "cw"))
    n = F.size("lw")
    score = F.when(n > 1, 100 + F.least(F.lit(20), exact * 5) + F.least(F.lit(10), n * 2)).when(F.length(c("lw")[0]) < 7, 0).when(exact == 1, 105).otherwise(90)
    good = pairs.where(F.forall("lw", near)).withColumn("score", score).groupBy("t", "item_key").agg(F.max(F.struct("score", F.length("alias").alias("len"))).alias("s"))
    top = good.groupBy("t").agg(F.max("s").alias("s"), F.max_by("item_key", F.struct("s", "item_key")).alias("item_key"))
    alone = good.join(top.select("t", "s"), ["t", "s"]).groupBy("t").agg(F.count("*").alias("n")).where("n = 1").select("t")
    enough = c("s.score") >= F.when(c("_item").isin(*GENERIC), 80).otherwise(100)
    return top.join(alone, "t").join(texts.select("t", "_item"), "t").where(enough).select("t", F.lit("all_words").alias("strategy"), "item_key")


def resolve_texts(texts: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(t, strategy, item_key, variant, quantity, reason): what each distinct (item, segment), numbered by ``t``, means.

    One row, or one per profession of generic tomes; item_key is null if a strategy claims the clause without an answer. Clauses
    that no strategy claims have no row.
    """
    labels = written(labels_of(items, aliases))  # every strategy reads these two
    rows = texts.select("t", _plain(c("item")).alias("_item"), _plain(F.when(c("segment") != "", c("segment")).otherwise(c("item"))).alias("_clause"))
    rows = written(rows)
    exact = rows.join(catalog._small(labels.select(c("alias").alias("_item"), "item_key")), "_item").select("t", F.lit("name").alias("strategy"), "item_key")
    proof = catalog.token_evidence(rows.select(c("t").alias("id"), c("_clause").alias("text")), items).select(c("id").alias("t"), F.lit("evidence").alias("strategy"), "item_key")
    plain = reduce(DataFrame.unionByName, [_by_labels(rows, labels), _all_words(rows, labels), exact, proof])
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    found = _tomes(rows, labels).unionByName(_miniatures(rows, labels)).unionByName(plain.select("t", "strategy", "item_key", blank("string", "variant"), blank("int", "quantity"), blank("string", "reason")))
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), c("strategy"))
    return found.withColumn("_first", F.min(rank).over(W.partitionBy("t"))).where(rank == c("_first")).drop("_first")


def resolve(offers: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(offer_id, pos, item_key, strategy, in_list, variant, quantity, reason) of offers (offer_id, item, segment).

    A list replaces its offer by one row per part (``pos`` from 0) only if every part means an item; else the offer is read as it
    stands. ``items`` has (item_key, name), ``aliases`` (alias, item_key). Every offer has a row: without an item ``reason`` says
    why. Null items and segments are read as empty; offers that share an id are each read, under that id.
    """
    # written, as Spark would make the offers again for each reading of the clauses, and split lists in every offer to filter by their size
    rows = written(offers.select("offer_id", F.coalesce("item", F.lit("")).alias("item"), F.coalesce("segment", F.lit("")).alias("segment")))
    t = lambda item, segment: F.md5(F.concat(F.length(item).cast("string"), F.lit(":"), item, segment))
    whole = written(rows.select("item", "segment").distinct()).withColumn("t", t(c("item"), c("segment")))
    lists = part_readings(whole.select("t", split_list(c("item"), c("segment")).alias("parts")).where("size(parts) > 0"))
    lists = written(lists.select(c("t").alias("list"), "pos", "form", c("said").alias("item"), c("said").alias("segment"), t(c("said"), c("said")).alias("t")))
    texts = whole.unionByName(lists.select("item", "segment", "t")).distinct()
    found = written(resolve_texts(texts, items, aliases))
    read = lists.select("list", "pos", "form", "t").join(found.where("item_key IS NOT NULL"), "t", "left")
    best = read.groupBy("list", "pos").agg(F.min(F.when(c("item_key").isNotNull(), c("form"))).alias("form"))
    full = best.groupBy("list").agg(F.bool_and(c("form").isNotNull()).alias("all")).where("all").select("list")
    parts = read.join(best, ["list", "pos", "form"]).join(full, "list").where("item_key IS NOT NULL").select(c("list").alias("t"), "pos", "item_key", "strategy", F.lit(True).alias("in_list"), "variant", "quantity", "reason")
    single = found.join(full.withColumnRenamed("list", "t"), "t", "left_anti").select("t", F.lit(0).alias("pos"), "item_key", "strategy", F.lit(False).alias("in_list"), "variant", "quantity", "reason")
    means = whole.join(parts.unionByName(single), "t", "left").withColumn("reason", F.when(c("item_key").isNull(), F.coalesce("reason", upkeep.residual_reason(c("item"), c("segment")))))
    means = means.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    means = written(means.select("item", "segment", "pos", "item_key", "strategy", "in_list", "variant", "quantity", "reason"))
    return rows.join(catalog._small(means), ["item", "segment"]).select("offer_id", "pos", "item_key", "strategy", "in_list", "variant", "quantity", "reason")
