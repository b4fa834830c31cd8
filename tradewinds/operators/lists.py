"""Lists in trade messages, read from left to right: what a clause leaves unsaid, it takes from the clauses before it.

A block of a message is cut into segments (``|``, ``;``, ``~``, ``//``) and these into clauses (commas, ``&``, ``and``, slashes
between words), but not within quotes and parentheses. Each clause is described by itself: requirements, attributes, price,
state, and the name that is left. The names that a clause could mean, also under the headings of its block, meet the catalog in
one equi-join; then a fold over the clauses of a block keeps the item, heading, requirement and state that hold at that point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, text, values
from . import catalog

c = F.col

#: Words of a name up to which its parts are looked up in the catalog.
LONGEST = 5
_QUOTED = r"\"[^\"]*\"|\([^()]*\)"
_SEGMENT = r"\s*(?:[|;~]|//)\s*"
_CLAUSE = r"\s*,(?!\d{3}(?!\d))\s*(?:(?:&|and\b)\s*)?|\s+(?:&|and)\s+|(?<![\d/])(?<!\d[aekp])\s*/\s*(?!\d|/|(?:st|stk|stacks?|ea|each)\b)"
_POINTS = r"(?i)(?<![a-z0-9])(\d{1,3}(?:,\d{3})+|\d+)\s*(party|sweet|alcohol|alc)\b(?:\s*points?)?\s*[,&+]?\s*"
_REQUIREMENT = r"(?i)\b(?:r?q|req|requirement|r)\s?(\d{1,2})(?:\s*-\s*q?(\d{1,2})|((?:\s*/\s*q?\d{1,2})+))?(?!\d|\s*%)"
_ALIASES = sorted({a for name, short in values.ATTRIBUTES.items() for a in (name, *short) if a not in values.WEAPON_WORDS}, key=lambda a: (-len(a), a))
_ATTRIBUTE = rf"(?<![a-z0-9'])(?:{'|'.join(_ALIASES)})(?![a-z0-9'])"
_STATE = r"(?i)\b(un)?ded(?:icated)?\b"
_INSCRIBABLE, _OLD = r"(?i)\b(?:insc|inscr|inscribable|inscriptable)\b", r"(?i)\b(?:os|old\s?school)\b"
#: Families that can head a list, by the pattern of their words.
HEADINGS = {
    "Staff": "staff|staffs|staves", "Wand": "wands?", "Bow": "bows?", "Sword": "swords?", "Axe": "axes?", "Hammer": "hammers?", "Shield": "shields?", "Spear": "spears?", "Scythe": "scythes?",
    "Daggers": "daggers?", "Focus": "foci|focus|focuses", "Tome": "tomes?", "Everlasting Tonic": "(?:everlasting |el )?tonics?", "Miniature": "(?:(?:bday|birthday|celestial) )?(?:miniatures?|minis?|mini ?pets?)",
}
_FIRST = ("Miniature", "Everlasting Tonic")  # these stand before a name, the others behind
_ANY_HEADING = "|".join(f"(?:{p})" for p in HEADINGS.values())

_OFFER = "struct<item:string,item_key:string,requirement:string,attribute:string,dedication:string,oldschool:boolean,inscribable:boolean,quantity:double,price:struct<amount:double,currency:string,basis:string,quantity:double,unit_ecto:double>,raw:string>"
_STATE_OF_FOLD = f"struct<item:string,item_key:string,family:string,prefix:string,requirement:string,spread:boolean,local:string,dedication:string,pending:array<{_OFFER}>,out:array<{_OFFER}>>"


def cut(x: Column, separators: str) -> Column:
    """``x`` between separators that stand outside quotes and parentheses; no empty parts."""
    marked = F.regexp_replace(x, rf"(?i)({_QUOTED})|({separators})", "$1\u0001$2\u0002")
    parts = F.split(F.regexp_replace(marked, "\u0001\u0002", ""), "\u0001[^\u0002]*\u0002")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def _number(found: Column, kind: str) -> Column:
    """What a pattern found, as a number; casting the empty text of one that didn't fit would raise an error and catch it."""
    return F.nullif(found, F.lit("")).try_cast(kind)


def clauses_of(segment: Column) -> Column:
    """The clauses of a segment; counted lists ('Monk (12) Ele (6)') and points ('5 party 3 sweet') are cut between their parts."""
    counted = F.when(F.regexp_count(segment, F.lit(r"[A-Za-z']\s*\(\d+\)")) > 1, F.regexp_replace(segment, r"([A-Za-z']\s*\(\d+\))\s*(?=[A-Za-z])", "$1, ")).otherwise(segment)
    points = F.when(F.regexp_count(counted, F.lit(_POINTS)) > 1, F.regexp_replace(counted, _POINTS, ", $1 $2 points ")).otherwise(counted)
    years = tuple(_number(F.regexp_extract(points, r"(?i)\bpresents?\s+(\d)\s?-\s?(\d)$", k), "int") for k in (1, 2))
    each = F.transform(F.sequence(years[0], F.greatest(years[0], years[1])), lambda n: F.regexp_replace(points, F.lit(r"\d\s?-\s?\d$"), n.cast("string")))
    return F.when(years[0].isNotNull(), each).otherwise(cut(points, _CLAUSE))


def requirements(clause: Column) -> Column:
    """'q9' as [q9], 'q5-7' as [q5, q6, q7] (ten at most, else its first), 'q9/11' as [q9, q11],
    'req channeling' as [any]; none as an empty array."""
    unnamed = clause.rlike(rf"(?i)\b(?:req|requirement)\s+(?:{'|'.join(_ALIASES)})(?![a-z0-9'])")  # 'req channeling'
    none = F.when(unnamed, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>"))

    def read(x: Column) -> Column:
        low, high = x["low"], x["high"]
        span = F.when((high > low) & (high - low <= 10), F.sequence(low, high)).otherwise(F.concat(F.array(low), x["more"]))
        return F.when(low.isNull(), none).otherwise(F.transform(span, lambda n: F.concat(F.lit("q"), n.cast("string"))))

    def parts(stated: Column) -> Column:  # what is stated, by itself, is read like that in its clause
        low, high = (_number(F.regexp_extract(stated, _REQUIREMENT, k), "int") for k in (1, 2))
        more = F.transform(F.regexp_extract_all(F.regexp_extract(stated, _REQUIREMENT, 3), F.lit(r"\d+"), 0), lambda n: n.cast("int"))
        return F.when(stated == "", none).otherwise(exprs.once(F.struct(low.alias("low"), high.alias("high"), more.alias("more")), read))

    return exprs.once(F.regexp_extract(clause, _REQUIREMENT, 0), parts)


def attributes(clause: Column) -> Column:
    """The attributes that a clause names, in order."""
    known = F.create_map(*[F.lit(x) for name, short in values.ATTRIBUTES.items() for a in (name, *short) for x in (a, name)])
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(clause), F.lit(_ATTRIBUTE), 0), lambda a: F.try_element_at(known, a)))


def describe(clause: Column, hard: Column) -> Column:
    """What a clause says by itself. ``kind`` is req, heading, prefix, mods, variant (no name, but attributes, a price or a
    requirement with something else) or name."""
    said = F.regexp_replace(clause, "[()\"]", " ")
    outside = F.trim(F.regexp_replace(clause, r"\([^()]*\)", " "))  # what stands in parentheses explains a name
    named_by = F.regexp_replace(F.when(outside != "", outside).otherwise(said), '"', " ")
    count = F.coalesce(_number(F.regexp_extract(clause, r"\((\d+)\)", 1), "double"), _number(F.replace(F.regexp_extract(clause, r"^\s*(\d[\d,]*)\s?x?\s+(?=[A-Za-z])", 1), F.lit(","), F.lit("")), "double"))
    bare = F.regexp_replace(F.regexp_replace(named_by, _REQUIREMENT, " "), rf"{_STATE}|{_INSCRIBABLE}|{_OLD}|^\s*\d[\d,]*\s?x?\s+(?=[A-Za-z])", " ")
    full = F.regexp_replace(text.clean_name(F.regexp_replace(bare, r"(?i)\b(?:req|requirement|each|ea)\b", " ")), r"(?i)(?<!\bpresents?)\s+\d+$|\b(?:skins?|list|all)\s*$", "")

    def named(x: Column) -> Column:
        name = F.trim(F.regexp_replace(F.regexp_replace(x["full"], f"(?i){_ATTRIBUTE}", " "), r"(?<!\d)[/+-]+(?!\d)|\s+", " "))

        def headed(low: Column) -> Column:
            heading = F
            for family, pattern in HEADINGS.items():
                heading = heading.when(low.rlike(f"^(?:{pattern})$"), family)
            return F.when((F.size(x["attrs"]) == 0) & x["price"]["amount"].isNull() & low.rlike(f"^(?:{_ANY_HEADING})$"), heading.otherwise(None))

        prefix = F.when(clause.rlike(r":\s*$"), F.trim(F.regexp_replace(x["full"], r"[\s:]+$", "")))
        return exprs.once(F.struct(name.alias("name"), exprs.once(F.lower(F.trim(x["full"])), headed).alias("heading"), prefix.alias("prefix")), lambda y: made(x, y))

    def made(x: Column, y: Column) -> Column:
        name, plain_heading, prefix = y["name"], y["heading"], y["prefix"]
        family_of_prefix = F.when(prefix.rlike(rf"(?i)^(?:{_ANY_HEADING})$"), F.lit(True)).otherwise(False)
        kind = (
            F.when(plain_heading.isNotNull(), "heading").when(prefix.isNotNull() & (prefix != "") & ~family_of_prefix, "prefix").when(name != "", "name")
            .when((F.size(x["attrs"]) > 0) | x["price"]["amount"].isNotNull(), "variant").when(F.size(x["reqs"]) > 0, F.when(x["mods"], "variant").otherwise("req")).when(x["mods"], "mods").otherwise("none")
        )
        return F.struct(
            hard.alias("hard"), clause.alias("raw"), kind.alias("kind"), F.trim(x["full"]).alias("full"), name.alias("name"), plain_heading.alias("heading"), prefix.alias("prefix"), x["reqs"].alias("reqs"), x["attrs"].alias("attrs"),
            x["price"].alias("price"), count.alias("quantity"), F.when(clause.rlike(_STATE), F.when(clause.rlike(r"(?i)\bunded"), "undedicated").otherwise("dedicated")).alias("dedication"),
            clause.rlike(_OLD).alias("oldschool"), clause.rlike(_INSCRIBABLE).alias("inscribable"), F.lower(name).rlike(rf"\b(?:{_ANY_HEADING})\b").alias("own_family"),
        )

    read = F.struct(
        full.alias("full"), requirements(clause).alias("reqs"), attributes(said).alias("attrs"), text.price(F.regexp_replace(clause, _REQUIREMENT, " ")).alias("price"), (clause.rlike(_STATE) | clause.rlike(_INSCRIBABLE) | clause.rlike(_OLD)).alias("mods"),
    )
    return exprs.once(read, named)


def described(block: Column) -> Column:
    """The clauses of a block, described; a unit price behind the last clause of a segment holds for those without one."""

    def shared(clauses: Column) -> Column:
        last = F.element_at(clauses, -1)["price"]
        passes = last["basis"].isin("each", "stack") & (F.size(clauses) > 1)
        return F.transform(clauses, lambda x: F.when(passes & (x["kind"] == "name") & x["price"]["amount"].isNull(), x.withField("price", last)).otherwise(x))

    heads = F.transform(cut(block, _SEGMENT), lambda s: F.regexp_replace(s, r"^([A-Za-z' ]{3,40}:)\s*(?=\S)", "$1\u0003"))  # 'heading: a, b'
    parts = F.transform(heads, lambda s: F.flatten(F.transform(F.split(s, "\u0003"), clauses_of)))
    told = F.transform(parts, lambda s: F.transform(s, lambda x, i: describe(x, i == 0)))
    return F.flatten(F.transform(F.filter(told, lambda s: F.size(s) > 0), lambda s: exprs.once(s, shared)))


def _attach(name: Column, family: Column, prefix: Column) -> Column:
    first = F.when(prefix.isNotNull(), prefix).when(family.isin(*_FIRST), family)
    return F.when(first.isNotNull(), F.concat_ws(" ", first, name)).otherwise(F.concat_ws(" ", name, family))


def candidates(clauses: Column) -> Column:
    """The names, in the catalog's spelling, that the clauses of a block may mean."""
    families = F.array_compact(F.array_distinct(F.transform(clauses, lambda x: x["heading"])))
    prefixes = F.array_compact(F.array_distinct(F.transform(clauses, lambda x: F.when(x["kind"] == "prefix", x["prefix"]))))

    def names(x: Column) -> Column:
        own = F.array(x["full"], x["name"])
        attached = F.concat(F.transform(families, lambda f: _attach(x["name"], f, F.lit(None).cast("string"))), F.transform(prefixes, lambda p: _attach(x["name"], F.lit(None).cast("string"), p)))
        return F.when(x["kind"] == "name", F.transform(F.concat(own, attached, spans(x), runs(x)), catalog.plain)).otherwise(F.array().cast("array<string>"))

    return F.filter(F.array_distinct(F.flatten(F.transform(clauses, names))), lambda n: n != "")


def _runs(words: Column) -> Column:
    """Runs of up to LONGEST words, the longest first."""
    many = F.sequence(F.least(F.lit(LONGEST), F.size(words)), F.lit(1))
    return F.flatten(F.transform(many, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))


def spans(x: Column) -> Column:
    """Runs of words of a clause's whole name, the longest first."""
    w = F.filter(F.split(catalog.plain(x["full"]), " "), lambda s: s != "")
    return exprs.once(w, lambda v: F.when(F.size(v) > 0, _runs(v)).otherwise(F.array().cast("array<string>")))


def runs(x: Column) -> Column:
    """Runs of words of a clause as they stand, requirements and all, the longest first."""
    return exprs.once(F.split(F.trim(x["raw"]), r"\s+"), _runs)


def fold(clauses: Column, hits: Column, strict: bool) -> Column:
    """The offers of a block. ``hits`` maps candidates to (item_key, name); where nothing is known (not ``strict``), names under
    a heading are taken as that heading says."""
    none = F.lit(None).cast("string")
    no_offers = F.array().cast(f"array<{_OFFER}>")
    start = F.struct(
        none.alias("item"), none.alias("item_key"), none.alias("family"), none.alias("prefix"), none.alias("requirement"), F.lit(False).alias("spread"), none.alias("local"), none.alias("dedication"), no_offers.alias("pending"), no_offers.alias("out")
    ).cast(_STATE_OF_FOLD)
    found = lambda name: F.try_element_at(hits, catalog.plain(name))

    def offers(x: Column, item: Column, key: Column, inherited: Column, dedication: Column) -> Column:
        reqs = F.when(F.size(x["reqs"]) > 0, x["reqs"]).otherwise(F.array(inherited))
        many = (F.size(x["attrs"]) > 1) & x["price"]["amount"].isNull()
        attrs = F.when(many, x["attrs"]).otherwise(F.array(F.get(x["attrs"], F.lit(0))))
        one = lambda r, a: F.struct(
            item.alias("item"), key.alias("item_key"), r.alias("requirement"), a.alias("attribute"), dedication.alias("dedication"), x["oldschool"].alias("oldschool"), x["inscribable"].alias("inscribable"),
            x["quantity"].alias("quantity"), x["price"].alias("price"), x["raw"].alias("raw"),
        ).cast(_OFFER)
        return F.flatten(F.transform(reqs, lambda r: F.transform(attrs, lambda a: one(r, a))))

    def state(s: Column, **changed: Column) -> Column:
        names = [f.split(":")[0] for f in "item item_key family prefix requirement spread local dedication pending out".split()]
        return F.struct(*(changed.get(n, s[n]).alias(n) for n in names)).cast(_STATE_OF_FOLD)

    def step(before: Column, x: Column) -> Column:
        return exprs.once(before.withField("local", F.when(~x["hard"], before["local"])), lambda s: read(s, x))

    def read(s: Column, x: Column) -> Column:
        flushed = F.concat(s["out"], s["pending"])
        own_req = F.get(x["reqs"], F.lit(0))
        local = F.coalesce(own_req, s["local"])
        dedication = F.coalesce(x["dedication"], s["dedication"])

        def named(r: Column) -> Column:  # r: the name resolved
            weapon = F.lower(r["item"]).rlike(rf"\b(?:{_ANY_HEADING})\b") & ~F.lower(r["item"]).rlike(r"^(?:miniature|everlasting)\b")
            inherits = F.coalesce(s["local"], F.when(s["spread"] | weapon, s["requirement"]))
            mine = F.when(r["attached"], dedication).otherwise(x["dedication"])
            made = offers(x, r["item"], r["item_key"], inherits, mine)
            bare = (F.size(x["attrs"]) == 0) & x["price"]["amount"].isNull() & x["quantity"].isNull()
            return state(
                s, item=r["item"], item_key=r["item_key"], family=F.when(r["attached"], s["family"]), prefix=F.when(r["attached"], s["prefix"]), requirement=F.coalesce(own_req, s["requirement"]), local=local,
                dedication=F.when(r["attached"], s["dedication"]), pending=F.when(bare, made).otherwise(no_offers), out=F.when(bare, F.concat(r["kept"], no_offers)).otherwise(F.concat(r["kept"], made)),
            )

        def resolve(h: Column) -> Column:  # h: what the catalog knows
            headed = (s["family"].isNotNull() | s["prefix"].isNotNull()) & ~x["own_family"]
            known = F.coalesce(h["own"], h["part"])
            attach = headed & (h["attached"].isNotNull() | (known.isNull() & (F.lit(not strict) | s["prefix"].isNotNull() | s["family"].isin(*_FIRST))))
            item = F.when(attach, F.coalesce(h["attached"]["name"], h["text"])).otherwise(F.coalesce(known["name"], x["name"]))
            key = F.when(attach, h["attached"]["item_key"]).otherwise(known["item_key"])
            # a heading that a name follows is no offer of its own
            kept = F.when(attach & s["item"].isNull(), s["out"]).otherwise(flushed)
            return exprs.once(F.struct(item.alias("item"), key.alias("item_key"), attach.alias("attached"), kept.alias("kept")), named)

        part = F.get(F.filter(F.transform(F.concat(spans(x), runs(x)), found), lambda hit: hit.isNotNull()), F.lit(0))
        attached = _attach(x["name"], s["family"], s["prefix"])
        own = F.coalesce(found(x["full"]), found(x["name"]))
        # a part counts only where the whole name is unknown
        by_name = exprs.once(F.struct(found(attached).alias("attached"), own.alias("own"), F.when(own.isNull(), part).alias("part"), attached.alias("text")), resolve)
        with_mods = F.transform(s["pending"], lambda o: o.withField("oldschool", o["oldschool"] | x["oldschool"]).withField("inscribable", o["inscribable"] | x["inscribable"]).withField("dedication", F.coalesce(x["dedication"], o["dedication"])))
        heading = F.coalesce(x["heading"], x["prefix"])
        variant = offers(x, s["item"], s["item_key"], F.coalesce(s["local"], s["requirement"]), dedication)
        return (
            F.when(x["kind"] == "req", state(s, requirement=own_req, spread=F.lit(True), local=own_req, pending=no_offers, out=flushed))
            .when(
                x["kind"].isin("heading", "prefix"),
                state(
                    s, item=none, item_key=none, family=F.when(x["kind"] == "heading", x["heading"]), prefix=F.when(x["kind"] == "prefix", x["prefix"]), requirement=own_req, spread=own_req.isNotNull(), local=own_req, dedication=x["dedication"],
                    pending=F.when(x["kind"] == "heading", offers(x, F.coalesce(F.nullif(x["full"], F.lit("")), heading), none, none, x["dedication"])).otherwise(no_offers), out=flushed,
                ),
            )
            .when(x["kind"] == "name", by_name)
            .when((x["kind"] == "mods") & (F.size(s["pending"]) > 0), state(s, pending=with_mods))
            .when((x["kind"] == "variant") & s["item"].isNotNull(), state(s, local=local, pending=no_offers, out=F.concat(s["out"], variant)))
            .otherwise(state(s, local=local))
        )

    return F.aggregate(clauses, start, step, lambda s: F.concat(s["out"], s["pending"]))


def cut_at_items(clauses: Column, hits: Column) -> Column:
    """Clauses cut before every catalog item but the first that they hold, and before the word of a family behind an item.

    Requirements, colours and states right before an item go with it; a family takes all since the item before it.
    """
    found = lambda words: F.try_element_at(hits, catalog.plain(F.array_join(words, " "))).isNotNull()

    def places(w: Column) -> Column:  # (start, words, item): what each word begins, items the longest first
        many = F.sequence(F.lit(LONGEST), F.lit(1))
        fits = lambda i: F.get(F.filter(many, lambda n: (i + n - 1 <= F.size(w)) & found(F.slice(w, i, n))), F.lit(0))
        one = lambda i: exprs.once(fits(i), lambda n: F.struct(i.alias("start"), F.coalesce(n, F.lit(1)).alias("words"), n.isNotNull().alias("item"), F.lower(F.element_at(w, i)).rlike(rf"^(?:{_ANY_HEADING})$").alias("family")))
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(w)), one), lambda p: p["item"] | p["family"])

    def points(w: Column, held: Column) -> Column:  # where clauses begin, the first word aside
        along = F.transform(w, lambda t: F.lower(t).rlike(r"^(?:r?q\d{1,2}|gold|green|purple|blue|white|insc|os|unid|unded|ded)$"))
        none = F.struct(F.lit(0).alias("end"), F.lit(False).alias("item"), F.array().cast("array<int>").alias("at"))

        def take(s: Column, p: Column) -> Column:
            free = p["start"] > s["end"]
            before = F.sequence(s["end"] + 1, p["start"])
            own = F.filter(before, lambda k: F.forall(F.slice(along, k, p["start"] - k), lambda a: a))
            start = F.when(p["item"], F.element_at(own, 1)).otherwise(s["end"] + 1)
            new = free & s["item"]
            taken = F.struct((p["start"] + p["words"] - 1).alias("end"), (p["item"] | s["item"]).alias("item"), F.when(new, F.array_append(s["at"], start)).otherwise(s["at"]).alias("at"))
            return F.when(free & (p["item"] | s["item"]), taken).otherwise(s)

        return F.aggregate(held, none, take, lambda s: s["at"])

    def parts(x: Column, w: Column, at: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(1)), at), F.concat(F.transform(at, lambda k: k - 1), F.array(F.size(w)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z, i: describe(F.array_join(F.slice(w, z["a"], z["b"] - z["a"] + 1), " "), x["hard"] & (i == 0)))

    def cut_one(x: Column) -> Column:
        w = F.split(F.trim(x["raw"]), r"\s+")
        at = exprs.once(w, lambda v: exprs.once(places(v), lambda p: F.when(F.size(p) > 1, points(v, p)).otherwise(F.array().cast("array<int>"))))
        may = (x["kind"] == "name") & F.try_element_at(hits, catalog.plain(x["full"])).isNull()
        return F.when(may, exprs.once(F.struct(w.alias("w"), at.alias("at")), lambda z: F.when(F.size(z["at"]) > 0, parts(x, z["w"], z["at"])).otherwise(F.array(x)))).otherwise(F.array(x))

    return F.flatten(F.transform(clauses, cut_one))


def list_offers(messages: DataFrame, known: DataFrame | None = None, id_column: str = "message_id", text_column: str = "message") -> DataFrame:
    """(message_id, block, pos, trade_type, item, item_key, requirement, attribute, ...): one row per offer of a message.

    ``known`` (alias, item_key, name) is the catalog; aliases that mean several items must be left out. Without it, names are
    taken as they are. Null and empty messages, and those that the gate keeps out, have no offers; messages that share an id are
    read each for itself, but each distinct text once. The names of a message meet the catalog in an equi-join, broadcast only if counted small.
    """
    gated = exprs.once(text.normalise(c("_text")), lambda m: F.when(text.gate(m)["accepted"], text.split_offers(m)))
    rows = catalog.opened(catalog.distinct_texts(messages, text_column), ["_text"], gated, "block", "b")
    rows = rows.select("_text", "block", "b.trade_type", described(c("b.text")).alias("clauses"))
    if known is None:
        told = rows.withColumn("hits", F.lit(None).cast("map<string,struct<item_key:string,name:string>>"))
    else:
        names = known.select(c("alias").alias("_alias"), F.struct("item_key", "name").alias("_hit"))
        names = F.broadcast(names) if names.limit(catalog.SMALL + 1).count() <= catalog.SMALL else names
        # the clauses go with the first of a block's many candidates; of the others only those stay that the catalog has
        met = rows.select("*", F.posexplode_outer(candidates(c("clauses"))).alias("_at", "_c")).withColumn("_first", F.coalesce("_at", F.lit(0)) == 0)
        met = met.select("_text", "block", "trade_type", F.when(c("_first"), c("clauses")).alias("clauses"), "_first", "_c").join(names, c("_c") == c("_alias"), "left").where(c("_first") | c("_hit").isNotNull())
        pairs = F.collect_list(F.when(c("_hit").isNotNull(), F.struct(c("_c").alias("key"), c("_hit").alias("value"))))
        told = met.groupBy("_text", "block").agg(F.first("trade_type").alias("trade_type"), F.first("clauses", ignorenulls=True).alias("clauses"), F.map_from_entries(pairs).alias("hits"))
        told = told.withColumn("clauses", cut_at_items(c("clauses"), c("hits")))
    out = catalog.opened(told, ["_text", "block", "trade_type"], fold(c("clauses"), c("hits"), known is not None), "pos", "o").where("o.item <> ''")
    said = messages.select(c(id_column).alias("message_id"), c(text_column).alias("_said"))
    return said.join(out, c("_said") == c("_text")).select("message_id", "block", "pos", "trade_type", "o.*")
