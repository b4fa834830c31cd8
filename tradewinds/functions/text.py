"""Trade messages as text: gate, splitter, prices, modifiers, metadata, exchanges, all as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STACK
from . import values
from .exprs import once, to_ecto

# The words by which traders say what they want.
SIDES = {"buy": ("wtb", "buying"), "sell": ("wts", "selling"), "trade": ("wtt", "trading")}
_MARK = "|".join(w for ws in SIDES.values() for w in ws)
_NUMBER, _UNIT = r"(\d+(?:[.,]\d+)?)", r"(a|ambr(?:ace)?s?|armbraces?|e|ectos?|k|plat(?:inum)?)"
_TRIM = " \t\r\n_|-/:"


def normalise(message: Column) -> Column:
    """Entities decoded, typographic marks plain, white space single."""
    steps = [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;|[‘’`´]", "'"), ("[“”]", '"'), ("[–—]", "-"), (" ", " "),
        (r"(?i)\b(w)\s?[./]\s?(t)\s?[./]\s?([sbt])\b", "$1$2$3"), (r"([|~])\1+", "$1"), (r"\s+", " "),
    ]
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, message))


def words(message: Column) -> Column:
    """The words of a message with a blank before and after each: letters, digits and apostrophes, colons, question marks."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(message), F.lit("[a-z0-9']+|[:?]"), 0), " "), F.lit(" "))


def says(w: Column, phrases: list[str]) -> Column:
    """Whether :func:`words` hold one of the phrases; ``^`` and ``$`` tie it to the ends."""
    found = F.lit(False)
    for p in phrases:
        plain = f" {p.strip('^$')} "
        found = found | (w == plain if p[0] == "^" and p[-1] == "$" else F.startswith(w, F.lit(plain)) if p[0] == "^" else F.contains(w, F.lit(plain)))
    return found


def _verdict(kind: str, reason: str) -> Column:
    return F.struct(F.lit(kind == "market").alias("accepted"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))


def gate(message: Column) -> Column:
    """(accepted, kind, reason): whether a message can hold offers at all; the first row of the table that applies decides."""

    def decide(w: Column) -> Column:
        stated = says(w, [x for xs in SIDES.values() for x in xs])
        found = F.when(F.trim(w) == "", _verdict("noise", "empty"))
        for kind, reason, always, phrases in values.GATE:
            found = found.when(says(w, phrases) if always else says(w, phrases) & ~stated, _verdict(kind, reason))
        return found.otherwise(_verdict("market", "market_candidate"))

    return once(words(F.coalesce(message, F.lit(""))), decide)


def classify(message: Column, learned: dict[str, tuple[str, str]] | None = None) -> Column:
    """(accepted, kind, reason) of a message: the gate, then learned exclusions (phrase: kind, reason), contacts, names,
    guilds, and services (two words of service, or one with a price in armbraces)."""

    def decide(w: Column) -> Column:
        found = F
        for phrase, (kind, reason) in sorted((learned or {}).items()):
            found = found.when(F.contains(w, F.lit(phrase.lower())), _verdict(kind, reason))
        for kind, reason, phrases in values.CLASSES:
            found = found.when(says(w, phrases), _verdict(kind, reason))
        hits = sum((F.contains(w, F.lit(x)).cast("int") for x in values.SERVICE_WORDS), F.lit(0))
        paid = says(w, ["mission", "missions", "quest", "quests", "dungeon", "dungeons", "run", "runs", "rush", "service", "services"]) & w.rlike(" [0-9]+a ")
        return found.when((hits >= 2) | paid, _verdict("service", "service_advertisement")).otherwise(_verdict("market", "market_candidate"))

    first = gate(message)
    return F.when(~first["accepted"], first).otherwise(once(words(F.coalesce(message, F.lit(""))), decide))


def side_of(text: Column) -> Column:
    found = F
    for side, words in SIDES.items():
        found = found.when(text.rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), side)
    return found.otherwise("unknown")


def split_offers(message: Column) -> Column:
    """Array of (trade_type, text): what follows each marker up to the next; a message without markers is one block."""
    text = F.trim(message)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?is)\b(?:{_MARK})\b.*?(?=\b(?:{_MARK})\b|$)"), 0)
    made = F.transform(blocks, lambda b: F.struct(side_of(F.substring(b, 1, 7)).alias("trade_type"), F.trim(F.regexp_replace(b, rf"(?i)^(?:{_MARK})\b", ""), F.lit(_TRIM)).alias("text")))
    whole = F.array(F.struct(F.lit("unknown").alias("trade_type"), text.alias("text")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<struct<trade_type:string,text:string>>")).when(F.size(blocks) == 0, whole).otherwise(F.filter(made, lambda b: b["text"] != ""))


def strip_negatives(text: Column) -> Column:
    """Without '(no ...)', 'except ...' and 'not ...' clauses."""
    return F.trim(F.regexp_replace(text, r"(?i)\((?:no|not|except)\b[^)]*\)|\b(?:except|no)\s+[\w' ]+", ""))


def shared_prefix(text: Column) -> Column:
    """'prefix: a, b, c' as an array of 'prefix a', 'prefix b', 'prefix c'; any other text as an array of itself."""
    prefix, rest = F.regexp_extract(text, r"^\s*([A-Za-z' ]{3,40}):\s*(.+,.+)$", 1), F.regexp_extract(text, r"^\s*([A-Za-z' ]{3,40}):\s*(.+,.+)$", 2)
    parts = F.filter(F.transform(F.split(rest, r"\s*,\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(rest != "", F.transform(parts, lambda p: F.concat_ws(" ", F.trim(prefix), p))).otherwise(F.array(text))


def shared_price(text: Column) -> Column:
    """'A, B, C 4k each' as an array of 'A 4k each', ...: a trailing unit price holds for the whole list."""
    shape = rf"(?i)^(.+?)\s+({_NUMBER}\s*{_UNIT}\s*/?\s*(?:ea|each))\s*$"
    items, price = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    parts = F.filter(F.transform(F.split(items, r"\s*,\s*"), lambda p: F.trim(p)), lambda p: p != "")
    spread = (price != "") & (F.size(F.split(items, ",")) > 1)
    return F.when(spread, F.transform(parts, lambda p: F.concat_ws(" ", p, price))).otherwise(F.array(text))


def counted_list(text: Column) -> Column:
    """'prefix: a (12) b (6) 2e/ea' as an array of '12 prefix a 2e/ea', ...; any other text as an array of itself."""
    shape = r"^\s*([A-Za-z' ]{3,40}):\s*((?:[A-Za-z' ]+\(\d+\)\s*,?\s*){2,})(.*)$"
    get = lambda k: F.trim(F.regexp_extract(text, shape, k))
    parts = F.regexp_extract_all(get(2), F.lit(r"[A-Za-z' ]+\(\d+\)"), 0)
    made = F.transform(parts, lambda p: F.concat_ws(" ", F.regexp_extract(p, r"\((\d+)\)", 1), get(1), F.trim(F.regexp_extract(p, r"([A-Za-z' ]+)\(", 1)), get(3)))
    return F.when(get(2) != "", made).otherwise(F.array(text))


def priced_list(text: Column) -> Column:
    """Parts between commas, if each has a price of its own; else the text."""
    parts = F.filter(F.transform(F.split(text, r"\s*,\s+"), lambda p: F.trim(p)), lambda p: p != "")
    own = F.forall(parts, lambda p: p.rlike(rf"(?i)(?<![a-z0-9.]){_NUMBER}\s*{_UNIT}\b"))
    return F.when((F.size(parts) > 1) & own, parts).otherwise(F.array(text))


def segments(text: Column) -> Column:
    """Parts between | ; ~ and the like, but not within parentheses."""
    masked = F.regexp_replace(text, r"\(([^()|;~]*)[|;~]([^()]*)\)", "($1\u0001$2)")
    parts = F.split(masked, r"\s*(?:[|;~^]|//|\s-\s)\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit("|")))), lambda p: p != "")


def expand_requirements(text: Column) -> Column:
    """'bow q5-7' or 'bow q9/11' as one text for each requirement; ranges of ten at most."""
    span = r"(?i)\b(q|r|req)(\d{1,2})\s*-\s*q?(\d{1,2})\b"
    low, high = (F.nullif(F.regexp_extract(text, span, k), F.lit("")).try_cast("int") for k in (2, 3))
    ranged = F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.regexp_replace(text, F.lit(span), F.concat(F.lit("q"), n.cast("string"))))
    listed = r"(?i)\b(?:q|r|req)(\d{1,2}(?:/q?\d{1,2})+)\b(?!\s*%)"
    items = F.split(F.regexp_replace(F.regexp_extract(text, listed, 1), "(?i)q", ""), "/")
    each = F.transform(items, lambda n: F.regexp_replace(text, F.lit(listed), F.concat(F.lit("q"), n)))
    fits = low.isNotNull() & (high > low) & (high - low <= 10)
    return F.when(fits, ranged).when(F.regexp_extract(text, listed, 1) != "", each).otherwise(F.array(text))


#: The kinds of token in a price, a letter each: number, coin (short or in full), stack, each, times, goods, for, word.
_TOKEN = r"x(?=\d)|[a-z']+\d+[a-z]*|[a-z']+|\d+(?:[.,]\d+)?|[^\sa-z\d]"
_LETTERS = [(values.COINS, "c"), (values.COIN_NAMES, "C"), (values.STACK_WORDS, "s"), (values.EACH_WORDS, "h"), (["x"], "x"), (values.COUNTED, "g"), (["for"], "f")]
#: Rules on the letters of a segment's tokens, the surest first: (basis, shape, token of the quantity or the quantity itself,
#: token of the amount), tokens counted from the shape's begin or, if negative, from its end.
PRICE_RULES = [
    ("range", "n-n[cC]", None, 2),
    ("currency_conversion", "n[cC]=n[cC]", None, 0),
    ("ratio", "n:n[cC]", 0, 2),
    ("total", "n/n[cC]", 0, 2),
    ("exchange", "n=n[cC]", 0, 2),
    ("total", "n[wgCs]{0,6}fn[cC]", 0, -2),
    ("stack", "nsn[cC]/?s", float(STACK), 2),
    ("stack_total", "s[(]?xn[)]?[w-]{0,4}n[cC]", "xn", -2),
    ("stack", "n[cC]h?[/-]?s", float(STACK), 0),
    ("each", "n[cC][/.-]?h", "held", 0),
    ("each", "n[cC]/?xn", -1, 0),
    ("total", "nx?[gC]+[w,]{0,3}n[cC]", 0, -2),
    ("total", "xn.*n[cC]", 1, -2),
    ("unqualified", "n[cC]", None, 0),
]


def _price_of(t: Column) -> Column:
    """The price that tokens state, in the words of :func:`stated_price`."""

    def letter(w: Column) -> Column:
        found = F
        for known, sign in _LETTERS:
            found = found.when(w.isin(*known), sign)
        return found.when(w.rlike(r"^\d"), "n").when(w.rlike("^[a-z']"), "w").when(w.isin("–", "—"), "-").otherwise(w)

    def read(shape: Column) -> Column:
        void = F.lit(None).cast("string")
        coins = F.create_map(*[F.lit(x) for pair in {**values.COINS, **values.COIN_NAMES}.items() for x in pair])
        token = lambda at: F.get(t, at)
        held = F.coalesce(token(F.nullif(F.regexp_instr(shape, F.lit("xn")), F.lit(0))), token(F.nullif(F.regexp_instr(shape, F.lit("nx?g")), F.lit(0)) - 1))

        def made(basis: str, amount: Column, coin: Column, quantity: Column, fixed: float | None) -> Column:
            return F.struct(amount.alias("amount"), coin.alias("currency"), F.lit(basis).alias("basis"), quantity.alias("quantity"), F.lit(fixed).cast("double").alias("fixed"))

        found = F
        for basis, pattern, quantity, amount in PRICE_RULES:
            start = F.regexp_instr(shape, F.lit(pattern)) - 1
            end = start + F.length(F.regexp_substr(shape, F.lit(pattern)))
            place = lambda k: start + k if k >= 0 else end + k  # noqa: E731, B023
            fixed = None
            if quantity is None:
                q = void
            elif isinstance(quantity, float):
                q, fixed = void, quantity
            elif quantity == "held":
                q = held
            elif quantity == "xn":
                q = token(F.regexp_instr(shape, F.lit("xn")))
            else:
                q = token(place(quantity))
            found = found.when(start >= 0, made(basis, token(place(amount)), coins[token(place(amount) + 1)], q, fixed))
        return found.otherwise(_no_price())

    return once(F.array_join(F.transform(t, letter), ""), read)


def _no_price() -> Column:
    void = F.lit(None).cast("string")
    return F.struct(void.alias("amount"), void.alias("currency"), F.lit("unknown").alias("basis"), void.alias("quantity"), F.lit(None).cast("double").alias("fixed"))


def stated_price(segment: Column) -> Column:
    """(amount, currency, basis, quantity, fixed) of the price that a segment states, by the surest rule that fits: amount and
    quantity as they are written, and the quantity that the rule itself says."""
    # every rule wants a coin right behind a number
    return F.when(F.lower(segment).rlike(r"\d\s*[a-z]"), once(F.regexp_extract_all(F.lower(segment), F.lit(_TOKEN), 0), _price_of)).otherwise(_no_price())


def counted_price(stated: Column) -> Column:
    """(amount, currency, basis, quantity, unit_ecto) of a price as :func:`stated_price` has it."""
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    basis, quantity = stated["basis"], F.coalesce(stated["fixed"], number(stated["quantity"]))

    def made(x: Column) -> Column:
        ecto = to_ecto(x["amount"], stated["currency"])
        unit = F.when(basis.isin("each", "unqualified"), ecto).when(~basis.isin("range", "currency_conversion", "unknown") & (x["quantity"] > 0), ecto / x["quantity"])
        return F.struct(x["amount"].alias("amount"), stated["currency"].alias("currency"), basis.alias("basis"), x["quantity"].alias("quantity"), unit.cast("double").alias("unit_ecto"))

    return once(F.struct(number(stated["amount"]).alias("amount"), quantity.alias("quantity")), made)


def price(segment: Column) -> Column:
    """(amount, currency, basis, quantity, unit_ecto) of the price that a segment states, by the surest rule that fits."""
    return once(stated_price(segment), counted_price)


_TWENTY = r"(?<![a-z0-9])20(?![a-z0-9])"
#: Marks and words by which the value of a number can decide, not only its length: ranges, upgrades, character references; and
#: what is cut out between two numbers, so that they read as one.
_BY_VALUE = rf"(?is)[-–—#&+^]|{_TWENTY}.*/.*{_TWENTY}|\((?:no|not|except)\b"
#: Numbers up to which a text has a form; the place of each is one digit.
_PLACES = 10


def numbers_of(text: Column) -> Column:
    """The numbers of a text in order, if all that :func:`number_form` needs to know of them is where they stand; else none."""
    found = F.regexp_extract_all(text, F.lit("[0-9]+"), 0)
    return F.when(text.rlike(_BY_VALUE) | (F.size(found) > _PLACES), F.array().cast("array<string>")).otherwise(found)


def number_form(text: Column, numbers: Column) -> Column:
    """What texts share that differ in nothing but their numbers: '~', which of the numbers are equal (if any are), '~', and the
    text with zeros for digits. A text without such numbers is its own form, behind '='."""
    places = F.array_join(F.transform(numbers, lambda n: (F.array_position(numbers, n) - 1).cast("string")), "")
    equal = F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), places).otherwise("")
    return F.when(F.size(numbers) > 0, F.concat(F.lit("~"), equal, F.lit("~"), F.translate(text, "123456789", "000000000"))).otherwise(F.concat(F.lit("="), text))


def text_of_form(form: Column) -> Column:
    """A text of the form: each number is the place of the first one equal to it, in as many digits."""

    def told(x: Column) -> Column:
        between, runs = F.split(x["text"], "[0-9]+", -1), F.regexp_extract_all(x["text"], F.lit("[0-9]+"), 0)
        place = lambda i: F.when(x["equal"] == "", i.cast("string")).otherwise(F.substring(x["equal"], i + 1, F.lit(1)))
        return once(F.struct(between.alias("between"), runs.alias("runs")), lambda p: F.array_join(F.transform(p["between"], lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lpad(place(i - 1), F.length(F.get(p["runs"], i - 1)), F.lit("0")), t))), ""))

    equal = F.split_part(form, F.lit("~"), F.lit(2))
    whole = F.struct(equal.alias("equal"), F.substring(form, F.length(equal) + 3, F.length(form)).alias("text"))
    return F.when(F.startswith(form, F.lit("=")), F.substring(form, F.lit(2), F.length(form))).otherwise(once(whole, told))


def with_numbers(read: Column, numbers: Column) -> Column:
    """What was read from a :func:`text_of_form`, with a text's own numbers."""
    own = F.transform(F.regexp_extract_all(read, F.lit("[0-9]+|[^0-9]+"), 0), lambda t: F.coalesce(F.get(numbers, F.when(t.rlike("^[0-9]"), t).try_cast("int")), t))
    return F.when((F.size(numbers) > 0) & read.rlike("[0-9]"), F.array_join(own, "")).otherwise(read)


def attribute_of(segment: Column) -> Column:
    """The attribute that a segment names, by the longest of its names that occurs; what follows 'no' or 'not' is no name."""
    rows = sorted(((alias, name) for name, short in values.ATTRIBUTES.items() for alias in [name, *short] if alias not in values.WEAPON_WORDS), key=lambda r: (-len(r[0]), r[0]))

    def longest(w: Column) -> Column:
        found = F
        for alias, name in rows:
            found = found.when(F.contains(w, F.lit(f" {alias} ")), name)
        return found.otherwise(None)

    return once(F.regexp_replace(words(segment), " (?:no|not) [a-z']+(?= )", " "), longest)


def canonical_attribute(label: Column) -> Column:
    """The attribute's key (words joined by '_') of a name or short form; any other label as it is, in that form."""
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z]+", " "))
    known = F.create_map(*[F.lit(x) for name, short in values.ATTRIBUTES.items() for alias in [name, *short] for x in (alias, name)])
    return F.replace(F.coalesce(F.try_element_at(known, plain), plain), F.lit(" "), F.lit("_"))


def canonical_name(name: Column, item_key: Column) -> Column:
    """The name that an item has now: by its key, by an older name, else its own."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.coalesce(F.try_element_at(table(values.LEGACY_KEYS), F.trim(item_key)), F.try_element_at(table(values.LEGACY_NAMES), plain), F.trim(name))


def upgrades_of(segment: Column) -> Column:
    """The upgrades that a segment names."""

    def named(x: Column) -> Column:
        known = [F.when(x.rlike("|".join(rf"(?<![a-z0-9+/]){re.escape(way)}(?![a-z0-9])" for way in ways)), name) for name, ways in values.UPGRADES.items()]
        return F.array_compact(F.array(*known))

    return once(F.regexp_replace(F.lower(segment), r"\s*([+^/])\s*", "$1"), named)


def metadata(segment: Column) -> Column:
    """(requirement, attribute, inscribable, oldschool, dedication, identified, upgrades) that a segment states."""

    def read(x: Column) -> Column:
        w, attribute = x["w"], x["attribute"]
        number = F.regexp_extract(w, " (?:rq|req|requirement|q|r) ?([0-9]{1,2})(?= )", 1)
        any_req = attribute.isNotNull() & w.rlike(" (?:req|requirement) [a-z]")
        return F.struct(
            F.when(number != "", F.concat(F.lit("q"), number)).when(any_req, "any").alias("requirement"), attribute.alias("attribute"),
            says(w, ["insc", "inscr", "inscribable", "inscriptable"]).alias("inscribable"), says(w, ["os", "old school", "oldschool"]).alias("oldschool"),
            F.when(says(w, ["unded", "undedicated"]), "undedicated").when(says(w, ["ded", "dedicated"]), "dedicated").alias("dedication"),
            (~says(w, ["unid", "unidentified"])).alias("identified"), x["upgrades"].alias("upgrades"),
        )

    return once(F.struct(words(segment).alias("w"), attribute_of(segment).alias("attribute"), upgrades_of(segment).alias("upgrades")), read)


def modifiers(segment: Column) -> Column:
    """Map of the modifiers that a segment states."""

    def entries(m: Column) -> Column:
        of = {"requirement": m["requirement"], "attribute": m["attribute"], "oldschool": F.when(m["oldschool"], "OS"), "inscribable": F.when(m["inscribable"], "insc"), "dedication": m["dedication"]}
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in of.items()]), lambda e: e["value"].isNotNull()))

    return once(metadata(segment), entries)


# Weapon families.
FAMILIES = ("bow", "sword", "axe", "hammer", "staff", "wand", "focus", "shield", "spear", "scythe", "daggers", "miniature", "tome", "tonic", "dye")


def family(segment: Column) -> Column:
    found = F
    for name in FAMILIES:
        stem = {"staff": "sta(?:ff|ffs|ves)", "focus": "foc(?:us|i|uses)", "daggers": "daggers?", "miniature": "mini(?:ature)?s?"}.get(name, f"{name}s?")
        found = found.when(segment.rlike(rf"(?i)\b{stem}\b"), name)
    return found.otherwise(None)


def stated_exchange(segment: Column) -> Column:
    """(give, give_quantity, receive_quantity, receive) of 'give n:m receive' or 'n give for m receive', as they are written."""
    ratio = r"(?i)^\s*([a-z' ]+?)\s+(\d+)\s*[:=]\s*(\d+)\s+([a-z' ]+?)\s*$"
    named = r"(?i)^\s*(\d+)\s+([a-z' ]+?)\s+for\s+(\d+)\s+([a-z' ]+?)\s*$"
    get = lambda p, *ks: [F.regexp_extract(segment, p, k) for k in ks]
    shape = lambda g, n, m, r: F.struct(g.alias("give"), n.alias("give_quantity"), m.alias("receive_quantity"), r.alias("receive"))
    return F.when(segment.rlike(ratio), shape(*get(ratio, 1, 2, 3, 4))).when(segment.rlike(named), shape(*get(named, 2, 1, 3, 4)))


def exchange(segment: Column) -> Column:
    """:func:`stated_exchange` with numbers as quantities."""
    made = lambda x: F.struct(x["give"].alias("give"), x["give_quantity"].try_cast("double").alias("give_quantity"), x["receive_quantity"].try_cast("double").alias("receive_quantity"), x["receive"].alias("receive"))
    return once(stated_exchange(segment), lambda x: F.when(x.isNotNull(), made(x)))


def clean_name(text: Column) -> Column:
    """An item's name without notation: '/stk', 'per stack', '[x250]', '/each', prices and requirements."""
    steps = [rf"(?i)(?<![a-z0-9.]){_NUMBER}\s*(?:[-/:=]|\bfor\b)\s*{_NUMBER}\s*{_UNIT}\b", r"(?i)\[?\bx\s*\d+\]?", r"(?i)\[\s*\]", rf"(?i)(?<![a-z0-9]){_NUMBER}\s*(?:armbraces?|ambr(?:ace)?s?|ectos?|plat(?:inum)?)\b(?!\s+\d+(?:[.,]\d+)?\s*[aek]\b)", rf"(?i)(?<![a-z0-9]){_NUMBER}\s*[aek]\b", r"(?i)(?:/|\bper)\s*(?:stk|st|stacks?|ea|each)\b", r"(?i)\b(?:q|req|rq)\s*\d{1,2}\b", r"(?i)\b(?:os|insc|unded|ded)\b", r"[\[\](){}]", r"\s+"]
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, p, " "), steps, text), F.lit(" /-,:|"))


def parse_score(match_score: Column, concrete: Column, requirement: Column, amount: Column, basis: Column, has_modifiers: Column, rejected: Column, generic: Column) -> Column:
    """(confidence, status, reason) of a parsed offer."""
    say = lambda x, status, reason: F.struct(x.cast("double").alias("confidence"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    raw = match_score + F.when(amount.isNotNull(), 0.08).otherwise(0.0) + F.when(has_modifiers, 0.04).otherwise(0.0) - F.when(basis == "unknown", 0.02).otherwise(0.0)
    score = F.least(F.lit(0.99), F.greatest(F.lit(0.0), raw))
    return (
        F.when(rejected, say(F.lit(0.05), "rejected", "reject_pattern")).when(match_score.isNull(), say(F.when(amount.isNotNull(), 0.35).otherwise(0.20), "review", "no_catalog_item"))
        .when(~generic & (match_score >= 0.86) & concrete, say(F.greatest(F.lit(0.86), match_score), "accepted", "catalog_match"))
        .when(generic & requirement.isNotNull(), say(F.lit(0.86), "accepted", "catalog_match"))
        .when(score >= 0.82, say(score, "accepted", "catalog_match")).otherwise(say(score, "review", "low_confidence"))
    )


def tokens(text: Column) -> Column:
    """Array of (value, normalized, start, length): words in order with their places."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}+%^/:=.'-]+"), 0)

    def add(s: Column, w: Column) -> Column:
        at = F.instr(F.substring(text, s["at"], F.length(text)), w) + s["at"] - 1
        token = F.struct(w.alias("value"), F.lower(w).alias("normalized"), at.cast("int").alias("start"), F.length(w).alias("length"))
        return F.struct(F.array_append(s["out"], token).alias("out"), (at + F.length(w)).cast("int").alias("at"))

    empty = F.array().cast("array<struct<value:string,normalized:string,start:int,length:int>>")
    return F.aggregate(found, F.struct(empty.alias("out"), F.lit(1).alias("at")), add, lambda s: s["out"])
