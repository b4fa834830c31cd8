"""What is left of a segment in which no item was found: a category, a fragment, a service, or perhaps an item that is missing.

Every word has a kind; which kinds occur, and how many words there are, decides. A rule holds if all kinds that it needs occur
and none besides but those that it allows, so the order of the words says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, values
from .exprs import once

# Words of the trade language by their kind.
KINDS = {
    "profession": "assassin derv dervish ele elementalist mes mesmer mo monk necro necromancer para paragon rang ranger rit ritualist sin war warrior",
    "professions": "profess profession professions",
    "weapon": "axe axes bow bows dagger daggers hammer hammers scy scythe scythes shield spear spears staff staves sword swords wand wands",
    "part": "bowstring bowstrings grip grips haft hafts head heads pommel pommels string strings wrapping wrappings",
    "upgrade": "barbed crippling cruel fiery hale icy insightful shocking sundering vamp vampiric zealous",
    "enchanting": "ench enchant stance",
    "mods": "mod mods",
    "goods": "greens inscriptions shields skins tonics upgrades weapon weapons weaps",
    "tome": "tome tomes",
    "normal": "normal",
    "elite": "elite",
    "mini": "mini miniature miniatures minis",
    "skin": "celestial tormented zodiac",
    "rarity": "blue gold green purple rare red white yellow",
    "state": "ded dedicated unded undedicated",
    "unidentified": "noid unid unids",
    "inscribable": "insc inscr inscribable inscriptable",
    "old": "oldschool os",
    "alcohol": "alcohol",
    "party": "drunk drunkard party",
    "sweet": "sweet",
    "points": "point points",
    "stack": "stack stacks",
    "set": "set sets",
    "hours": "hour hours",
    "times": "time times",
    "each": "ea each",
    "toward": "for from on",
    "joiner": "and or",
    "all": "all",
    "coin": "a e g k zkey zkeys",
    "asking": "q r req requirement rq",
}
#: Kinds of words that are written in many ways, by their form; a word of the table has its kind, any other is a name.
FORMS = [("number", r"^[0-9]+$"), ("price", r"^[0-9]+[aekg]$"), ("requirement", r"^r?q[0-9]+$"), ("letter", r"^.$")]
_ANY = "*"
_DESCRIBES = "requirement asking number attribute rarity inscribable old state mods".split()

# By subject: kind, reason, kinds that must occur, kinds that may, least and most words. The first that holds decides.
RULES: list[tuple[str, str, list[str], list[str], int, int]] = [
    # titles
    ("generic", "alcohol_point_category", ["alcohol", "points", "stack"], ["number"], 1, 9),
    ("generic", "alcohol_stack_category", ["alcohol", "stack"], [_ANY], 1, 99),
    ("generic", "title_points_category", ["sweet", "points"], [_ANY], 1, 99),
    ("generic", "points_category", ["party", "points"], [_ANY], 1, 99),
    # professions
    ("generic", "profession_list_context", ["profession"], [], 2, 99),
    ("generic", "profession_count_context", ["profession"], ["number", "joiner"], 1, 9),
    ("generic", "profession_weapon_modifier_search", ["profession", "weapon", "toward"], [_ANY], 1, 99),
    ("generic", "broad_market_category", ["all", "professions"], [], 1, 9),
    ("generic", "broad_market_category", ["all", "requirement", "inscribable"], [], 1, 9),
    # upgrades and attributes
    ("generic", "weapon_upgrade_component", ["part", "weapon"], [_ANY], 1, 99),
    ("generic", "weapon_upgrade_component", ["part", "upgrade"], [_ANY], 1, 99),
    ("generic", "weapon_upgrade_advertisement", ["weapon", "upgrade"], [_ANY], 1, 99),
    ("generic", "weapon_upgrade_advertisement", ["weapon", "enchanting"], [_ANY], 1, 99),
    ("generic", "weapon_upgrade_advertisement", ["weapon", "mods"], [_ANY], 1, 99),
    ("generic", "upgrade_modifier_list", ["upgrade"], [], 1, 99),
    ("noise", "orphan_modifier_fragment", ["enchanting"], ["number", "price"], 1, 9),
    ("generic", "upgrade_family", ["mods", "number"], [], 1, 9),
    ("generic", "generic_weapons_mods_listing", ["goods", "mods"], ["requirement", "inscribable"], 1, 9),
    ("generic", "attribute_upgrade_search", ["attribute"], ["mods", "number"], 1, 9),
    ("generic", "attribute_set_category", ["attribute", "set"], [], 1, 9),
    ("noise", "orphan_weapon_stats", ["requirement", "attribute"], _DESCRIBES, 1, 99),
    # goods
    ("generic", "unidentified_gold_category", ["rarity", "unidentified"], [], 1, 9),
    ("generic", "unidentified_item_category", ["unidentified"], [_ANY], 1, 99),
    ("generic", "rarity_or_collection_category", ["rarity", "mini"], ["joiner"], 1, 9),
    ("generic", "rarity_or_collection_category", ["rarity", "goods"], ["profession"], 1, 9),
    ("generic", "rarity_or_collection_category", ["rarity", "weapon"], ["profession"], 1, 9),
    ("generic", "generic_weapon_category", ["old", "goods"], [_ANY], 1, 99),
    ("generic", "generic_weapon_category", ["old", "weapon"], ["joiner", "goods", "rarity", "requirement"], 1, 99),
    ("generic", "generic_weapon_category", ["goods"], ["joiner"], 2, 9),
    ("generic", "weapon_family_search", ["skin", "goods"], [], 1, 9),
    ("generic", "miniature_category", ["mini"], ["all", "skin"], 2, 9),
    ("generic", "tome_category", ["tome"], ["normal", "price", "each", "number"], 2, 9),
    ("generic", "elite_tome_shorthand_family", ["elite", "letter"], ["coin", "asking", "each"], 2, 99),
    ("generic", "generic_category", ["goods"], [], 1, 1),
    ("generic", "generic_category", ["tome"], [], 1, 1),
    ("generic", "generic_category", ["mods"], [], 1, 1),
    ("generic", "generic_category", ["part"], [], 1, 1),
    ("generic", "miniature_category", ["mini"], [], 1, 1),
    ("generic", "market_category_or_variant", ["party"], [], 1, 1),
    ("generic", "market_category_or_variant", ["rarity"], [], 1, 1),
    # what is left of a price or of a description
    ("noise", "orphan_trade_quantity_context", ["stack"], ["number"], 1, 9),
    ("noise", "orphan_trade_quantity_context", ["price"], ["number", "joiner"], 1, 9),
    ("noise", "price_fragment", ["coin"], ["number"], 1, 9),
    ("noise", "price_context_fragment", ["times"], ["price", "number"], 1, 9),
    ("noise", "price_context_fragment", ["each"], ["toward"], 1, 9),
    ("noise", "service_duration_fragment", ["hours"], ["number"], 1, 9),
    ("noise", "single_token_fragment", ["letter"], [], 1, 1),
    ("noise", "dedication_only", ["state"], [], 1, 1),
]
RULES += [("noise", "modifier_only", [k], _DESCRIBES, 1, 99) for k in _DESCRIBES]
#: Services, by what the whole segment says.
SERVICES = [
    ("service_transport_or_tour", ["outpost run", "outpost runs", "crystal desert tour", "crystal desert tours", "campaign tour", "campaign tours", "service tour", "service tours", "ferry to", "ferry from", "run to", "runs to"]),
    ("service_or_listing", ["town in proph", "towns in proph", "rp to trim your guild", "storage sale", "inventory list"]),
    ("non_trade_request", ["can someone help me get"]),
]


def known_words() -> dict[str, str]:
    """The kind of every word of the table, the attributes' words among them."""
    found = {w: kind for kind, ws in KINDS.items() for w in ws.split()}
    for name, short in values.ATTRIBUTES.items():
        for w in " ".join((name, *short)).split():
            if len(w) > 1:
                found.setdefault(w, "attribute")
    return found


def kinds_of(words: Column) -> Column:
    """The kind of each word."""
    by_kind: dict[str, list[str]] = {}
    for w, kind in sorted(known_words().items()):
        by_kind.setdefault(kind, []).append(w)

    def kind(w: Column) -> Column:
        found = F
        for name, of in by_kind.items():
            found = found.when(w.isin(*of), name)
        for name, form in FORMS:
            found = found.when(w.rlike(form), name)
        return found.otherwise("name")

    return F.transform(words, kind)


def judge(candidate: Column, segment: Column) -> Column:
    """(kind, reason) of what is left (``candidate``) of a segment; nulls are empty."""
    say = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    left = F.trim(F.coalesce(candidate, F.lit("")))
    blank = (left == "") | (F.lower(left) == "unknown")

    def decide(kinds: Column) -> Column:
        found = F.when(blank, say("noise", "empty")).when(F.size(kinds) == 0, say("noise", "punctuation"))
        occurring = F.array_distinct(kinds)
        for kind, reason, must, may, least, most in RULES:
            fits = F.size(kinds).between(least, most)
            for m in must:
                fits = fits & F.array_contains(kinds, m)
            if _ANY not in may:
                fits = fits & (F.size(F.array_except(occurring, F.array(*map(F.lit, [*must, *may])))) == 0)
            found = found.when(fits, say(kind, reason))
        for reason, phrases in SERVICES:
            found = found.when(text.says(text.words(F.coalesce(segment, F.lit(""))), phrases), say("service", reason))
        return found.otherwise(say("item", "concrete_candidate"))

    return once(kinds_of(F.regexp_extract_all(F.lower(left), F.lit("[a-z0-9']+"), 0)), decide)
