"""Goldens of the text operators."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewinds.functions import leftovers, text
from tradewinds.operators import catalog


def value(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "segment, amount, currency, basis, quantity, unit",
    [
        ("5 GoTT 12e", 12, "e", "total", 5, 2.4), ("11 zkey for 7 ectos", 7, "e", "total", 11, 7 / 11), ("3:1 ecto", 1, "e", "ratio", 3, 1 / 3), ("2 stacks 18e/stk", 18, "e", "stack", 250, 0.072),
        ("225-675e", 675, "e", "range", None, None), ("27e/ea", 27, "e", "each", None, 27), ("Rez 4e/stk", 4, "e", "stack", 250, 0.016), ("2a", 2, "a", "unqualified", None, 54),
        ("1750e = 64a", 1750, "e", "currency_conversion", None, None), ("30k", 30, "k", "unqualified", None, 2), ("400gv", None, None, "unknown", None, None), ("20/20", None, None, "unknown", None, None),
        ("15^50", None, None, "unknown", None, None), ("+30", None, None, "unknown", None, None), ("-2we", None, None, "unknown", None, None),
    ],
)
def test_price(spark, segment, amount, currency, basis, quantity, unit):
    p = value(spark, text.price, segment)
    assert (p.amount, p.currency, p.basis, p.quantity) == (amount, currency, basis, quantity)
    assert p.unit_ecto == (None if unit is None else pytest.approx(unit))


def test_shared_price_and_prefix(spark):
    assert value(spark, text.shared_price, "A, B, C 4k each") == ["A 4k each", "B 4k each", "C 4k each"]
    assert value(spark, text.shared_prefix, "Elite Tomes: Monk, Ele, Mes") == ["Elite Tomes Monk", "Elite Tomes Ele", "Elite Tomes Mes"]
    assert value(spark, text.shared_price, "A 4k") == ["A 4k"]


def test_split_offers(spark):
    got = [tuple(b) for b in value(spark, text.split_offers, "hi WTS Q9 Volta | WTB unded Gpriest")]
    assert got == [("sell", "Q9 Volta"), ("buy", "unded Gpriest")]
    assert [tuple(b) for b in value(spark, text.split_offers, "just a bow")] == [("unknown", "just a bow")]
    assert value(spark, text.split_offers, "") == [] and value(spark, text.split_offers, None) == []


@pytest.mark.parametrize(
    "message, kind",
    [("Hello", "noise"), ("PC on q9 bow", "price_check"), ("trim your guild cape here", "guild_advertisement"), ("fast dungeon run", "service"), ("WTS bow, pc on it", "market"), ("WTB Q8 Flatbow", "market"), ("", "noise"), ("how much is a staff", "price_question")],
)
def test_gate(spark, message, kind):
    assert value(spark, text.gate, message).kind == kind


def test_metadata(spark):
    m = value(spark, text.metadata, "PLATINUM WAND REQ CHANNELING insc unded 20/20")
    assert (m.requirement, m.attribute, m.inscribable, m.dedication, m.upgrades) == ("any", "channeling magic", True, "undedicated", ["20/20"])
    assert value(spark, text.metadata, "RQ9 SILVERWING BOW").requirement == "q9"


def test_requirements(spark):
    assert value(spark, text.expand_requirements, "bow q5-7") == ["bow q5", "bow q6", "bow q7"]
    assert value(spark, text.expand_requirements, "BDS Air Q9/11") == ["BDS Air q9", "BDS Air q11"]
    assert value(spark, text.expand_requirements, "bow") == ["bow"]


@pytest.mark.parametrize("raw, name", [("Rez /stk", "Rez"), ("Rez per stack", "Rez"), ("Rez [x250]", "Rez"), ("Black Dye /each", "Black Dye")])
def test_clean_name(spark, raw, name):
    assert value(spark, text.clean_name, raw) == name


def test_exchange(spark):
    assert tuple(value(spark, text.exchange, "Tengu flare 2:1 Ghastly")) == ("Tengu flare", 2.0, 1.0, "Ghastly")


def test_tokens(spark):
    assert [(t.value, t.start, t.length) for t in value(spark, text.tokens, "q9 bow, q9")] == [("q9", 1, 2), ("bow", 4, 3), ("q9", 9, 2)]


def parsed(spark, *messages):
    df = spark.createDataFrame(list(enumerate(messages)), "message_id long, message string")
    return sorted(catalog.parse(df).collect(), key=lambda r: (r.message_id, r.block, r.segment_no, r.part))


def test_parse_inherits_requirement_and_drops_repeats(spark):
    got = parsed(spark, "WTB Q9 Staves | Zodiac staff | Zodiac staff 5e", "Hello", "", None)
    assert sorted((r.item, r.requirement) for r in got) == [("Staves", "q9"), ("Zodiac staff", "q9")]


def test_parse_lists_exchanges_and_headings(spark):
    got = parsed(
        spark, "Elite Tomes: Monk (12) Ele (6) Mes (10) 2e/ea", "WTS BDS | Air Q9/11 | Blood Q9/10", "WTT Tengu flare 2:1 Ghastly", "WTS 2 Armbrace 54e, Zkeys 5=2e", "WTS A sword, B axe, C bow 4k each",
        "WTB PLATINUM WAND REQ CHANNELING", "WTS Rez 4e/stk", "WTS Q9 Volta | WTB unded Gpriest",
    )
    of = lambda k: [r for r in got if r.message_id == k]
    assert [(r.item, r.price_amount, r.price_basis) for r in of(0)] == [("12 Elite Tomes Monk", 2, "each"), ("6 Elite Tomes Ele", 2, "each"), ("10 Elite Tomes Mes", 2, "each")]
    assert [(r.item, r.attribute, r.requirement) for r in of(1)] == [("BDS", "air magic", "q9"), ("BDS", "air magic", "q11"), ("BDS", "blood magic", "q9"), ("BDS", "blood magic", "q10")]
    assert [(r.item, r.quantity, r.receive, r.receive_quantity, r.price_basis, r.price_amount) for r in of(2)] == [("Tengu flare", 2, "Ghastly", 1, "barter", None)]
    assert [(r.price_amount, r.quantity, r.price_basis, r.unit_price) for r in of(3)] == [(54, 2, "total", 27), (2, 5, "exchange", 0.4)]
    assert [(r.price_amount, r.price_currency, r.price_basis) for r in of(4)] == [(4, "k", "each")] * 3
    assert [(r.attribute, r.requirement) for r in of(5)] == [("channeling magic", "any")]
    assert [(r.item, r.price_basis, r.quantity) for r in of(6)] == [("Rez", "stack", 250)] and [(r.trade_type, r.requirement) for r in of(7)] == [("sell", "q9"), ("buy", None)]


def test_sets_have_the_size_of_their_item(spark):
    df = spark.createDataFrame([(1, "WTS Rin Relics set 5a"), (2, "WTS Rin Relics 5a"), (3, "WTS Odd set 5a")], "message_id long, message string")
    sizes = spark.createDataFrame([("Rin Relic", 25), (None, 3)], "item string, n int")
    got = {r.message_id: (r.price_basis, r.quantity, r.unit_price) for r in catalog.with_sets(catalog.parse(df), sizes).collect()}
    assert got == {1: ("set", 25, pytest.approx(5.4)), 2: ("unqualified", None, 135), 3: ("unqualified", None, 135)}


@pytest.mark.parametrize("segment, amount, basis", [("5e or 27e/ea", 27, "each"), ("1750e = 64a 2e/stk", 1750, "currency_conversion"), ("Air 12 e", 12, "unqualified"), ("q9 20/20 15^50 3e", 3, "unqualified"), ("x250 4e", 4, "total")])
def test_the_surest_price_wins(spark, segment, amount, basis):
    p = value(spark, text.price, segment)
    assert (p.amount, p.basis) == (amount, basis)


def test_attribute_is_the_longest_and_not_negated(spark):
    assert [value(spark, text.attribute_of, s) for s in ("soul reaping sr", "no domination, air", "death and dom", "dagger", None)] == ["soul reaping", "air magic", "death magic", None, None]


def test_negatives_modifiers_family_score(spark):
    assert value(spark, text.strip_negatives, "bow (no q9) axe") == "bow  axe" and value(spark, text.modifiers, "q9 air os") == {"requirement": "q9", "attribute": "air magic", "oldschool": "OS"}
    assert value(spark, text.family, "Zodiac Staves") == "staff"
    row = spark.range(1).select(text.parse_score(F.lit(0.9), F.lit(True), F.lit(None).cast("string"), F.lit(5.0), F.lit("each"), F.lit(False), F.lit(False), F.lit(False)).alias("s")).first().s
    assert (row.confidence, row.status) == (0.9, "accepted")


def test_dictionary_takes_the_longest_leftmost(spark):
    messages = spark.createDataFrame([(1, "WTS zodiac staff and a bow")], "id long, m string")
    aliases = spark.createDataFrame([("zodiac", "z"), ("zodiac staff", "zs"), ("staff and", "x"), ("bow", "b")], "alias string, item_key string")
    assert sorted(r.item_key for r in catalog.dictionary_join(messages, aliases, "m", "id").collect()) == ["b", "zs"]


def test_fuzzy_needs_a_clear_winner(spark):
    names = spark.createDataFrame([("voltaic speer",), ("zzz",)], "name string")
    aliases = spark.createDataFrame([("voltaic spear", "v"), ("silver bow", "s")], "alias string, item_key string")
    assert [(r.name, r.item_key) for r in catalog.fuzzy_join(names, aliases, 0.8).collect()] == [("voltaic speer", "v")]


def test_dictionary_against_brute_force(spark):
    rng = np.random.default_rng(1)
    some = lambda n: " ".join(rng.choice(list("abcde"), n))
    names = sorted({some(int(n)) for n in rng.integers(1, 9, 60)})
    texts = [(k, some(int(n)) if n else None) for k, n in enumerate(rng.integers(0, 40, 80))] + [(80, "")]
    want = set()
    for k, t in texts:
        ws, at = (t or "").split(), 0
        while at < len(ws):
            fits = [n for n in range(1, 10) if at + n <= len(ws) and " ".join(ws[at : at + n]) in names]
            if fits:
                want.add((k, " ".join(ws[at : at + max(fits)]), at, max(fits)))
            at += max(fits, default=1)
    aliases = spark.createDataFrame([(n, f"k{n}") for n in names], "alias string, item_key string")
    got = catalog.dictionary_join(spark.createDataFrame(texts, "id long, m string"), aliases, "m", "id").collect()
    assert {(r.id, r.alias, r.start, r.words) for r in got} == want and len(got) == len(want) and max(r.words for r in got) >= 6


def test_compact_names_and_vetoes(spark):
    texts = ["WTS voltaicspear, VOLTAIC-SPEAR and volta icspear", "avoltaicspear voltaicspears", "not voltaic spear", "voltaic spear set", "zod iac staff and", None, "", "x " * 3000 + "bow"]
    aliases = spark.createDataFrame([("Voltaic Spear", "v"), ("zodiac staff", "z"), ("zodi acstaff", "y"), ("bow", "b"), ("", "e")], "alias string, item_key string")
    vetoes = spark.createDataFrame([("voltaic spear", "before", "not"), ("voltaic spear", "after", "SET"), ("bow", "after", "tie")], "alias string, side string, word string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, m string")
    of = lambda v: sorted((r.id, r.item_key, r.start, r.words) for r in catalog.compact_join(df, aliases, "m", "id", v).collect())
    always = [(0, "v", 1, 1), (0, "v", 2, 2), (0, "v", 5, 2), (4, "y", 0, 3), (7, "b", 3000, 1)]
    assert of(vetoes) == always and of(None) == sorted([*always, (2, "v", 1, 2), (3, "v", 0, 2)])


def _similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize("least", [0.88, 0.75])
def test_fuzzy_against_brute_force(spark, least):
    rng = np.random.default_rng(2)
    letters = list("abcdefg")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 10))))
    items = sorted({" ".join(word() for _ in range(int(rng.integers(1, 4)))) for _ in range(40)})
    names = []
    for n in items:
        at = int(rng.integers(0, len(n)))
        names += [n[:at] + n[at + 1 :], n[:at] + "z" + n[at + 1 :], n, n + "s", " ".join(reversed(n.split(" "))), n + " common"]
    items += [f"common {i}" for i in items[::3]]
    def like(x, y):
        stem = lambda w: re.sub("(?:es|s)$", "", w)
        return 1.0 if x == y else 0.98 if len(stem(x)) >= 4 and stem(x) == stem(y) else _similar(x, y)

    def score(a, b):
        xs, ys, used, total = a.split(" "), b.split(" "), set(), 0.0
        for x in xs:
            near = [(like(x, y), -j) for j, y in enumerate(ys) if j not in used]
            if near and max(near)[0] >= 0.72:
                total += max(near)[0]
                used.add(-max(near)[1])
        return 0.72 * 2 * total / (len(xs) + len(ys)) + 0.28 * _similar(a.replace(" ", ""), b.replace(" ", ""))

    want = {}
    for n in set(names):
        plain = " ".join(n.split())
        scored = sorted(((-score(plain, i), i) for i in items))
        if -scored[0][0] >= least and scored[1][0] - scored[0][0] >= 0.08:
            want[n] = (scored[0][1], -scored[0][0])
    aliases = spark.createDataFrame([(i, i) for i in items], "alias string, item_key string")
    got = {r.name: (r.item_key, r.score) for r in catalog.fuzzy_join(spark.createDataFrame([(n,) for n in [*names, "", None]], "name string"), aliases, least).collect()}
    assert got.keys() == want.keys() and all(got[n][0] == i and got[n][1] == pytest.approx(s) for n, (i, s) in want.items()) and len(got) > 30


def test_near_words_against_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    left, right = ({word(int(n)) for n in rng.integers(1, 14, 150)} for _ in range(2))
    for w in sorted(right)[::2]:
        at = int(rng.integers(0, len(w)))
        left |= {w[:at] + w[at + 1 :] or "a", w[:at] + "q" + w[at:], w + "es", w[:at] + "q" + w[at + 1 :]}
    frame = lambda ws: spark.createDataFrame([(w,) for w in sorted(ws)] + [(None,), ("",)], "w string")
    stem = lambda w: re.sub("(?:es|s)$", "", w)
    want = {(x, y) for x in left for y in right if x == y or (len(stem(x)) >= 4 and stem(x) == stem(y)) or _similar(x, y) >= 0.72}
    got = [tuple(r) for r in catalog.near_words(frame(left), frame(right)).collect()]
    assert set(got) == want and len(got) == len(want) > 400


def test_token_evidence_needs_a_single_best(spark):
    texts = spark.createDataFrame([(1, "wts storm daggers of the old"), (2, "storm"), (3, "stormy axes"), (4, None), (5, "silver silverwing")], "id long, text string")
    items = spark.createDataFrame([("sd", "Storm Daggers"), ("sb", "Storm Bow"), ("sw", "Silverwing Bow"), ("ax", "Storm Axe")], "item_key string, name string")
    assert {r.id: (r.item_key, r.score) for r in catalog.token_evidence(texts, items).collect()} == {1: ("sd", 6)}


def test_leftovers(spark):
    cases = [
        (None, "noise", "empty"), ("", "noise", "empty"), (" Unknown ", "noise", "empty"), ("...", "noise", "punctuation"), ("x" * 50_000, "item", "concrete_candidate"), ("Axe of Ünder", "item", "concrete_candidate"),
        ("Rit, Necro", "generic", "profession_list_context"), ("and 3 monk", "generic", "profession_count_context"), ("professions all", "generic", "broad_market_category"), ("2 stacks", "noise", "orphan_trade_quantity_context"),
        ("pommel for swords", "generic", "weapon_upgrade_component"), ("cruel, icy & barbed", "generic", "upgrade_modifier_list"), ("zodiac weapons", "generic", "weapon_family_search"), ("q7 tactics os", "noise", "orphan_weapon_stats"),
        ("os gold", "noise", "modifier_only"), ("dedicated", "noise", "dedication_only"), ("minis", "generic", "miniature_category"), ("6 hours", "noise", "service_duration_fragment"), ("party points 2e", "generic", "points_category"), ("q", "noise", "modifier_only"),
        ("Eternal Blade", "item", "concrete_candidate"), ("Party Beacon", "item", "concrete_candidate"), ("gold", "generic", "market_category_or_variant"), ("5e or", "noise", "orphan_trade_quantity_context"),
    ]
    df = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(cases)], "k int, s string")
    got = [tuple(r.g) for r in df.select("k", leftovers.judge(F.col("s"), F.col("s")).alias("g")).orderBy("k").collect()]
    assert got == [(kind, reason) for _, kind, reason in cases]
    services = spark.createDataFrame([("Xyz", "ferry to town"), ("Xyz", None), (None, "ferry to town")], "a string, b string")
    assert [tuple(r.g) for r in services.select(leftovers.judge(F.col("a"), F.col("b")).alias("g")).collect()] == [("service", "service_transport_or_tour"), ("item", "concrete_candidate"), ("noise", "empty")]
