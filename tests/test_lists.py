"""Messages that hold lists, read in context."""

import pytest

from tradewinds.operators import lists

NAMES = "zodiac staff,embercrest staff,ghostly staff,zodiac shield,crystalline sword,miniature gwen,miniature kanaxai,miniature mallyx,miniature bone dragon,voltaic spear,war pick,archaic maul,platinum wand,silverwing bow".split(",")
ALIASES = [("bds", "bone_dragon_staff", "Bone Dragon Staff"), ("war tome", "warrior_tome", "Warrior Tome"), ("volta", "voltaic_spear", "Voltaic Spear")]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(n, n.replace(" ", "_"), n.title()) for n in NAMES] + ALIASES, "alias string, item_key string, name string")


#: Message, fields that are compared, and what each offer says in them.
CASES = [
    (
        "WTS BDS | Air Q9/11 | Blood Q9/11 | SR Q10/11 | Illu Q9/10 | Smite Q9/10/13 | Dom Q9/12 | DF Q10 | Resto Q9/12 | Com Q10", "item attribute requirement",
        [("Bone Dragon Staff", a, q) for a, qs in [("air magic", "q9 q11"), ("blood magic", "q9 q11"), ("soul reaping", "q10 q11"), ("illusion magic", "q9 q10"), ("smiting prayers", "q9 q10 q13"), ("domination magic", "q9 q12"), ("divine favor", "q10"), ("restoration magic", "q9 q12"), ("communing", "q10")] for q in qs.split()],
    ),
    ("WTB Q9 Staves | Zodiac (OS) | Embercrest | Ghostly (Inspi)", "item requirement attribute oldschool", [("Zodiac Staff", "q9", None, True), ("Embercrest Staff", "q9", None, False), ("Ghostly Staff", "q9", "inspiration magic", False)]),
    ("WTS Zodiac Shield q9 str, Crystalline Sword q9 100a", "item requirement attribute amount", [("Zodiac Shield", "q9", "strength", None), ("Crystalline Sword", "q9", None, 100)]),
    ("WTS minis: Gwen, Kanaxai & Mallyx 5e each", "item amount basis", [("Miniature Gwen", 5, "each"), ("Miniature Kanaxai", 5, "each"), ("Miniature Mallyx", 5, "each")]),
    ("WTS 5 party 3 sweet points 2e", "item quantity", [("party points", 5), ("sweet points", 3)]),
    ("WTS 1,200 party, 300 alc", "item quantity", [("party points", 1200), ("alc points", 300)]),
    ("WTS BDay Present 1-7", "item", [(f"BDay Present {k}",) for k in range(1, 8)]),
    ("WTS unded minis | Bone Dragon, Zhed | Voltaic Spear q9", "item dedication requirement", [("Miniature Bone Dragon", "undedicated", None), ("Miniature Zhed", "undedicated", None), ("Voltaic Spear", None, "q9")]),
    ("WTS Q11 Eternal Blade | Insc", "item requirement inscribable", [("Eternal Blade", "q11", True)]),
    ("WTS Q9 | War Pick | Archaic Maul", "item requirement", [("War Pick", "q9"), ("Archaic Maul", "q9")]),
    ('WTS "Zodiac | Staff" 5e', "item amount", [("Zodiac Staff", 5)]),
    ("WTS TOMES: WAR (WARRIOR)", "item", [("Warrior Tome",)]),
    ("Elite Tomes: Monk (12) Ele (6) Mes (10) 2e/ea", "item quantity amount basis", [("Elite Tomes Monk", 12, 2, "each"), ("Elite Tomes Ele", 6, 2, "each"), ("Elite Tomes Mes", 10, 2, "each")]),
    ("WTS Frog Scepter q9 insp SR", "item requirement attribute", [("Frog Scepter", "q9", "inspiration magic"), ("Frog Scepter", "q9", "soul reaping")]),
    ("WTS BDS | q10 Heal 6e, Fire 4e | Death 4e", "requirement attribute amount", [("q10", "healing prayers", 6), ("q10", "fire magic", 4), (None, "death magic", 4)]),
    ("WTS Q9 FC BDS, Q8 Tac Shield", "item requirement attribute", [("Bone Dragon Staff", "q9", "fast casting"), ("Shield", "q8", "tactics")]),
    ("WTS BDS/ q8 gold inscribable scarabshell shield", "item requirement inscribable", [("Bone Dragon Staff", None, False), ("gold scarabshell shield", "q8", True)]),
    ("WTS Ghostly Staff Green shield q8", "item requirement", [("Ghostly Staff", None), ("Green shield", "q8")]),
    ("WTS Zodiac Shield q9 Crystalline Sword", "item requirement", [("Zodiac Shield", None), ("Crystalline Sword", "q9")]),
    ("WTS Q9 Volta (Voltaic Spear) INSC | WTB unded minis | Gwen", "trade_type item requirement inscribable dedication", [("sell", "Voltaic Spear", "q9", True, None), ("buy", "Miniature Gwen", None, False, "undedicated")]),
    ("WTB PLATINUM WAND REQ CHANNELING", "item requirement attribute", [("Platinum Wand", "any", "channeling magic")]),
    ("WTB Q9 Staves", "item requirement", [("Staves", "q9")]),
    ("WTS q5-7 bows 5e", "item requirement amount", [("bows", "q5", 5), ("bows", "q6", 5), ("bows", "q7", 5)]),
    ("WTS BDS all q9 // q10 dom/death/insp", "requirement attribute", [("q10", "domination magic"), ("q10", "death magic"), ("q10", "inspiration magic")]),
    ("WTS Rez 18e/stk; 20/20 bow", "item amount", [("Rez", 18), ("20/20 bow", None)]),
    ("Hello", "item", []), ("", "item", []), (None, "item", []), ("WTS", "item", []), ("WTS | , & ; ()", "item", []),
]


def test_lists_in_context(spark, known):
    messages = spark.createDataFrame([(k, m) for k, (m, _, _) in enumerate(CASES)], "message_id long, message string")
    rows = sorted(lists.list_offers(messages, known).select("*", "price.amount", "price.basis").collect(), key=lambda r: (r.message_id, r.block, r.pos))
    got = [(m, [tuple(r[f] for f in fields.split()) for r in rows if r.message_id == k]) for k, (m, fields, _) in enumerate(CASES)]
    assert [(g, want) for g, (_, _, want) in zip(got, CASES) if g[1] != want] == []


def test_without_a_catalog_headings_name_what_follows(spark):
    messages = spark.createDataFrame([(1, "WTB q9 Staves | Goldhorn | Icicle 5e"), (1, "WTB q9 Staves | Goldhorn | Icicle 5e"), (None, "WTS ded minis: Zhed, Gwen")], "message_id long, message string")
    got = sorted(((r.message_id, r.item, r.item_key, r.requirement, r.dedication) for r in lists.list_offers(messages).collect()), key=repr)
    two = [(1, "Goldhorn Staff", None, "q9", None), (1, "Icicle Staff", None, "q9", None)]
    assert got == sorted(two + two + [(None, "Miniature Gwen", None, None, "dedicated"), (None, "Miniature Zhed", None, None, "dedicated")], key=repr)


def test_long_messages_and_empty_tables(spark, known):
    long = "WTS " + " | ".join(f"Crystalline Sword q{k % 14}" for k in range(300))
    messages = spark.createDataFrame([(1, long)], "message_id long, message string")
    assert lists.list_offers(messages, known).where("item_key = 'crystalline_sword'").count() == 300
    assert lists.list_offers(messages.limit(0), known).count() == 0 and lists.list_offers(messages, known.limit(0)).count() == 300
