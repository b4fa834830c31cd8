"""Which catalog item a clause means, strategy by strategy, and lists of which every part must be known."""

import pytest

from tradewinds.operators import strategies

NAMES = "Zodiac Staff,Zodiac Shield,Crystalline Sword,Eternal Shield,Plagueborn Sword,Demon Crest Axe,Miniature Celestial Sheep,Miniature Celestial Rat,Miniature Grawl,Elite Monk Tome,Elite Mesmer Tome,Monk Tome,Silver Dye,Axe,Glacial Bladestorm Relic Stone".split(",")
ALIASES = [("eshield", "Eternal Shield"), ("twice", "Zodiac Staff"), ("twice", "Zodiac Shield")]
#: Item, segment, and what comes out: (item, strategy, in a list, variant, quantity, reason).
CASES = [
    ("Elite Tomes", "elite tomes 12 mes 3 monk derv", [("Elite Mesmer Tome", "tome", False, None, 12, None), ("Elite Monk Tome", "tome", False, None, 3, None)]),
    ("tomes", "all tomes", [(None, "tome", False, None, None, "insufficient_item_identity")]),
    ("minis", "unded grawl 5e", [("Miniature Grawl", "miniature", False, "unded", None, None)]),
    ("Grawl", "grawl ded", [("Miniature Grawl", "miniature", False, "ded", None, None)]),
    ("mini", "mini grawl", [(None, "miniature", False, None, None, "miniature_variant_unresolved")]),
    ("mini", "unded grawl or celestial rat", [(None, "miniature", False, None, None, "miniature_bundle_unresolved")]),
    ("Grawl", "grawl tonic", [(None, "miniature", False, None, None, "miniature_context_conflict")]),
    ("unded celestial sheep and rat", "", [("Miniature Celestial Sheep", "miniature", True, "unded", None, None), ("Miniature Celestial Rat", "miniature", True, "unded", None, None)]),
    ("Sword", "q9 crystalline sword 100a", [("Crystalline Sword", "longest_label", False, None, None, None)]),
    ("shield", "q8 eshield", [("Eternal Shield", "longest_label", False, None, None, None)]),
    ("axe", "q9 crystalline sword", [("Crystalline Sword", "only_label", False, None, None, None)]),
    ("shield", "zodiac shield eternal shield", [("Eternal Shield", "longest_label", False, None, None, None)]),
    ("sword", "plaguebor sword q9", [("Plagueborn Sword", "all_words", False, None, None, None)]),
    ("axe", "demoncrest axe", [("Demon Crest Axe", "all_words", False, None, None, None)]),
    ("silver dye", "cheap 5e", [("Silver Dye", "name", False, None, None, None)]),
    ("cheap stuff", "glacialx bladestormx relicx", [("Glacial Bladestorm Relic Stone", "evidence", False, None, None, None)]),
    ("Zodiac, Crystalline Sword", "", [("Crystalline Sword", "longest_label", False, None, None, None)]),
    ("Zodiac Staff, Silver Dye & Demon Crest Axe 5e", "", [(n, "longest_label", True, None, None, None) for n in ("Zodiac Staff", "Silver Dye", "Demon Crest Axe")]),
    ("Zodiac Staff, unheard of", "Zodiac Staff", [("Zodiac Staff", "longest_label", False, None, None, None)]),
    ("Demon Crest, Fire Axe", "", [("Demon Crest Axe", "all_words", False, None, None, None)]),
    ("Plagueborn, Crystalline Sword", "", [("Plagueborn Sword", "all_words", True, None, None, None), ("Crystalline Sword", "longest_label", True, None, None, None)]),
    ("twice", "twice", [(None, None, False, None, None, "catalog_first_unresolved")]),
    ("things", "pm me 20/20", [(None, None, False, None, None, "service_or_noise")]),
    (None, None, [(None, None, False, None, None, "catalog_first_unresolved")]),
    ("", "", [(None, None, False, None, None, "catalog_first_unresolved")]),
]


@pytest.fixture(scope="module")
def known(spark):
    items = spark.createDataFrame([(n.replace(" ", "_"), n) for n in NAMES], "item_key string, name string")
    return items, spark.createDataFrame([(a, n.replace(" ", "_")) for a, n in ALIASES], "alias string, item_key string")


def test_each_case(spark, known):
    said = spark.createDataFrame([(k, item, segment) for k, (item, segment, _) in enumerate(CASES)], "offer_id int, item string, segment string")
    found = {}
    for r in sorted(strategies.resolve(said, *known).collect(), key=lambda r: (r.offer_id, r.pos, r.item_key or "")):
        found.setdefault(r.offer_id, []).append((r.item_key and r.item_key.replace("_", " "), r.strategy, r.in_list, r.variant, r.quantity, r.reason))
    assert [found[k] for k in range(len(CASES))] == [want for _, _, want in CASES]
    assert {s for rows in found.values() for _, s, *_ in rows} == {None, *strategies.STRATEGIES}


def test_empty_tables_and_repeated_ids(spark, known):
    none = spark.createDataFrame([], "offer_id int, item string, segment string")
    assert strategies.resolve(none, *known).collect() == []
    twice = spark.createDataFrame([(1, "silver dye", ""), (1, "silver dye", ""), (1, "axe", "")], none.schema)
    assert sorted((r.item_key or "") for r in strategies.resolve(twice, *known).collect()) == ["", "Silver_Dye", "Silver_Dye"]
    bare = spark.createDataFrame([], "item_key string, name string"), spark.createDataFrame([], "alias string, item_key string")
    assert [r.item_key for r in strategies.resolve(twice, *bare).collect()] == [None] * 3
