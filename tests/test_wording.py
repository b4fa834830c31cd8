"""Stated cases of the rules on words: classes, kinds, leftovers, labels."""

from pyspark.sql import functions as F

from tradewinds.functions import text
from tradewinds.operators import upkeep

c = F.col
# Messages, and what they must be classified as.
MESSAGES = [
    ("WTS q9 bow 5e | WTB unded mini", "market", "market_candidate"), ("hello", "noise", "conversation"), ("PC on q9 bow", "price_check", "price_check"), ("WTS bow, pc on it", "market", "market_candidate"),
    ("how much is a staff?", "price_question", "price_question"), ("I just bought a tome", "historical_trade", "historical_purchase"), ("giving away runes", "giveaway", "giveaway"), ("need a runner", "service", "runner_request"),
    ("do you still have the axe", "conversation", "trade_conversation"), ("WTS your guild cape trim", "guild_advertisement", "guild_advertisement"), ("fast dungeon run, WTB clients", "service", "service_advertisement"),
    ("Services: titles", "service", "service_transport_or_tour"), ("WTB anything cool", "noise", "non_specific_request"), ("", "noise", "empty"), ("pm me", "noise", "contact_instruction"), ("WTS names: Sir Bob", "character_name_sale", "character_name_sale"),
    ("WTS duncan furnace", "service", "service_advertisement"), ("WTS quest 12a", "service", "service_advertisement"), ("WTS cape trim", "guild_advertisement", "guild_advertisement"), ("Zodiac Staff 12e", "market", "market_candidate"),
]
# Items that were not found with their segments, and why they stay open.
RESIDUALS = [
    ("axe", "q9 axe", "insufficient_item_identity"), ("Elite Tomes", "elite tomes 2e", "insufficient_item_identity"), ("stuff", "WTB white minis", "collection_or_market_request"), ("things", "all tomes", "collection_or_market_request"),
    ("go", "pm me for it", "service_or_noise"), ("fast taxi", "taxi to docks", "service_or_noise"), ("hale staffhead", "staffhead", "modifier_fragment_unresolved"), ("Zodiac Thing", "zodiac thing 5e", "catalog_first_unresolved"),
]
# Names, and the kind of goods that they speak of and whether they name no more than that.
KINDS = [("Zodiac Staff", "caster", False), ("staves", "caster", True), ("Elite Monk Tome", "tome", False), ("minis", "miniature", True), ("Miniature Mallyx", "miniature", False), ("black dye", "dye", False), ("recurve bow", "weapon", True), ("Armbrace", None, False)]
# Attributes as traders write them, and their keys; names of old, and those of now.
LABELS = [("Dom", "domination_magic"), ("energy storage", "energy_storage"), ("SR", "soul_reaping"), ("Fast-Casting", "fast_casting"), ("prot", "protection_prayers"), ("something else", "something_else")]
NAMES = [("Kuunavang", "", "Miniature Kuunavang"), ("x", "silverwing-bow", "Silverwing Recurve Bow"), ("Mad King's  Guard", "", "Miniature Mad King's Guard"), (" Other ", "z", "Other")]
# Segments, with the family that they name and their modifiers.
SEGMENTS = [
    ("Zodiac Longbow q9 insc OS", None, "inscribable=insc,oldschool=OS,requirement=q9"), ("Bows req 8 marksmanship", "bow", "attribute=marksmanship,requirement=q8"), ("two staves", "staff", ""), ("unded miniature", "miniature", "dedication=undedicated"),
    ("Shield q7 not tactics", "shield", "requirement=q7"), ("FOCI req fire", "focus", "attribute=fire magic,requirement=any"), ("ded mini", "miniature", "dedication=dedicated"), ("bowstring", None, ""), ("daggers, old school", "daggers", "oldschool=OS"),
]


def test_messages(spark):
    rows = spark.createDataFrame(MESSAGES, "said string, kind string, reason string").select("said", "kind", "reason", text.classify(text.normalise(c("said"))).alias("v"))
    assert [tuple(r) for r in rows.where("v.kind <> kind OR v.reason <> reason").collect()] == []


def test_leftovers(spark):
    rows = spark.createDataFrame(RESIDUALS, "item string, segment string, reason string")
    assert rows.where(upkeep.residual_reason(c("item"), c("segment")) != c("reason")).collect() == []


def test_kinds(spark):
    rows = spark.createDataFrame(KINDS, "item string, kind string, generic boolean")
    assert rows.where(~upkeep.kind_of(c("item")).eqNullSafe(c("kind")) | (upkeep.is_generic(c("item")) != c("generic"))).collect() == []


def test_labels_and_names(spark):
    rows = spark.createDataFrame(LABELS, "said string, want string")
    assert rows.where(text.canonical_attribute(c("said")) != c("want")).collect() == []
    rows = spark.createDataFrame(NAMES, "name string, key string, want string")
    assert rows.where(text.canonical_name(c("name"), c("key")) != c("want")).collect() == []


def test_segments(spark):
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    rows = spark.createDataFrame(SEGMENTS, "said string, family string, want string").withColumn("m", text.modifiers(c("said")))
    assert rows.where(~text.family(c("said")).eqNullSafe(c("family")) | (shown != c("want"))).collect() == []
