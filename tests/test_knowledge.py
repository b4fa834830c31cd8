"""Redirects, staging and publishing of a knowledge pack."""

import pytest

from tradewinds.operators import knowledge
from tradewinds.sources import payload


def test_redirects_are_followed_to_the_end(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(40)]
    rows = [*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("self", "self"), ("two", "y"), ("two", "x"), (None, "x"), ("x0", None)]
    got = {r.source: (r.target, r.steps) for r in knowledge.followed(spark.createDataFrame(rows, "source string, target string")).collect()}
    want = {f"n{k}": ("n40", 40 - k) for k in range(40)} | {s: (None, None) for s in ("a", "b", "c", "into", "self")} | {"two": ("x", 1)}
    assert got == want
    assert knowledge.followed(spark.createDataFrame([], "source string, target string")).count() == 0


def test_the_last_title_wins_and_aliases_come_along(spark):
    pages = spark.createDataFrame([("Bow", 1, 5), ("bow ", 2, 7), ("BOW", 3, 7), ("Axe", 4, None), (None, 5, 1), ("!", 6, 1)], "title string, pageid long, fetched_at long")
    redirects = spark.createDataFrame([("Longbow", "Flat Bow"), ("Flat-Bow", "bow"), ("x", "y")], "source string, target string")
    got = {r.pageid: (r.title, r.aliases) for r in knowledge.pack(pages, redirects).collect()}
    assert got == {3: ("BOW", ["flat bow", "longbow"]), 4: ("Axe", [])}


def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "pack")
    frame = lambda n: spark.createDataFrame([(n,)], "n int")
    with pytest.raises(ValueError):
        knowledge.read(spark, root)
    knowledge.publish(spark, root, knowledge.write_version(frame(1), root))
    knowledge.write_version(frame(2), root)  # written, never published
    (tmp_path / "pack" / "versions" / "half").mkdir()
    with pytest.raises(ValueError):
        knowledge.publish(spark, root, "half")
    before = knowledge.read(spark, root)
    assert [r.n for r in before.collect()] == [1]
    knowledge.publish(spark, root, knowledge.write_version(frame(3), root))
    assert [r.n for r in knowledge.read(spark, root).collect()] == [3] and [r.n for r in before.collect()] == [1]


def test_catalogs_of_any_depth(spark):
    deep = '{"name": "x"}'
    for k in range(12):
        deep = f'{{"items": [{deep}, "text{k}"]}}'
    bodies = [
        '[{"type": "bow", "items": [{"name": "a", "aliases": ["p", "q"]}, {"type": "long", "groups": [{"name": "b"}]}, "c"]}]', '{"catalog": {"no": "list"}}', '{"name": "alone"}', "no json", None, "[]", '"text alone"', "5",
        '{"items": [{"name": " "}, null, 7, {"aliases": ["none"]}]}', deep,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = sorted(((r.type, r.name, tuple(r.aliases)) for r in payload.nested_catalog(df, "body").collect()), key=repr)
    want = [("bow", "a", ("p", "q")), ("long", "b", ()), ("bow", "c", ()), (None, "alone", ()), (None, "x", ())] + [(None, f"text{k}", ()) for k in range(12)]
    assert got == sorted(want, key=repr)
    assert payload.nested_catalog(df.limit(0), "body").count() == 0
