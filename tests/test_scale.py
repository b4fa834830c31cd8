"""Work that must grow with the distinct texts, or happen once however its result is used."""

import re

from tradewinds.operators import catalog, review


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_messages_that_share_an_id_are_each_parsed(spark):
    said = [(1, "WTS red ring 5e"), (1, "WTB red ring 5e"), (2, "WTS red ring 5e"), (1, "WTS red ring 5e"), (3, None)]
    found = catalog.parse(spark.createDataFrame(said, "message_id int, message string"))
    assert sorted((r.message_id, r.trade_type, r.item) for r in found.collect()) == [(1, "buy", "red ring"), (1, "sell", "red ring"), (1, "sell", "red ring"), (2, "sell", "red ring")]


def test_parsing_computes_no_array_again_to_filter_by_its_size(spark):
    plan = _plan(catalog.parse(spark.createDataFrame([(1, "WTS red ring 5e")], "message_id int, message string")))
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]


def test_field_rates_read_both_sides_once_for_the_pairs(spark):
    shape = "message_id int, k int, trade_type string, item string, requirement string, attribute string"
    expected = spark.createDataFrame([(1, 0, "buy", "Ring", "q9", None), (1, 1, "sell", "axe", None, None), (2, 0, "buy", "bow", None, None)], shape)
    actual = spark.createDataFrame([(1, 0, "sell", "axe", "q9", None), (1, 1, "buy", "ring", "q9", None)], shape)
    rates = review.field_rates(expected, actual.selectExpr("message_id", "k", "trade_type", "concat(item, substr('MARK', 1, k * 0)) AS item", "requirement", "attribute"))
    assert {r.field: (r.correct, r.total) for r in rates.collect()} == {"trade_type": (2, 3), "item": (2, 3), "requirement": (1, 3), "attribute": (2, 3)}
    assert _plan(rates).count("MARK") == 1


def test_evidence_of_each_distinct_text_is_gathered_once(spark):
    items = spark.createDataFrame([(f"i{k}", f"storm axe{k} word{k}") for k in range(5)] + [("sd", "Storm Daggers")], "item_key string, name string")
    texts = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'storm daggers', 'storm') AS text")
    found = catalog.token_evidence(texts, items)
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(0, 4000, 2)) and {(r.item_key, r.score) for r in rows} == {("sd", 6)}
    aggregated = [line for line in _plan(found).splitlines() if line.strip(" :+-").startswith("Aggregate [")]
    assert not [line for line in aggregated if "id#" in line.split("]")[0]]  # nothing is grouped by the rows' ids


def test_names_in_messages_that_share_an_id_or_a_text(spark):
    said = spark.createDataFrame([(1, "wts red ring"), (1, "wtb bow"), (2, "wts red ring"), (3, None), (4, "")], "id int, m string")
    known = spark.createDataFrame([("red ring", "r"), ("bow", "b"), ("ring", "x")], "alias string, item_key string")
    want = [(1, "b", 1, 1), (1, "r", 1, 2), (2, "r", 1, 2)]
    for found in (catalog.dictionary_join(said, known, "m", "id"), catalog.compact_join(said, known, "m", "id")):
        assert sorted((r.id, r.item_key, r.start, r.words) for r in found.collect()) == want
        assert not [line for line in _plan(found).splitlines() if "Filter" in line and "size(" in line]


def test_residual_reasons_judge_distinct_clauses(spark):
    from tradewinds.plans import wording

    plan = _plan(wording.residual_reasons(spark, "/root/testdata/sf0.001"))
    judged = next(line for line in plan.splitlines() if "insufficient_item_identity" in line)
    assert "[n#" in judged  # counts of distinct clauses, not the rows


def test_texts_that_differ_in_other_words_are_looked_at_once(spark):
    said = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, concat('WTS red ring ', id, 'e or bow x', id)) AS m")
    known = spark.createDataFrame([("red ring", "r"), ("bow", "b"), ("ring", "x")], "alias string, item_key string")
    found = catalog.dictionary_join(said, known, "m", "id").collect()
    assert sorted((r.id, r.item_key, r.start, r.words) for r in found) == sorted((k, *m) for k in range(3000) if k % 3 for m in (("r", 1, 2), ("b", 5, 1)))
    assert "\u0001" in _plan(catalog.dictionary_join(said, known, "m", "id"))


def test_segments_are_read_once_and_nulls_keep_their_row(spark):
    from tradewinds.operators import upkeep

    offers = spark.createDataFrame([("a", "x", "x 5e/ea"), ("b", "x", "x 5e/ea"), ("c", None, "x 5e/ea"), ("d", "x", None)], "offer_id string, item_key string, raw_segment string")
    found = upkeep.recovered(offers, spark.createDataFrame([("x", "each", 1.0)], "item_key string, basis string, size double"))
    assert sorted((r.offer_id, r.unit, r.basis) for r in found.collect()) == [("a", 5.0, "each"), ("b", 5.0, "each"), ("c", 5.0, "each"), ("d", None, None)]
    assert "Aggregate [item_key" in _plan(found)


def test_redirects_never_go_by_way_of_the_driver(spark, monkeypatch):
    from tradewinds.operators import knowledge

    redirects = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "source string, target string")
    kind, plans = type(redirects), []
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda *a: plans.append(join(*a)) or plans[-1])
    assert {r.source: r.target for r in knowledge.followed(redirects).collect()} == {"a": "c", "b": "c", "d": None}
    assert plans and not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


def test_lists_of_the_same_text_are_read_once(spark):
    from tradewinds.operators import lists

    said = spark.createDataFrame([(1, "WTS red ring 5e, axe 2e"), (1, "WTS red ring 5e, axe 2e"), (2, None)], "message_id int, message string")
    known = spark.createDataFrame([("red ring", "r", "red ring"), ("axe", "a", "axe")], "alias string, item_key string, name string")
    found = lists.list_offers(said, known)
    assert sorted((r.message_id, r.item_key) for r in found.collect()) == [(1, "a"), (1, "a"), (1, "r"), (1, "r")]
    assert not [line for line in _plan(found).splitlines() if "Filter" in line and "size(" in line]


def test_lines_come_to_their_orders_last(spark):
    from tradewinds.sources.market import offers

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = offers(spark, "/root/testdata/sf0.001").groupBy("message_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 6  # two for each join, none for the messages


def test_outliers_read_the_offers_once(spark):
    from tradewinds.operators import price_quality

    shape = "offer_id string, player string, trade_type string, normalized_market_key string, item_key string, price_amount double, price_currency string, price_basis string, unit_price double"
    rows = [(f"o{k}", f"P{k % 4}", "sell", None, "x", 1.0, "e", "each", p) for k, p in enumerate((1.0, 2.0, 2.0, 3.0, 2.0, 40.0))] + [("n", "p", "sell", None, None, 1.0, "e", "each", 9.0)]
    found = price_quality.outliers(spark.createDataFrame(rows, shape).selectExpr("*", "concat('MARK', offer_id) AS _m").selectExpr("substr(_m, 5) AS offer_id", *[x.split()[0] for x in shape.split(", ")[1:]]))
    assert sorted((r.offer_id, r.baseline, r.is_outlier) for r in found.collect()) == [(f"o{k}", 2.0, k == 5) for k in range(6)]
    assert "MARK" not in _plan(found)  # what was written is read, not the offers once for each figure


def test_the_resolver_makes_the_offers_once(spark):
    from tradewinds.operators import strategies

    items = spark.createDataFrame([("Chaos Axe", "ca"), ("Storm Bow", "sb")], "name string, item_key string")
    said = [("a", "Chaos Axe, Storm Bow", ""), ("b", "Axe", "q9 chaos axe"), ("b", "Axe", "q9 chaos axe"), ("c", None, None)]
    offers = spark.createDataFrame(said, "offer_id string, item string, segment string").selectExpr("substr(concat('MARK', offer_id), 5) AS offer_id", "item", "segment")
    found = strategies.resolve(offers, items, items.selectExpr("item_key AS alias", "item_key"))
    assert sorted((r.offer_id, r.pos, r.item_key or "", r.in_list) for r in found.collect()) == [("a", 0, "ca", True), ("a", 1, "sb", True), ("b", 0, "ca", False), ("b", 0, "ca", False), ("c", 0, "", False)]
    assert "MARK" not in _plan(found)  # what was written is read


def test_lines_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from __spark_entry__ import oracle_sql, queries
    from tests.oracle import differences
    from tradewinds.sources import market

    at, kept = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lines = market.table(spark, at, "lineitem").count()
    assert market.tasks(spark, at) is None
    monkeypatch.setattr(market, "TASK_ROWS", 300)
    monkeypatch.setattr(market, "FEW_TASKS", -1)  # every table counts as large
    assert market.tasks(spark, at) == lines // 300
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name, keys in (("item_encyclopedia", ("_name", "player")), ("trader_top_markets", ("player", "market"))):
            found = queries()[name](spark, at)
            plan = found._jdf.queryExecution().executedPlan().toString()
            for key in (("l_partkey",), ("l_orderkey",), keys):
                assert f"hashpartitioning({', '.join(f'{k}#' for k in key)}, {lines // 300})" in re.sub(r"#\d+L?", "#", plan)
            assert not differences(spark, at, name, queries()[name], oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_traders_of_an_item_are_counted_once_and_null_is_none(spark):
    rows = [(" Ring", "a", "active", 1), ("ring ", "a", "expired", 3), ("RING", None, "active", 2), ("ring", "b", "x", 1), ("bow", None, None, 5), (None, "a", "active", 9)]
    items = spark.createDataFrame([("r", "Ring", "t"), ("b", "bow", "t"), ("z", "Axe", "t"), ("n", None, "t")], "item_key string, name string, category string")
    offers = spark.createDataFrame(rows, "raw_segment string, player string, lifecycle_status string, posted_at int")
    for tasks in (None, 7):
        found = {r.item_key: tuple(r)[3:] for r in catalog.encyclopedia(items, offers, tasks=tasks).collect()}
        assert found == {"r": (4, 2, 2, 3), "b": (1, 0, 0, 5), "z": (0, 0, 0, None), "n": (0, 0, 0, None)}


def test_messages_that_differ_in_numbers_are_read_once(spark):
    from pyspark.sql import functions as F

    from tradewinds.functions import text

    said = spark.range(3000).selectExpr("id AS message_id", "concat('WTS red ring q', 10 + id % 40, ' ', 50 + id % 40, '/', 1000 + id, 'e') AS message")
    forms = said.select(text.number_form(F.col("message"), text.numbers_of(F.col("message"))).alias("form")).distinct()
    assert forms.count() == 1
    rows = {r.message_id: (r.item, r.requirement, r.quantity, r.price_amount, r.unit_price, r.raw_segment) for r in catalog.parse(said).collect()}
    assert rows == {k: ("red ring", f"q{10 + k % 40}", 50.0 + k % 40, 1000.0 + k, (1000.0 + k) / (50 + k % 40), f"red ring q{10 + k % 40} {50 + k % 40}/{1000 + k}e") for k in range(3000)}


def test_numbers_that_decide_by_value_or_by_being_equal_keep_doing_so(spark):
    said = ["WTS item 5 | item 6 | Item 5", "WTS item 7 | item 7 | Item 7", "WTS bow q5-7 3e", "WTS bow q5-4 3e", "WTS ring 12(no x)34e", "WTS axe 20/20 5e", "WTS axe 30/20 5e", "WTS a1b 2.500e, c 1 2 3 4 5 6 7 8 9 10 11e", "WTS gift of 12 11e/ea"]
    found = {}
    for r in catalog.parse(spark.createDataFrame(list(enumerate(said)), "message_id int, message string")).collect():
        found.setdefault(r.message_id, []).append((r.item, r.requirement, r.price_amount))
    assert sorted(found[0]) == [("item 5", None, None), ("item 6", None, None)] and found[1] == [("item 7", None, None)]
    assert sorted(x[1] for x in found[2]) == ["q5", "q6", "q7"] and len(found[3]) == 1
    assert [x[2] for x in found[4]] == [1234.0] and found[8] == [("gift of 12", None, 11.0)]


def test_market_context_joins_its_offers_once(spark):
    made = [(k, "m1" if k < 5 else None, [5.0, 1.0, None, 3.0, 9.0, 2.0, 2.0][k]) for k in range(7)]
    o = spark.createDataFrame(made, "offer_id int, market_key string, unit_price double").selectExpr("offer_id", "concat(market_key, substr('MARK', 1, offer_id * 0)) AS market_key", "'' AS normalized_market_key", "unit_price")
    found = review.market_context(o)
    assert "MARK" not in _plan(found)  # the offers were written, and nothing behind that computes them again
    assert {r.offer_id: (r.others, r.mean_price, r.median_price) for r in found.collect()} == {
        0: (3, 4.0, 3.0), 1: (3, 6.0, 5.0), 2: (4, 5.0, 4.0), 3: (3, 5.0, 5.0), 4: (3, 3.0, 3.0), 5: (1, 2.0, 2.0), 6: (1, 2.0, 2.0),
    }


def test_places_come_from_the_numbers_of_sorted_ranges(spark):
    from pyspark.sql import functions as F

    from tradewinds.operators import ranking

    rows = spark.range(4000).selectExpr("id", "if(id % 4 = 0, null, 'k' || if(id % 50 = 1, 1, 2)) AS k", "(id * 7919) % 1000 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking.place(rows, ["k"], [F.desc("v"), F.asc("id")])
        found = sorted((r.k or "", r.place, r.id) for r in placed.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, groups = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r.k or "", -r.v, r.id)):
        groups[r.k] = groups.get(r.k, 0) + 1
        want.append((r.k or "", groups[r.k], r.id))
    assert found == want and "Window" not in _plan(placed)


def test_clauses_of_a_block_go_with_one_of_its_candidates(spark):
    from tradewinds.operators import lists

    said = spark.createDataFrame([(1, "WTS red ring q9, blue rod q10 4e"), (2, "WTS nothing known"), (3, None), (4, "WTB Q8 Staves | red ring")], "message_id int, message string")
    known = spark.createDataFrame([("red ring", "r", "Red Ring"), ("blue rod", "b", "Blue Rod"), ("red ring staff", "s", "Red Ring Staff")], "alias string, item_key string, name string")
    found = lists.list_offers(said, known)
    assert sorted((r.message_id, r.item_key or "", r.requirement or "", r.price.amount or 0) for r in found.collect()) == [(1, "b", "q10", 4.0), (1, "r", "q9", 0), (2, "", "", 0), (4, "s", "q8", 0)]
    plan = _plan(found)
    assert [line for line in plan.splitlines() if "Filter" in line and "_first" in line and "_hit" in line]  # candidates that nothing means are gone before the blocks are gathered


def test_requirements_are_read_from_what_is_stated(spark):
    from pyspark.sql import functions as F

    from tradewinds.operators import lists

    said = {"bow q9": ["q9"], "bow q5-7": ["q5", "q6", "q7"], "bow q9/11": ["q9", "q11"], "q7-5 x": ["q7"], "req channeling": ["any"], "bow": [], "q9%": [], "q12 - 30 axe": ["q12"], "rq 8 / 9 / q10 axe": ["q8", "q9", "q10"]}
    df = spark.createDataFrame([(k,) for k in said], "s string").select("s", lists.requirements(F.col("s")).alias("r"))
    assert {r.s: r.r for r in df.collect()} == said


def test_parser_reports_read_messages_by_their_forms(spark):
    from tradewinds.plans import resolving

    for query in (resolving.parser_evaluation, resolving.parser_field_rates):
        assert "translate(" in _plan(query(spark, "/root/testdata/sf0.001"))
