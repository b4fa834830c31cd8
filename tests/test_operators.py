"""Invariants, and streams that agree with batches."""

import tempfile

from pyspark.sql import functions as F

from tradewinds.operators import catalog, lifecycle, price_quality, ranking, review, search
from tradewinds.schemas import with_defaults
from tradewinds.sources import payload
from tradewinds.sources.market import AS_OF, events, offers, table
from tradewinds.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_one_active_row_per_identity(spark):
    o = offers(spark, SF)
    r = lifecycle.reconcile(o, AS_OF)
    assert r.where("status <> 'superseded' AND superseded_by IS NOT NULL OR status = 'superseded' AND superseded_by IS NULL").count() == 0
    winners = r.where("status <> 'superseded'").select("offer_id")
    assert lifecycle.reconcile(o.join(winners, "offer_id"), AS_OF).where("status = 'superseded'").count() == 0


def test_price_statuses_cover_all(spark):
    o = offers(spark, SF)
    assert price_quality.rebuilt(o).count() == o.count()


def test_payloads(spark):
    bodies = ['{"messages":[{"m":"WTS bow","s":"A","t":"1700000000000","h":"1"},{"m":" ","s":"A"}]}', '{"results":[{"message":"WTB bow","player":"B","t":"2023-01-02 03:04:05"}]}', '[{"m":"x","s":"C","t":"58567-01-01"}]', "junk", None]
    got = payload.messages(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.player, r.message, r.posted_at.isoformat()) for r in got) == [("A", "WTS bow", "2023-11-14T22:13:20"), ("B", "WTB bow", "2023-01-02T03:04:05"), ("C", "x", "2024-01-01T00:00:00")]
    df = payload.messages(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", F.lit("2024-01-01").cast("timestamp"))
    assert payload.new_messages(df.union(df), df.limit(1)).count() == 2


def test_defaults_and_upsert(spark):
    df = with_defaults(spark.createDataFrame([(1,)], "k int"))
    assert df.first().lifecycle_status == "active"
    got = search.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def _stream(spark, df, parts=3):
    path = tempfile.mkdtemp()
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return jobs.read_files(spark, path, df.schema, 1), tempfile.mkdtemp()


def _drain(q):
    q.processAllAvailable()
    q.stop()


def test_stream_windows_agree_with_batch(spark):
    e = events(spark, SF).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    stream, at = _stream(spark, e, 1)
    _drain(jobs.windowed(jobs.deduplicated(stream, "event_id", "posted_at"), "posted_at", "item_key", "unit_price", "1 day", delay=None).writeStream.outputMode("update").format("memory").queryName("win").option("checkpointLocation", at).start())
    got = spark.sql("SELECT start, item_key, max(n) n FROM win GROUP BY 1, 2")
    want = e.groupBy(F.window("posted_at", "1 day").start.alias("start"), "item_key").agg(F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and want.count() == got.count()


def test_queue_keeps_final_statuses_and_orphans(spark):
    queue = spark.createDataFrame([("a", "validated", 1), ("b", "queued", 1), ("gone", "queued", 7)], "offer_id string, status string, risk int")
    risks = spark.createDataFrame([("a", 50, True), ("b", 5, False), ("c", 90, True)], "offer_id string, risk int, risky boolean")
    got = sorted(map(tuple, review.sync_queue(queue, risks).collect()))
    assert got == [("a", "validated", 50), ("b", "skipped", 5), ("c", "queued", 90), ("gone", "queued", 7)]


def test_market_aggregates_keep_offers_without_market(spark):
    rows = spark.createDataFrame([(1, "m", None, 2.0), (2, None, None, 4.0), (3, None, "", 8.0)], "k int, market_key string, normalized_market_key string, unit_price double")
    got = review.with_market(rows, F.max("unit_price").alias("top")).select("k", "top")
    assert sorted(map(tuple, got.collect())) == [(1, 2.0), (2, 8.0), (3, 8.0)]


def test_places_in_large_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise("a").alias("g"), (F.col("id") * 7919 % 4999).alias("x"), "id")
    got = ranking.place(df, ["g"], [F.asc("x"), F.asc("id")]).collect()
    for g in (None, "a"):
        own = sorted((r.x, r.id, r.place) for r in got if r.g == g)
        assert [p for _, _, p in own] == list(range(1, len(own) + 1))
    assert ranking.place(df.limit(0), ["g"], [F.asc("x")]).count() == 0


def test_either_key_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "B"), (None, None)], "k int, n string")
    right = spark.createDataFrame([(1, "A"), (5, "b"), (None, None)], "rk int, rn string")
    assert sorted(map(tuple, search.either_key(left, right, ("k", "rk"), ("n", "rn")).collect())) == [(1, "a", 1, "A"), (1, "a", 1, "A"), (2, "B", 5, "b")]


def test_catalog_files_and_sinks(spark):
    folder = tempfile.mkdtemp(prefix="tradewinds-test-")
    with open(f"{folder}/items.json", "w") as f:
        f.write('{"items": [{"type": "bow",\n "items": [{"name": "Flatbow", "aliases": ["fb"]}, {"name": "Longbow"}]}]}')
    got = payload.flat_catalog(payload.read_documents(spark, folder), "body").collect()
    assert sorted((r.type, r.name, list(r.aliases)) for r in got) == [("bow", "Flatbow", ["fb"]), ("bow", "Longbow", [])]
    o = spark.createDataFrame([(1, "sell", "bow", "q9", 5.0, "e")], "message_id long, trade_type string, item string, requirement string, price_amount double, price_currency string")
    payload.write_training_set(spark.createDataFrame([(1, "WTS bow"), (2, "hi")], "id long, message string"), o, f"{folder}/set")
    assert sorted((r.id, r.offers and len(r.offers)) for r in spark.read.json(f"{folder}/set").collect()) == [(1, 1), (2, None)]
    summary = spark.createDataFrame([("m", 1.0)], "market string, best double")
    for _ in range(2):  # a rerun of a capture replaces it
        payload.append_snapshot(summary, "2024-01-02 03:00:00", f"{folder}/snap")
        payload.append_snapshot(summary, "2024-01-02 04:00:00", f"{folder}/snap")
    assert spark.read.parquet(f"{folder}/snap").count() == 2
    payload.replace_table(summary, f"{folder}/table")
    payload.replace_table(spark.read.parquet(f"{folder}/table").withColumn("best", F.lit(2.0)), f"{folder}/table")
    assert [r.best for r in spark.read.parquet(f"{folder}/table").collect()] == [2.0]


def test_lists_all_or_nothing_and_first_strategies(spark):
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "zz"), (3, 0, None)], "offer_id long, pos int, part string")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "alias string, item_key string")
    assert sorted((r.offer_id, r.item_key) for r in catalog.all_or_nothing(parts, known).collect()) == [(1, "A"), (1, "B")]
    first = spark.createDataFrame([(1, "x")], "offer_id long, item_key string")
    second = spark.createDataFrame([(1, "y"), (2, "z")], "offer_id long, item_key string")
    assert sorted(map(tuple, catalog.first_strategy(first, second).collect())) == [(1, "x", 0), (2, "z", 1)]


def test_field_rates_count_unpaired_offers_as_wrong(spark):
    kind = "message_id long, k int, trade_type string, item string, requirement string, attribute string"
    expected = spark.createDataFrame([(1, 0, "sell", "Bow", "q9", None), (1, 1, "buy", "Axe", None, "strength"), (2, 0, "sell", "Orb", None, None)], kind)
    actual = spark.createDataFrame([(1, 0, "buy", "axe", None, None), (1, 1, "sell", "bow", "q9", None)], kind)
    got = {r.field: (r.correct, r.total) for r in review.field_rates(expected, actual).collect()}
    assert got == {"trade_type": (2, 3), "item": (2, 3), "requirement": (2, 3), "attribute": (1, 3)}
    assert {r.correct for r in review.field_rates(expected, actual.limit(0)).collect()} == {0}
    assert {r.total for r in review.field_rates(expected.limit(0), actual).collect()} == {0}
