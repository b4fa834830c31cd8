"""Streams against the same operators on tables, and restarts."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradewinds.operators import lifecycle as batch
from tradewinds.sources import landing
from tradewinds.streaming import ledger, stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"
c = F.col


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All events as ten files whose rows are out of order within twelve hours."""
    stateful.use_rocksdb(spark)
    at = str(tmp_path_factory.mktemp("events") / "in")
    rows = spark.read.parquet(EVENTS).withColumn("_by", F.unix_micros(c("ts").cast("timestamp")) + (F.xxhash64("event_id") % F.lit(6 * 3_600_000_000)))
    rows.repartitionByRange(10, "_by").sortWithinPartitions("_by").drop("_by").write.parquet(at)
    for k, path in enumerate(sorted(Path(at).glob("*.parquet"))):
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in this order
    return at


def stream(spark, folder):
    s = spark.readStream.schema(spark.read.parquet(EVENTS).schema).option("maxFilesPerTrigger", 3).parquet(folder)
    return s.withColumns({"listing": F.concat_ws("|", "user_id", "event_type"), "market": F.concat(F.lit("m"), (c("user_id") % 7).cast("string")), "target": F.lit(20.0)})


def run(out, target, checkpoint, mode, stop_after=None):
    """Write a stream's rows batch by batch; with ``stop_after``, fail in that batch before its rows are written."""

    def write(rows, number):
        if stop_after is not None and number >= stop_after:
            raise RuntimeError("stopped")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if stop_after is None:
        q.awaitTermination()
    else:
        with pytest.raises(Exception):
            q.awaitTermination()


@pytest.mark.parametrize("restart", [False, True])
def test_lifecycle_stream_equals_the_table(spark, folder, tmp_path, restart):
    hours, target = 48, str(tmp_path / "out")
    made = lambda: stateful.lifecycle(stream(spark, folder), "listing", "event_id", "ts", hours, "12 hours")
    if restart:
        run(made(), target, str(tmp_path / "cp"), "update", stop_after=2)
    run(made(), target, str(tmp_path / "cp"), "update")
    got = {r.offer_id: (r.identity, r.status, r.superseded_by) for r in stateful.current(spark.read.parquet(target)).collect()}
    events = spark.read.parquet(EVENTS)
    now = events.agg(F.max("ts")).first()[0]
    offers = events.select(
        c("event_id").cast("string").alias("offer_id"), F.concat_ws("|", "user_id", "event_type").alias("player"), F.lit("sell").alias("trade_type"), F.lit(None).cast("string").alias("normalized_market_key"), F.lit("x").alias("item_key"),
        F.lit(None).cast("int").alias("requirement"), F.lit("").alias("attribute_key"), F.lit(False).alias("is_oldschool"), F.lit(False).alias("is_inscribable"), c("ts").alias("posted_at"), F.lit("accepted").alias("quality_status"),
    )
    want = {}
    for r in batch.reconcile(offers, str(now), hours + 12).join(offers.select("offer_id", "player"), "offer_id").collect():
        want[r.offer_id] = (r.player, r.status, r.superseded_by)
    assert got.keys() == want.keys() and {s for _, s, _ in want.values()} == {"active", "superseded", "expired"}
    assert [(k, got[k], want[k]) for k in got if got[k] != want[k]] == []


@pytest.mark.parametrize("restart", [False, True])
def test_alert_stream_equals_the_table(spark, folder, tmp_path, restart):
    args = ("market", "event_id", "ts", "value", "target", 5)
    target = str(tmp_path / "out")
    made = lambda: stateful.alert_edges(stream(spark, folder), *args, delay="12 hours")
    if restart:
        run(made(), target, str(tmp_path / "cp"), "append", stop_after=2)
    run(made(), target, str(tmp_path / "cp"), "append")
    rows = spark.read.parquet(EVENTS).withColumns({"market": F.concat(F.lit("m"), (c("user_id") % 7).cast("string")), "target": F.lit(20.0)})
    end = rows.agg(F.max(F.unix_millis(c("ts").cast("timestamp")))).first()[0] - 12 * stateful.HOUR
    want = sorted(map(tuple, stateful.edges_of_table(rows, *args).where((F.floor(c("at") / stateful.HOUR) + 1) * stateful.HOUR <= end).collect()))
    got = sorted(map(tuple, spark.read.parquet(target).select("market", "id", "at", "value").collect()))
    assert got == want and len(want) > 5


def test_a_batch_that_failed_between_write_and_entry_counts_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "message_id long, item string"
    put = ledger.write(path)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert ledger.current(spark, path, schema).count() == 0
    put(frame((1, "a"), (1, "b"), (2, "c"), (None, "n")), 0)
    frame((1, "half")).write.parquet(f"{path}/rows/batch=1")  # written, never entered
    read = lambda: sorted(map(tuple, ledger.current(spark, path, schema).collect()), key=repr)
    assert read() == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "n")], key=repr)
    put(frame((1, "new")), 1)
    assert read() == sorted([(1, "new"), (2, "c"), (None, "n")], key=repr)
    put(frame((2, "other rows under a number that counts")), 1)
    assert read() == sorted([(1, "new"), (2, "c"), (None, "n")], key=repr) and ledger.batches(spark, path) == [0, 1]


def test_a_stream_that_fails_between_write_and_commit_repeats_nothing(spark, tmp_path):
    source, path, schema = tmp_path / "in", str(tmp_path / "t"), "message_id string, item string"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("".join(json.dumps({"source_key": str(k * 10 + n), "player": "p", "message": f"m{k}", "posted_at": None}) + "\n" for n in range(10)) + "no json\n[1]\n")
    put, failed = ledger.write(path), []

    def write(rows, number):
        put(rows.select(c("source_key").alias("message_id"), c("message").alias("item")), number)
        assert rows.count() <= 8
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("after the write, before the commit")

    def start():
        q = landing.read_messages(spark, str(source), 8).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception):
        start()
    start()
    (source / "3.json").write_text(json.dumps({"source_key": "late", "message": "x"}) + "\n")
    start()
    rows = [r.message_id for r in ledger.current(spark, path, schema).collect()]
    assert failed == [1] and sorted(rows) == sorted([str(k) for k in range(30)] + ["late"])


def test_listings_share_calls_of_the_state(spark, tmp_path):
    """Listings by buckets: one unnamed, one whose end the watermark comes to exactly, one whose end it has passed."""
    stateful.use_rocksdb(spark)
    source, told, calls = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "calls"
    calls.mkdir()
    for k, rows in enumerate((
        "SELECT if(id = 7, NULL, concat('p', id)) AS identity, concat('o', id) AS offer_id, timestamp_seconds(id % 3) AS ts FROM range(900) UNION ALL SELECT 'even', 'e', timestamp_seconds(3600) UNION ALL SELECT 'past', 'x', timestamp_seconds(3599)",
        "SELECT if(id = 7, NULL, concat('p', id)) AS identity, concat('n', id) AS offer_id, timestamp_seconds(3600 * 5) AS ts FROM range(450) UNION ALL SELECT 'last', 'l', timestamp_seconds(3600 * 61)",
    )):
        spark.sql(rows).selectExpr("identity", "offer_id", "ts + INTERVAL 54 YEARS AS ts").coalesce(1).write.mode("append").parquet(source)
        newest = max(Path(source).glob("*.parquet"), key=lambda x: x.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))

    class Counted(stateful.Winner):
        def handleInputRows(self, key, rows, timerValues):
            (calls / os.urandom(8).hex()).touch()
            return super().handleInputRows(key, rows, timerValues)

    kept, stateful.Winner = stateful.Winner, Counted
    try:
        s = spark.readStream.schema("identity string, offer_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        run(stateful.lifecycle(s, "identity", "offer_id", "ts", 48, "12 hours", buckets=32), told, str(tmp_path / "cp"), "update")
    finally:
        stateful.Winner = kept
    changes = spark.read.parquet(told)
    got = {r.offer_id: (r.identity, r.status, r.superseded_by) for r in stateful.current(changes).collect()}
    want = {f"n{k}": (f"p{k}", "active", None) for k in range(450)} | {f"o{k}": (f"p{k}", "superseded", f"n{k}") if k < 450 else (f"p{k}", "expired", None) for k in range(900)}
    want |= {"e": ("even", "active", None), "x": ("past", "expired", None), "l": ("last", "active", None)}
    for k in ("n7", "o7"):  # no identity: told, but joined with nothing
        del want[k]
    assert got == want
    assert {(r.offer_id, r.status) for r in changes.where("identity IS NULL").collect()} == {("o7", "active"), ("o7", "superseded"), ("n7", "active")}
    assert len(list(calls.iterdir())) <= 2 * 32 + 1
