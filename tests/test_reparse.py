"""Parsing again: a targeted run equals a full one, and leaves the other partitions' files alone."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradewinds.operators import reparse
from tradewinds.plans.listings import _MARKET_SCHEMA, _OFFER_SCHEMA, _prices, _summary

c = F.col


def files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def rows(spark, path, schema):
    return sorted(map(tuple, reparse.read(spark, path, schema).collect()), key=repr)


def test_targeted_equals_full_and_touches_no_more(spark, tmp_path):
    said = [(k, f"WTS item{k % 40} {k}{"a" if k % 50 == 0 else "e"}") for k in range(400)] + [(400, "Hello"), (401, "WTS odd"), (None, "WTS item1 5e")]
    messages = spark.createDataFrame(said, "message_id long, message string")
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    reparse.full(messages, _prices(26.0), _summary, one)
    before = files(one)
    again = lambda who, rate, path=one: reparse.targeted(messages, who, _prices(rate), _summary, path, _OFFER_SCHEMA, _MARKET_SCHEMA)
    assert again(messages.where("message LIKE '%a'"), 26.0) == {"offers": [], "markets": []} and files(one) == before
    done = again(messages.where("message LIKE '%a' OR message_id % 3 = 0"), 27.0)
    reparse.full(messages, _prices(27.0), _summary, other)
    assert rows(spark, f"{one}/offers", _OFFER_SCHEMA) == rows(spark, f"{other}/offers", _OFFER_SCHEMA)
    assert rows(spark, f"{one}/markets", _MARKET_SCHEMA) == rows(spark, f"{other}/markets", _MARKET_SCHEMA)
    after = files(one)
    for name in ("offers", "markets"):
        same = {p for p in before if f"/{name}/" in p and int(p.split("part=")[1].split("/")[0]) not in done[name]}
        assert 0 < len(done[name]) < reparse.PARTS and same and all(after.get(p) == before[p] for p in same)


def test_messages_that_lose_all_offers(spark, tmp_path):
    at = str(tmp_path / "t")
    messages = spark.createDataFrame([(1, "WTS a 5e"), (2, "WTS b 7e")], "message_id long, message string")
    reparse.full(messages, _prices(26.0), _summary, at)
    silent = messages.withColumn("message", F.when(c("message_id") == 1, "Hello").otherwise(c("message")))
    args = (_prices(26.0), _summary, at, _OFFER_SCHEMA, _MARKET_SCHEMA)
    for _ in range(2):
        reparse.targeted(silent, messages.where("message_id = 1"), *args)
        assert [r[:3] for r in rows(spark, f"{at}/offers", _OFFER_SCHEMA)] == [(2, "b", 7.0)] and [r[:2] for r in rows(spark, f"{at}/markets", _MARKET_SCHEMA)] == [("b", 1)]
    reparse.targeted(messages, messages.where("message_id = 1"), *args)
    assert [r[0] for r in rows(spark, f"{at}/offers", _OFFER_SCHEMA)] == [1, 2]


def test_a_run_that_breaks_off_between_the_tables_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    messages = spark.createDataFrame([(k, f"WTS item{k % 9} {k}a") for k in range(60)], "message_id long, message string")
    reparse.full(messages, _prices(26.0), _summary, one)
    args, replace = (_prices(27.0), _summary, one, _OFFER_SCHEMA, _MARKET_SCHEMA), reparse._replace

    def breaks(spark, rows, path, parts):
        if path.endswith("markets"):
            raise OSError("lost")
        replace(spark, rows, path, parts)

    monkeypatch.setattr(reparse, "_replace", breaks)
    with pytest.raises(OSError):
        reparse.targeted(messages, messages, *args)
    monkeypatch.setattr(reparse, "_replace", replace)
    reparse.targeted(messages, messages.limit(0), *args)
    reparse.full(messages, _prices(27.0), _summary, other)
    assert rows(spark, f"{one}/markets", _MARKET_SCHEMA) == rows(spark, f"{other}/markets", _MARKET_SCHEMA) and sorted(os.listdir(one)) == ["markets", "offers"]
