"""Streams over the events, run to their end, and the SQL that their rows must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import shared_dir
from ..sources.market import table
from ..streaming import ledger, stateful
from .queries import Query

c = F.col


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: listings of users, prices of markets."""
    stateful.use_rocksdb(spark)
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(c("event_id").cast("string").alias("event_id"), "ts", "value", F.concat_ws("|", "user_id", "event_type").alias("listing"), F.concat(F.lit("item_"), (k % 20).cast("string")).alias("market"), F.lit(20.0).alias("target"))


def _to_the_end(out: DataFrame, mode: str, key: str) -> DataFrame:
    """All rows that a stream writes, through the ledger."""
    spark = out.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.outputMode(mode).foreachBatch(ledger.write(at, key)).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(*(f"{at}/rows/batch={n}" for n in ledger.batches(spark, at)))


def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by user and kind of event: the newest is active, or expired after 48 hours of silence; the others are superseded."""
    changes = stateful.lifecycle(_events(spark, sf_dir), "listing", "event_id", "ts", hours=48, delay="12 hours")
    return stateful.current(_to_the_end(changes, "update", "none"))


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a market's price comes to 20 or below, in the order of time; markets silent for five hours start anew."""
    edges = stateful.alert_edges(_events(spark, sf_dir), "market", "event_id", "ts", "value", "target", forget=5, delay="12 hours")
    return _to_the_end(edges, "append", "none").select("market", c("id").alias("event_id"), c("at").alias("at_ms"), "value")


_E = "e AS (SELECT event_id::VARCHAR AS event_id, epoch_us(ts) // 1000 AS ms, value, user_id || '|' || event_type AS listing, 'item_' || ((props->>'$.k')::INT % 20)::VARCHAR AS market FROM events)"

QUERIES: dict[str, Query] = {"lifecycle_stream": lifecycle_stream, "alert_stream": alert_stream}
ORACLE_SQL: dict[str, str] = {
    "lifecycle_stream": f"""WITH {_E}, r AS (SELECT *, row_number() OVER w AS n, first_value(event_id) OVER w AS best, max(ms) OVER () AS last FROM e WINDOW w AS (PARTITION BY listing ORDER BY ms DESC, event_id DESC))
  SELECT listing AS identity, event_id AS offer_id, CASE WHEN n > 1 THEN 'superseded' WHEN ms + 48 * 3600000 < last - 12 * 3600000 THEN 'expired' ELSE 'active' END AS status, CASE WHEN n > 1 THEN best END AS superseded_by FROM r""",
    "alert_stream": f"""WITH {_E}, r AS (SELECT *, lag(value <= 20) OVER w AS before, ms - lag(ms) OVER w AS gap, max(ms) OVER () AS last FROM e WHERE value IS NOT NULL WINDOW w AS (PARTITION BY market ORDER BY ms, event_id))
  SELECT market, event_id, ms AS at_ms, value FROM r WHERE value <= 20 AND (NOT coalesce(before, false) OR gap > 5 * 3600000) AND (ms // 3600000 + 1) * 3600000 <= last - 12 * 3600000""",
}
