"""Lifecycle and alerts as streams with typed state and event-time timers (RocksDB state store).

State is kept per listing, listings by buckets, and per market, so no entry holds more than one listing or what of one market
and hour the watermark has not passed; both forget. Rows of a batch are handled as tables, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import TTL_HOURS

c = F.col
HOUR = 3_600_000
CHANGES = "identity string, offer_id string, posted_at long, status string, superseded_by string"
EDGES = "market string, id string, at long, value double"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Set the state store that typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Winner(StatefulProcessor):
    """The newest listing of each identity of a bucket. Every other listing is reported superseded, an old winner too; without a
    newer one for ``hours`` of event time the winner is reported expired and forgotten.

    A call costs far more than a row, so a bucket's identities are handled together. The bucket has one timer, for whichever
    winner ends first.
    """

    COLUMNS = ["identity", "offer_id", "posted_at"]

    def __init__(self, hours: int, sane: tuple[int, int]):
        self.age, self.sane = hours * HOUR, sane

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "identity string", "offer_id string, posted_at long")
        self.next = handle.getValueState("next", "at long")

    def _ends(self, posted: Iterator[int]) -> list[int]:
        return [int(at) + self.age for at in posted if self.sane[0] <= at < self.sane[1]]  # a mistaken time never expires a listing

    def _wake(self, ends: list[int]) -> None:
        if not ends:
            return
        known = self.next.get()[0] if self.next.exists() else None
        if known is not None and known <= min(ends):
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.next.update((min(ends),))
        self.handle.registerTimer(min(ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows, ignore_index=True)[self.COLUMNS]
        if self.best.exists():
            known = [(i, *won) for i in new["identity"].unique() if (won := self.best.getValue((i,))) is not None]
            new = pd.concat([pd.DataFrame(known, columns=self.COLUMNS), new], ignore_index=True) if known else new
        new = new.drop_duplicates().sort_values(self.COLUMNS[:1] + ["posted_at", "offer_id"], ignore_index=True)
        won = ~new["identity"].duplicated(keep="last")
        for identity, offer, at in new[won].itertuples(index=False):
            self.best.updateValue((identity,), (str(offer), int(at)))
        self._wake(self._ends(new.loc[won, "posted_at"]))
        winner = new["offer_id"].where(won).bfill()  # an identity's winner is its last row
        yield new.assign(status=won.map({True: "active", False: "superseded"}), superseded_by=winner.mask(won, None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(k[0], *won) for k, won in self.best.iterator()]
        over = [row for row in rows if any(end < now for end in self._ends(row[2:]))]  # a timer goes off once the watermark is behind it
        for row in over:
            self.best.removeKey(row[:1])
        self.next.clear()
        self._wake([end for end in self._ends(at for _, _, at in rows) if end >= now])
        if over:
            yield pd.DataFrame(over, columns=self.COLUMNS).assign(status="expired", superseded_by=None)

    def close(self) -> None:
        pass


def lifecycle(stream: DataFrame, identity: str, offer_id: str, time: str, hours: int = TTL_HOURS, delay: str = "1 hour", years: tuple[int, int] = (2005, 2100), buckets: int = 512) -> DataFrame:
    """Changes (identity, offer_id, posted_at in ms, status, superseded_by) of listings, in update mode.

    A repeated row changes nothing; rows behind the watermark are dropped by Spark. Which batch a row comes in decides when a
    change is told, not what :func:`current` makes of all changes. Identities lie in ``buckets`` by hash; a checkpoint keeps to
    the number that it began with.
    """
    sane = tuple(int(pd.Timestamp(f"{y}-01-01").timestamp() * 1000) for y in (years[0], years[1] + 1))
    at = c(time).cast("timestamp")
    rows = stream.select(at.alias("_time"), c(identity).alias("identity"), c(offer_id).cast("string").alias("offer_id"), F.unix_millis(at).alias("posted_at"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("identity"), F.lit(buckets)))
    return rows.withWatermark("_time", delay).groupBy("_bucket").transformWithStateInPandas(Winner(hours, sane), CHANGES, "Update", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """(identity, offer_id, status, superseded_by): what the changes told so far amount to, in whatever order they are read.

    The newest listing of an identity is active or, if that was told, expired; it supersedes all others.
    """
    told = changes.groupBy("identity", "offer_id").agg(F.max("posted_at").alias("posted_at"), F.bool_or(c("status") == "expired").alias("expired"))
    best = told.groupBy("identity").agg(F.max(F.struct("posted_at", "offer_id")).alias("best"))
    won = c("offer_id") == c("best.offer_id")
    status = F.when(~won, "superseded").when(c("expired"), "expired").otherwise("active")
    return told.join(best, "identity").select("identity", "offer_id", status.alias("status"), F.when(~won, c("best.offer_id")).alias("superseded_by"))


class Edge(StatefulProcessor):
    """Tells when a market's price comes to its target or below, in the order of event time.

    Rows wait, one state entry per hour, until the watermark has passed their hour, so the order in which they come decides
    nothing. A market silent for ``forget`` hours is forgotten: its next price counts as its first.
    """

    COLUMNS = ["at", "id", "value", "target"]

    def __init__(self, forget: int):
        self.forget = forget * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", "at array<long>, id array<string>, value array<double>, target array<double>")
        self.last = handle.getValueState("last", "at long, met boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows, ignore_index=True)[self.COLUMNS]
        for hour, part in new.groupby(new["at"] // HOUR):
            known = (int(hour),)
            if self.waiting.containsKey(known):
                part = pd.concat([pd.DataFrame(dict(zip(self.COLUMNS, self.waiting.getValue(known)))), part])
            self.waiting.updateValue(known, tuple(part[k].tolist() for k in self.COLUMNS))
            self.handle.registerTimer((int(hour) + 1) * HOUR)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        hours = sorted(k[0] for k in self.waiting.keys() if (k[0] + 1) * HOUR <= now)
        if not hours:
            if self.last.exists() and self.last.get()[0] + self.forget < now:
                self.last.clear()
            return
        ready = pd.concat([pd.DataFrame(dict(zip(self.COLUMNS, self.waiting.getValue((h,))))) for h in hours])
        ready = ready.drop_duplicates(["at", "id"]).sort_values(["at", "id"], ignore_index=True)
        met = ready["value"] <= ready["target"]
        known = self.last.get() if self.last.exists() else (int(ready["at"].iloc[0]), False)
        before, gap = met.shift(fill_value=bool(known[1])), ready["at"] - ready["at"].shift(fill_value=known[0])
        for h in hours:
            self.waiting.removeKey((h,))
        self.last.update((int(ready["at"].iloc[-1]), bool(met.iloc[-1])))
        self.handle.registerTimer(int(ready["at"].iloc[-1]) + self.forget + 1)
        yield ready[met & (~before | (gap > self.forget))].assign(market=key[0])[["market", "id", "at", "value"]]

    def close(self) -> None:
        pass


def alert_edges(stream: DataFrame, market: str, row_id: str, time: str, value: str, target: str, forget: int = TTL_HOURS, delay: str = "1 hour") -> DataFrame:
    """(market, id, at in ms, value) of the prices that come to their target after one above it, or as a market's first.

    Appended once the watermark has passed their hour. Rows without a price or target are left out; a repeated (time, id) counts once.
    """
    at = c(time).cast("timestamp")
    rows = stream.select(at.alias("_time"), c(market).alias("market"), c(row_id).cast("string").alias("id"), F.unix_millis(at).alias("at"), c(value).cast("double").alias("value"), c(target).cast("double").alias("target"))
    return rows.where("value IS NOT NULL AND target IS NOT NULL").withWatermark("_time", delay).groupBy("market").transformWithStateInPandas(Edge(forget), EDGES, "Append", "EventTime")


def edges_of_table(rows: DataFrame, market: str, row_id: str, time: str, value: str, target: str, forget: int = TTL_HOURS) -> DataFrame:
    """:func:`alert_edges` of a table: what a stream of its rows tells in the end."""
    at = F.unix_millis(c(time).cast("timestamp"))
    met, order = c("value") <= c("target"), W.partitionBy("market").orderBy("at", "id")
    found = rows.select(c(market).alias("market"), c(row_id).cast("string").alias("id"), at.alias("at"), c(value).cast("double").alias("value"), c(target).cast("double").alias("target")).where("value IS NOT NULL AND target IS NOT NULL")
    found = found.withColumns({"_met": met, "_before": F.lag(met).over(order), "_gap": c("at") - F.lag("at").over(order)})
    return found.where("_met AND (NOT coalesce(_before, false) OR _gap > %d)" % (forget * HOUR)).select("market", "id", "at", "value")
