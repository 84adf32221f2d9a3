"""Structured Streaming twins of the incremental operators; each equals its batch form on the same rows."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.operators.rules import tag_match
from corpusloom.session import ship_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream; ts is an instant, so that it can carry a watermark."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "72 hours") -> DataFrame:
    """bucket, event_type, n: tumbling hours; rows later than the watermark are lost, as in the queue's look-back."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], horizon: str = "20 days") -> DataFrame:
    """The first row of each key within the horizon: the cache of what was screened, or an update claimed once."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, user: str, gap: str, late: str = "72 hours") -> DataFrame:
    """user, started, ended, n: sessions that a pause of gap ends."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def _sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object) for k, name in enumerate(("subscriber", "item", "us"))})


class _Subscriber(StatefulProcessor):
    """What is remembered of a subscriber: how far rows were evaluated, and the rows that are held until they are ripe."""

    def __init__(self, hold_minutes: int):
        self.hold_ms = hold_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "us long")
        self.held = handle.getListState("held", "item long, us long, deliver boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        due = set()
        for part in rows:
            for item, us, floor, deliver in part[["item", "us", "floor_us", "deliver"]].itertuples(index=False):
                if mark is None:
                    mark = int(floor)
                    self.mark.update((mark,))
                if us > mark:
                    self.held.appendValue((int(item), int(us), bool(deliver)))
                    due.add(-(-int(us) // 1000) + self.hold_ms)
        for at in due:
            self.handle.registerTimer(at)
        yield _sent([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ripe_us = (expiredTimerInfo.getExpiryTimeInMs() - self.hold_ms) * 1000
        held = sorted(tuple(r) for r in self.held.get())
        ripe = [r for r in held if r[1] <= ripe_us]
        rest = [r for r in held if r[1] > ripe_us]
        if ripe:
            self.mark.update((max(self.mark.get()[0], *(us for _, us, _ in ripe)),))
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        yield _sent([(key[0], item, us) for item, us, deliver in ripe if deliver])

    def close(self) -> None:
        pass


def deliveries(queue: DataFrame, subscriptions: DataFrame, hold_minutes: int, late: str = "72 hours") -> DataFrame:
    """subscriber, item, created_at: each queue row once to every subscriber of its audience whom it suits, as soon as it
    is old enough for the hold.

    queue (a stream): item (long), created_at, audience, tags; subscriptions (a table): subscriber, audience, tags, since
    (where the first delivery starts). Rows meet subscribers by audience. A subscriber's state is a value, the newest row
    evaluated (delivered or not), and a list, the rows that are held; a timer on event time at the end of each row's hold
    evaluates them. Rows not newer than the value come too late and are left out. After a restart the query goes on from
    its checkpoint, so a row is neither lost nor sent twice.
    """
    ship_package(queue.sparkSession)
    people = subscriptions.select("subscriber", F.col("audience").alias("_a"), F.col("tags").alias("_wanted"), F.unix_micros(F.col("since").cast("timestamp")).alias("floor_us"))
    rows = queue.withWatermark("created_at", late).join(people, F.col("audience") == F.col("_a"))
    rows = rows.select("subscriber", "item", "created_at", F.unix_micros("created_at").alias("us"), "floor_us", tag_match(F.col("tags"), F.col("_wanted")).alias("deliver"))
    kind = subscriptions.schema["subscriber"].dataType.simpleString()
    sent = rows.groupBy("subscriber").transformWithStateInPandas(statefulProcessor=_Subscriber(hold_minutes), outputStructType=f"subscriber {kind}, item long, us long", outputMode="Append", timeMode="EventTime")
    return sent.select("subscriber", "item", F.timestamp_micros("us").alias("created_at"))


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that deliveries() needs, for queries that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes all there is, in bounded micro-batches, and stops; a restart goes on from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(df: DataFrame, checkpoint: str, apply) -> StreamingQuery:
    """Hands every micro-batch to apply(batch, id), which must be idempotent by id (a watermark table, say)."""
    query = df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
