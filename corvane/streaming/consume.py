"""Event consumption with Structured Streaming: routing, idempotent effects, retries, dead letters.

Events are JSON files in a source folder for each kind. The inbox is keyed state of the stream: for each event the last attempt that
went through, kept in the state store for a time, so that a micro-batch reads its own files and no earlier batch. What passes is
routed and written under the batch's id, so that a batch that is repeated overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.control import after_failure, backoff
from corvane.schemas import EVENT
from corvane.sources.parsers import parse_events

#: Routes of a micro-batch.
ROUTES = ("done", "retry", "dead_letter")


def route(events: DataFrame, domain: str, kinds: tuple[str, ...], run: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """Parsed events with route, error_code, next_attempt and delay.

    Events that don't parse, of another kind or of another domain are dead letters at once. run takes the others
    and returns (event_id, ok, retryable).
    """
    checked = events.withColumn("error", F.coalesce("error", F.when(~F.col("event_type").isin(*kinds), "WRONG_KIND").when(F.col("domain") != domain, "WRONG_DOMAIN")))
    good = checked.where("error is null")
    ran = good.join(run(good).select("event_id", "ok", "retryable"), "event_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    routed = after_failure(ran.withColumn("retryable", F.coalesce("retryable", F.lit(True))), most)
    routed = routed.withColumn("route", F.when(F.coalesce("ok", F.lit(False)), "done").otherwise(F.col("route"))).withColumn("delay", F.when(F.col("route") == "retry", backoff(F.col("next_attempt"))))
    bad = checked.where("error is not null").withColumn("route", F.lit("dead_letter"))
    return routed.unionByName(bad, allowMissingColumns=True)


def effects(spark: SparkSession, sink: str) -> DataFrame:
    """The events whose effects are recorded: the inbox."""
    schema = spark.createDataFrame([], "event_id string, route string, batch long").schema
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "false").option("basePath", sink).parquet(sink)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


#: The state store that keeps its keys on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_deliveries(events: DataFrame, days: int = 30) -> DataFrame:
    """The rows of a stream of parsed events (with `value`, the line) that come for the first time: an event's attempt passes if it is higher than all before it.

    A line that isn't an event passes once. State is a number for each event, dropped `days` after the event was last seen.
    """
    keyed = events.withColumn("_key", F.coalesce("event_id", F.sha2("value", 256))).withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    fields = T.StructType([f for f in keyed.schema.fields if f.name != "_key"])

    def pick(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames))  # deliveries of one event
        fresh = rows[rows["attempt"] > last].sort_values("attempt", kind="stable").drop_duplicates("attempt")
        state.update((int(max(last, rows["attempt"].max())),))
        state.setTimeoutDuration(days * 86_400_000)
        if len(fresh):
            yield fresh[[f.name for f in fields]]

    return keyed.groupBy("_key").applyInPandasWithState(pick, fields, "last int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def consume(spark: SparkSession, source: str, sink: str, checkpoint: str, *, domain: str, kinds: tuple[str, ...], run: Callable[[DataFrame], DataFrame], most: int = 5, files: int = 8, days: int = 30) -> StreamingQuery:
    """Start a consumer over JSON event files that stops when it has caught up.

    sink gets Parquet by batch: every attempt of an event once, as done, retry or dead_letter; retries come again from their own source folder with attempt counted up.
    """
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source)

    def handle(batch: DataFrame, number: int) -> None:
        columns = [*EVENT.names, "error", "route", "next_attempt", "delay"]
        batch.persist()  # run() and the routing read it
        try:
            route(batch.drop("value"), domain, kinds, run, most).select(*columns).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    fresh = first_deliveries(parse_events(stream, "value", "value"), days)
    # a stream has its own copy of the settings from its start on; states that have timed out go with the next batch that has data
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def counts(events: DataFrame, key: str, moment: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Event counts by kind and hour of a stream or a table, with a watermark for late rows."""
    return events.withWatermark(moment, late).groupBy(F.window(moment, window), key).agg(F.count("*").alias("n")) if events.isStreaming else events.groupBy(F.window(moment, window), key).agg(F.count("*").alias("n"))


def dead_letters(spark: SparkSession, sink: str) -> DataFrame:
    """What was given up, for inspection."""
    return spark.read.parquet(sink).where("route = 'dead_letter'")


def redrive(spark: SparkSession, sink: str, ids: DataFrame, target: str) -> int:
    """Write dead letters of the ids (event_id) to a source folder again, first attempt; how many."""
    again = dead_letters(spark, sink).join(ids.select("event_id").distinct(), "event_id", "left_semi").select(*EVENT.names).withColumn("attempt", F.lit(0))
    again.select(F.to_json(F.struct(*again.columns)).alias("value")).write.mode("append").text(target)
    return again.count()
