"""Structured Streaming variants: incremental snapshots and first-seen tracking.

Every function takes a streaming (or batch) frame; sinks and checkpoints live in folders
the caller names, which on a cluster are in shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postingflow.operators import snapshots
from postingflow.operators.skew import rows_with_key
from postingflow.schema import COMPRESSION, KEY
from postingflow.session import settle
from postingflow.sources import buckets
from postingflow.sources.snapshots import has_batch, merge_store, next_version


def stream_parquet(spark: SparkSession, folder: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def utc_time(ts: Column) -> Column:
    """A wall-clock timestamp read as UTC, whatever the session's time zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def first_last_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time of each key; min/max make late input harmless.

    As a stream it holds a row of state for every key it ever saw; ``track_seen`` holds none.
    """
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def new_keys(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key when it first appears.

    State is kept for ``delay`` only, so a key unseen for longer appears again.
    """
    return events.select(key, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, ts: str, delay: str, width: str = "1 day") -> DataFrame:
    """Rows per day. In append mode a day comes once, when the watermark has passed it; in
    update mode it comes with its count so far whenever that changes."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("day_start"), F.col("window.end").alias("day_end"), "n")
    )


def run_available(stream: DataFrame, checkpoint: str, sink: str | None = None, each=None, mode: str = "append") -> StreamingQuery:
    """Process what is there now into a parquet folder or a per-batch function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format("parquet").option("path", sink).start()
    query.awaitTermination()
    return query


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """A batch's name for good: batch numbers start again with a new checkpoint."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/{batch_id}"


def upsert_seen(store: str, key: str, number: int = buckets.BUCKETS):
    """Per-batch step for first and last times: merge into a store in buckets.

    Only the buckets of the batch's keys are read and written. A batch that the store has is
    left out, so a repeated one changes nothing.
    """

    def merge(past: DataFrame, rows: DataFrame) -> DataFrame:
        return past.unionByName(rows).groupBy(key).agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
        )

    def step(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch, batch_id)
        if not has_batch(batch.sparkSession, store, name):
            merge_store(settle(batch, "seen"), store, merge, key, name, number)

    return step


def track_seen(store: str, key: str, ts: str, number: int = buckets.BUCKETS):
    """Per-batch step over plain events: first and last time of each key, without stream state.

    A batch shrinks to a row for each of its keys, which are merged into the buckets that
    they fall in. So the stream holds no key at all, however long it runs: older keys live in
    the store, a key that returns keeps its first time, and late rows are harmless. Rows
    without a key or a time are left out.
    """
    merge = upsert_seen(store, key, number)

    def step(batch: DataFrame, batch_id: int) -> None:
        whole = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        merge(first_last_seen(whole, key, ts), batch_id)

    return step


def upsert_latest(store: str, key: str, number: int = buckets.BUCKETS):
    """Per-batch step in update mode: a row of the batch replaces the stored row of its key."""

    def step(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch, batch_id)
        if not has_batch(batch.sparkSession, store, name):
            merge_store(settle(batch, "latest"), store, lambda past, rows: snapshots.upsert(past, rows, key=key), key, name, number)

    return step


def ingest_snapshots(
    history: str, added_log: str, order: str = "ord", key: str = KEY, number: int = buckets.BUCKETS, settled: bool = False,
):
    """Per-batch step of the daily loop: log the added postings, merge into history.

    The history's next version numbers the run, whatever stream or job wrote the last one. A
    batch that history has is left out; one that failed half-way writes the same run again.
    A batch is settled, unless it costs no more to read again (``settled``), such as plain files.

    What the merge says of a key that history did not have is what the batch says of it, so
    the added postings are taken from the merged rows before these are committed. Rows
    without a key are always added, and logged without what history holds of them.
    """

    def fold(past: DataFrame, rows: DataFrame) -> DataFrame:
        # History comes before everything in the batch.
        both = snapshots.union_columns(past.withColumn(order, F.lit(-1).cast("bigint")), rows)
        return snapshots.unify(both, order, key).withColumn(order, F.lit(-1).cast("bigint"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(batch, batch_id)
        if has_batch(spark, history, name):
            return
        rows = batch if settled else settle(batch, "batch", compression=COMPRESSION)
        new_keys = buckets.added_keys(rows, history, key)
        log = f"{added_log}/run={next_version(spark, history)}"

        def log_added(merged: DataFrame) -> None:
            keyless = snapshots.unify(rows.where(F.col(key).isNull()), order, key)
            fresh = merged.where(F.col(key).isNotNull())
            if new_keys is not None:
                fresh = rows_with_key(fresh, new_keys, key)
            fresh = fresh.select(*keyless.columns).unionByName(keyless)
            fresh.write.mode("overwrite").option("compression", COMPRESSION).parquet(log)

        merge_store(rows, history, fold, key, name, number, grouped=True, before_commit=log_added)

    return step
