"""Streams: order of arrival, repeated batches, bounded state."""

import datetime as dt

from pyspark.sql import functions as F

from postingflow.operators import snapshots
from postingflow.sources.snapshots import read_store
from postingflow.streaming import streams


def batches():
    day = dt.date
    return [
        [("a", "T", "x", day(2024, 1, 5), 1), ("b", "T", "y", day(2024, 1, 5), 1)],
        [("a", "T2", "z", day(2024, 1, 3), 2), ("c", "T", "w", day(2024, 1, 9), 2)],
    ]


SCHEMA = "posting_id string, title string, description string, collected_on date, ord bigint, first_collected_on date, last_collected_on date"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def test_ingest_and_repeat(spark, tmp_path):
    step = streams.ingest_snapshots(f"{tmp_path}/history", f"{tmp_path}/added")
    for i, rows in enumerate(batches()):
        step(frame(spark, rows), i)

    def state():
        kept = read_store(spark, f"{tmp_path}/history").select("posting_id", "title", "description", "first_collected_on", "last_collected_on")
        added = spark.read.parquet(f"{tmp_path}/added").select("posting_id", F.col("run").cast("int"))
        return sorted(map(tuple, kept.collect())), sorted(map(tuple, added.collect()))

    first = state()
    assert [r[0] for r in first[0]] == ["a", "b", "c"] and first[1] == [("a", 0), ("b", 0), ("c", 1)]
    assert first[0][0][3:] == (dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    step(frame(spark, batches()[1]), 1)
    assert state() == first


def test_ingest_stream_equals_batch_merge(spark, tmp_path):
    for i, rows in enumerate(batches()):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = frame(spark, []).schema
    stream = streams.stream_parquet(spark, f"{tmp_path}/in", schema, max_files=1)
    streams.run_available(stream, f"{tmp_path}/cp", each=streams.ingest_snapshots(f"{tmp_path}/h", f"{tmp_path}/a"), mode="update")
    cols = ["posting_id", "first_collected_on", "last_collected_on"]
    got = sorted(map(tuple, read_store(spark, f"{tmp_path}/h").select(cols).collect()))
    everything = frame(spark, [r for b in batches() for r in b])
    assert got == sorted(map(tuple, snapshots.unify(everything).select(cols).collect()))


def test_new_keys_and_daily_counts(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    parts = [[("a", t(1, 1)), ("b", t(1, 2)), ("a", t(1, 3))], [("a", t(2, 1)), ("c", t(2, 1))], [("d", t(5, 1))], [("e", t(5, 2))]]
    for p in parts:
        spark.createDataFrame(p, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "k string, ts timestamp"
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    keys = streams.new_keys(streams.stream_parquet(spark, f"{tmp_path}/in", schema, max_files=1), "k", "ts", "10 days")
    streams.run_available(keys, f"{tmp_path}/cp1", f"{tmp_path}/keys")
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/keys").collect()) == list("abcde")
    daily = streams.daily_counts(streams.stream_parquet(spark, f"{tmp_path}/in", schema, max_files=1), "ts", "1 day")
    streams.run_available(daily, f"{tmp_path}/cp2", f"{tmp_path}/daily")
    done = {r["day_start"].day: r["n"] for r in spark.read.parquet(f"{tmp_path}/daily").collect()}
    assert done == {1: 3, 2: 2}
    seen = streams.first_last_seen(streams.stream_parquet(spark, f"{tmp_path}/in", schema, max_files=1), "k", "ts")
    streams.run_available(seen, f"{tmp_path}/cp3", each=streams.upsert_seen(f"{tmp_path}/seen", "k"), mode="update")
    rows = {r["k"]: (r["first_seen"], r["last_seen"]) for r in read_store(spark, f"{tmp_path}/seen").collect()}
    assert rows["a"] == (t(1, 1), t(2, 1)) and len(rows) == 5


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    """Batch numbers start again with a fresh checkpoint; versions and runs go on."""
    history, log = f"{tmp_path}/h", f"{tmp_path}/a"
    for i, rows in enumerate(batches()):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        stream = streams.stream_parquet(spark, f"{tmp_path}/in{i}", frame(spark, []).schema)
        streams.run_available(stream, f"{tmp_path}/cp{i}", each=streams.ingest_snapshots(history, log), mode="update")
    everything = {r[0] for b in batches() for r in b}
    assert {r["posting_id"] for r in read_store(spark, history).collect()} == everything
    assert {r["posting_id"] for r in spark.read.parquet(log).collect()} == everything


def test_seen_keys_live_in_the_store(spark, tmp_path):
    """The stream has no state; a key that returns, or comes late, keeps its first time."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k string, at bigint")
    step = streams.track_seen(f"{tmp_path}/seen", "k", "at", 4)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = streams.run_available(streams.stream_parquet(spark, f"{tmp_path}/in", schema), f"{tmp_path}/cp", each=step)
        assert query.lastProgress["stateOperators"] == []

    run([(f"k{i}", i) for i in range(50)] + [("a", 7), ("a", 5), (None, 1), ("n", None)])
    run([("a", 9), ("z", 1)])
    run([("z", 0), ("a", 3)])
    rows = {r["k"]: (r["first_seen"], r["last_seen"]) for r in read_store(spark, f"{tmp_path}/seen").collect()}
    assert rows["a"] == (3, 9) and rows["z"] == (0, 1) and rows["k7"] == (7, 7) and len(rows) == 52
