"""Stores in buckets: what a run touches, what a filter rules out, failed and repeated runs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postingflow.operators import snapshots
from postingflow.plans import jobs
from postingflow.session import settle
from postingflow.sources import buckets
from postingflow.sources.snapshots import has_batch, merge_store, next_version, read_store, write_store
from postingflow.streaming import streams

SCHEMA = "k string, v int"


def frame(spark, rows):
    return settle(spark.createDataFrame(rows, SCHEMA), "rows")


def newest(past, rows):
    return snapshots.upsert(past, rows, key="k")


def stored(spark, path):
    return sorted(map(tuple, read_store(spark, path).collect()), key=str)


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_a_small_run_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    state, some = merge_store(frame(spark, [(f"k{i}", i) for i in range(4000)]), path, newest, "k", number=16)
    assert some == list(range(16)) and state.held == (0,) * 16
    whole = size(f"{path}/data/version=0")
    few = [(f"k{i}", -i) for i in range(0, 40, 20)] + [("new", 1)]
    state, some = merge_store(frame(spark, few), path, newest, "k")
    assert 0 < len(some) <= 3 and state.buckets == 16
    assert {b for b, v in enumerate(state.held) if v == 1} == set(some)
    assert size(f"{path}/data/version=1") < whole * (len(some) + 1) / 16
    want = {f"k{i}": i for i in range(4000)} | dict(few)
    assert stored(spark, path) == sorted(want.items(), key=str)
    assert read_store(spark, path, before=1).where("k = 'new'").count() == 0
    sizes = buckets.bucket_sizes(spark, path)
    assert sizes.agg(F.sum("rows")).first()[0] == 4001 and sizes.where("version = 1").count() == len(some)
    buckets.rebucket(spark, path, 5, next_version(spark, path), "k")
    assert stored(spark, path) == sorted(want.items(), key=str) and buckets.manifest(spark, path).buckets == 5
    merge_store(frame(spark, [("k1", 7)]), path, newest, "k", number=16)
    assert dict(stored(spark, path))["k1"] == 7


def test_null_keys_empty_runs_and_removed_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    merge_store(frame(spark, [("a", 1), (None, 2)]), path, newest, "k", number=4)
    merge_store(frame(spark, []), path, newest, "k")
    assert stored(spark, path) == [("a", 1), (None, 2)]
    state, _ = merge_store(frame(spark, [("a", 0)]), path, lambda past, rows: past.where("false"), "k")
    assert -1 in state.held and "a" not in dict(stored(spark, path))
    assert read_store(spark, str(tmp_path / "none"), schema=SCHEMA).count() == 0
    with pytest.raises(ValueError):
        merge_store(settle(spark.createDataFrame([("a", 1)], "k string, store_bucket int"), "x"), str(tmp_path / "c"), newest, "k")


def test_columns_may_be_added(spark, tmp_path):
    path = str(tmp_path / "store")
    merge_store(frame(spark, [(f"k{i}", i) for i in range(50)]), path, newest, "k", number=8)
    merge_store(settle(spark.createDataFrame([("k1", 5, "x")], SCHEMA + ", w string"), "r"), path, newest, "k")
    rows = {r["k"]: r for r in read_store(spark, path).collect()}
    assert rows["k1"]["w"] == "x" and rows["k2"]["w"] is None and len(rows) == 50


def test_a_whole_store_can_go_on_beside(spark, tmp_path):
    path = str(tmp_path / "store")
    merge_store(frame(spark, [("a", 1)]), path, newest, "k")
    write_store(frame(spark, [("b", 2)]), path)
    assert stored(spark, path) == [("b", 2)]


def test_failed_and_repeated_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    merge_store(frame(spark, [(f"k{i}", i) for i in range(100)]), path, newest, "k", "q/0", 8)
    before = stored(spark, path)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "write_filters", lost)  # the rows are there, the commit is not
        with pytest.raises(RuntimeError):
            merge_store(frame(spark, [("k1", -1), ("z", 0)]), path, newest, "k", "q/1")
    assert stored(spark, path) == before and not has_batch(spark, path, "q/1")
    merge_store(frame(spark, [("k1", -1), ("z", 0)]), path, newest, "k", "q/1")
    assert len(stored(spark, path)) == 101 and has_batch(spark, path, "q/1")


def test_filters_rule_out_new_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    rnd = random.Random(3)
    known = [f"id-{rnd.getrandbits(60)}" for _ in range(20000)]
    merge_store(frame(spark, [(k, 1) for k in known]), path, newest, "k", number=8)
    state = buckets.manifest(spark, path)
    asked = [(k, 2) for k in known[:3000]] + [(f"new-{i}", 3) for i in range(10000)]
    tested = buckets.with_maybe_known(frame(spark, asked), path, state, "k")
    assert tested.columns == ["k", "v", "maybe_known"]
    rows = tested.collect()
    assert len(rows) == len(asked) and all(r["maybe_known"] for r in rows if r["v"] == 2)
    assert sum(r["maybe_known"] for r in rows if r["v"] == 3) < 300
    fresh = buckets.added_rows(frame(spark, asked + [(None, 4)]), path, state, "k")
    old = read_store(spark, path)
    want = snapshots.added(frame(spark, asked + [(None, 4)]), old, "k")
    assert sorted(map(tuple, fresh.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_history_is_read_for_possible_keys_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    merge_store(frame(spark, [(f"id-{i}", 1) for i in range(5000)]), path, newest, "k", number=16)
    state, read = buckets.manifest(spark, path), []
    plain = buckets.read_buckets
    monkeypatch.setattr(buckets, "read_buckets", lambda s, p, st, some=None, schema=None: read.append(list(some)) or plain(s, p, st, some, schema))
    assert buckets.added_rows(frame(spark, [(f"n-{i}", 1) for i in range(20)] + [("id-7", 1)]), path, state, "k").count() == 20
    assert len(read) == 1 and len(read[0]) <= 3  # the known key's bucket, and those of false positives


def test_store_run_equals_one_merge(spark, tmp_path):
    rnd = random.Random(4)
    rows = [
        (f"p{rnd.randint(0, 60)}", f"T{i}", f"2024-01-{1 + i // 40:02d}", i // 40, ["w"]) for i in range(120)
    ]
    df = spark.createDataFrame(rows, "posting_id string, title string, day string, ord bigint, matched_titlewords array<string>")
    df = df.withColumns({"collected_on": F.to_date("day"), "description": F.col("title"), "first_collected_on": F.lit(None).cast("date"), "last_collected_on": F.lit(None).cast("date")}).drop("day")
    df = settle(snapshots.unify(df.withColumn("key2", F.lit(1)), "ord", ["posting_id", "ord"]).drop("key2"), "rows")
    seen = set()
    for i in range(3):
        part = df.where(F.col("ord") == i)
        jobs.store_run(part, str(tmp_path))
        ids = {r[0] for r in part.select("posting_id").collect()}
        added = {r[0] for r in read_store(spark, f"{tmp_path}/newly_added").select("posting_id").collect()}
        assert added == ids - seen
        seen |= ids
    cols = ["posting_id", "title", "first_collected_on", "last_collected_on"]
    got = sorted(map(tuple, read_store(spark, f"{tmp_path}/history").select(cols).collect()))
    assert got == sorted(map(tuple, snapshots.unify(df, "ord").select(cols).collect()))


def test_first_seen_of_repeated_batches(spark, tmp_path):
    step = streams.upsert_seen(str(tmp_path / "seen"), "k", 4)
    schema = "k string, first_seen int, last_seen int"
    for i, rows in enumerate([[("a", 5, 6), ("b", 1, 1)], [("a", 2, 9)], [("a", 2, 9)]]):
        step(spark.createDataFrame(rows, schema), min(i, 1))
    assert sorted(map(tuple, read_store(spark, str(tmp_path / "seen")).collect())) == [("a", 2, 9), ("b", 1, 1)]


def _postings(spark, rows):
    schema = "posting_id string, title string, day string, ord bigint, matched_titlewords array<string>, first_collected_on date, last_collected_on date"
    df = spark.createDataFrame([(k, t, d, o, ["w"], None, None) for k, t, d, o in rows], schema)
    df = df.withColumns({"collected_on": F.to_date("day"), "description": F.concat(F.lit("text of "), "title")})
    return settle(df.drop("day"), "rows")


# The first run has copies, the second a known key, a new one with copies, and null keys.
RUNS = [
    [("a", "A1", "2024-01-01", 1), ("a", "A2", "2024-01-03", 2), ("b", "B", "2024-01-02", 1), (None, "N1", "2024-01-02", 1)],
    [("a", "A3", "2024-01-02", 3), ("c", "C1", "2024-01-09", 3), ("c", "C2", "2024-01-07", 4), (None, "N2", "2024-01-01", 3), (None, "N3", "2024-01-08", 4)],
]


def _watch(monkeypatch, *modules):
    """The columns of the tables that are settled, and which were joined to stored keys."""
    settled, tested = [], []
    for module in modules:
        monkeypatch.setattr(module, "settle", lambda df, purpose, **options: settled.append(df.columns) or settle(df, purpose, **options))
    plain = buckets.added_rows
    monkeypatch.setattr(buckets, "added_rows", lambda rows, *args: tested.append(rows.columns) or plain(rows, *args))
    return settled, tested


def test_a_run_moves_texts_for_the_merge_and_the_dates_only(spark, tmp_path, monkeypatch):
    settled, tested = _watch(monkeypatch, jobs, buckets)
    root = str(tmp_path)
    for rows in RUNS:
        jobs.store_run(_postings(spark, rows), root, settled=True)
    assert tested == [["posting_id"]] and not any("description" in columns for columns in settled)

    def shown(name):
        rows = read_store(spark, f"{root}/{name}").selectExpr("posting_id", "title", "description", "string(first_collected_on)", "string(last_collected_on)", "timespan_days")
        return sorted(map(tuple, rows.collect()), key=str)

    # A posting without a key gets no dates of history, and is always added.
    added = [
        (None, "N2", "text of N2", None, None, None), (None, "N3", "text of N3", None, None, None),
        ("c", "C1", "text of C1", "2024-01-07", "2024-01-09", 2), ("c", "C2", "text of C2", "2024-01-07", "2024-01-09", 2),
    ]
    assert shown("newly_added") == sorted(added, key=str)
    assert shown("current") == sorted([*added, ("a", "A3", "text of A3", "2024-01-01", "2024-01-03", 2)], key=str)
    assert shown("history") == sorted([
        (None, "N1", "text of N3", "2024-01-01", "2024-01-08", 7), ("a", "A1", "text of A2", "2024-01-01", "2024-01-03", 2),
        ("b", "B", "text of B", "2024-01-02", "2024-01-02", 0), ("c", "C1", "text of C1", "2024-01-07", "2024-01-09", 2),
    ], key=str)


def test_ingest_logs_added_postings_from_the_merge(spark, tmp_path, monkeypatch):
    settled, tested = _watch(monkeypatch, streams, buckets)
    step = streams.ingest_snapshots(f"{tmp_path}/history", f"{tmp_path}/added", number=4, settled=True)
    logged = []
    for i, rows in enumerate(RUNS):
        batch = _postings(spark, rows)
        step(batch, i)
        logged.append(batch)
    assert tested == [["posting_id"]] and not any("description" in columns for columns in settled)
    columns = ["posting_id", "title", "description", "first_collected_on", "last_collected_on", "matched_titlewords"]
    whole = [logged[0], logged[1].where("posting_id IS NULL OR posting_id = 'c'")]
    for i, fresh in enumerate(whole):
        merged = snapshots.unify(fresh, "ord")
        got = spark.read.parquet(f"{tmp_path}/added/run={i}")
        assert got.columns == merged.columns
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, merged.select(columns).collect()))


def test_nothing_added_is_committed_before_it_is_logged(spark, tmp_path, monkeypatch):
    """A batch whose log could not be written is not in history, so it is repeated whole."""
    history, added = f"{tmp_path}/history", tmp_path / "added"
    added.write_text("not a folder")
    step = streams.ingest_snapshots(history, str(added), number=4)
    with pytest.raises(Exception):
        step(_postings(spark, RUNS[0]), 0)
    assert buckets.manifest(spark, history) is None


def test_grouped_rows_are_not_moved_again(spark, tmp_path):
    rows = _postings(spark, RUNS[0])
    fold = lambda past, new: snapshots.unify(new, "ord")
    plain, _ = merge_store(rows, str(tmp_path / "plain"), fold)
    state, some = merge_store(rows, str(tmp_path / "grouped"), fold, grouped=True)
    assert state.held == plain.held and some
    both = [sorted(map(str, read_store(spark, str(tmp_path / n)).collect())) for n in ("plain", "grouped")]
    assert both[0] == both[1] and len(both[0]) == 3
