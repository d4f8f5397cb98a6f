"""Merges, differences, skew, reports and coverage on small fixtures."""

import datetime as dt
import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import Profile
from postingflow.operators import coverage, enrich, filters, phrases, reports, skew, snapshots
from postingflow.session import settle

D = dt.date
SCHEMA = "posting_id string, company string, points decimal(12,2), description string, collected_on date, matched_titlewords array<string>, ord bigint"


def versions(spark):
    return spark.createDataFrame(
        [
            ("a", "", Decimal(0), "x", D(2024, 1, 5), ["p", "q"], 1),
            ("a", "B", Decimal("1.5"), "y", D(2024, 1, 9), ["r", "p"], 2),
            ("b", "C", Decimal(2), "", D(2024, 1, 9), None, 2),
            ("b", "", Decimal(0), "late", D(2024, 1, 2), ["z"], 3),
            ("c", "", Decimal(0), None, D(2024, 1, 2), [], 1),
        ],
        SCHEMA,
    )


def test_unify(spark):
    rows = {r["posting_id"]: r for r in snapshots.with_timespan(snapshots.unify(versions(spark))).collect()}
    a = rows["a"]
    assert (a["company"], a["points"], a["description"], a["timespan_days"]) == ("B", Decimal("1.5"), "y", 4)
    assert (a["first_collected_on"], a["last_collected_on"]) == (D(2024, 1, 5), D(2024, 1, 9))
    assert a["matched_titlewords"] == ["p", "q", "r"]
    assert (rows["b"]["company"], rows["b"]["description"], rows["b"]["matched_titlewords"]) == ("C", "late", ["z"])
    assert (rows["c"]["company"], rows["c"]["points"], rows["c"]["description"]) == ("", Decimal(0), None)


def test_unify_is_idempotent_and_order_free_in_dates(spark):
    once = snapshots.unify(versions(spark)).withColumn("ord", F.lit(0).cast("bigint"))
    twice = snapshots.unify(once)
    cols = sorted(c for c in once.columns if c != "ord")
    assert sorted(once.select(cols).collect()) == sorted(twice.select(cols).collect())
    flipped = snapshots.unify(versions(spark).withColumn("ord", -F.col("ord")))
    keep = ["posting_id", "first_collected_on", "last_collected_on"]
    assert sorted(once.select(keep).collect()) == sorted(flipped.select(keep).collect())


def test_unify_extend(spark):
    rows = snapshots.unify_extend(versions(spark)).collect()
    assert len(rows) == 5
    for r in rows:
        if r["posting_id"] == "a":
            assert (r["first_collected_on"], r["last_collected_on"], r["description"]) == (D(2024, 1, 5), D(2024, 1, 9), "y")
            assert r["matched_titlewords"] == ["p", "q", "r"]


def skewed(spark, n=6000, seed=1):
    """A third of the rows on one key."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 900)}", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "posting_id string, v int").repartition(8)


def test_joins_split_a_hot_key_without_changing_results(spark):
    rows, df = skewed(spark)
    others = [("hot",), ("k1",), ("k2",), ("nobody",), ("k1",), ("hot",)]
    other = spark.createDataFrame(others, "posting_id string")
    keys = {k for (k,) in others}
    kept = [r["v"] for r in skew.rows_with_key(df, other, "posting_id").collect()]
    gone = [r["v"] for r in skew.rows_without_key(df, other, "posting_id").collect()]
    assert sorted(kept) == [v for k, v in rows if k in keys]
    assert sorted(gone) == [v for k, v in rows if k not in keys]
    per_key = df.groupBy("posting_id").agg(F.max("v").alias("top"))
    top = {}
    for k, v in rows:
        top[k] = max(top.get(k, -1), v)
    joined = skew.join_per_key(df, per_key, "posting_id").collect()
    assert len(joined) == len(rows) and all(r["top"] == top[r["posting_id"]] for r in joined)
    left = skew.join_per_key(df, per_key.where("posting_id = 'hot'"), "posting_id", "left").collect()
    assert len(left) == len(rows) and sum(r["top"] is not None for r in left) == sum(k == "hot" for k, _ in rows)


def test_hot_key_is_split_by_adaptive_execution(spark, tmp_path):
    """A third of the rows on one key: no join partition keeps them all."""
    _, df = skewed(spark, 60000)
    df.withColumn("pad", F.repeat(F.md5(F.col("v").cast("string")), 8)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        marks = df.groupBy("posting_id").agg(F.max("v").alias("x"))
        keys = df.select("posting_id").distinct()
        keys.write.parquet(str(tmp_path / "keys"))
        keys = spark.read.parquet(str(tmp_path / "keys"))
        for joined in (skew.join_per_key(df, marks, "posting_id"), skew.rows_with_key(df, keys, "posting_id")):
            written = settle(joined.withColumn("p", F.spark_partition_id()), "joined")
            sizes = [r["count"] for r in written.where("posting_id = 'hot'").groupBy("p").count().collect()]
            assert len(sizes) > 3 and max(sizes) < 0.6 * sum(sizes)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_details_of_one_id_overwrite_each_other(spark):
    postings = spark.createDataFrame([("a", "t", None), ("b", "u", "own")], "posting_id string, title string, description string")
    details = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "posting_id string, description string, seq int")
    got = snapshots.detail_join(postings, details, order="seq").collect()
    assert sorted((r["posting_id"], r["description"]) for r in got) == [("a", "new"), ("b", "own")]


def test_rare_companies(spark):
    rows, df = skewed(spark)
    counts = {}
    for k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    named = df.withColumnRenamed("posting_id", "company")
    got = sorted(r["v"] for r in coverage.rare_company_postings(named, 4).collect())
    assert got == [v for k, v in rows if counts[k] <= 4] and got


def test_differences_are_disjoint_from_intersection(spark):
    a = spark.createDataFrame([(f"k{i}", i) for i in range(0, 30)], "posting_id string, v int")
    b = spark.createDataFrame([(f"k{i}", i) for i in range(20, 50)], "posting_id string, v int")
    added = {r[0] for r in snapshots.added(a, b).select("posting_id").collect()}
    removed = {r[0] for r in snapshots.removed(a, b).select("posting_id").collect()}
    both = {r[0] for r in snapshots.key_intersection(a, b).collect()}
    assert added == {f"k{i}" for i in range(20)} and removed == {f"k{i}" for i in range(30, 50)}
    assert not both & (added | removed) and len(both) == 10
    assert {(r[0], r[1]) for r in snapshots.change_counts(a, b).collect()} == {("added", 20), ("removed", 20), ("kept", 10)}


def test_upsert_and_backfill(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "posting_id string, v int")
    more = spark.createDataFrame([("b", 20), ("c", 30)], "posting_id string, v int")
    assert sorted(map(tuple, snapshots.upsert(base, more).collect())) == [("a", 1), ("b", 20), ("c", 30)]
    only = spark.createDataFrame([("c",)], "posting_id string")
    assert sorted(map(tuple, snapshots.upsert(base, more, only).collect())) == [("a", 1), ("b", 2), ("c", 30)]


def test_select_and_drop_partition_the_input(spark):
    df = spark.createDataFrame([("1", "Data Engineer", "graph"), ("2", None, None), ("3", "Chef", "Küche")], "posting_id string, title string, description string")
    lists = {"title_keywords": ["data"], "description_keywords": ["KÜCHE"]}
    kept = [r[0] for r in filters.select_keywords(df, **lists).collect()]
    dropped = [r[0] for r in filters.filter_out_keywords(df, **lists).collect()]
    assert (kept, dropped) == (["1", "3"], ["2"])
    assert filters.select_keywords(df).count() == 0


def test_recency_buckets(spark):
    days = [D(2024, 2, 15), D(2024, 2, 9), D(2024, 2, 8), D(2024, 2, 2), D(2024, 2, 1), D(2024, 1, 19), D(2024, 1, 18), None]
    df = spark.createDataFrame([(f"k{i}", d, Decimal(i)) for i, d in enumerate(days)], "posting_id string, first_collected_on date, points decimal(12,2)")
    rows = reports.in_report_order(reports.recency_report(df, D(2024, 2, 15))).collect()
    assert {r["posting_id"]: r["bucket"] for r in rows} == dict(zip((f"k{i}" for i in range(8)), [0, 0, 1, 1, 2, 2, 3, 3]))
    assert [r["posting_id"] for r in rows] == ["k1", "k0", "k3", "k2", "k5", "k4", "k7", "k6"]
    assert [r["separator"] for r in rows if r["separator"]] == list(config.BUCKET_LABELS)


def test_title_word_audit(spark):
    arrays = [["a"], ["a", "b"], ["c"], ["b", "d"], [], ["a"]]
    df = spark.createDataFrame([(x,) for x in arrays], "matched_titlewords array<string>")
    assert {r[0] for r in coverage.mandatory_words(df).collect()} == {"a", "c"}
    assert {r[0] for r in coverage.optional_words(df).collect()} == {"b", "d"}
    assert {(r[0], r[1]) for r in coverage.sole_match_counts(df).collect()} == {("a", 2), ("c", 1)}
    assert tuple(coverage.removal_impact(df, ["a"]).first()) == (2, 3, 1)


def test_report_with_missing_columns(spark):
    df = spark.createDataFrame([("k", "T\x07", "Google AT", Decimal(1))], "posting_id string, title string, company string, points decimal(12,2)")
    row = reports.report_table(df, D(2024, 2, 15)).first()
    assert (row["Title"], row["URL"], row["link"], row["bucket"], row["is_highlighted_company"]) == ("T", "", "", 3, True)


def test_phrase_counts_by_hand(spark):
    df = spark.createDataFrame([("Graph data and graph data",), ("graph data",), ("the graph",)], "description string")
    stop = ("and", "the")
    words_ = {r["phrase"]: r["n"] for r in phrases.mine_keywords(df, stop).collect()}
    assert words_ == {"graph": 4, "data": 3, "graph data": 3}
    runs = {r["phrase"]: r["n"] for r in phrases.mine_keyphrases(df, stop, min_count=1).collect()}
    assert runs == {"graph data": 3}
    assert len(phrases.default_stopwords()) > 300


def test_process_steps_can_be_replaced(spark):
    df = spark.createDataFrame(
        [("a", "Sales Manager", "x", ["Wien"], None), ("b", "Graph Data Engineer", "und der die", ["Graz"], 4100)],
        "posting_id string, title string, description string, locations array<string>, salary_monthly_guessed bigint",
    )
    done = {r["posting_id"]: r for r in enrich.process(df, Profile()).collect()}
    assert set(done) == {"b"} and done["b"]["language"] == "de"
    assert done["b"]["points"] == Decimal("1.80")  # 2.15 + 0.65 - 1 (secondary place)
    all_rows = enrich.process(df, Profile(), filter_step=lambda d: d)
    assert all_rows.count() == 2
    assert Profile().extended(keywords=("new",)).keywords[-1] == "new"


def test_universal_inputs(spark):
    from dataclasses import replace

    from postingflow.plans import jobs

    chosen = [replace(Profile(), name="a", titlewords=("x", "y")), replace(Profile(), name="b", titlewords=("y", "y"))]
    rows = {r["word"]: r["profiles"] for r in jobs.universal_inputs(jobs.profile_words(spark, chosen)).collect()}
    assert rows == {"x": ["a"], "y": ["a", "b"]}


def test_daily_run(spark, tmp_path):
    from postingflow.plans import jobs
    from postingflow.sources.snapshots import read_store

    D2 = dt.date(2024, 2, 10)
    raw = spark.createDataFrame(
        [("new", "Research Analyst", "Firm", "graph data", ["Wien", "Graz"], D2, None), ("old", "Data Engineer", "Firm 2", "python, sql", ["Linz", "Vienna"], D2, "4.200,00"),
         ("bad", "Sales Manager", "Firm 3", "x", ["Wien"], D2, None), ("low", "Consultant", "Firm 4", "x", ["Wien"], D2, None),
         ("undated", "Research Analyst", "Firm", "x", ["Wien"], D2, None)],
        "posting_id string, title string, company string, description string, locations array<string>, collected_on date, salary string",
    )
    history = spark.createDataFrame(
        [("old", D(2024, 1, 1), D(2024, 2, 1), Decimal(1)), ("gone", D(2024, 1, 1), D(2024, 2, 1), Decimal(3)), ("gone_low", D(2024, 1, 1), D(2024, 2, 1), Decimal(0)),
         ("bad", D(2024, 1, 1), D(2024, 2, 1), Decimal(2)), ("undated", None, None, Decimal(1))],
        "posting_id string, first_collected_on date, last_collected_on date, points decimal(12,2)",
    )
    run = jobs.daily_run(raw, history, Profile())
    results = {r["posting_id"]: r for r in run.results.collect()}
    assert set(results) == {"new", "old", "undated"}
    assert {r["posting_id"] for r in run.stored.collect()} == {"new", "old", "low", "undated"}
    assert (results["old"]["first_collected_on"], results["old"]["last_collected_on"], results["old"]["timespan_days"]) == (D(2024, 1, 1), D2, 40)
    assert results["old"]["salary_monthly_guessed"] == 4200 and results["old"]["locations"] == ["Vienna", "Linz"]
    assert [r["posting_id"] for r in run.added.collect()] == ["new"]
    # A posting whose title is banned by now counts as removed.
    assert {r["posting_id"] for r in run.removed.collect()} == {"gone", "bad"}
    firms = [r["company"] for r in run.companies.orderBy("first_seen").collect()]
    best = sorted(results.values(), key=lambda r: -r["points"])
    assert firms == list(dict.fromkeys(r["company"] for r in best))
    made = jobs.outputs(run, D2, dt.datetime(2024, 2, 10, 9))
    assert [r["line"] for r in made["log"].collect()] == ["Research Analyst - at - Firm"]
    assert {r["posting_id"]: r["is_new"] for r in made["report"].collect()} == {"new": True, "old": False, "undated": False}
    assert made["digest"].count() == 3

    root = str(tmp_path / "stores")
    for _ in range(2):
        jobs.daily_job(raw, root, Profile())
    read = lambda name: {r["posting_id"]: r for r in read_store(spark, f"{root}/{name}").collect()}
    assert set(read("history")) == set(read("current")) == {"new", "old", "low", "undated"}
    assert read("newly_added") == {} and read("current")["low"]["timespan_days"] == 0


@pytest.mark.parametrize("seed", range(4))
def test_smallest_word_set_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i:02}" for i in range(9)]
    rows = [sorted(rnd.sample(vocabulary, rnd.randint(1, 4))) for _ in range(25)] + [None, [], [None]]
    rows += rows[:7] * 3
    df = settle(spark.createDataFrame([(r,) for r in rows], "matched_titlewords array<string>"), "test")
    sets = [{w for w in r if w} for r in rows if r and any(r)]
    used = sorted(set().union(*sets))
    enough = [c for k in range(len(used) + 1) for c in itertools.combinations(used, k) if all(s & set(c) for s in sets)]
    least = min(map(len, enough))
    best = min((c for c in enough if len(c) == least), key=lambda c: tuple(reversed(c)))
    got = coverage.smallest_word_set(df).orderBy("pos").collect()
    assert tuple(r["word"] for r in got) == best
    left = list(sets)
    for r in got:
        assert r["newly_found"] == sum(r["word"] in s for s in left)
        left = [s for s in left if r["word"] not in s]
    assert not left
    greedy = [r["word"] for r in coverage.smallest_word_set(df, exact=0).collect()]
    assert all(s & set(greedy) for s in sets)
    distinct = {frozenset(s) for s in sets}
    most = max(sum(w in s for s in distinct) for w in used)
    assert least <= len(greedy) <= least * (1 + math.log(most))


def test_smallest_word_set_of_nothing(spark):
    empty = spark.createDataFrame([(None,), ([],)], "matched_titlewords array<string>")
    assert coverage.smallest_word_set(empty).isEmpty() and coverage.smallest_word_set(empty, exact=0).isEmpty()


def test_written_counts_take_no_job_of_their_own(spark, tmp_path):
    rows = settle(spark.createDataFrame([(f"p{i}" if i % 5 else None, i) for i in range(50)], "posting_id string, n int"), "test")
    parts = {"results": rows, "added": rows.where("n < 10"), "none": rows.where("n < 0")}
    plain = {name: df.where("posting_id IS NOT NULL").count() for name, df in parts.items()}
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        totals = coverage.written_counts(parts, lambda name, df: df.write.parquet(str(tmp_path / name)))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == len(parts)
    assert {r["part"]: r["postings"] for r in totals.collect()} == plain
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in parts] == [50, 10, 0]
