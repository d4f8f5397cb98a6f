"""Registered queries: scans, snapshot differences and merges, unions, sorts."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from postingflow.operators import coverage, reports, snapshots
from postingflow.operators.skew import rows_with_key
from postingflow.plans import jobs
from postingflow.plans.registry import query
from postingflow.plans.views import (
    joined, over_postings, over_snapshots, postings, snapshot_pair, snapshot_rows, table,
)
from postingflow.session import scratch_dir
from postingflow.sources import snapshots as store

RUN_TS = dt.datetime(2024, 2, 15, 8, 0, 0)
DATES = ("first_collected_on", "last_collected_on", "collected_on")


def as_text(df, *dates):
    """Dates as ISO text and word lists as joined text, for comparing results."""
    types = dict(df.dtypes)
    out = {c: F.col(c).cast("string") for c in df.columns if types[c] == "date"}
    out |= {c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in df.columns if types[c] == "array<string>"}
    return df.withColumns(out) if out else df


# --- scans and stores --------------------------------------------------------------------


def _chunks():
    """Postings as the pieces of an indented snapshot file between two record ends."""
    value = F.to_json(F.struct("title", "company", "description", "locations", "points", "collected_on"))
    return F.concat(F.lit('    "'), "posting_id", F.lit('": '), F.substr(value, F.lit(1), F.length(value) - 1))


@query("s1_scan_snapshot", over_postings(
    f"SELECT posting_id, title, company, md5(description) AS description_md5, {joined('locations')} AS locations, points, CAST(collected_on AS VARCHAR) AS collected_on FROM postings"))
def s1(spark, sf):
    df = postings(spark, sf)
    rows = store.parse_snapshot(df.select(_chunks().alias("value")))
    return as_text(
        rows.select("posting_id", "title", "company", F.md5("description").alias("description_md5"), "locations", "points", "collected_on")
    )


@query("s2_scan_folder", over_postings(
    "SELECT lang_label AS folder, count(*) AS postings, CAST(sum(length(description)) AS BIGINT) AS chars FROM postings GROUP BY lang_label"))
def s2(spark, sf):
    """Snapshot files of nested folders, written first and then scanned."""
    path = scratch_dir(spark, "folders")
    df = postings(spark, sf)
    df.select(_chunks().alias("value"), F.col("lang_label").alias("lang")).write.partitionBy("lang").option(
        "lineSep", store.record_end(4)
    ).text(path)
    rows = store.read_snapshots(spark, path, nested=True, glob="*.txt")
    folder = F.regexp_extract("snapshot_file", "lang=([a-z]+)", 1).alias("folder")
    return rows.groupBy(folder).agg(F.count("*").alias("postings"), F.sum(F.length("description")).alias("chars"))


def _as_files(spark, sf):
    """Postings with the snapshot file they would come from."""
    df = postings(spark, sf)
    file = F.concat(F.lit("file:/data/tech/postings_"), F.col("collected_on").cast("string"), F.lit("-08-00-00.json"))
    return df.withColumns({
        "snapshot_file": F.when(F.col("company") != "", file).otherwise(F.lit("file:/data/tech/postings.json")),
        "collected_on": F.when(F.col("lang_label") == "en", F.col("collected_on") + 1),
        "snapshot_time": F.lit(RUN_TS),
    })


def _snapshot_file(spark, sf, root: str, i: int) -> str:
    """Snapshot ``i`` written as snapshot files in a folder of its own."""
    path = f"{root}/snapshot_{i}"
    rows = snapshot_rows(spark, sf).where(f"ord = {i}")
    rows.select(_chunks().alias("value")).write.option("lineSep", store.record_end(4)).text(path)
    return path


def _folder():
    return F.regexp_extract("snapshot_file", "(snapshot_[0-9])/", 1).alias("file")


@query("s3_scan_many", over_snapshots(
    "SELECT 'snapshot_' || CAST(ord AS VARCHAR) AS file, count(*) AS postings, CAST(sum(length(description)) AS BIGINT) AS chars FROM snapshots WHERE ord <> 2 GROUP BY ord"))
def s3(spark, sf):
    """Two of three snapshots read in one scan; each row knows its file."""
    root = scratch_dir(spark, "snapshots")
    rows = store.read_snapshots(spark, [_snapshot_file(spark, sf, root, i) for i in (1, 3)], glob="*.txt")
    return rows.groupBy(_folder()).agg(F.count("*").alias("postings"), F.sum(F.length("description")).alias("chars"))


@query("s6_collection_date", over_postings(
    "SELECT posting_id, CAST(CASE WHEN lang_label = 'en' THEN collected_on + 1 WHEN company <> '' THEN collected_on ELSE DATE '2024-02-15' END AS VARCHAR) AS collected_on FROM postings"))
def s6(spark, sf):
    return as_text(store.dated(_as_files(spark, sf)).select("posting_id", "collected_on"))


@query("s4_file_date_filter", over_snapshots(
    "SELECT 'snapshot_' || CAST(ord AS VARCHAR) AS file, count(*) AS postings FROM snapshots WHERE ord > 1 GROUP BY ord"))
def s4(spark, sf):
    """Only files changed after a time: those of the first snapshot are older than it."""
    root = scratch_dir(spark, "snapshots")
    old = _snapshot_file(spark, sf, root, 1)
    newest = store.read_snapshots(spark, old, glob="*.txt").agg(F.max("snapshot_time")).first()[0]
    time.sleep(2.1)  # the cut-off is in whole seconds
    paths = [old, *(_snapshot_file(spark, sf, root, i) for i in (2, 3))]
    after = (newest + dt.timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")
    rows = store.read_snapshots(spark, paths, modified_after=after, glob="*.txt")
    return rows.groupBy(_folder()).agg(F.count("*").alias("postings"))


@query("s5_pick_snapshot", over_postings(
    "SELECT posting_id, snapshot_id FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_id DESC) AS r FROM "
    "(SELECT *, 'postings_' || CAST(collected_on AS VARCHAR) AS snapshot_id FROM postings)) WHERE r = 3"))
def s5(spark, sf):
    rows = postings(spark, sf).withColumn("snapshot_id", F.concat(F.lit("postings_"), F.col("collected_on").cast("string")))
    return store.nth_snapshot(rows, 2).select("posting_id", "snapshot_id")


_THIRD = (
    "SELECT posting_id, snapshot_id FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_id DESC) AS r FROM "
    "(SELECT *, 'postings_' || CAST(collected_on AS VARCHAR) AS snapshot_id FROM postings)) WHERE r = 3"
)


@query("s5_pick_partition", over_postings(_THIRD))
def s5_partition(spark, sf):
    """Snapshots in folders by name: the names come from the listing, one folder is read."""
    path = scratch_dir(spark, "partitions")
    name = F.concat(F.lit("postings_"), F.col("collected_on").cast("string"))
    rows = postings(spark, sf).select("posting_id", name.alias("snapshot_id"))
    store.write_snapshot(rows, path, ("snapshot_id",))
    return store.read_nth_partition(spark, path, "snapshot_id", 2).select("posting_id", "snapshot_id")


@query("w4_latest_snapshot", over_snapshots("SELECT posting_id, ord FROM snapshots WHERE ord = (SELECT max(ord) FROM snapshots)"))
def w4(spark, sf):
    return store.nth_snapshot(snapshot_rows(spark, sf), 0, "ord").select("posting_id", "ord")


@query("s7_sink_snapshot", over_snapshots(
    "SELECT CAST(collected_on AS VARCHAR) AS snapshot_date, source AS profile, count(*) AS postings FROM newest GROUP BY ALL"))
def s7(spark, sf):
    newest, _ = snapshot_pair(spark, sf)
    path = scratch_dir(spark, "sink")
    store.write_snapshot(
        newest.withColumns({"profile": F.col("source"), "snapshot_date": F.col("collected_on").cast("string")}),
        path, ("profile",),
    )
    written = spark.read.parquet(path)
    return written.groupBy("profile", "snapshot_date").agg(F.count("*").alias("postings"))


@query("s8_ensure_store", over_snapshots("SELECT 0 AS before, count(*) AS after FROM previous"))
def s8(spark, sf):
    path = scratch_dir(spark, "store")
    before = store.read_or_empty(spark, path).agg(F.count("*").alias("before"))
    _, previous = snapshot_pair(spark, sf)
    store.write_store(previous, path)
    after = store.read_or_empty(spark, path).agg(F.count("*").alias("after"))
    return before.select("before", F.lit(1).alias("k")).join(after.select("after", F.lit(1).alias("k")), "k").drop("k")


@query("s13_scan_lists", over_postings(
    "SELECT company, count(*) AS n FROM (SELECT unnest(list_concat(matched_titlewords, [company])) AS company FROM postings) GROUP BY company"))
def s13(spark, sf):
    files = postings(spark, sf).select(
        F.to_json(F.concat("matched_titlewords", F.array("company"))).alias("value")
    )
    return store.parse_list(files, "company").groupBy("company").agg(F.count("*").alias("n"))


@query("s14_newly_added_log", over_snapshots(
    "SELECT posting_id, title || ' - at - ' || company AS line FROM newest WHERE posting_id NOT IN (SELECT posting_id FROM previous)"))
def s14(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    path = scratch_dir(spark, "log")
    store.append_log(reports.log_lines(snapshots.added(newest, previous), RUN_TS), path)
    return store.read_log(spark, path).select("posting_id", "line")


# --- differences and joins ---------------------------------------------------------------

_ADDED = "SELECT * FROM newest WHERE posting_id NOT IN (SELECT posting_id FROM previous)"
_REMOVED = "SELECT * FROM previous WHERE posting_id NOT IN (SELECT posting_id FROM newest)"


@query("j1_added", over_snapshots(f"SELECT posting_id, title, company, points FROM ({_ADDED})"))
def j1(spark, sf):
    return snapshots.added(*snapshot_pair(spark, sf)).select("posting_id", "title", "company", "points")


@query("j2_removed", over_snapshots(f"SELECT posting_id, title, company, points FROM ({_REMOVED})"))
def j2(spark, sf):
    return snapshots.removed(*snapshot_pair(spark, sf)).select("posting_id", "title", "company", "points")


@query("j1_added_customers",
       "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j1_customers(spark, sf):
    """Keys with many rows on both sides: open orders of customers without a filled one."""
    orders = table(spark, sf, "orders")
    return snapshots.added(
        orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), "o_custkey"
    ).select("o_custkey", "o_orderkey")


@query("j3_compare", over_snapshots(
    "SELECT change, posting_id, title, company, points, CASE WHEN length(description) > 100 THEN substr(description, 1, 100) || '...' ELSE description END AS description "
    f"FROM (SELECT 'added' AS change, * FROM ({_ADDED}) UNION ALL SELECT 'removed', * FROM ({_REMOVED})) WHERE points >= 0.01"))
def j3(spark, sf):
    return snapshots.compare(
        *snapshot_pair(spark, sf), attrs=("title", "company", "points", "description"), threshold="0.01"
    )


@query("j3_only_lengths", over_snapshots(
    f"SELECT 'added' AS change, count(*) AS postings FROM ({_ADDED}) UNION ALL SELECT 'removed', count(*) FROM ({_REMOVED}) "
    "UNION ALL SELECT 'kept', count(*) FROM newest WHERE posting_id IN (SELECT posting_id FROM previous)"))
def j3_lengths(spark, sf):
    return snapshots.change_counts(*snapshot_pair(spark, sf))


_HISTORY = "(SELECT posting_id, min(collected_on) AS f, max(collected_on) AS l FROM snapshots WHERE ord <> 3 GROUP BY 1)"


@query("j4_history_backfill", over_snapshots(
    f"SELECT n.posting_id, CAST(f AS VARCHAR) AS first_collected_on, CAST(l AS VARCHAR) AS last_collected_on, CAST(l - f AS INT) AS timespan_days FROM newest n LEFT JOIN {_HISTORY} h USING (posting_id)"))
def j4(spark, sf):
    rows = snapshot_rows(spark, sf)
    history = snapshots.with_timespan(
        rows.where("ord <> 3").groupBy("posting_id").agg(
            F.min("collected_on").alias("first_collected_on"), F.max("collected_on").alias("last_collected_on")
        )
    )
    filled = snapshots.history_backfill(rows.where("ord = 3"), history)
    return as_text(filled.select("posting_id", "first_collected_on", "last_collected_on", "timespan_days"))


@query("j5_detail_join", over_postings(
    "SELECT posting_id, title, CASE WHEN l.quality IS NULL THEN md5(description) ELSE md5('quality ' || CAST(l.quality AS VARCHAR)) END AS description_md5 FROM postings LEFT JOIN labels l USING (doc_id)"))
def j5(spark, sf):
    details = table(spark, sf, "labels").select(
        F.concat(F.lit("src"), F.col("doc_id").cast("string")).alias("posting_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
    )
    rows = snapshots.detail_join(postings(spark, sf), details)
    return rows.select("posting_id", "title", F.md5("description").alias("description_md5"))


@query("j6_upsert", over_snapshots(
    "SELECT posting_id, title, ord FROM previous WHERE posting_id NOT IN (SELECT posting_id FROM newest) UNION ALL SELECT posting_id, title, ord FROM newest"))
def j6(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    return snapshots.upsert(previous, newest).select("posting_id", "title", "ord")


_SELECTED = "(SELECT posting_id FROM newest WHERE points > 3)"


@query("j6_upsert_selected", over_snapshots(
    f"SELECT posting_id, title, ord FROM previous WHERE posting_id NOT IN {_SELECTED} UNION ALL SELECT posting_id, title, ord FROM newest WHERE posting_id IN {_SELECTED}"))
def j6_selected(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    chosen = newest.where("points > 3").select("posting_id")
    return snapshots.upsert(previous, newest, chosen).select("posting_id", "title", "ord")


@query("j9_site_union", over_snapshots(
    "SELECT posting_id, company, points, ord FROM snapshots QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY ord DESC) = 1"))
def j9(spark, sf):
    rows = snapshot_rows(spark, sf)
    merged = snapshots.site_union(*[rows.where(f"ord = {i}") for i in (1, 2, 3)])
    return merged.select("posting_id", "company", "points", "ord")


@query("w3_first_seen_wins", over_snapshots(
    "SELECT posting_id, company, points, ord FROM snapshots QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY ord) = 1"))
def w3(spark, sf):
    return snapshots.first_per_key(snapshot_rows(spark, sf), "ord").select("posting_id", "company", "points", "ord")


# --- merging -----------------------------------------------------------------------------

_WORDS = (
    "words AS (SELECT posting_id, string_agg(w, '|' ORDER BY seen) AS ws FROM (SELECT posting_id, w, min(ord * 1000 + i) AS seen "
    "FROM (SELECT posting_id, ord, unnest(matched_titlewords) AS w, unnest(range(1, len(matched_titlewords) + 1)) AS i FROM snapshots) "
    "GROUP BY posting_id, w) GROUP BY posting_id)"
)
_UNIFIED = (
    "unified AS (SELECT posting_id, "
    "coalesce(arg_min(company, ord) FILTER (WHERE company <> ''), '') AS company, arg_min(title, ord) AS title, "
    "coalesce(arg_min(points, ord) FILTER (WHERE points <> 0), 0) AS points, "
    "arg_max(description, CAST(epoch(collected_on) AS BIGINT) * 10 - ord) AS description, "
    "arg_min(locations, ord) FILTER (WHERE len(locations) > 0) AS locations, "
    "min(collected_on) AS f, max(collected_on) AS l FROM snapshots GROUP BY posting_id)"
)


@query("a1_unify_merge", over_snapshots(
    f"SELECT u.posting_id, title, company, CAST(points AS DECIMAL(12,2)) AS points, md5(description) AS description_md5, {joined('locations')} AS locations, "
    "CAST(f AS VARCHAR) AS first_collected_on, CAST(l AS VARCHAR) AS last_collected_on, CAST(l - f AS INT) AS timespan_days, coalesce(ws, '') AS matched_titlewords "
    "FROM unified u LEFT JOIN words USING (posting_id)", f"{_WORDS}, {_UNIFIED}"))
def a1(spark, sf):
    merged = snapshots.with_timespan(snapshots.unify(snapshot_rows(spark, sf)))
    return as_text(merged.select(
        "posting_id", "title", "company", "points", F.md5("description").alias("description_md5"), "locations",
        "first_collected_on", "last_collected_on", "timespan_days", "matched_titlewords",
    ))


@query("a1_customers",
       "SELECT o_custkey, coalesce(arg_min(o_orderpriority, (CAST(epoch(o_orderdate) AS BIGINT) // 86400) * 1000000000 + o_orderkey), '') AS o_orderpriority, "
       "CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_collected_on, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_collected_on "
       "FROM orders GROUP BY o_custkey")
def a1_customers(spark, sf):
    """Orders folded to one row per customer, in order of date and order number."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("collected_on"),
        F.struct(F.unix_date(F.to_date("o_orderdate")).alias("d"), "o_orderkey").alias("ord"),
    )
    merged = snapshots.unify(orders, "ord", "o_custkey")
    return as_text(merged.select("o_custkey", "o_orderpriority", "first_collected_on", "last_collected_on"))


@query("a2_titleword_union", over_snapshots("SELECT posting_id, ws AS matched_titlewords FROM words", _WORDS))
def a2(spark, sf):
    return as_text(snapshots.ordered_union(snapshot_rows(spark, sf), "matched_titlewords", "ord"))


@query("a3_unify_extend", over_snapshots(
    "SELECT s.posting_id, s.ord, s.company, md5(u.description) AS description_md5, CAST(f AS VARCHAR) AS first_collected_on, "
    "CAST(l AS VARCHAR) AS last_collected_on, coalesce(ws, '') AS matched_titlewords FROM snapshots s JOIN unified u USING (posting_id) LEFT JOIN words w USING (posting_id)",
    f"{_WORDS}, {_UNIFIED}"))
def a3(spark, sf):
    rows = snapshots.unify_extend(snapshot_rows(spark, sf))
    return as_text(rows.select(
        "posting_id", "ord", "company", F.md5("description").alias("description_md5"),
        "first_collected_on", "last_collected_on", "matched_titlewords",
    ))


@query("w2_version_propagation",
       "SELECT event_id, user_id, CAST(min(d) OVER (PARTITION BY user_id) AS VARCHAR) AS first_collected_on, "
       "CAST(max(d) OVER (PARTITION BY user_id) AS VARCHAR) AS last_collected_on FROM (SELECT *, CAST(ts AS DATE) AS d FROM events)")
def w2(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("collected_on"))
    return as_text(snapshots.propagate_dates(events, "user_id").drop("collected_on"))


@query("a4_dedupe_queries", over_postings(
    "SELECT source AS posting_id, arg_min(title, doc_id) AS title, string_agg(DISTINCT lang_label, '|' ORDER BY lang_label) AS words, min(doc_id) AS seq FROM postings GROUP BY source"))
def a4(spark, sf):
    """Searches by language that find sources: few keys with very many hits each."""
    hits = postings(spark, sf).select(
        F.col("source").alias("posting_id"), "title", F.col("doc_id").alias("seq"), F.col("lang_label").alias("asked")
    )
    unique = snapshots.dedupe_queries(hits, "seq", "asked")
    return unique.select(
        "posting_id", "title", F.array_join(F.array_sort("matched_titlewords"), "|").alias("words"), "seq"
    )


@query("a5_timespan",
       "SELECT user_id, CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS INT) AS timespan_days FROM events GROUP BY user_id")
def a5(spark, sf):
    bounds = table(spark, sf, "events").groupBy("user_id").agg(
        F.min(F.to_date("ts")).alias("first_collected_on"), F.max(F.to_date("ts")).alias("last_collected_on")
    )
    return snapshots.with_timespan(bounds).select("user_id", "timespan_days")


# --- set operations ----------------------------------------------------------------------


@query("u1_key_difference", over_snapshots("SELECT posting_id FROM newest EXCEPT SELECT posting_id FROM previous"))
def u1(spark, sf):
    return snapshots.key_difference(*snapshot_pair(spark, sf))


@query("u2_key_intersection", over_snapshots("SELECT posting_id FROM newest INTERSECT SELECT posting_id FROM previous"))
def u2(spark, sf):
    return snapshots.key_intersection(*snapshot_pair(spark, sf))


@query("u4_column_union", over_snapshots(
    "SELECT posting_id, title, CAST(NULL AS VARCHAR) AS company, points FROM newest UNION ALL SELECT posting_id, NULL, company, points FROM previous"))
def u4(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    return snapshots.union_columns(
        newest.select("posting_id", "title", "points"), previous.select("posting_id", "company", "points")
    )


@query("u5_snapshot_union", over_snapshots(
    "SELECT posting_id, count(*) AS versions, string_agg('snapshot_' || CAST(ord AS VARCHAR), '|' ORDER BY ord) AS files FROM snapshots GROUP BY posting_id"))
def u5(spark, sf):
    """All versions of all postings over several files, each with the file it came from."""
    root = scratch_dir(spark, "snapshots")
    paths = [_snapshot_file(spark, sf, root, i) for i in (1, 2, 3)]
    rows = store.read_snapshots(spark, paths, glob="*.txt").withColumn("file", _folder())
    return rows.groupBy("posting_id").agg(
        F.count("*").alias("versions"), F.array_join(F.array_sort(F.collect_set("file")), "|").alias("files")
    )


# --- sorts -------------------------------------------------------------------------------


@query("o1_sort_by_key", over_postings("SELECT posting_id, salary, points FROM postings ORDER BY points DESC, posting_id"))
def o1(spark, sf):
    return reports.sort_by_key(postings(spark, sf).select("posting_id", "salary", "points"))


@query("o2_sort_results", over_snapshots("SELECT posting_id, points FROM newest ORDER BY points DESC, posting_id"))
def o2(spark, sf):
    newest, _ = snapshot_pair(spark, sf)
    return reports.sort_by_key(newest.select("posting_id", "points"))


@query("o1_top_by_points", over_postings("SELECT posting_id, points FROM postings ORDER BY points DESC, posting_id LIMIT 20"))
def o1_top(spark, sf):
    return reports.top_n(postings(spark, sf).select("posting_id", "points"), 20)


# --- the universal store -----------------------------------------------------------------


@query("g3_universal_store", over_snapshots(
    "SELECT table_name, postings FROM (SELECT 'newly_added' AS table_name, count(*) AS postings FROM snapshots WHERE ord = 3 AND posting_id NOT IN (SELECT posting_id FROM snapshots WHERE ord < 3) "
    "UNION ALL SELECT 'current', count(*) FROM snapshots WHERE ord = 3 UNION ALL SELECT 'history', count(DISTINCT posting_id) FROM snapshots)"))
def g3(spark, sf):
    """Three runs into a versioned store, then the sizes of its tables."""
    root = scratch_dir(spark, "universal")
    rows = snapshot_rows(spark, sf)
    for i in (1, 2, 3):
        jobs.store_run(rows.where(f"ord = {i}"), root, settled=True)
    sizes = [
        store.read_store(spark, f"{root}/{name}").agg(F.count("*").alias("postings")).select(F.lit(name).alias("table_name"), "postings")
        for name in ("newly_added", "current", "history")
    ]
    return snapshots.union_columns(*sizes)


@query("g3_stored_history", over_snapshots(
    "SELECT u.posting_id, company, CAST(points AS DECIMAL(12,2)) AS points, md5(description) AS description_md5, "
    "CAST(f AS VARCHAR) AS first_collected_on, CAST(l AS VARCHAR) AS last_collected_on, coalesce(ws, '') AS matched_titlewords "
    "FROM unified u LEFT JOIN words USING (posting_id)", f"{_WORDS}, {_UNIFIED}"))
def g3_history(spark, sf):
    """History built run by run equals one merge of all snapshots."""
    root = scratch_dir(spark, "universal")
    rows = snapshot_rows(spark, sf)
    for i in (1, 2, 3):
        jobs.store_run(rows.where(f"ord = {i}"), root, settled=True)
    history = store.read_store(spark, f"{root}/history")
    return as_text(history.select(
        "posting_id", "company", "points", F.md5("description").alias("description_md5"),
        "first_collected_on", "last_collected_on", "matched_titlewords",
    ))


@query("g2_merge_universal_chunks", over_snapshots(
    "SELECT u.posting_id, title, coalesce(ws, '') AS matched_titlewords FROM unified u LEFT JOIN words USING (posting_id)", f"{_WORDS}, {_UNIFIED}"))
def g2(spark, sf):
    return as_text(jobs.merge_chunks(snapshot_rows(spark, sf)).select("posting_id", "title", "matched_titlewords"))


@query("j7_semi_by_company",
       "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 8)")
def j7_customers(spark, sf):
    few = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n <= 8")
    rows = rows_with_key(
        table(spark, sf, "customer"), few.select(F.col("o_custkey").alias("c_custkey")), "c_custkey"
    )
    return rows.select("c_custkey", "c_name")


@query("a13_distinct_lists", over_postings(
    "SELECT 'title' AS kind, title AS value FROM postings GROUP BY title UNION ALL SELECT 'company', company FROM postings GROUP BY company"))
def a13(spark, sf):
    df = postings(spark, sf)
    parts = [
        coverage.distinct_values(df, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"))
        for c in ("title", "company")
    ]
    return parts[0].unionByName(parts[1])
