"""Registered queries: coverage, reports, profiles, jobs and streams."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import Profile
from postingflow.operators import coverage, enrich, filters, profiles, reports, snapshots, urls
from postingflow.plans import jobs
from postingflow.plans import sqltext as Q
from postingflow.plans.queries_snapshots import RUN_TS, as_text
from postingflow.plans.queries_text import _PAID_CTES, _RANK_CTES, SCORE_SQL, paid_postings
from postingflow.plans.registry import ORACLES, query
from postingflow.plans.views import joined, over_postings, over_snapshots, postings, snapshot_pair, snapshot_rows, table
from postingflow.schema import COMPRESSION
from postingflow.session import scratch_dir
from postingflow.sources.snapshots import read_store, write_store
from postingflow.streaming import streams

AS_OF = dt.date(2024, 2, 15)
BUCKET_SQL = (
    "CASE WHEN DATE '2024-02-15' - {d} < 7 THEN 0 WHEN DATE '2024-02-15' - {d} < 14 THEN 1 WHEN DATE '2024-02-15' - {d} < 28 THEN 2 ELSE 3 END"
)
BUCKET = BUCKET_SQL.format(d="collected_on")


# --- coverage ----------------------------------------------------------------------------


@query("a6_companies_in_city", over_postings(
    f"SELECT company, min(doc_id) AS first_seen FROM postings WHERE {Q.location_match('locations', config.COMPANY_CITY_TERMS)} GROUP BY company"))
def a6(spark, sf):
    return coverage.companies_in_city(postings(spark, sf), "doc_id")


_DIM = f"(SELECT unnest({Q.array(config.MAIN_KEYWORDS)}) AS keyword)"


@query("a7_keyword_counts", over_postings(
    f"SELECT d.keyword, count(k.word) AS postings FROM {_DIM} d LEFT JOIN "
    f"(SELECT unnest({Q.keywords('description', config.MAIN_KEYWORDS)}) AS word FROM postings) k ON k.word = d.keyword GROUP BY d.keyword"))
def a7(spark, sf):
    tagged = enrich.with_keywords(postings(spark, sf), config.MAIN_KEYWORDS)
    return coverage.keyword_counts(tagged).select("keyword", "postings")


@query("a8_rare_companies",
       "SELECT o_custkey AS company, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <= 3")
def a8(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("company"))
    return coverage.rare_companies(rows)


_RARE = (
    "SELECT o_orderkey, o_custkey AS company, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 6)"
)


def _orders_as_postings(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("company"), "o_totalprice")


@query("j7_rare_company_postings", _RARE)
def j7(spark, sf):
    return coverage.rare_company_postings(_orders_as_postings(spark, sf), 6)


@query("o4_rare_company_report", _RARE + " ORDER BY o_totalprice DESC, o_orderkey")
def o4(spark, sf):
    rare = coverage.rare_company_postings(_orders_as_postings(spark, sf), 6)
    return reports.sort_by_key(rare, "o_totalprice", key="o_orderkey")


_WORD_PROFILE = (
    "(SELECT w AS word, count(*) AS postings, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sole_matches FROM "
    "(SELECT unnest(matched_titlewords) AS w, len(matched_titlewords) AS n FROM postings WHERE points > 0) GROUP BY w)"
)


def _positive(spark, sf):
    return filters.positive_only(postings(spark, sf))


@query("a9_mandatory_titlewords", over_postings(f"SELECT word FROM {_WORD_PROFILE} WHERE sole_matches > 0"))
def a9(spark, sf):
    return coverage.mandatory_words(_positive(spark, sf))


@query("a10_sole_match_counts", over_postings(f"SELECT word, sole_matches FROM {_WORD_PROFILE} WHERE sole_matches > 0"))
def a10(spark, sf):
    return coverage.sole_match_counts(_positive(spark, sf))


@query("u3_non_mandatory_words", over_postings(f"SELECT word FROM {_WORD_PROFILE} WHERE sole_matches = 0"))
def u3(spark, sf):
    return coverage.optional_words(_positive(spark, sf))


@query("a11_titleword_removal_impact", over_postings(
    "SELECT count(*) FILTER (WHERE n > 0 AND k = 0) AS lost, count(*) FILTER (WHERE k > 0) AS kept, count(*) FILTER (WHERE n = 0) AS unmatched FROM "
    "(SELECT len(matched_titlewords) AS n, len(list_filter(matched_titlewords, lambda x: x <> 'data engineer' AND x <> 'biotech')) AS k FROM postings)"))
def a11(spark, sf):
    return coverage.removal_impact(postings(spark, sf), ("data engineer", "biotech"))


_MASKS = (
    "ws AS (SELECT list_sort(list_distinct(matched_titlewords)) AS ws, count(*) AS n FROM postings WHERE len(matched_titlewords) > 0 GROUP BY 1), "
    "vocabulary AS (SELECT list_sort(list_distinct(flatten(list(ws)))) AS v FROM ws), "
    "masks AS (SELECT ws, n, CAST(list_sum(list_transform(ws, lambda w: 1 << (list_position(v, w) - 1))) AS BIGINT) AS m FROM ws, vocabulary), "
    "subset AS (SELECT s FROM vocabulary, range(1, 1 << 12) AS r(s) WHERE s < (1 << len(v)) AND NOT EXISTS (SELECT 1 FROM masks WHERE (m & s) = 0) ORDER BY bit_count(s), s LIMIT 1), "
    "kept AS (SELECT list_filter(v, lambda w: ((s >> (list_position(v, w) - 1)) & 1) = 1) AS k FROM vocabulary, subset)"
)


@query("a11_smallest_word_set", over_postings(
    "SELECT CAST(p AS INT) AS pos, k[p + 1] AS word, CAST(coalesce((SELECT sum(n) FROM ws WHERE list_contains(ws, k[p + 1]) AND len(list_intersect(ws, k[1:p])) = 0), 0) AS BIGINT) AS newly_found "
    "FROM (SELECT k, unnest(range(len(k))) AS p FROM kept)", _MASKS))
def a11_smallest(spark, sf):
    """Which words a search needs; all others can go."""
    return coverage.smallest_word_set(postings(spark, sf))


@query("a14_run_counts", over_snapshots(
    "SELECT 'results' AS part, count(*) AS postings FROM newest UNION ALL SELECT 'added', count(*) FROM newest WHERE posting_id NOT IN (SELECT posting_id FROM previous) "
    "UNION ALL SELECT 'removed', count(*) FROM previous WHERE posting_id NOT IN (SELECT posting_id FROM newest)"))
def a14(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    return coverage.run_counts(newest, snapshots.added(newest, previous), snapshots.removed(newest, previous))


@query("a14_counts_on_write", ORACLES["a14_run_counts"])
def a14_on_write(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    parts = {"results": newest, "added": snapshots.added(newest, previous), "removed": snapshots.removed(newest, previous)}
    path = scratch_dir(spark, "counted")
    return coverage.written_counts(parts, lambda name, df: df.write.parquet(f"{path}/{name}"))


# --- reports -----------------------------------------------------------------------------

_LABELS = "[" + ", ".join(Q.quote(b) for b in config.BUCKET_LABELS) + "]"
_W1 = (
    f"w1 AS (SELECT *, {BUCKET} AS bucket FROM postings), "
    f"w2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY points DESC, posting_id) = 1 THEN {_LABELS}[bucket + 1] ELSE '' END AS separator FROM w1)"
)


@query("w1_recency_report", over_postings("SELECT posting_id, bucket, points, separator FROM w2", _W1))
def w1(spark, sf):
    rows = reports.recency_report(postings(spark, sf), AS_OF, "collected_on")
    return reports.in_report_order(rows.select("posting_id", "bucket", "points", "separator"))


_REPORT_URL = "CASE WHEN contains(url, 'www.') THEN split_part(url, 'www.', 2) WHEN contains(url, '://') THEN split_part(url, '://', 2) ELSE url END"


@query("r1_report_table", over_postings(
    "SELECT posting_id, bucket, separator, DATE '2024-02-15' - collected_on < 10 AS is_new, "
    f"{Q.contains_any('lower(company)', config.HIGHLIGHTED_COMPANY_TERMS)} AS is_highlighted_company, "
    f"'https://' || {_REPORT_URL} AS link, title AS \"Title\", company AS \"Company\", '' AS \"Salary?\", array_to_string(locations, ', ') AS \"Locations\", "
    f"'' AS \"Keywords\", {_REPORT_URL} AS \"URL\", '' AS \"HomeOffice\", points AS \"Points\", CAST(collected_on AS VARCHAR) AS \"First date\", description AS \"Description\" FROM w2", _W1))
def r1(spark, sf):
    rows = postings(spark, sf).withColumnRenamed("collected_on", "first_collected_on")
    table_ = reports.report_table(rows, AS_OF, highlight_days=10)
    return table_.withColumn("First date", F.col("First date").cast("string"))


@query("r2_highlight_recent", over_postings(
    "SELECT posting_id, coalesce(DATE '2024-02-15' - collected_on < 10, false) AS is_new FROM postings"))
def r2(spark, sf):
    return reports.highlight_recent(postings(spark, sf), AS_OF, 10, "collected_on").select("posting_id", "is_new")


_NEW = "SELECT posting_id, title, points FROM newest WHERE posting_id NOT IN (SELECT posting_id FROM previous)"


@query("r2_highlight_added", over_snapshots(
    f"SELECT posting_id, posting_id IN (SELECT posting_id FROM ({_NEW})) AS is_new FROM newest"))
def r2_added(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    return reports.highlight_added(newest, snapshots.added(newest, previous)).select("posting_id", "is_new")


@query("r2_highlight_titles", over_snapshots(
    f"SELECT posting_id, title IN (SELECT title FROM ({_NEW}) WHERE points > 9) AS is_new FROM newest"))
def r2_titles(spark, sf):
    """By title: few titles, each with very many postings."""
    newest, previous = snapshot_pair(spark, sf)
    new_rows = snapshots.added(newest, previous).where("points > 9")
    return reports.highlight_added(newest, new_rows, "title").select("posting_id", "is_new")


_COMPANY = "CASE source WHEN 'src1' THEN 'Graph Lab' WHEN 'src2' THEN 'NVIDIA' ELSE company END"


@query("r3_highlight_company", over_postings(
    f"SELECT posting_id, company, {Q.contains_any('lower(company)', config.HIGHLIGHTED_COMPANY_TERMS)} AS is_highlighted_company FROM (SELECT posting_id, {_COMPANY} AS company FROM postings)"))
def r3(spark, sf):
    rows = postings(spark, sf).select("posting_id", F.expr(_COMPANY).alias("company"))
    return reports.highlight_company(rows)


@query("r4_separators", over_postings("SELECT bucket, separator, posting_id FROM w2 WHERE separator <> ''", _W1))
def r4(spark, sf):
    rows = reports.recency_report(postings(spark, sf), AS_OF, "collected_on")
    return rows.where("separator <> ''").select("bucket", "separator", "posting_id")


def _bundle(spark, sf):
    """A daily run on stores that hold two earlier snapshots; its stores are at ``root``."""
    rows = snapshot_rows(spark, sf)
    root = scratch_dir(spark, "daily")
    jobs.store_run(rows.where("ord < 3"), root, settled=True)
    profile = Profile(banned_words=("manager",))
    raw = rows.where("ord = 3").withColumn("salary", F.lit(None).cast("string"))
    return jobs.daily_job(raw, root, profile), root


_RUN = (
    f"src AS (SELECT *, {Q.full_section('description')} AS pay FROM newest), "
    + Q.salary_ctes("src", "pay", "paid")
    + ", hist AS (SELECT posting_id, min(collected_on) AS f, max(collected_on) AS l, "
    "coalesce(arg_min(points, ord) FILTER (WHERE points <> 0), 0) AS old_points FROM snapshots WHERE ord < 3 GROUP BY posting_id), "
    f"run AS (SELECT p.*, {SCORE_SQL} AS score, h.posting_id IS NULL AS fresh, f, coalesce(least(f, collected_on), collected_on) AS first_on FROM paid p LEFT JOIN hist h ON h.posting_id = p.posting_id), "
    f"kept AS (SELECT * FROM run WHERE NOT (contains(lower(title), 'manager') OR {Q.contains_any('title', config.BANNED_CAPITAL_WORDS)})), "
    "res AS (SELECT * FROM kept WHERE score >= 0.01), "
    f"rep AS (SELECT *, {BUCKET_SQL.format(d='first_on')} AS bucket FROM res)"
)


@query("r5_run_bundle", over_snapshots(
    "SELECT 'results' AS part, count(*) AS postings FROM res UNION ALL SELECT 'added', count(*) FROM res WHERE fresh "
    "UNION ALL SELECT 'removed', count(*) FROM hist WHERE old_points >= 0.01 AND posting_id NOT IN (SELECT posting_id FROM kept) "
    "UNION ALL SELECT 'stored', count(*) FROM kept UNION ALL SELECT 'history', count(*) FROM (SELECT posting_id FROM hist UNION SELECT posting_id FROM kept) "
    f"UNION ALL SELECT 'companies', count(DISTINCT company) FROM res WHERE {Q.location_match('locations', config.COMPANY_CITY_TERMS)}", _RUN))
def r5(spark, sf):
    """Sizes of the tables of a daily run, and of the history it stored, low scores included."""
    b, root = _bundle(spark, sf)
    sizes = coverage.run_counts(b.results, b.added, b.removed)
    firms = b.companies.agg(F.count("*").alias("postings")).select(F.lit("companies").alias("part"), "postings")
    kept = [("stored", b.stored), ("history", read_store(spark, f"{root}/history"))]
    for name, df in kept:
        sizes = sizes.unionByName(df.agg(F.count("*").alias("postings")).select(F.lit(name).alias("part"), "postings"))
    return sizes.unionByName(firms)


@query("r5_saved_bundle", over_snapshots(
    "SELECT 'results' AS part, count(*) AS postings FROM res UNION ALL SELECT 'added', count(*) FROM res WHERE fresh "
    "UNION ALL SELECT 'removed', count(*) FROM hist WHERE old_points >= 0.01 AND posting_id NOT IN (SELECT posting_id FROM kept)", _RUN))
def r5_saved(spark, sf):
    """The tables of a daily run written out, counted as they are written."""
    return jobs.save_bundle(_bundle(spark, sf)[0], scratch_dir(spark, "bundle"))


@query("r6_tech_profile", over_snapshots(
    f"SELECT posting_id, bucket, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY score DESC, posting_id) = 1 THEN {_LABELS}[bucket + 1] ELSE '' END AS separator, "
    "DATE '2024-02-15' - first_on < 10 AS is_new, title AS \"Title\", company AS \"Company\", score AS \"Points\", CAST(first_on AS VARCHAR) AS \"First date\" FROM rep", _RUN))
def r6(spark, sf):
    """The report of a daily run."""
    made = jobs.outputs(_bundle(spark, sf)[0], AS_OF, RUN_TS, highlight_days=10)
    return made["report"].withColumn("First date", F.col("First date").cast("string")).select(
        "posting_id", "bucket", "separator", "is_new", "Title", "Company", "Points", "First date"
    )


@query("r7_digest", over_snapshots(
    "SELECT 1 AS section, 'New posting not seen before:' AS heading, title || chr(10) || chr(9) || ' at ' || company AS line FROM newest WHERE posting_id NOT IN (SELECT posting_id FROM previous) "
    f"UNION ALL SELECT 2, 'Currently relevant companies:', company FROM newest WHERE {Q.location_match('locations', config.COMPANY_CITY_TERMS)} GROUP BY company"))
def r7(spark, sf):
    newest, previous = snapshot_pair(spark, sf)
    return reports.digest(
        snapshots.added(newest, previous), coverage.companies_in_city(newest, "posting_id")
    )


# --- profiles ----------------------------------------------------------------------------

TECH = Profile(name="tech", min_points=Decimal("1"), drop_title_keywords=("sap", "leiter"))
SALES = replace(
    TECH, name="sales", rules=(("roles", True, "sales", "2.5"), ("roles", True, "manager", "1.2"), ("roles", False, r"\bHR\b", "0.4")),
    candidate_title_keywords=("sales", "manager", "hr"), candidate_description_keywords=("home office",),
    locations_desired=("berlin",), locations_secondary=(), salary_root=3000, drop_title_keywords=(),
)
PROFILES = [TECH, SALES]


def _route_sql(p: Profile) -> str:
    return (
        f"({Q.contains_any('lower(title)', p.candidate_title_keywords)} OR "
        f"{Q.contains_any('lower(description)', p.candidate_description_keywords)})"
    )


def _profile_points_sql(p: Profile) -> str:
    knee = p.salary_root * p.knee
    peak2 = 2 * (knee - p.salary_root) * p.salary_ratio
    return (
        f"CAST(round({Q.rule_sum('title', p.rules)} + 0.3 * {Q.rule_sum('description', p.rules)} "
        f"+ CASE WHEN coalesce(monthly, 0) = 0 THEN 0 WHEN monthly > {knee} THEN {peak2} - (monthly - {p.salary_root}) * 0.0015 ELSE (monthly - {p.salary_root}) * 0.0015 END "
        f"+ {Q.penalty('locations', p.locations_desired, p.locations_secondary or ('nowhere at all',))}, 2) AS DECIMAL(12,2))"
    )


_PAID = _PAID_CTES
_ROUTED = ", ".join(
    f"r_{p.name} AS (SELECT '{p.name}' AS profile, *, {_profile_points_sql(p)} AS score FROM paid WHERE {_route_sql(p)})" for p in PROFILES
) + ", routed AS (SELECT * FROM r_tech UNION ALL SELECT * FROM r_sales)"
_SELECTED = (
    "selected AS (SELECT * FROM routed WHERE score >= 1 AND collected_on >= DATE '2024-01-10' AND (profile <> 'tech' OR "
    f"NOT {Q.contains_any('lower(title)', TECH.drop_title_keywords)}))"
)


@query("g1_build_universal_inputs", over_postings(
    "SELECT word, string_agg(DISTINCT profile, '|' ORDER BY profile) AS profiles FROM (SELECT unnest(matched_titlewords) AS word, lang_label AS profile FROM postings) GROUP BY word"))
def g1(spark, sf):
    words = postings(spark, sf).select(F.explode("matched_titlewords").alias("word"), F.col("lang_label").alias("profile"))
    return as_text(jobs.universal_inputs(words))


@query("g0_load_profile_state", over_postings("SELECT 'tech' AS profile, count(*) AS candidates FROM r_tech", _PAID + ", " + _ROUTED))
def g0(spark, sf):
    path = scratch_dir(spark, "profile")
    empty = read_store(spark, path)
    routed = profiles.candidates(postings(spark, sf), [TECH]).select("profile", "posting_id")
    write_store(routed, path)
    loaded = read_store(spark, path).join(empty.select("posting_id"), "posting_id", "left_anti")
    return loaded.groupBy("profile").agg(F.count("*").alias("candidates"))


@query("g4_candidate_filter", over_postings("SELECT profile, posting_id FROM routed", _PAID + ", " + _ROUTED))
def g4(spark, sf):
    return profiles.candidates(postings(spark, sf), PROFILES).select("profile", "posting_id")


def _scored(spark, sf):
    return profiles.score_candidates(profiles.candidates(paid_postings(spark, sf), PROFILES), PROFILES)


@query("g6_profile_scoring", over_postings(
    f"SELECT posting_id, 'tech' AS profile, {_profile_points_sql(TECH)} AS points FROM paid UNION ALL SELECT posting_id, 'sales', {_profile_points_sql(SALES)} FROM paid", _PAID))
def g6(spark, sf):
    return profiles.score_all(paid_postings(spark, sf), PROFILES).select("posting_id", "profile", "points")


@query("g6_candidate_scoring", over_postings("SELECT profile, posting_id, score AS points FROM routed", _PAID + ", " + _ROUTED))
def g6_candidates(spark, sf):
    return _scored(spark, sf).select("profile", "posting_id", "points")


@query("g7_selection_filter", over_postings("SELECT profile, posting_id, score AS points FROM selected", f"{_PAID}, {_ROUTED}, {_SELECTED}"))
def g7(spark, sf):
    rows = profiles.select_final(_scored(spark, sf), PROFILES, dt.date(2024, 1, 10))
    return rows.select("profile", "posting_id", "points")


@query("g5_profile_history", over_snapshots(
    "SELECT source AS profile, posting_id, coalesce(arg_min(points, ord) FILTER (WHERE points <> 0), 0) AS points, "
    "CAST(min(collected_on) AS VARCHAR) AS first_collected_on, CAST(max(collected_on) AS VARCHAR) AS last_collected_on FROM snapshots GROUP BY source, posting_id"))
def g5(spark, sf):
    rows = snapshot_rows(spark, sf).withColumnRenamed("source", "profile")
    history = snapshots.unify(rows.where("ord = 1"), key=profiles.PROFILE_KEY).withColumn("ord", F.lit(0).cast("bigint"))
    merged = profiles.merge_history(history, rows.where("ord > 1"))
    return as_text(merged.select("profile", "posting_id", "points", "first_collected_on", "last_collected_on"))


@query("g5_score_history", over_postings("SELECT profile, posting_id, '2024-02-15' AS scored_on, score AS points FROM routed", _PAID + ", " + _ROUTED))
def g5_scores(spark, sf):
    return as_text(profiles.score_history(_scored(spark, sf), AS_OF))


@query("g8_compare_selected", over_postings(
    "SELECT 'added' AS change, profile, posting_id FROM selected s WHERE NOT EXISTS (SELECT 1 FROM routed r WHERE r.profile = s.profile AND r.posting_id = s.posting_id AND r.lang_label = 'en') "
    "UNION ALL SELECT 'removed', profile, posting_id FROM routed r WHERE lang_label = 'en' AND NOT EXISTS (SELECT 1 FROM selected s WHERE r.profile = s.profile AND r.posting_id = s.posting_id)",
    f"{_PAID}, {_ROUTED}, {_SELECTED}"))
def g8(spark, sf):
    root = scratch_dir(spark, "profiles")
    write_store(_scored(spark, sf), root)
    scored = read_store(spark, root)
    selected = profiles.select_final(scored, PROFILES, dt.date(2024, 1, 10))
    fresh, gone = profiles.compare_selected(selected, scored.where("lang_label = 'en'"))
    parts = [d.select(F.lit(n).alias("change"), "profile", "posting_id") for n, d in (("added", fresh), ("removed", gone))]
    return parts[0].unionByName(parts[1])


@query("g9_derive_profile_postings", over_postings("SELECT profile, count(*) AS postings, sum(score) AS points FROM selected GROUP BY profile", f"{_PAID}, {_ROUTED}, {_SELECTED}"))
def g9(spark, sf):
    made = jobs.derive_profiles(
        paid_postings(spark, sf), PROFILES, scratch_dir(spark, "profiles"), dt.date(2024, 1, 10)
    )
    return made["selected"].groupBy("profile").agg(F.count("*").alias("postings"), F.sum("points").alias("points"))


@query("g10_profile_outputs", over_postings(
    "SELECT profile || '/' || posting_id AS posting_id, title || ' - at - ' || company AS line FROM selected", f"{_PAID}, {_ROUTED}, {_SELECTED}"))
def g10(spark, sf):
    made = jobs.derive_profiles(
        paid_postings(spark, sf), PROFILES, scratch_dir(spark, "profiles"), dt.date(2024, 1, 10)
    )
    return jobs.profile_outputs(made["selected"], AS_OF, RUN_TS)["log"].select("posting_id", "line")


@query("v1_run_stages", over_postings(
    "SELECT posting_id, score AS points FROM ranked WHERE NOT contains(lower(title), 'manager') AND score > 0", _RANK_CTES))
def v1(spark, sf):
    stages = (
        enrich.with_salary,
        lambda d: filters.ban_title_words(d, ("manager",), ()),
        lambda d: enrich.rank_for(d, Profile()),
        filters.positive_only,
    )
    return jobs.run_stages(postings(spark, sf), stages).select("posting_id", "points")


@query("j8_cross_inputs", over_postings(
    f"SELECT DISTINCT word, location FROM (SELECT unnest(matched_titlewords) AS word FROM postings), (SELECT unnest({Q.array(config.LOCATIONS_DESIRED)}) AS location)"))
def j8(spark, sf):
    words = postings(spark, sf).select(F.explode("matched_titlewords").alias("word")).distinct()
    return urls.pairs(words, "word", config.LOCATIONS_DESIRED)


# --- streams -----------------------------------------------------------------------------


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    events = streams.stream_parquet(spark, sf, schema, glob="events.parquet")
    return events.withColumn("ts", streams.utc_time(F.col("ts")))


@query("z1_incremental_ingest", over_snapshots(
    "SELECT posting_id, CAST(min(collected_on) AS VARCHAR) AS first_collected_on, CAST(max(collected_on) AS VARCHAR) AS last_collected_on FROM snapshots GROUP BY posting_id"))
def z1(spark, sf):
    """Snapshots arriving one file set at a time, merged into history batch by batch."""
    root = scratch_dir(spark, "ingest")
    rows = snapshot_rows(spark, sf)
    dates = {c: F.lit(None).cast("date") for c in ("first_collected_on", "last_collected_on")}
    incoming = rows.withColumns(dates)
    for i in (1, 2, 3):
        # The stream goes on where it stopped, with the files that came since.
        incoming.where(f"ord = {i}").write.mode("append").option("compression", COMPRESSION).parquet(f"{root}/in")
        stream = streams.stream_parquet(spark, f"{root}/in", incoming.schema)
        streams.run_available(
            stream, f"{root}/checkpoint", each=streams.ingest_snapshots(f"{root}/history", f"{root}/added", settled=True), mode="update"
        )
    history = read_store(spark, f"{root}/history")
    return as_text(history.select("posting_id", "first_collected_on", "last_collected_on"))


@query("z2_first_last_seen",
       "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id")
def z2(spark, sf):
    root = scratch_dir(spark, "seen")
    # Microseconds keep the comparison exact and independent of the session time zone.
    events = _events(spark, sf).withColumn("us", F.unix_micros("ts"))
    seen = streams.first_last_seen(events, "user_id", "us")
    streams.run_available(seen, f"{root}/checkpoint", each=streams.upsert_seen(f"{root}/seen", "user_id"), mode="update")
    stored = read_store(spark, f"{root}/seen")
    return stored.select("user_id", F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"))


@query("z2_seen_without_state",
       "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id")
def z2_stateless(spark, sf):
    """Batches merged into the store by touched buckets: no state in the stream."""
    root = scratch_dir(spark, "tracked")
    events = _events(spark, sf).withColumn("us", F.unix_micros("ts"))
    streams.run_available(events, f"{root}/checkpoint", each=streams.track_seen(f"{root}/seen", "user_id", "us"))
    stored = read_store(spark, f"{root}/seen")
    return stored.select("user_id", F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"))


@query("z3_new_posting_stream", "SELECT DISTINCT user_id FROM events")
def z3(spark, sf):
    root = scratch_dir(spark, "new")
    fresh = streams.new_keys(_events(spark, sf), "user_id", "ts", "40 days")
    streams.run_available(fresh, f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("user_id")


@query("z4_daily_counts",
       "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def z4(spark, sf):
    """All days, the last ones with their counts so far."""
    root = scratch_dir(spark, "daily")
    counts = streams.daily_counts(_events(spark, sf), "ts", "1 day")
    streams.run_available(counts, f"{root}/checkpoint", each=streams.upsert_latest(f"{root}/out", "day_start"), mode="update")
    done = read_store(spark, f"{root}/out")
    day = F.date_from_unix_date((F.unix_seconds("day_start") / 86400).cast("int"))
    return done.select(day.cast("string").alias("day"), "n")
