"""Registered queries: projections, urls, scalar columns, and row filters."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions import columns as C
from postingflow.operators import coverage, enrich, filters, reports, urls
from postingflow.operators.phrases import is_stopword, keep_keyphrases, keep_keywords, not_language
from postingflow.plans import sqltext as Q
from postingflow.plans.registry import query
from postingflow.plans.views import joined, over_postings, postings, snapshot_rows, over_snapshots, table
from postingflow.session import spread
from postingflow.sources.snapshots import key_coverage, parse_snapshot

AS_OF = dt.date(2024, 2, 15)
PRIMARY = ("wien", "vienna", "berlin")
BASE_URL = "https://www.karriere.at/jobs/"
SEARCH_BASE = "https://jobs.rbinternational.com/search/?q="


# --- projections and urls --------------------------------------------------------------


@query("p1_project_columns", over_postings("SELECT title, company, points, url, source FROM postings"))
def p1(spark, sf):
    return coverage.project(postings(spark, sf), ("source", "url", "title", "points", "company", "nowhere"))


@query("p2_column_union_keys", over_postings(
    "SELECT c AS column_name, n AS present, n > 0 AS in_any, n = total AS in_all FROM ("
    "SELECT count(*) AS total, unnest(['title', 'company', 'salary', 'points']) AS c, "
    "unnest([count(title), count(company), count(salary), count(points)]) AS n FROM postings)"))
def p2(spark, sf):
    return coverage.column_coverage(postings(spark, sf), ("title", "company", "salary", "points"))


_OTHERS = {"lang_label": "lang_label", "team": "CASE WHEN doc_id % 3 = 0 THEN source END", "grade": "CASE WHEN doc_id % 5 < 2 THEN doc_id % 4 END"}


@query("p2_keys_of_rows", over_postings(
    "SELECT c AS column_name, n AS present, n > 0 AS in_any, n = total AS in_all FROM (SELECT count(*) AS total, "
    f"unnest({list(_OTHERS)}) AS c, unnest([{', '.join(f'count({e})' for e in _OTHERS.values())}]) AS n FROM postings) WHERE n > 0"))
def p2_keys(spark, sf):
    """Keys that no schema names, from the snapshot's own rows."""
    rows = postings(spark, sf).withColumns({name: F.expr(sql) for name, sql in _OTHERS.items()})
    value = F.to_json(F.struct("title", "company", "salary", "points", *_OTHERS))
    chunks = rows.select(F.concat(F.lit('{"'), "posting_id", F.lit('": '), value, F.lit("}")).alias("value"))
    return key_coverage(parse_snapshot(chunks, others="others"), "others")


def _hit_sql(word="x"):
    return " OR ".join(f"contains(lower({word}), '{p}')" for p in PRIMARY)


@query("p3_reorder_locations", over_postings(
    f"SELECT posting_id, {joined(f'list_concat(list_filter(locations, lambda x: {_hit_sql()}), list_filter(locations, lambda x: NOT ({_hit_sql()})))')} AS locations FROM postings"))
def p3(spark, sf):
    return postings(spark, sf).select(
        "posting_id", F.array_join(C.reorder_locations(F.col("locations"), PRIMARY), "|").alias("locations")
    )


_URLS_SQL = "SELECT page_id AS id, url FROM pages UNION ALL SELECT doc_id, url FROM postings"


def _all_urls(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return pages.unionByName(postings(spark, sf).select(F.col("doc_id").alias("id"), "url"))


@query("p4_reduce_url", over_postings(
    f"SELECT id, CASE WHEN contains(url, 'www.') THEN split_part(url, 'www.', 2) "
    f"WHEN contains(url, '://') THEN split_part(url, '://', 2) ELSE url END AS short_url FROM ({_URLS_SQL})"))
def p4(spark, sf):
    return _all_urls(spark, sf).select("id", C.reduce_url(F.col("url")).alias("short_url"))


@query("p5_hyperlink", over_postings(
    f"SELECT id, CASE WHEN url LIKE 'https://%' OR url LIKE 'http://%' THEN url ELSE 'https://' || url END AS link FROM ({_URLS_SQL})"))
def p5(spark, sf):
    return _all_urls(spark, sf).select("id", C.hyperlink(F.col("url")).alias("link"))


@query("p6_url_build", over_postings(
    f"SELECT posting_id, '{BASE_URL}' || source || '/' || lang_label AS url FROM postings"))
def p6(spark, sf):
    return postings(spark, sf).select(
        "posting_id", C.url_build(F.lit(BASE_URL), F.col("source"), F.col("lang_label")).alias("url")
    )


_LOCATION_LIST = config.LOCATIONS_DESIRED + config.LOCATIONS_SECONDARY


@query("p7_url_frontier", over_postings(
    "SELECT DISTINCT 'https://www.karriere.at/jobs/' || word || '/' || location AS url FROM "
    f"(SELECT unnest(matched_titlewords) AS word FROM postings), (SELECT unnest({Q.array(_LOCATION_LIST)}) AS location)"))
def p7(spark, sf):
    words = postings(spark, sf).select(F.explode("matched_titlewords").alias("word")).distinct()
    return urls.url_frontier(words, "word", _LOCATION_LIST, BASE_URL)


@query("p7_zipped_urls", over_postings(
    "SELECT DISTINCT 'https://www.karriere.at/jobs/' || matched_titlewords[i] || '/' || locations[i] AS url FROM "
    "(SELECT *, unnest(range(1, least(len(matched_titlewords), len(locations)) + 1)) AS i FROM postings)"))
def p7_zip(spark, sf):
    return urls.zipped_urls(postings(spark, sf), "matched_titlewords", "locations", BASE_URL)


@query("p8_query_from_url", over_postings(
    f"SELECT posting_id, source || ' engineer' AS query FROM postings"))
def p8(spark, sf):
    searched = postings(spark, sf).withColumn(
        "search_url", F.concat(F.lit(SEARCH_BASE), "source", F.lit(" engineer&sortColumn=date&startrow=25"))
    )
    return searched.select("posting_id", C.query_from_url(F.col("search_url"), SEARCH_BASE).alias("query"))


@query("p9_clean_text",
       "SELECT doc_id, md5(translate(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), "
       "chr(10) || chr(9) || chr(13) || chr(160), '    ')) AS clean_md5 FROM documents")
def p9(spark, sf):
    df = spread(table(spark, sf, "documents"))
    return df.select("doc_id", F.md5(C.clean_text(F.col("text"))).alias("clean_md5"))


@query("p10_strip_control",
       "SELECT page_id, md5(replace(replace(chr(7) || url || chr(31) || html, chr(7), ''), chr(31), '')) AS cell_md5 FROM pages")
def p10(spark, sf):
    dirty = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("\x07"), "url", F.lit("\x1f"), "html").alias("cell")
    )
    clean = reports.strip_control_chars(dirty)
    return clean.select("page_id", F.md5("cell").alias("cell_md5"))


@query("p11_truncate_preview",
       "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def p11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.preview(F.col("text"), 100).alias("preview"))


@query("p12_dash_titlewords", over_postings(
    "SELECT posting_id, array_to_string(list_transform(matched_titlewords, lambda x: replace(x, ' ', '-')), '|') AS dashed FROM postings WHERE len(matched_titlewords) > 0"))
def p12(spark, sf):
    words = postings(spark, sf).where(F.size("matched_titlewords") > 0)
    return words.select(
        "posting_id", F.array_join(F.transform("matched_titlewords", C.dash), "|").alias("dashed")
    )


@query("p13_keyword_universe", over_postings(
    "SELECT DISTINCT word FROM (SELECT unnest(matched_titlewords) AS word FROM postings "
    "UNION ALL SELECT lower(x) FROM (SELECT unnest(locations) AS x FROM postings) UNION ALL SELECT source FROM postings)"))
def p13(spark, sf):
    df = postings(spark, sf)
    lists = (
        df.select(F.lit("titlewords").alias("list"), F.explode("matched_titlewords").alias("word"))
        .unionByName(df.select(F.lit("locations").alias("list"), F.explode(F.transform("locations", F.lower)).alias("word")))
        .unionByName(df.select(F.lit("sources").alias("list"), F.col("source").alias("word")))
    )
    return urls.keyword_universe(lists)


_EXTENDED = config.Profile(keywords=config.STARTER_KEYWORDS).extended(keywords=("pay", "graph", "brutto"))


@query("p14_config_extend", over_postings(
    f"SELECT posting_id, {joined(Q.keywords('description', _EXTENDED.keywords))} AS keywords FROM postings"))
def p14(spark, sf):
    tagged = enrich.with_keywords(postings(spark, sf), _EXTENDED.keywords)
    return tagged.select("posting_id", F.array_join("keywords", "|").alias("keywords"))


@query("p15_business_day", "SELECT event_id, CAST(CAST(ts - INTERVAL 8 HOURS AS DATE) AS VARCHAR) AS day FROM events")
def p15(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.business_day(F.col("ts")).cast("string").alias("day")
    )


@query("p16_section_split",
       "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) "
       "SELECT doc_id, s[1] AS role, s[2] AS requirements, CASE WHEN len(s) = 4 THEN s[3] END AS nice_to_have, "
       "md5(CASE WHEN len(s) = 3 THEN s[3] WHEN len(s) = 4 THEN s[4] WHEN len(s) > 4 THEN array_to_string(s[3:], chr(10) || ' ') END) AS benefits_md5 FROM s")
def p16(spark, sf):
    # Paragraphs of a document stand in for the lists of a page.
    sections = spread(table(spark, sf, "documents")).select("doc_id", F.split("text", "\n").alias("sections"))
    return enrich.split_sections(sections).select(
        "doc_id", "role", "requirements", "nice_to_have", F.md5("benefits").alias("benefits_md5")
    )


# --- filters -----------------------------------------------------------------------------

_BANNED = ("manager", "leiter", "legal")


@query("f1_ban_title_words", over_postings(
    f"SELECT posting_id, title FROM postings WHERE NOT ({Q.contains_any('lower(title)', config.BANNED_WORDS)} OR {Q.contains_any('title', config.BANNED_CAPITAL_WORDS)})"))
def f1(spark, sf):
    return filters.ban_title_words(postings(spark, sf)).select("posting_id", "title")


@query("f2_pattern_match_any", over_postings(
    "SELECT posting_id, contains(lower(description), 'graph theory') OR contains(lower(description), 'etl') AS any_literal, "
    "contains(lower(description), 'python') AND contains(lower(description), 'machine learning') AS all_literal, "
    r"regexp_matches(description, 'sehr\s+gut(e)?\s+deutsch', 'i') OR regexp_matches(description, '[0-9]{2}\.[0-9]{3}') OR contains(description, '(ab') AS any_regex, "
    "false AS none FROM postings"))
def f2(spark, sf):
    text = F.col("description")
    return postings(spark, sf).select(
        "posting_id",
        filters.pattern_match(text, ("graph theory", "ETL"), casefold=True).alias("any_literal"),
        filters.pattern_match(text, ("Python", "machine learning"), casefold=True, mode="all").alias("all_literal"),
        # "(ab" is not a valid regex, so it is looked for as it is.
        filters.pattern_match(
            text, (r"sehr\s+gut(e)?\s+deutsch", r"[0-9]{2}\.[0-9]{3}", "(ab"), use_regex=True, ignore_case=True
        ).alias("any_regex"),
        filters.pattern_match(text, (), mode="all").alias("none"),
    )


_LISTS = {
    "title_keywords": ("data", "research"), "title_capital_keywords": ("SAP",),
    "description_keywords": ("data mining", "ETL pipelines"), "description_capital_keywords": ("Graph Theory",),
}
_LISTS_SQL = (
    f"({Q.contains_any('lower(title)', ('data', 'research'))} OR contains(title, 'SAP') OR "
    f"{Q.contains_any('lower(description)', ('data mining', 'etl pipelines'))} OR contains(description, 'Graph Theory'))"
)


@query("f3_select_keywords", over_postings(f"SELECT posting_id, title FROM postings WHERE {_LISTS_SQL}"))
def f3(spark, sf):
    return filters.select_keywords(postings(spark, sf), **_LISTS).select("posting_id", "title")


@query("f4_filter_out_keywords", over_postings(f"SELECT posting_id, title FROM postings WHERE NOT {_LISTS_SQL}"))
def f4(spark, sf):
    return filters.filter_out_keywords(postings(spark, sf), **_LISTS).select("posting_id", "title")


@query("f5_min_points", over_postings("SELECT posting_id, points FROM postings WHERE coalesce(points, 0) >= 0.01"))
def f5(spark, sf):
    return filters.min_points(postings(spark, sf)).select("posting_id", "points")


@query("f6_threshold_points", over_postings(
    "SELECT 'none' AS threshold, count(*) AS n FROM postings UNION ALL SELECT 'two', count(*) FROM postings WHERE points >= 2"))
def f6(spark, sf):
    df = postings(spark, sf)
    parts = [
        filters.threshold_points(df, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("threshold"), "n")
        for name, t in (("none", None), ("two", Decimal(2)))
    ]
    return parts[0].unionByName(parts[1])


@query("f7_min_date", over_postings(
    "SELECT posting_id, CAST(collected_on AS VARCHAR) AS collected_on FROM postings WHERE collected_on >= DATE '2024-01-20'"))
def f7(spark, sf):
    rows = filters.min_date(postings(spark, sf), dt.date(2024, 1, 20), "collected_on")
    return rows.select("posting_id", F.col("collected_on").cast("string").alias("collected_on"))


@query("f8_location_match", over_postings(
    f"SELECT posting_id, {Q.location_match('locations', config.LOCATIONS_DESIRED)} AS desired, false AS nothing_desired FROM postings"))
def f8(spark, sf):
    return postings(spark, sf).select(
        "posting_id", C.location_match(F.col("locations"), config.LOCATIONS_DESIRED).alias("desired"),
        C.location_match(F.col("locations"), ()).alias("nothing_desired"),
    )


@query("f9_rolling_window_filter", over_postings(
    "SELECT posting_id, CAST(collected_on AS VARCHAR) AS collected_on FROM postings WHERE collected_on >= DATE '2024-02-15' - 21"))
def f9(spark, sf):
    rows = filters.rolling_window(postings(spark, sf), AS_OF, 21, "collected_on")
    return rows.select("posting_id", F.col("collected_on").cast("string").alias("collected_on"))


def _profile_sql():
    keep = " OR ".join([
        Q.contains_any("lower(title)", config.SELECT_TITLE_KEYWORDS),
        Q.contains_any("title", config.SELECT_TITLE_CAPITAL_KEYWORDS),
        Q.contains_any("lower(description)", config.SELECT_DESCRIPTION_KEYWORDS),
        Q.contains_any("description", config.SELECT_DESCRIPTION_CAPITAL_KEYWORDS),
    ])
    drop = " OR ".join(
        [Q.contains_any("lower(title)", config.DROP_TITLE_KEYWORDS),
         Q.contains_any("title", config.DROP_TITLE_CAPITAL_KEYWORDS)]
        + [f"regexp_matches(description, {Q.quote(p)}, 'i')" for p in config.DROP_DESCRIPTION_PATTERNS]
    )
    return f"({keep}) AND NOT ({drop}) AND points >= 0.01 AND collected_on >= DATE '2024-01-25'"


@query("f10_profile_filter", over_postings(f"SELECT posting_id, title, points FROM postings WHERE {_profile_sql()}"))
def f10(spark, sf):
    rows = filters.profile_filter(postings(spark, sf), AS_OF - dt.timedelta(days=21), "collected_on")
    return rows.select("posting_id", "title", "points")


@query("f11_positive_only", over_postings("SELECT posting_id, points FROM postings WHERE points > 0"))
def f11(spark, sf):
    return filters.positive_only(postings(spark, sf)).select("posting_id", "points")


@query("f12_nonempty_description",
       "SELECT page_id, length(description) AS n FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS description FROM pages) WHERE length(description) > 0")
def f12(spark, sf):
    titled = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("description")
    )
    return filters.nonempty_description(titled).select("page_id", F.length("description").alias("n"))


_STOP = config.ENGLISH_WORDS + tuple(w for w in config.GERMAN_WORDS if w not in config.ENGLISH_WORDS)


@query("f13_phrase_filters", over_postings(
    f"SELECT phrase, count(*) AS n, NOT list_contains({Q.array(_STOP)}, lower(phrase)) AS is_keyword, "
    f"len(string_split(phrase, ' ')) > 1 AND len(list_intersect(string_split(lower(phrase), ' '), {Q.array(_STOP)})) = 0 AS is_keyphrase "
    "FROM x GROUP BY phrase",
    "x AS (SELECT unnest(list_concat(matched_titlewords, [title, 'the ' || lang_label, 'with ' || title])) AS phrase FROM postings)"))
def f13(spark, sf):
    df = postings(spark, sf)
    extra = F.array(F.col("title"), F.concat(F.lit("the "), "lang_label"), F.concat(F.lit("with "), "title"))
    pooled = df.select(F.explode(F.concat("matched_titlewords", extra)).alias("phrase"))
    counted = pooled.groupBy("phrase").agg(F.count("*").alias("n"))
    one = F.array("phrase")
    return counted.select(
        "phrase", "n",
        (F.size(keep_keywords(one, _STOP)) == 1).alias("is_keyword"),
        (F.size(keep_keyphrases(one, _STOP)) == 1).alias("is_keyphrase"),
    )


@query("f13_drop_stopwords",
       f"WITH w AS (SELECT unnest({Q.token_list('text')}) AS word FROM documents) "
       f"SELECT word, count(*) AS n FROM w WHERE NOT list_contains({Q.array(_STOP)}, word) GROUP BY word HAVING count(*) > 1")
def f13_words(spark, sf):
    from postingflow.functions.text import words

    tokens = spread(table(spark, sf, "documents")).select(F.explode(words(F.col("text"))).alias("word"))
    return tokens.where(~is_stopword(F.col("word"), _STOP)).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


@query("f14_not_language",
       f"SELECT DISTINCT p AS phrase FROM (SELECT unnest(string_split(text, '. ')) AS p FROM documents) "
       f"WHERE length(p) > 2 AND coalesce({Q.language('p')}, '') <> 'de'")
def f14(spark, sf):
    sentences = spread(table(spark, sf, "documents")).select(F.explode(F.split("text", r"\. ")).alias("phrase"))
    return sentences.where(not_language(F.col("phrase"), "de")).distinct()


@query("f15_apply_chain", over_postings(
    "SELECT posting_id, points + 0.5 AS points FROM postings WHERE NOT contains(lower(title), 'sales') AND points >= 0.01 "
    "AND NOT contains(lower(title), 'python') AND NOT contains(lower(description), 'python') "
    "UNION ALL SELECT posting_id, points FROM postings WHERE NOT contains(lower(title), 'sales') AND points >= 0.01 "
    "AND (contains(lower(title), 'python') OR contains(lower(description), 'python'))"))
def f15(spark, sf):
    steps = (
        (filters.filter_out_keywords, {"title_keywords": ("sales",)}),
        (filters.min_points, {}),
        (enrich.missing_keyword_bonus, {"keyword_points": ((("python",), Decimal("0.5")),)}),
    )
    return filters.apply_chain(postings(spark, sf), steps).select("posting_id", "points")
