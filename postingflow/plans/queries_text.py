"""Registered queries: salary, language, keywords, scoring, text statistics, phrases."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import Profile
from postingflow.functions import salary as S
from postingflow.functions import gramlang, scoring
from postingflow.functions.text import find_keywords, language
from postingflow.operators import enrich, filters, phrases
from postingflow.plans import sqltext as Q
from postingflow.plans.registry import query
from postingflow.plans.views import joined, over_postings, postings, table
from postingflow.session import spread

# The section patterns an engine without lookahead can also run, in list order.
PLAIN_SECTIONS = tuple(p for p in config.SALARY_SECTION_PATTERNS if "(?!" not in p and not p.startswith(r"\b("))
PROFILE = Profile()
STOPWORDS = tuple(dict.fromkeys(config.ENGLISH_WORDS + config.GERMAN_WORDS))


def _annual_monthly(df, column="salary_guessed"):
    return df.select("posting_id", F.col(f"{column}.annual").alias("annual"), F.col(f"{column}.monthly").alias("monthly"))


# --- salary ------------------------------------------------------------------------------


@query("t1_salary_number", over_postings(
    "SELECT posting_id, coalesce(TRY_CAST(regexp_extract(t, '([0-9]{6})', 1) AS BIGINT), TRY_CAST(regexp_extract(t, '([0-9]{5})', 1) AS BIGINT)) AS number, "
    f"CASE WHEN {Q.contains_any('lower(description)', config.MONTHLY_KEYWORDS)} THEN TRY_CAST(regexp_extract(t, '([0-9]{{4}})', 1) AS BIGINT) END AS monthly_number "
    "FROM (SELECT *, replace(lower(description), '.', '') AS t FROM postings)"))
def t1(spark, sf):
    lowered = postings(spark, sf).select("posting_id", F.lower("description").alias("t"))
    return lowered.select(
        "posting_id", S.salary_number(F.col("t")).alias("number"),
        S.salary_number(F.col("t"), config.MONTHLY_KEYWORDS, lengths=(4,)).alias("monthly_number"),
    )


@query("t2_salary_regex", over_postings(
    "SELECT posting_id, TRY_CAST(trunc(TRY_CAST(replace(coalesce(" + ", ".join(
        f"nullif(regexp_extract(description, '{p}', 0), '')" for p in ("[0-9]{6},[0-9]{2}", "[0-9]{5},[0-9]{2}", "[0-9]{6}", "[0-9]{5}")
    ) + "), ',', '.') AS DECIMAL(20,4))) AS BIGINT) AS number FROM postings"))
def t2(spark, sf):
    return postings(spark, sf).select("posting_id", S.salary_regex(F.col("description")).alias("number"))


@query("t3_salary_from_text", over_postings(
    "SELECT posting_id, annual, monthly FROM paid",
    "src AS (SELECT posting_id, description FROM postings), " + Q.salary_ctes("src", "description", "paid")))
def t3(spark, sf):
    return _annual_monthly(S.with_salary_from_text(postings(spark, sf), F.col("description")))


@query("t3_salary_field", over_postings(
    "SELECT posting_id, annual, monthly FROM paid",
    "src AS (SELECT posting_id, salary FROM postings), " + Q.salary_ctes("src", "salary", "paid")))
def t3_field(spark, sf):
    return _annual_monthly(S.with_salary_from_text(postings(spark, sf), F.col("salary")))


_SECTION_SQL = (
    f"src AS (SELECT posting_id, source, {Q.section('description', PLAIN_SECTIONS)} AS pay FROM postings), "
)


@query("t4_salary_plain_sections", over_postings(
    "SELECT posting_id, annual, monthly FROM paid", _SECTION_SQL + Q.salary_ctes("src", "pay", "paid")))
def t4_plain(spark, sf):
    rows = S.with_salary_from_description(postings(spark, sf), F.col("description"), patterns=PLAIN_SECTIONS)
    return _annual_monthly(rows)


_FULL_SECTION = f"src AS (SELECT posting_id, {Q.full_section('description')} AS pay FROM postings), "


@query("t4_salary_from_description", over_postings(
    "SELECT posting_id, annual, monthly FROM paid", _FULL_SECTION + Q.salary_ctes("src", "pay", "paid")))
def t4(spark, sf):
    """All 13 section patterns; the SQL tries number positions where they need lookahead."""
    return _annual_monthly(S.with_salary_from_description(postings(spark, sf), F.col("description")))


@query("t5_salary_dual_locale", over_postings(
    "SELECT posting_id, coalesce(annual1, annual) AS annual, coalesce(monthly1, monthly) AS monthly FROM comma",
    _FULL_SECTION + Q.salary_ctes("src", "pay", "point", thousands=",", decimal=".")
    + ", first AS (SELECT posting_id, pay, annual AS annual1, monthly AS monthly1 FROM point), "
    + Q.salary_ctes("first", "pay", "comma")))
def t5(spark, sf):
    return _annual_monthly(S.with_salary_dual_locale(postings(spark, sf), F.col("description")))


_FACTORS = {"src1": 14, "src2": 14, "src3": 13}


@query("t6_site_conversion", over_postings(
    "SELECT posting_id, annual, monthly FROM paid",
    "src AS (SELECT posting_id, salary, CASE source WHEN 'src1' THEN 14 WHEN 'src2' THEN 14 WHEN 'src3' THEN 13 ELSE 12 END AS factor FROM postings), "
    + Q.salary_ctes("src", "salary", "paid", factor="factor")))
def t6(spark, sf):
    factor = S.site_factor(F.col("source"), _FACTORS)
    return _annual_monthly(S.with_salary_from_text(postings(spark, sf), F.col("salary"), factor=factor))


# --- language and keywords ---------------------------------------------------------------


@query("t7_language", over_postings(f"SELECT posting_id, {Q.language('description')} AS language FROM postings"))
def t7(spark, sf):
    return enrich.with_language(postings(spark, sf)).select("posting_id", "language")


@query("t7_language_of_pages",
       f"SELECT page_id, {Q.language('html')} AS language FROM pages")
def t7_pages(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", language(F.col("html")).alias("language"))


_KEYWORDS = ("graph theory", "Python", "data mining", "ETL", "python", "sql")


@query("t8_find_keywords", over_postings(
    f"SELECT posting_id, array_to_string(list_filter({Q.array(_KEYWORDS)}, lambda k: contains(description, k)), '|') AS exact, "
    f"array_to_string(list_filter({Q.array([k.lower() for k in _KEYWORDS])}, lambda k: contains(lower(description), k)), '|') AS loose FROM postings"))
def t8(spark, sf):
    text = F.col("description")
    return postings(spark, sf).select(
        "posting_id",
        F.array_join(find_keywords(text, _KEYWORDS, case_sensitive=True), "|").alias("exact"),
        F.array_join(find_keywords(text, _KEYWORDS), "|").alias("loose"),
    )


@query("t9_tag_keywords", over_postings(
    f"SELECT posting_id, array_to_string({Q.keywords('description', config.STARTER_KEYWORDS)}, '|') AS keywords FROM postings"))
def t9(spark, sf):
    tagged = enrich.with_keywords(postings(spark, sf), config.STARTER_KEYWORDS)
    return tagged.select("posting_id", F.array_join("keywords", "|").alias("keywords"))


@query("t9_keep_existing_keywords", over_postings(
    f"SELECT posting_id, array_to_string(CASE WHEN len(matched_titlewords) > 0 THEN matched_titlewords ELSE {Q.keywords('description', config.STARTER_KEYWORDS)} END, '|') AS keywords FROM postings"))
def t9_keep(spark, sf):
    rows = postings(spark, sf).withColumn("keywords", F.col("matched_titlewords"))
    tagged = enrich.with_keywords(rows, config.STARTER_KEYWORDS, overwrite=False)
    return tagged.select("posting_id", F.array_join("keywords", "|").alias("keywords"))


# --- scoring -----------------------------------------------------------------------------


@query("t10_score_text", over_postings(
    f"SELECT posting_id, CAST({Q.rule_sum('title', config.STARTER_RULES)} AS DECIMAL(15,3)) AS title_score, "
    f"CAST({Q.rule_sum('description', config.STARTER_RULES)} AS DECIMAL(15,3)) AS description_score FROM postings"))
def t10(spark, sf):
    return postings(spark, sf).select(
        "posting_id", scoring.score(F.col("title"), config.STARTER_RULES).alias("title_score"),
        scoring.score(F.col("description"), config.STARTER_RULES).alias("description_score"),
    )


@query("t11_salary_points",
       "SELECT o_orderkey, CAST(CASE WHEN s > 5740 THEN 4.92 - (s - 4100) * 0.0015 ELSE (s - 4100) * 0.0015 END AS DECIMAL(20,4)) AS points, "
       "CAST((s - 5000) * 0.0015 AS DECIMAL(20,4)) AS straight FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 12) AS BIGINT) AS s FROM orders)")
def t11(spark, sf):
    pay = table(spark, sf, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 12).cast("bigint").alias("s")
    )
    return pay.select(
        "o_orderkey",
        S.salary_points(F.col("s"), config.SALARY_BEARABLE, knee=config.KNEE_RANKING).cast("decimal(20,4)").alias("points"),
        S.salary_points(F.col("s"), dropoff=False).cast("decimal(20,4)").alias("straight"),
    )


SCORE_SQL = (
    f"CAST(round({Q.rule_sum('title', config.STARTER_RULES)} + 0.3 * {Q.rule_sum('description', config.STARTER_RULES)} "
    "+ CASE WHEN coalesce(monthly, 0) = 0 THEN 0 WHEN monthly > 5740 THEN 4.92 - (monthly - 4100) * 0.0015 ELSE (monthly - 4100) * 0.0015 END "
    f"+ {Q.penalty('locations', config.LOCATIONS_DESIRED, config.LOCATIONS_SECONDARY)}, 2) AS DECIMAL(12,2))"
)
_PAID_CTES = (
    f"src AS (SELECT *, coalesce(salary, {Q.full_section('description')}) AS pay FROM postings), "
    + Q.salary_ctes("src", "pay", "paid")
)
_RANK_CTES = _PAID_CTES + f", ranked AS (SELECT *, {SCORE_SQL} AS score FROM paid)"


def paid_postings(spark, sf):
    return enrich.with_salary(postings(spark, sf))


@query("t12_rank", over_postings("SELECT posting_id, monthly AS salary_monthly_guessed, score AS points FROM ranked", _RANK_CTES))
def t12(spark, sf):
    ranked = enrich.rank_for(paid_postings(spark, sf), PROFILE)
    return ranked.select("posting_id", "salary_monthly_guessed", "points")


@query("t12_rank_keep_points", over_postings(
    "SELECT posting_id, CASE WHEN points > 3 THEN points ELSE score END AS points FROM ranked", _RANK_CTES))
def t12_keep(spark, sf):
    rows = paid_postings(spark, sf).withColumn("points", F.when(F.col("points") > 3, F.col("points")))
    return enrich.rank_for(rows, PROFILE, overwrite=False).select("posting_id", "points")


@query("t13_location_penalty", over_postings(
    f"SELECT posting_id, {Q.penalty('locations', ('wien', 'vienna', 'remote'), ('linz', 'graz'))} AS penalty, "
    f"{Q.penalty('locations', ('nowhere',), ('linz',))} AS strict FROM postings"))
def t13(spark, sf):
    at = F.col("locations")
    return postings(spark, sf).select(
        "posting_id", enrich.location_penalty(at, ("wien", "vienna", "remote"), ("linz", "graz")).alias("penalty"),
        enrich.location_penalty(at, ("nowhere",), ("linz",)).alias("strict"),
    )


_BONUS = ((("python", "sql"), Decimal("0.5")), (("manager",), Decimal("-0.25")))


@query("t14_missing_keyword_bonus", over_postings(
    "SELECT posting_id, CAST(coalesce(points, 0) + CASE WHEN contains(x, 'python') OR contains(x, 'sql') THEN 0 ELSE 0.5 END "
    "+ CASE WHEN contains(x, 'manager') THEN 0 ELSE -0.25 END AS DECIMAL(12,2)) AS points "
    "FROM (SELECT *, lower(title) || chr(10) || lower(description) AS x FROM postings)"))
def t14(spark, sf):
    return enrich.missing_keyword_bonus(postings(spark, sf), _BONUS).select("posting_id", "points")


def _tags_sql(column):
    cases = []
    for cat in scoring.RuleSet.of(config.STARTER_TAXONOMY).categories():
        tests = [Q.rule_test(column, ic, p) for c, ic, p in config.STARTER_TAXONOMY if c == cat]
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN '{cat}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


@query("t15_taxonomy_tags", over_postings(
    f"SELECT posting_id, array_to_string({_tags_sql('description')}, '|') AS tags FROM postings"))
def t15(spark, sf):
    tags = scoring.tag_categories(F.col("description"), config.STARTER_TAXONOMY)
    return postings(spark, sf).select("posting_id", F.array_join(tags, "|").alias("tags"))


@query("t15_taxonomy_counts", over_postings(
    f"SELECT category, count(*) AS postings FROM (SELECT unnest({_tags_sql('description')}) AS category FROM postings) GROUP BY category"))
def t15_counts(spark, sf):
    tags = scoring.tag_categories(F.col("description"), config.STARTER_TAXONOMY)
    tagged = postings(spark, sf).select(F.explode(tags).alias("category"))
    return tagged.groupBy("category").agg(F.count("*").alias("postings"))


_FIRMS = "CASE source WHEN 'src0' THEN 'Google Research' WHEN 'src1' THEN 'ÖBB AG' WHEN 'src2' THEN 'Meta Science Lab' WHEN 'src3' THEN 'AIT' ELSE company END"


@query("t16_title_company_score", over_postings(
    f"SELECT posting_id, CAST({Q.rule_sum('title', config.TITLE_SCORING)} AS DECIMAL(15,3)) AS title_points, "
    f"CAST({Q.rule_sum('firm', config.COMPANY_SCORING)} AS DECIMAL(15,3)) AS company_points, "
    "CASE WHEN " + " OR ".join(f"regexp_matches(firm, {Q.quote(Q.edges(p))}, 'i')" for p in config.DEDUCT_COMPANIES)
    + f" THEN -1 ELSE 0 END AS deduction FROM (SELECT *, {_FIRMS} AS firm FROM postings)"))
def t16(spark, sf):
    rows = postings(spark, sf).withColumn("firm", F.expr(_FIRMS))
    return rows.select(
        "posting_id", scoring.score(F.col("title"), config.TITLE_SCORING).alias("title_points"),
        scoring.score(F.col("firm"), config.COMPANY_SCORING).alias("company_points"),
        scoring.deduction(F.col("firm"), config.DEDUCT_COMPANIES, Decimal(-1)).cast("int").alias("deduction"),
    )


@query("t17_enrich_salary", over_postings(
    "SELECT posting_id, annual, monthly, CASE WHEN points > 0 THEN 1234 ELSE monthly END AS kept_monthly FROM paid",
    _PAID_CTES))
def t17(spark, sf):
    rows = postings(spark, sf).withColumn(
        "salary_monthly_guessed", F.when(F.col("points") > 0, F.lit(1234).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    )
    kept = enrich.with_salary(rows, overwrite=False)
    return kept.select(
        "posting_id", F.col("salary_guessed.annual").alias("annual"),
        F.col("salary_guessed.monthly").alias("monthly"), F.col("salary_monthly_guessed").alias("kept_monthly"),
    )


@query("t17_enrich", over_postings(
    f"SELECT posting_id, monthly AS salary_monthly_guessed, {Q.language('description')} AS language, score AS points, "
    "CAST(CASE WHEN length(title) % 2 = 0 THEN collected_on ELSE DATE '2024-03-01' END AS VARCHAR) AS collected_on "
    f"FROM ranked WHERE NOT (contains(lower(title), 'manager') OR {Q.contains_any('title', config.BANNED_CAPITAL_WORDS)})", _RANK_CTES))
def t17_enrich(spark, sf):
    """Salary and scores derived again, missing dates filled."""
    rows = postings(spark, sf).withColumn("collected_on", F.expr("CASE WHEN length(title) % 2 = 0 THEN collected_on END"))
    rows = rows.drop("points")
    done = enrich.enrich(rows, Profile(banned_words=("manager",)), fallback_date=F.lit("2024-03-01").cast("date"))
    return done.select("posting_id", "salary_monthly_guessed", "language", "points", F.col("collected_on").cast("string").alias("collected_on"))


@query("t18_process", over_postings(
    f"SELECT posting_id, {Q.language('description')} AS language, score AS points, "
    f"{joined(Q.keywords('description', config.STARTER_KEYWORDS))} AS keywords FROM ranked "
    f"WHERE NOT ({Q.contains_any('lower(title)', config.BANNED_WORDS)} OR {Q.contains_any('title', config.BANNED_CAPITAL_WORDS)}) AND score >= 0.01",
    _RANK_CTES))
def t18(spark, sf):
    done = enrich.process(
        paid_postings(spark, sf), PROFILE, transformations=((filters.min_points, {}),)
    )
    return done.select("posting_id", "language", "points", F.array_join("keywords", "|").alias("keywords"))


# --- statistics and phrases --------------------------------------------------------------


@query("t19_word_char_stats", over_postings(
    "SELECT count(*) AS postings, count(*) FILTER (WHERE n > 0) AS with_text, CAST(sum(n) AS BIGINT) AS chars, "
    "avg(n) FILTER (WHERE n > 0) AS avg_chars, CAST(sum(w) AS BIGINT) AS words, avg(w) AS avg_words FROM "
    r"(SELECT length(description) AS n, len(list_filter(string_split_regex(description, '\s+'), lambda x: x <> '')) AS w FROM postings)"))
def t19(spark, sf):
    return phrases.text_stats(postings(spark, sf))


@query("t20_nlp_cost", over_postings(
    "SELECT count(*) AS texts, CAST(sum(3) AS BIGINT) AS probe_units, CAST(sum(u) AS BIGINT) AS phrase_units, "
    "CAST((sum(3) + sum(u)) * 0.0001 AS DECIMAL(20,4)) AS usd FROM (SELECT greatest(3, CAST(ceil(length(description) / 100.0) AS INT)) AS u FROM postings)"))
def t20(spark, sf):
    return phrases.nlp_cost(postings(spark, sf))


def _ngram_sql(n):
    if n == 1:
        return "tok"
    parts = " || ' ' || ".join(f"tok[i + {k}]" if k else "tok[i]" for k in range(n))
    return f"list_transform(range(1, greatest(len(tok) - {n - 2}, 1)), lambda i: {parts})"


_TOKENS = f"t AS (SELECT {Q.token_list('description')} AS tok FROM postings)"
_KEYWORD_COUNTS = (
    "SELECT phrase, count(*) AS n FROM (SELECT unnest(list_concat(" + ", ".join(_ngram_sql(n) for n in (1, 2, 3))
    + f")) AS phrase FROM t) WHERE NOT list_contains({Q.array(STOPWORDS)}, phrase) GROUP BY phrase HAVING count(*) > 1"
)
_KEYPHRASE_COUNTS = (
    "SELECT phrase, count(*) AS n FROM (SELECT unnest(list_concat(" + ", ".join(_ngram_sql(n) for n in (2, 3))
    + f")) AS phrase FROM t) WHERE len(list_filter(string_split(phrase, ' '), lambda w: list_contains({Q.array(STOPWORDS)}, w))) = 0 "
    "GROUP BY phrase HAVING count(*) > 1"
)


@query("t21_phrase_mining", over_postings(_KEYWORD_COUNTS, _TOKENS))
def t21(spark, sf):
    return phrases.mine_keywords(postings(spark, sf), STOPWORDS)


@query("t21_keyphrase_mining", over_postings(_KEYPHRASE_COUNTS, _TOKENS))
def t21_keyphrases(spark, sf):
    return phrases.mine_keyphrases(postings(spark, sf), STOPWORDS)


@query("a12_phrase_counts", over_postings(
    f"SELECT * FROM ({_KEYPHRASE_COUNTS}) ORDER BY n DESC, phrase LIMIT 15", _TOKENS))
def a12(spark, sf):
    return phrases.top_phrases(phrases.mine_keyphrases(postings(spark, sf), STOPWORDS), 15)


@query("a12_frequent_phrases", over_postings(
    f"SELECT * FROM ({_KEYPHRASE_COUNTS}) ORDER BY n DESC, phrase LIMIT 15", _TOKENS))
def a12_frequent(spark, sf):
    """The same by hash buckets: no shuffle of every phrase."""
    found = postings(spark, sf).select(phrases.keyphrases(F.col("description"), STOPWORDS).alias("phrases"))
    return phrases.frequent_phrases(found, 15)


def _slots_sql(word: str) -> str:
    code = "unicode(substr(' ' || {w} || ' ', i + {k}, 1))"
    a, b, c = (code.format(w=word, k=k) for k in range(3))
    return f"list_transform(range(1, length({word}) + 1), lambda i: (({a} * {gramlang.BASE} + {b}) * {gramlang.BASE} + {c}) % {gramlang.SLOTS})"


def _language_ctes(phrases_sql: str) -> str:
    """The language of distinct phrases, by trigram counts of all labelled documents."""
    weight = f"CAST(round(ln(({{n}} + 1) / (total + {gramlang.SLOTS}.0)) * 1000) AS BIGINT)"
    return (
        f"lw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({Q.token_list('text')}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY ALL), "
        f"lg AS (SELECT lang, slot, sum(n) AS n FROM (SELECT lang, n, unnest({_slots_sql('word')}) AS slot FROM lw) GROUP BY ALL), "
        "lt AS (SELECT lang, sum(n) AS total FROM lg GROUP BY lang), "
        f"ph AS (SELECT DISTINCT phrase FROM ({phrases_sql})), "
        f"pw AS (SELECT phrase, unnest({Q.token_list('phrase')}) AS word FROM ph), "
        f"ps AS (SELECT phrase, slot, count(*) AS times FROM (SELECT phrase, unnest({_slots_sql('word')}) AS slot FROM pw) GROUP BY ALL), "
        f"pc AS (SELECT phrase, lt.lang, sum(times * -{weight.format(n='coalesce(lg.n, 0)')}) AS cost FROM ps, lt "
        "LEFT JOIN lg ON lg.lang = lt.lang AND lg.slot = ps.slot GROUP BY ALL), "
        "pl AS (SELECT phrase, lang FROM pc QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY cost, lang) = 1)"
    )


def _phrase_model(spark, sf):
    return gramlang.train(spread(table(spark, sf, "documents")))


@query("t7_phrase_language", over_postings(
    "SELECT ph.phrase, lang FROM ph LEFT JOIN pl ON ph.phrase = pl.phrase", f"{_TOKENS}, {_language_ctes(_KEYPHRASE_COUNTS)}"))
def t7_phrases(spark, sf):
    """Short phrases, where the word lists mostly know no word."""
    mined = phrases.mine_keyphrases(postings(spark, sf), STOPWORDS)
    return mined.select("phrase", gramlang.phrase_language(F.col("phrase"), _phrase_model(spark, sf)).alias("lang"))


_SENTENCES = "SELECT unnest(string_split(text, '. ')) AS phrase FROM documents"


@query("f14_known_other_language",
       f"WITH {_language_ctes(_SENTENCES)} SELECT phrase FROM pl WHERE length(phrase) > 2 AND lang <> 'de'")
def f14_known(spark, sf):
    sentences = spread(table(spark, sf, "documents")).select(F.explode(F.split("text", r"\. ")).alias("phrase"))
    return sentences.where(phrases.known_other_language(F.col("phrase"), _phrase_model(spark, sf), "de")).distinct()


@query("o3_top_n", over_postings(
    f"SELECT * FROM ({_KEYWORD_COUNTS}) ORDER BY n DESC, phrase LIMIT 15", _TOKENS))
def o3(spark, sf):
    return phrases.top_phrases(phrases.mine_keywords(postings(spark, sf), STOPWORDS), 15)
