"""Posting tables derived from the given tables, once for Spark and once as SQL text.

The column expressions are portable: the same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.operators.snapshots import latest_per_key
from postingflow.session import spread

POSTING_EXPRESSIONS = (
    ("posting_id", "concat('src', CAST(doc_id AS STRING))"),
    ("title", "CASE doc_id % 8 WHEN 0 THEN 'Data Engineer (AI)' WHEN 1 THEN 'Machine Learning Engineer' "
     "WHEN 2 THEN 'Sales Manager' WHEN 3 THEN 'Graph Data Scientist' WHEN 4 THEN 'SAP Consultant' "
     "WHEN 5 THEN 'Softwareentwickler Python' WHEN 6 THEN 'HR Leiter' ELSE 'Research Analyst' END"),
    ("company", "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('Company ', source) END"),
    ("description", "concat(text, ' ', CASE doc_id % 5 WHEN 0 THEN 'Fluent in German. Python, SQL and machine learning.' "
     "WHEN 1 THEN 'Sehr gute Deutsch Kenntnisse und Graph Theory.' WHEN 2 THEN 'We design ETL pipelines for AI.' "
     "WHEN 3 THEN 'Wir suchen und bieten: Datenbank, data mining' ELSE 'home office' END, ' ', "
     "CASE doc_id % 7 WHEN 0 THEN concat('Gehalt: ', CAST(30000 + (doc_id * 37) % 60000 AS STRING), ' EUR brutto p.a.') "
     "WHEN 1 THEN concat('Salary: ', CAST(2000 + (doc_id * 13) % 6000 AS STRING), ',50 per month') "
     "WHEN 2 THEN '54321,00' WHEN 3 THEN '50000,00 gross' WHEN 4 THEN 'Vergütung: 45.000 jährlich' "
     "WHEN 5 THEN 'ab 3.500,00 monatlich brutto' ELSE 'no pay stated' END)"),
    ("locations_s", "CASE doc_id % 6 WHEN 0 THEN 'Wien 04|Graz' WHEN 1 THEN 'Linz' WHEN 2 THEN 'Berlin' "
     "WHEN 3 THEN '' WHEN 4 THEN 'Berlin|Vienna' ELSE 'Remote' END"),
    ("titlewords_s", "CASE doc_id % 6 WHEN 0 THEN 'data engineer' WHEN 1 THEN 'data engineer|data analyst' "
     "WHEN 2 THEN 'scientist' WHEN 3 THEN '' WHEN 4 THEN 'data analyst|biotech' "
     "ELSE 'biotech|scientist|data analyst' END"),
    ("url", "concat(CASE doc_id % 3 WHEN 0 THEN 'https://www.' WHEN 1 THEN 'http://' ELSE '' END, "
     "source, '.example.org/jobs/', CAST(doc_id AS STRING), '/')"),
    ("source", "source"),
    ("lang_label", "lang"),
    ("collected_on", "DATE '2024-01-01' + CAST(doc_id % 40 AS INT)"),
    ("salary", "CASE doc_id % 9 WHEN 0 THEN concat('EUR ', CAST(2500 + doc_id % 3000 AS STRING), ',00 monatlich') "
     "WHEN 1 THEN '61.500 p.a.' ELSE CAST(NULL AS STRING) END"),
    ("points", "CAST((doc_id * 7) % 13 - 4 AS DECIMAL(12,2))"),
    ("doc_id", "doc_id"),
)
# Three snapshots of the postings: which ones hold a posting depends on its own language
# and label; attributes change from one to the next.
SNAPSHOT_EXPRESSIONS = (
    ("posting_id", "posting_id"),
    ("title", "title"),
    ("company", "CASE WHEN ord = 1 AND lang_label = 'de' THEN '' ELSE company END"),
    ("description", "concat(description, ' v', CAST(ord AS STRING))"),
    ("locations_s", "locations_s"),
    ("titlewords_s", "CASE ord WHEN 2 THEN 'statistician|data analyst' ELSE titlewords_s END"),
    ("url", "url"),
    ("source", "source"),
    ("points", "CAST(CASE WHEN ord = 1 AND lang_label = 'en' THEN 0 ELSE points + ord END AS DECIMAL(12,2))"),
    ("collected_on", "collected_on + CASE ord WHEN 1 THEN 0 WHEN 2 THEN 7 ELSE 21 END"),
    ("ord", "CAST(ord AS BIGINT)"),
)
IN_SNAPSHOT = (
    "(ord = 1 AND lang_label <> 'es') OR (ord = 2 AND coalesce(quality, 1) <> 0) "
    "OR (ord = 3 AND lang_label <> 'fr')"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(column: str) -> F.Column:
    return F.filter(F.split(column, r"\|"), lambda x: x != "")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as postings."""
    documents = spread(table(spark, sf_dir, "documents"))
    rows = documents.selectExpr(*[f"{sql} AS {name}" for name, sql in POSTING_EXPRESSIONS])
    return rows.withColumns(
        {"locations": _split("locations_s"), "matched_titlewords": _split("titlewords_s")}
    ).drop("locations_s", "titlewords_s")


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three snapshots as rows with their fold order ``ord``; one scan."""
    documents = spread(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = documents.selectExpr(*[f"{sql} AS {name}" for name, sql in POSTING_EXPRESSIONS])
    rows = rows.join(labels, "doc_id", "left").withColumn(
        "ord", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
    rows = rows.where(IN_SNAPSHOT).selectExpr(*[f"{sql} AS {name}" for name, sql in SNAPSHOT_EXPRESSIONS])
    return rows.withColumns(
        {"locations": _split("locations_s"), "matched_titlewords": _split("titlewords_s")}
    ).drop("locations_s", "titlewords_s")


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newest snapshot, and the history before it: each posting as last seen."""
    rows = snapshot_rows(spark, sf_dir)
    return rows.where("ord = 3"), latest_per_key(rows.where("ord < 3"), "ord")


def _sql_list(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({column}, '|') END"


POSTINGS_CTE = (
    "p0 AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in POSTING_EXPRESSIONS) + " FROM documents), "
    f"postings AS (SELECT *, {_sql_list('locations_s')} AS locations, "
    f"{_sql_list('titlewords_s')} AS matched_titlewords FROM p0)"
)
SNAPSHOTS_CTE = (
    POSTINGS_CTE + ", s0 AS (SELECT p.*, l.quality, o.ord FROM p0 p LEFT JOIN labels l ON p.doc_id = l.doc_id, "
    "(VALUES (1), (2), (3)) AS o(ord)), "
    "s1 AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in SNAPSHOT_EXPRESSIONS)
    + f" FROM s0 WHERE {IN_SNAPSHOT}), "
    f"snapshots AS (SELECT *, {_sql_list('locations_s')} AS locations, "
    f"{_sql_list('titlewords_s')} AS matched_titlewords FROM s1), "
    "newest AS (SELECT * FROM snapshots WHERE ord = 3), "
    "previous AS (SELECT * FROM snapshots WHERE ord < 3 QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY ord DESC) = 1)"
)


def over_postings(sql: str, ctes: str = "") -> str:
    """SQL over the CTE ``postings`` and further CTEs."""
    return f"WITH {POSTINGS_CTE}{', ' + ctes if ctes else ''} {sql}"


def over_snapshots(sql: str, ctes: str = "") -> str:
    """SQL over the CTEs ``snapshots``, ``newest``, ``previous`` and further CTEs."""
    return f"WITH {SNAPSHOTS_CTE}{', ' + ctes if ctes else ''} {sql}"


def joined(column: str) -> str:
    """A list column as ``|``-joined text, in SQL."""
    return f"coalesce(array_to_string({column}, '|'), '')"
