"""Report tables: recency buckets, highlights, ordering, digest.

Sorting is a distributed range sort with posting_id as tie-break; nothing is numbered over
a whole bucket, because a bucket may hold most of the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingflow import config
from postingflow.functions.columns import contains_any, hyperlink, reduce_url, strip_control
from postingflow.operators.skew import join_per_key
from postingflow.schema import KEY


def sort_by_key(df: DataFrame, column: str = "points", descending: bool = True, default=0, key: str = KEY) -> DataFrame:
    """Sort by a column; NULL counts as the default; ties by key."""
    value = F.coalesce(F.col(column), F.lit(default))
    return df.orderBy(value.desc() if descending else value.asc(), key)


def top_n(df: DataFrame, n: int, column: str = "points", key: str = KEY) -> DataFrame:
    return sort_by_key(df, column, key=key).limit(n)


def recency_bucket(date: Column, as_of: dt.date) -> Column:
    """0: last 7 days, 1: last 14, 2: last 28, 3: older or undated."""
    age = F.date_diff(F.lit(as_of), date)
    bucket = F.lit(3)
    for i in reversed(range(len(config.BUCKET_DAYS))):
        bucket = F.when(age < config.BUCKET_DAYS[i], F.lit(i)).otherwise(bucket)
    return bucket


def recency_report(df: DataFrame, as_of: dt.date, date: str = "first_collected_on", key: str = KEY) -> DataFrame:
    """Bucket rows by age and put the bucket's label on its first row.

    The first row of each bucket comes from aggregates of at most four rows, which are
    joined back by broadcast; call ``in_report_order`` for the sorted report. ``df`` is read
    three times, so it should be a stored table rather than unfinished text work.
    """
    points = F.coalesce(F.col("points").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    rows = df.withColumns({"_bucket": recency_bucket(F.col(date), as_of), "_points": points})
    # Numbers first: the aggregate hashes them, and only rows with the best points go on.
    best = rows.groupBy("_bucket").agg(F.max("_points").alias("_points"))
    heads = rows.select("_bucket", "_points", key).join(F.broadcast(best), ["_bucket", "_points"], "left_semi")
    heads = heads.groupBy("_bucket").agg(F.min(key).alias(key))
    labels = F.array(*[F.lit(label) for label in config.BUCKET_LABELS])
    heads = heads.select("_bucket", key, F.get(labels, F.col("_bucket")).alias("separator"))
    return (
        rows.join(F.broadcast(heads), ["_bucket", key], "left")
        .withColumn("separator", F.coalesce("separator", F.lit("")))
        .withColumnsRenamed({"_bucket": "bucket"})
        .drop("_points")
    )


def in_report_order(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.orderBy("bucket", F.coalesce(F.col("points"), F.lit(0)).desc(), key)


def highlight_recent(df: DataFrame, as_of: dt.date, days: int, date: str = "first_collected_on") -> DataFrame:
    """Flag rows first collected within ``days``; undated rows are not."""
    recent = F.coalesce(F.date_diff(F.lit(as_of), F.col(date)) < days, F.lit(False))
    return df.withColumn("is_new", recent)


def highlight_added(df: DataFrame, new_rows: DataFrame, by: str = KEY) -> DataFrame:
    """Flag rows among the added ones, by key or (lighting up namesakes) by title."""
    marks = new_rows.select(by).where(F.col(by) != "").distinct().withColumn("is_new", F.lit(True))
    return join_per_key(df, marks, by, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def highlight_company(df: DataFrame, terms=config.HIGHLIGHTED_COMPANY_TERMS) -> DataFrame:
    """Flag rows whose company contains one of the terms."""
    hit = contains_any(F.lower("company"), terms)
    return df.withColumn("is_highlighted_company", F.coalesce(hit, F.lit(False)))


def report_table(
    df: DataFrame, as_of: dt.date, highlight_days: int | None = None,
    new_rows: DataFrame | None = None, columns: dict = config.REPORT_COLUMNS, key: str = KEY,
) -> DataFrame:
    """The report: chosen columns in sheet order, headings, buckets, flags, clean text.

    Rows come by bucket, points and key, so a separator stands on the first row of its
    bucket. The sort reads ``df`` once more, so it should be a stored table.
    """
    missing = {c: F.lit("") for c in columns if c not in df.columns and c != "first_collected_on"}
    if "first_collected_on" not in df.columns:
        missing["first_collected_on"] = F.lit(None).cast("date")
    rows = recency_report(df.withColumns(missing), as_of, key=key)
    if highlight_days is not None:
        rows = highlight_recent(rows, as_of, highlight_days)
    elif new_rows is not None:
        rows = highlight_added(rows, new_rows, key)
    else:
        rows = rows.withColumn("is_new", F.lit(False))
    rows = in_report_order(highlight_company(rows), key)
    types = dict(rows.dtypes)
    ordered = sorted(columns, key=lambda c: (len(columns[c][1]), columns[c][1]))

    def cell(name: str) -> Column:
        col = F.col(name)
        if name == "url":
            col = reduce_url(col)
        if types[name] == "array<string>":
            col = F.array_join(col, ", ")
        return strip_control(col) if types[name] in ("string", "array<string>") else col

    return rows.select(
        key, "bucket", "separator", "is_new", "is_highlighted_company",
        hyperlink(reduce_url(F.col("url"))).alias("link"),
        *[cell(c).alias(columns[c][0]) for c in ordered],
    )


def strip_control_chars(df: DataFrame) -> DataFrame:
    """Remove characters a spreadsheet cannot hold from every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip_control(F.col(c)) for c in text})


def posting_line(separator: str = " - at - ") -> Column:
    return F.concat(F.col("title"), F.lit(separator), F.col("company"))


def log_lines(new_rows: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Lines for the newly-added log; rows lacking title or company are skipped."""
    whole = new_rows.where(F.col("title").isNotNull() & F.col("company").isNotNull())
    return whole.select(F.lit(run_ts).alias("run_ts"), KEY, posting_line().alias("line"))


def digest(new_rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Lines of the daily message: new postings by points, then companies as first seen."""
    postings = new_rows.select(
        F.lit(1).alias("section"), F.lit("New posting not seen before:").alias("heading"),
        posting_line("\n\t at ").alias("line"),
        (-F.coalesce("points", F.lit(0))).cast("double").alias("_by"), F.col(KEY).alias("_tie"),
    )
    firms = companies.select(
        F.lit(2).alias("section"), F.lit("Currently relevant companies:").alias("heading"),
        F.col("company").alias("line"),
        F.expr("try_cast(first_seen AS double)").alias("_by"), F.col("first_seen").cast("string").alias("_tie"),
    )
    both = postings.unionByName(firms).where(F.col("line").isNotNull())
    return both.orderBy("section", "_by", "_tie").select("section", "heading", "line")
