"""Comparing and merging snapshots of postings.

Merges are aggregates with map-side partials, so many copies of one posting shrink to one
row per task before the shuffle. Where rows meet their key's result again, the join is one
whose hot keys Spark splits (see ``skew``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingflow.functions.columns import preview, timespan_days
from postingflow.operators.filters import threshold_points
from postingflow.operators.skew import cols, join_per_key, rows_with_key, rows_without_key
from postingflow.schema import KEY, falsy_value, truthy


# --- differences -------------------------------------------------------------------------


def added(new: DataFrame, previous: DataFrame, key=KEY) -> DataFrame:
    """Rows of ``new`` whose key is not in ``previous``."""
    return rows_without_key(new, previous, key)


def removed(new: DataFrame, previous: DataFrame, key=KEY) -> DataFrame:
    """Rows of ``previous`` whose key is not in ``new``."""
    return rows_without_key(previous, new, key)


def _keys(df: DataFrame, key) -> DataFrame:
    """Distinct keys, deduplicated within each task before the shuffle."""
    return df.select(*cols(key)).distinct()


def key_difference(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return _keys(left, key).join(_keys(right, key), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return _keys(left, key).join(_keys(right, key), key, "left_semi")


def with_default_points(df: DataFrame) -> DataFrame:
    return df.withColumn("points", F.coalesce(F.col("points"), F.lit(0).cast("decimal(12,2)")))


def compare(
    new: DataFrame, previous: DataFrame, attrs=("title", "company", "points"),
    max_length: int | None = 100, threshold=None, key: str = KEY,
) -> DataFrame:
    """Added and removed rows above a points threshold with previewed attributes."""
    both = union_columns(
        added(new, previous, key).withColumn("change", F.lit("added")),
        removed(new, previous, key).withColumn("change", F.lit("removed")),
    )
    both = threshold_points(with_default_points(both), threshold)
    if attrs == "complete_lists":
        attrs = [c for c in both.columns if c not in ("change", key)]
    text = {f.name for f in both.schema.fields if isinstance(f.dataType, T.StringType)}
    return both.select(
        "change", key,
        *[preview(F.col(a), max_length).alias(a) if a in text else F.col(a) for a in attrs],
    )


def change_counts(new: DataFrame, previous: DataFrame, key: str = KEY) -> DataFrame:
    """How many keys were added and removed; a row for each, zero included."""
    marks = _keys(new, key).select(key, F.lit(1).alias("is_new"), F.lit(0).alias("is_old"))
    marks = marks.unionByName(
        _keys(previous, key).select(key, F.lit(0).alias("is_new"), F.lit(1).alias("is_old"))
    )
    per_key = marks.groupBy(key).agg(F.max("is_new").alias("n"), F.max("is_old").alias("o"))
    totals = per_key.agg(
        F.count_if((F.col("n") == 1) & (F.col("o") == 0)).alias("added"),
        F.count_if((F.col("n") == 0) & (F.col("o") == 1)).alias("removed"),
        F.count_if((F.col("n") == 1) & (F.col("o") == 1)).alias("kept"),
    )
    return totals.select(
        F.expr("stack(3, 'added', added, 'removed', removed, 'kept', kept) AS (change, postings)")
    )


# --- unions and upserts --------------------------------------------------------------------


def union_columns(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_per_key(df: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """One whole row per key: the one with the greatest order."""
    return _pick(df, order, key, F.max_by)


def first_per_key(df: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """One whole row per key: the first one seen."""
    return _pick(df, order, key, F.min_by)


def _pick(df: DataFrame, order: str, key: str, pick) -> DataFrame:
    """An aggregate instead of a window: copies of a key shrink before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = pick(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def site_union(*sites: DataFrame, key: str = KEY) -> DataFrame:
    """All sites' postings; on equal keys the later site wins."""
    numbered = [d.withColumn("_site", F.lit(i)) for i, d in enumerate(sites)]
    return latest_per_key(union_columns(*numbered), "_site", key).drop("_site")


def upsert(postings: DataFrame, candidates: DataFrame, select_ids: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Add candidates (all, or those of ``select_ids``), replacing rows with equal keys."""
    if select_ids is not None:
        candidates = rows_with_key(candidates, select_ids, key)
    kept = rows_without_key(postings, candidates, key)
    return kept.unionByName(candidates, allowMissingColumns=True)


# --- merging to history --------------------------------------------------------------------


def ordered_union(rows: DataFrame, array: str, order: str, key=KEY) -> DataFrame:
    """Per key, the distinct array elements in order of first appearance.

    Elements are deduplicated per key first, so the final list per key holds its distinct
    words and never its occurrences.
    """
    keys = cols(key)
    items = rows.select(*keys, F.col(order).alias("o"), F.posexplode(array).alias("p", "word"))
    first_seen = items.groupBy(*keys, "word").agg(F.min(F.struct("o", "p")).alias("at"))
    listed = first_seen.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("found")
    )
    return listed.select(*keys, F.transform("found", lambda x: x["word"]).alias(array))


def _date_bounds(df: DataFrame) -> tuple[Column, Column]:
    """A record's own first/last date; either falls back to its collection date."""
    has = set(df.columns)
    first = [F.col(c) for c in ("first_collected_on", "collected_on") if c in has]
    last = [F.col(c) for c in ("last_collected_on", "collected_on") if c in has]
    return (
        F.least(*first) if len(first) > 1 else first[0],
        F.greatest(*last) if len(last) > 1 else last[0],
    )


_DATES = ("first_collected_on", "last_collected_on")


def unify(rows: DataFrame, order: str = "ord", key=KEY, titlewords: str = "matched_titlewords") -> DataFrame:
    """Fold snapshots to one row per key.

    Every column takes its first truthy value; the dates widen to min/max; the description
    comes from the record seen last; the title words are united in order.
    """
    first, last = _date_bounds(rows)
    rows = rows.withColumns({"_first": first, "_last": last})
    keys = cols(key)
    special = {*keys, order, titlewords, "description", "_first", "_last", *_DATES}
    aggs = [F.min("_first").alias(_DATES[0]), F.max("_last").alias(_DATES[1])]
    for field in rows.schema.fields:
        if field.name in special:
            continue
        value = F.min_by(field.name, F.when(truthy(field.name, field.dataType), F.col(order)))
        default = falsy_value(field.dataType)
        if default is not None:
            value = F.coalesce(value, F.when(F.count(field.name) > 0, default))
        aggs.append(value.alias(field.name))
    if "description" in rows.columns:
        newest = F.when(truthy("description", T.StringType()), F.struct("_last", -F.col(order)))
        aggs.append(F.max_by("description", newest).alias("description"))
    merged = rows.groupBy(*keys).agg(*aggs)
    if titlewords in rows.columns:
        merged = merged.join(ordered_union(rows, titlewords, order, keys), keys, "left")
        merged = merged.withColumn(
            titlewords, F.coalesce(F.col(titlewords), F.array().cast("array<string>"))
        )
    return merged


def unify_extend(rows: DataFrame, order: str = "ord", key: str = KEY, titlewords: str = "matched_titlewords") -> DataFrame:
    """Keep every version; give all of a key's versions the same dates, title words and
    newest description."""
    first, last = _date_bounds(rows)
    dated = rows.withColumns({"_first": first, "_last": last})
    newest = F.when(truthy("description", T.StringType()), F.struct("_last", -F.col(order)))
    shared = dated.groupBy(key).agg(
        F.min("_first").alias(_DATES[0]),
        F.max("_last").alias(_DATES[1]),
        F.max_by("description", newest).alias("description"),
    )
    shared = shared.join(ordered_union(rows, titlewords, order, key), key, "left")
    own = rows.drop("description", titlewords, *_DATES)
    return join_per_key(own, shared, key).withColumn(
        titlewords, F.coalesce(F.col(titlewords), F.array().cast("array<string>"))
    )


def propagate_dates(rows: DataFrame, key: str = KEY, date: str = "collected_on") -> DataFrame:
    """Give every version the first and last date of its key."""
    bounds = rows.groupBy(key).agg(F.min(date).alias(_DATES[0]), F.max(date).alias(_DATES[1]))
    return join_per_key(rows.drop(*_DATES), bounds, key)


def dedupe_queries(hits: DataFrame, order: str, word: str, key: str = KEY, out: str = "matched_titlewords") -> DataFrame:
    """One row per posting over many searches; keeps the words that found it, in order."""
    payload = first_per_key(hits.drop(word), order, key)
    asked = hits.where(F.col(word) != "").select(key, order, F.array(word).alias(out))
    return payload.join(ordered_union(asked, out, order, key), key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<string>"))
    )


def with_timespan(df: DataFrame) -> DataFrame:
    return df.withColumn("timespan_days", timespan_days(F.col(_DATES[0]), F.col(_DATES[1])))


def history_backfill(current: DataFrame, history: DataFrame, key: str = KEY) -> DataFrame:
    """Copy first/last date and timespan from history to postings that are in it.

    Both sides are plain scans, so AQE splits a skewed partition of the left side.
    """
    fields = (*_DATES, "timespan_days")
    past = history.select(key, *[F.col(c).alias(f"_h_{c}") for c in fields])
    joined = current.join(past, key, "left")
    have = set(current.columns)
    filled = {
        c: F.coalesce(F.col(f"_h_{c}"), F.col(c)) if c in have else F.col(f"_h_{c}") for c in fields
    }
    return joined.withColumns(filled).drop(*[f"_h_{c}" for c in fields])


def detail_join(postings: DataFrame, details: DataFrame, key: str = KEY, order: str | None = None) -> DataFrame:
    """Attach detail columns by key; a posting without details keeps what it had.

    Of several details of a key the one with the greatest ``order`` counts; without an order
    (rows alike in all other respects) it is the greatest row.
    """
    rest = [c for c in details.columns if c not in (key, order)]
    row = F.struct(*[c for c in (order, *rest) if c])
    details = details.groupBy(key).agg(F.max(row).alias("_d")).select(key, *[F.col("_d")[c].alias(c) for c in rest])
    shared = [c for c in details.columns if c != key and c in postings.columns]
    renamed = details.select(
        key, *[F.col(c).alias(f"_d_{c}") if c in shared else F.col(c) for c in details.columns if c != key]
    )
    joined = postings.join(renamed, key, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(f"_d_{c}"), F.col(c)) for c in shared}
    ).drop(*[f"_d_{c}" for c in shared])
