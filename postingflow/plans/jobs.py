"""Jobs composed of operators: the daily run, the stores, profiles, stage chains."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import Profile
from postingflow.functions.columns import reorder_locations
from postingflow.operators import coverage, enrich, filters, profiles, reports, snapshots
from postingflow.operators.skew import join_per_key, rows_with_same_key
from postingflow.schema import COMPRESSION, KEY
from postingflow.session import settle
from postingflow.sources import buckets
from postingflow.sources import snapshots as store

Step = Callable[[DataFrame], DataFrame]
# What a run needs of a history that does not exist yet.
HISTORY = f"{KEY} string, first_collected_on date, last_collected_on date, points decimal(12,2)"


@dataclass(frozen=True)
class RunBundle:
    """What a run hands on: all scores for the stores, the thresholded tables for display."""

    stored: DataFrame
    results: DataFrame
    added: DataFrame
    removed: DataFrame
    companies: DataFrame


def run_stages(df: DataFrame, stages: Iterable[Step]) -> DataFrame:
    """Each stage gets the previous stage's table."""
    for stage in stages:
        df = df.transform(stage)
    return df


def daily_run(
    raw: DataFrame, history: DataFrame, profile: Profile, threshold=config.MIN_POINTS
) -> RunBundle:
    """Process fresh postings, compare them with history and backfill their dates.

    ``history`` holds one row per posting with its dates. One join with it, before any text
    work, tells which postings are new and gives the others their first date. The processed
    postings, all that the title filter left, are settled as ``stored``, since every output
    of the run reads them; what is displayed is cut at the threshold afterwards. A posting
    of history that is not among them, banned titles included, is removed. Companies come in
    the order of their best posting (``first_seen`` is its points, negated).
    """
    past = history.select(
        KEY, F.col("first_collected_on").alias("_first"), F.col("last_collected_on").alias("_last"),
        F.lit(True).alias("_known"),
    )
    joined = join_per_key(raw.drop("first_collected_on", "last_collected_on"), past, KEY, "left")
    dates = joined.withColumns(
        {
            "is_added": F.col("_known").isNull(),
            "first_collected_on": F.least("_first", "collected_on"),
            "last_collected_on": F.greatest("_last", "collected_on"),
        }
    ).drop("_first", "_last", "_known")
    stored = settle(
        enrich.process(enrich.with_salary(snapshots.with_timespan(dates)), profile), "results", compression=COMPRESSION
    )
    kept = settle(stored.select(KEY), "kept")
    results = filters.threshold_points(stored, threshold).withColumn(
        "locations", reorder_locations(F.col("locations"), profile.locations_desired)
    )
    best_first = results.withColumn("_order", -F.coalesce("points", F.lit(0)))
    return RunBundle(
        stored=stored.drop("is_added"),
        results=results.drop("is_added"),
        added=results.where("is_added").drop("is_added"),
        removed=filters.threshold_points(snapshots.removed(kept, history), threshold),
        companies=coverage.companies_in_city(best_first, "_order"),
    )


def store_run(current: DataFrame, root: str, order: str = "ord", settled: bool = False) -> dict[str, int]:
    """Save a run: history first, then the current and the newly added postings with its dates.

    The postings are settled, so their processing runs once, unless the caller says that they
    are, or cost no more to read again than a settled copy (``settled``). What was added is told
    by the history before this run, from keys alone. History is a store in buckets: the run
    reads and rewrites those that its keys fall in, and keys that their filters deny are new
    without a join. Texts move to be merged and to get history's dates, and no more than that:
    merged rows are written where the merge left them, dates come as a narrow table, and the
    newly added postings are copied out of the current ones.
    """
    spark = current.sparkSession
    if order not in current.columns:
        current = current.withColumn(order, F.lit(0))
    if not settled:
        current = settle(current, "current", compression=COMPRESSION)
    path = f"{root}/history"
    new_keys = buckets.added_keys(current, path)

    def fold(past: DataFrame, rows: DataFrame) -> DataFrame:
        both = snapshots.union_columns(past.withColumn(order, F.lit(-1).cast("bigint")), rows)
        return snapshots.with_timespan(snapshots.unify(both, order))

    state, some = store.merge_store(current, path, fold, grouped=True)
    history = buckets.read_buckets(spark, path, state, some)
    dates = settle(history.select(KEY, "first_collected_on", "last_collected_on", "timespan_days"), "dates")
    version = store.write_store(snapshots.history_backfill(current, dates), f"{root}/current")
    written = store.read_store(spark, f"{root}/current", before=version + 1)
    new_rows = written if new_keys is None else rows_with_same_key(written, new_keys, KEY)
    return {
        "history": state.version,
        "current": version,
        "newly_added": store.write_store(new_rows, f"{root}/newly_added"),
    }


def daily_job(raw: DataFrame, root: str, profile: Profile, threshold=config.MIN_POINTS) -> RunBundle:
    """The whole daily loop: run against the stored history, store all scores, return the bundle.

    The version of history that the run was compared with stays as it is, so it is not copied.
    """
    history = store.read_store(raw.sparkSession, f"{root}/history", schema=HISTORY)
    bundle = daily_run(raw, history, profile, threshold)
    store_run(bundle.stored, root, settled=True)
    return bundle


def derive_profiles(
    universal: DataFrame, chosen: list[Profile], root: str, min_date: dt.date | None = None,
    date_key: str = "collected_on",
) -> dict[str, DataFrame]:
    """Route, score and select postings for every profile, and compare with last time.

    Scores are stored below ``root`` and read back: selection and comparison work on the
    stored table and score nothing again.
    """
    spark = universal.sparkSession
    store.write_store(
        profiles.score_candidates(profiles.candidates(universal, chosen), chosen), f"{root}/scored"
    )
    scored = store.read_store(spark, f"{root}/scored")
    previous = store.read_store(spark, f"{root}/selected", schema=scored.schema)
    store.write_store(profiles.select_final(scored, chosen, min_date, date_key), f"{root}/selected")
    selected = store.read_store(spark, f"{root}/selected")
    added, removed = profiles.compare_selected(selected, previous)
    return {"scored": scored, "selected": selected, "added": added, "removed": removed}


def profile_outputs(selected: DataFrame, as_of: dt.date, run_ts: dt.datetime, highlight_days: int | None = None) -> dict[str, DataFrame]:
    """Report table and log lines of selected (profile, posting) rows."""
    keyed = selected.withColumn(KEY, F.concat_ws("/", "profile", KEY))
    return {
        "report": reports.report_table(keyed, as_of, highlight_days),
        "log": reports.log_lines(keyed, run_ts),
    }


def outputs(bundle: RunBundle, as_of: dt.date, run_ts: dt.datetime, highlight_days: int | None = None) -> dict[str, DataFrame]:
    """Report, log, keyword counts, totals and digest of one run."""
    return {
        "report": reports.report_table(bundle.results, as_of, highlight_days, bundle.added),
        "log": reports.log_lines(bundle.added, run_ts),
        "keyword_counts": coverage.keyword_counts(bundle.results),
        "totals": coverage.run_counts(bundle.results, bundle.added, bundle.removed),
        "digest": reports.digest(bundle.added, bundle.companies),
    }


def save_bundle(bundle: RunBundle, path: str) -> DataFrame:
    """Write the results of a run and what was added and removed below ``path``; their totals."""
    parts = {"results": bundle.results, "added": bundle.added, "removed": bundle.removed}
    return coverage.written_counts(parts, lambda name, df: df.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{path}/{name}"))


def profile_words(spark: SparkSession, chosen: list[Profile]) -> DataFrame:
    """The search words of profiles as (profile, word) rows."""
    rows = [(p.name, w) for p in chosen for w in p.titlewords]
    return spark.createDataFrame(rows, "profile string, word string")


def universal_inputs(words: DataFrame) -> DataFrame:
    """Search words of all profiles, each once, with the profiles that asked for it.

    Pairs are made distinct first, so a word's list is as long as it has profiles.
    """
    asked = words.select("word", "profile").distinct().groupBy("word")
    return asked.agg(F.array_sort(F.collect_list("profile")).alias("profiles"))


def merge_chunks(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """One row per posting over all chunk files, keeping every search word."""
    return snapshots.unify(chunks, order)
