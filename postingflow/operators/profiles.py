"""One table of postings, many profiles.

Routing and scoring evaluate all profiles in one scan and unpivot the results; history and
comparison are the snapshot operators keyed on (profile, posting_id).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.config import Profile
from postingflow.functions.once import explode_once, materialize
from postingflow.operators import filters, snapshots
from postingflow.operators.enrich import posting_points
from postingflow.schema import KEY

PROFILE_KEY = ("profile", KEY)


def candidates(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """(profile, posting) rows of every profile whose broad keyword filter matches."""
    routes = [
        F.when(
            filters.keyword_hit(
                title_keywords=p.candidate_title_keywords,
                description_keywords=p.candidate_description_keywords,
            ),
            F.lit(p.name),
        )
        for p in profiles
    ]
    rest = [c for c in df.columns if c != "profile"]
    return explode_once(df, F.array_compact(F.array(*routes)), "profile", *rest)


def points_for(profile: Profile):
    return posting_points(
        profile.rules, profile.description_ratio, profile.salary_root, profile.salary_ratio,
        profile.knee, profile.locations_desired, profile.locations_secondary,
    )


def score_all(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """The points of every posting in every profile, from one scan."""
    scored = F.array(
        *[F.struct(F.lit(p.name).alias("profile"), points_for(p).alias("points")) for p in profiles]
    )
    rest = [c for c in df.columns if c not in ("points", "profile")]
    return explode_once(df, scored, "_s", *rest).select(
        *rest, F.col("_s.profile").alias("profile"), F.col("_s.points").alias("points")
    )


def score_candidates(routed: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Points of routed (profile, posting) rows, each with its own profile's rules."""
    points = F.lit(None).cast("decimal(12,2)")
    for p in profiles:
        points = F.when(F.col("profile") == p.name, points_for(p)).otherwise(points)
    return materialize(routed, {"points": points})


def merge_history(history: DataFrame, scored: DataFrame, order: str = "ord") -> DataFrame:
    """Profile history after a run: candidates stay even with low scores."""
    both = snapshots.union_columns(history, scored)
    return snapshots.unify(both, order, PROFILE_KEY)


def score_history(scored: DataFrame, scored_on: dt.date) -> DataFrame:
    """Rows to append to the score log of the profiles."""
    return scored.select(*PROFILE_KEY, F.lit(scored_on).alias("scored_on"), "points")


def select_final(
    scored: DataFrame, profiles: list[Profile], min_date: dt.date | None = None,
    date_key: str = "collected_on",
) -> DataFrame:
    """Rows good enough to show: thresholds, date, excluded titles, per profile."""
    keep = F.lit(False)
    for p in profiles:
        ok = ~filters.keyword_hit(title_keywords=p.drop_title_keywords)
        if p.min_points is not None:
            ok = ok & (F.coalesce(F.col("points"), F.lit(0)) >= F.lit(p.min_points))
        keep = keep | ((F.col("profile") == p.name) & ok)
    return filters.min_date(scored.where(keep), min_date, date_key)


def compare_selected(selected: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added and removed (profile, posting) rows."""
    return (
        snapshots.added(selected, previous, PROFILE_KEY),
        snapshots.removed(selected, previous, PROFILE_KEY),
    )
