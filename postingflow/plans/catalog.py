"""All registered queries (importing the query modules fills the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postingflow.config import Profile
from postingflow.operators import enrich, filters, reports
from postingflow.plans import (  # noqa: F401
    queries_columns,
    queries_pages,
    queries_reports,
    queries_snapshots,
    queries_text,
)
from postingflow.plans.registry import ORACLES, QUERIES  # noqa: F401
from postingflow.plans.views import postings
from postingflow.session import settle


def ranked_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: read salaries, detect language, score, tag, and rank all postings."""
    profile = Profile(banned_words=("manager", "leiter"))
    paid = enrich.with_salary(postings(spark, sf_dir))
    scored = enrich.process(paid, profile)
    kept = filters.threshold_points(scored, profile.min_points).select(
        "posting_id", "title", "company", "language", "salary_monthly_guessed", "points", "keywords"
    )
    # A sort samples its input before it sorts: settle, so the text work runs once.
    return reports.sort_by_key(settle(kept, "ranked"))
