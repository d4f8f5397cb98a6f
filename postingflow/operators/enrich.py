"""Adding attributes to postings: language, salary, points, keywords."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow import config
from postingflow.config import Profile
from postingflow.functions import salary as salary_fn
from postingflow.functions import scoring
from postingflow.functions.columns import contains_any, location_match, long_contains_any
from postingflow.functions.once import materialize
from postingflow.functions.text import language, tag_keywords
from postingflow.operators.filters import apply_chain, ban_title_words


def with_language(df: DataFrame, description_key: str = "description") -> DataFrame:
    return df.withColumn("language", language(F.col(description_key)))


def location_penalty(locations: Column, desired=(), secondary=()) -> Column:
    """0, -1 (only a secondary place) or -2; no penalty without locations."""
    has_any = F.coalesce(F.size(locations) > 0, F.lit(False))
    return (
        F.when(~has_any | location_match(locations, desired), F.lit(0))
        .when(location_match(locations, secondary), F.lit(-1))
        .otherwise(F.lit(-2))
    )


def posting_points(
    rules, desc_ratio=config.DESCRIPTION_RATIO, root: int | None = config.DEFAULT_ROOT,
    salary_ratio=config.SALARY_RATIO, knee=config.KNEE_RANKING,
    desired=(), secondary=(), salary: str = "salary_monthly_guessed",
) -> Column:
    """Title score + a share of the description score + salary points - location penalty.

    Sums are exact decimals, rounded half-up to two places at the end.
    """
    title = scoring.score_mills(F.col("title"), rules) * F.lit(scoring.SCALE)
    description = scoring.score_mills(F.col("description"), rules) * F.lit(
        scoring.SCALE * Decimal(str(desc_ratio))
    )
    pay = F.col(salary)
    pay_points = F.when(
        F.coalesce(pay != 0, F.lit(False)), salary_fn.salary_points(pay, root, salary_ratio, knee=knee)
    ).otherwise(F.lit(Decimal(0)))
    penalty = location_penalty(F.col("locations"), desired, secondary)
    return F.round(title + description + pay_points + penalty, 2).cast("decimal(12,2)")


def rank(
    df: DataFrame, rules, overwrite: bool = True, **options
) -> DataFrame:
    """Set ``points``; without ``overwrite`` existing points stay."""
    points = posting_points(rules, **options)
    if not overwrite and "points" in df.columns:
        points = F.coalesce(F.col("points"), points)
    return materialize(df, {"points": points})


def rank_for(df: DataFrame, profile: Profile, overwrite: bool = True) -> DataFrame:
    """``rank`` with a profile's rules, salary root and places."""
    return rank(
        df, profile.rules, overwrite, desc_ratio=profile.description_ratio,
        root=profile.salary_root, salary_ratio=profile.salary_ratio, knee=profile.knee,
        desired=profile.locations_desired, secondary=profile.locations_secondary,
    )


def missing_keyword_bonus(df: DataFrame, keyword_points) -> DataFrame:
    """For each (keywords, points): add the points when no keyword occurs anywhere."""
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    description = F.lower(F.coalesce(F.col("description"), F.lit("")))
    bonus = F.lit(Decimal(0))
    for keywords, points in keyword_points:
        found = contains_any(title, keywords) | long_contains_any(description, keywords)
        bonus = bonus + F.when(found, F.lit(Decimal(0))).otherwise(F.lit(Decimal(str(points))))
    base = F.coalesce(F.col("points"), F.lit(Decimal(0)))
    return materialize(df, {"points": (base + bonus).cast("decimal(12,2)")})


def with_keywords(df: DataFrame, keywords, overwrite: bool = True, description_key: str = "description") -> DataFrame:
    """Set ``keywords``; without ``overwrite`` a non-empty list stays."""
    tagged = tag_keywords(F.col(description_key), keywords)
    if not overwrite and "keywords" in df.columns:
        tagged = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(tagged)
    return df.withColumn("keywords", tagged)


def process(
    df: DataFrame, profile: Profile, overwrite: bool = True, transformations=None,
    filter_step=None, language_step=None, rank_step=None, keyword_step=None,
) -> DataFrame:
    """Title filter, language, points, keywords, then the profile's own steps.

    Each of the first four may be replaced by another ``DataFrame -> DataFrame`` function.
    """
    steps = (
        filter_step or (lambda d: ban_title_words(d, profile.banned_words, profile.banned_capital_words)),
        language_step or with_language,
        rank_step or (lambda d: rank_for(d, profile, overwrite)),
        keyword_step or (lambda d: with_keywords(d, profile.keywords, overwrite)),
    )
    for step in steps:
        df = df.transform(step)
    return apply_chain(df, profile.transformations if transformations is None else transformations)


def with_salary(
    df: DataFrame, overwrite: bool = True, fmt: salary_fn.NumberFormat = salary_fn.NumberFormat(),
    by_site: bool = False, patterns=config.SALARY_SECTION_PATTERNS,
) -> DataFrame:
    """Salary from the stated ``salary`` where there is one, else from the description.

    Both cases are the same ladder over different text, so it runs once per row.
    """
    salary = F.col("salary") if "salary" in df.columns else F.lit(None).cast("string")
    staged = df.withColumn(
        "_pay", F.when(salary.isNotNull(), salary).otherwise(salary_fn.section(F.col("description"), patterns))
    )
    factor = salary_fn.site_factor(F.col("source")) if by_site else None
    staged = salary_fn.with_salary_from_text(staged, F.col("_pay"), "_read", fmt, factor)
    guessed, monthly = F.col("_read"), F.col("_read.monthly")
    if not overwrite and "salary_guessed" in df.columns:
        guessed = F.coalesce(F.col("salary_guessed"), guessed)
    if not overwrite and "salary_monthly_guessed" in df.columns:
        old = F.col("salary_monthly_guessed")
        monthly = F.when(F.coalesce(old != 0, F.lit(False)), old).otherwise(monthly)
    return staged.withColumns(
        {"salary_guessed": guessed, "salary_monthly_guessed": monthly}
    ).drop("_pay", "_read")


def enrich(
    df: DataFrame, profile: Profile, overwrite: bool = True,
    fmt: salary_fn.NumberFormat = salary_fn.NumberFormat(), fallback_date: Column | None = None,
) -> DataFrame:
    """Re-derive salary and collection date, then ``process``."""
    out = with_salary(df, overwrite, fmt)
    if fallback_date is not None:
        out = out.withColumn("collected_on", F.coalesce(F.col("collected_on"), fallback_date))
    return process(out, profile, overwrite)


def split_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """Role, requirements, nice-to-have and benefits from the list texts of a page.

    First list = role, second = requirements; three lists: benefits; four: nice-to-have
    and benefits; more: benefits is the rest joined.
    """
    s = F.col(sections)
    size = F.coalesce(F.size(s), F.lit(0))
    at = lambda i: F.get(s, F.lit(i))
    return df.withColumns(
        {
            "role": at(0),
            "requirements": at(1),
            "nice_to_have": F.when(size == 4, at(2)),
            "benefits": F.when(size == 3, at(2))
            .when(size == 4, at(3))
            .when(size > 4, F.array_join(F.slice(s, 3, F.greatest(size - 2, F.lit(0))), "\n ")),
        }
    )
