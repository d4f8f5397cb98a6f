"""Row filters. NULL text is treated as empty text; no filter shuffles."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions import regex
from postingflow.functions.columns import all_of, any_of, contains_any, word_array
from postingflow.functions.once import let


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ban_title_words(df: DataFrame, banned=config.BANNED_WORDS, banned_capital=config.BANNED_CAPITAL_WORDS) -> DataFrame:
    """Drop rows whose title contains a banned word (lowered title) or capital word (as is)."""
    title = _text("title")
    return df.where(~(contains_any(F.lower(title), banned) | contains_any(title, banned_capital)))


def pattern_match(
    text: Column, terms, use_regex: bool = False, ignore_case: bool = False,
    casefold: bool = False, mode: str = "any",
) -> Column:
    """Whether any/all terms occur: as substrings, or as regexes.

    An invalid regex counts as a literal substring. No terms means no match, also for
    ``all``.
    """
    terms = tuple(terms or ())
    if not terms:
        return F.lit(False)
    text = F.coalesce(text, F.lit(""))
    patterns = [t for t in terms if use_regex and regex.is_valid(t)]
    literals = [t for t in terms if not (use_regex and regex.is_valid(t))]
    combine, quantifier = (any_of, F.exists) if mode == "any" else (all_of, F.forall)
    tests = []
    if patterns:
        tests.append(
            let(F.lower(text), lambda t: combine(regex.gated(text, t, p, ignore_case) for p in patterns))
        )
    if literals:
        needles = tuple(t.casefold() for t in literals) if casefold else tuple(literals)
        haystack = regex.casefold(text) if casefold else text
        # One casefold per row however many terms there are.
        tests.append(
            let(haystack, lambda t: quantifier(word_array(needles), lambda w: F.contains(t, w)))
        )
    return combine(tests)


def keyword_hit(
    title_keywords=(), title_capital_keywords=(), description_keywords=(),
    description_capital_keywords=(), use_regex: bool = False, ignore_case: bool = False,
) -> Column:
    """Any of four lists matches: title/description, ignoring case or exactly."""

    def loose(name, terms):
        return pattern_match(F.col(name), terms, use_regex, ignore_case=True, casefold=True)

    def exact(name, terms):
        return pattern_match(F.col(name), terms, use_regex, ignore_case=ignore_case)

    return (
        loose("title", title_keywords)
        | exact("title", title_capital_keywords)
        | loose("description", description_keywords)
        | exact("description", description_capital_keywords)
    )


def select_keywords(df: DataFrame, **lists) -> DataFrame:
    """Keep rows where any keyword list matches; no lists keep nothing."""
    return df.where(keyword_hit(**lists))


def filter_out_keywords(df: DataFrame, **lists) -> DataFrame:
    """Drop rows where any keyword list matches."""
    return df.where(~keyword_hit(**lists))


def min_points(df: DataFrame, minimum=config.MIN_POINTS, default=0) -> DataFrame:
    """Keep rows with at least ``minimum`` points."""
    points = F.coalesce(F.col("points"), F.lit(default))
    return df.where(points >= F.lit(Decimal(str(minimum))))


def threshold_points(df: DataFrame, threshold=config.MIN_POINTS) -> DataFrame:
    """``min_points``, or everything when there is no threshold."""
    return df if threshold is None else min_points(df, threshold)


def positive_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("points") > 0)


def min_date(df: DataFrame, minimum: dt.date | None = None, date_key: str = "first_collected_on") -> DataFrame:
    """Keep rows dated at or after ``minimum``; undated rows go; no minimum keeps all."""
    return df if minimum is None else df.where(F.col(date_key) >= F.lit(minimum))


def rolling_window(df: DataFrame, as_of: dt.date, days: int = 21, date_key: str = "first_collected_on") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return min_date(df, as_of - dt.timedelta(days=days), date_key)


def nonempty_description(df: DataFrame) -> DataFrame:
    return df.where(F.length("description") > 0)


def apply_chain(df: DataFrame, steps=()) -> DataFrame:
    """Apply (function, kwargs) steps in order; Catalyst merges neighbouring filters."""
    return reduce(lambda d, step: d.transform(step[0], **step[1]), steps, df)


def profile_filter_steps(minimum_date: dt.date | None = None, date_key: str = "first_collected_on"):
    """The fixed filters of the daily technical selection (they commute)."""
    return (
        # The cheap tests first: most rows never reach the text filters.
        (min_points, {}),
        (min_date, {"minimum": minimum_date, "date_key": date_key}),
        (filter_out_keywords, {
            "title_keywords": config.DROP_TITLE_KEYWORDS,
            "title_capital_keywords": config.DROP_TITLE_CAPITAL_KEYWORDS,
        }),
        (select_keywords, {
            "title_keywords": config.SELECT_TITLE_KEYWORDS,
            "title_capital_keywords": config.SELECT_TITLE_CAPITAL_KEYWORDS,
            "description_keywords": config.SELECT_DESCRIPTION_KEYWORDS,
            "description_capital_keywords": config.SELECT_DESCRIPTION_CAPITAL_KEYWORDS,
        }),
        # These terms are regexes, so they are matched as regexes.
        (filter_out_keywords, {
            "description_keywords": config.DROP_DESCRIPTION_PATTERNS, "use_regex": True,
        }),
    )


def profile_filter(df: DataFrame, minimum_date: dt.date | None = None, date_key: str = "first_collected_on") -> DataFrame:
    return apply_chain(df, profile_filter_steps(minimum_date, date_key))
