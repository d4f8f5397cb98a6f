"""Salary numbers from free text.

A salary is read by an ordered ladder of digit patterns, guarded by period words. Every
step is a native column; the text that steps share (section, lowered, without thousands
separators) is staged in projections so it is computed once per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions.columns import contains_any
from postingflow.functions.once import let, materialize
from postingflow.functions.regex import required_words, search


@dataclass(frozen=True)
class NumberFormat:
    """How numbers are written, and the factor between yearly and monthly pay."""

    thousands: str = "."
    decimal: str = ","
    factor: int = 12
    lengths: tuple[int, ...] = (6, 5)
    annual_keywords: tuple[str, ...] | None = config.ANNUAL_KEYWORDS
    monthly_keywords: tuple[str, ...] | None = config.MONTHLY_KEYWORDS


def _digits(text: Column, pattern: str) -> Column:
    """First capture of a digit pattern as a number."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def _nonzero(number: Column) -> Column:
    return F.nullif(number, F.lit(0).cast("bigint"))


def salary_number(
    text: Column, keywords=(), remove: tuple[str, ...] = (".",), lengths: tuple[int, ...] = (6, 5)
) -> Column:
    """First run of the given digit lengths, tried in order, once separators are removed.

    With keywords, only when one of them occurs in the text.
    """
    plain = text
    for char in remove:
        plain = F.replace(plain, F.lit(char), F.lit(""))
    number = F.coalesce(*[_digits(plain, f"([0-9]{{{n}}})") for n in lengths])
    return F.when(contains_any(text, keywords), number) if keywords else number


def salary_regex(
    text: Column,
    patterns=(r"[0-9]{6},[0-9]{2}", r"[0-9]{5},[0-9]{2}", r"[0-9]{6}", r"[0-9]{5}"),
    decimal: str = ",",
) -> Column:
    """The first pattern that matches decides; decimals are cut off."""
    found = F.coalesce(
        *[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns]
    )
    return F.replace(found, F.lit(decimal), F.lit(".")).try_cast("decimal(20,4)").try_cast("bigint")


def rungs(lowered: Column, plain: Column, fmt: NumberFormat) -> tuple[Column, Column, Column, Column]:
    """The four rungs of the ladder: stated year, stated month, bare year, bare month.

    ``plain`` is ``lowered`` without the thousands separator. Zero counts as not found.
    """
    none = F.lit(None).cast("bigint")
    cents = re.escape(fmt.decimal) + "[0-9]{2}"
    stated_year = stated_month = none
    if fmt.annual_keywords is not None:
        number = F.coalesce(*[_digits(plain, f"([0-9]{{{n}}})") for n in fmt.lengths])
        stated_year = F.when(contains_any(lowered, fmt.annual_keywords), _nonzero(number))
    if fmt.monthly_keywords is not None:
        # A four-digit amount with cents is monthly pay even without a period word.
        stated_month = F.coalesce(
            _nonzero(_digits(plain, f"([0-9]{{4}}){cents}")),
            F.when(
                contains_any(lowered, fmt.monthly_keywords), _nonzero(_digits(plain, "([0-9]{4})"))
            ),
        )
    bare_year = F.coalesce(
        *[_digits(plain, p) for p in (f"([0-9]{{6}}){cents}", f"([0-9]{{5}}){cents}", "([0-9]{6})", "([0-9]{5})")]
    )
    bare_month = F.coalesce(_digits(plain, f"([0-9]{{4}}){cents}"), _digits(plain, "([0-9]{4})"))
    return stated_year, stated_month, _nonzero(bare_year), _nonzero(bare_month)


def section(text: Column, patterns=config.SALARY_SECTION_PATTERNS) -> Column:
    """The salary section of a description, lower-cased as the ladder wants it: the first
    pattern that matches, in list order.

    ``coalesce`` stops at the first hit, and a pattern only runs on texts that hold one of
    the words it needs; patterns that need the same words share that test.
    """
    needs = [tuple(w.lower() for w in required_words(p)) for p in patterns]
    gates = list(dict.fromkeys(needs))

    def pick(lowered):
        def first_match(seen):
            options = []
            for p, words in zip(patterns, needs):
                found = search(lowered, p.lower())
                options.append(F.when(F.get(seen, F.lit(gates.index(words))), found) if words else found)
            return F.coalesce(*options)

        tests = [contains_any(lowered, words) if words else F.lit(True) for words in gates]
        return let(F.array(*tests), first_match)

    return let(F.lower(text), pick)


def with_salary_from_text(
    df: DataFrame, text: Column, out: str = "salary_guessed", fmt: NumberFormat = NumberFormat(),
    factor: Column | None = None,
) -> DataFrame:
    """Add ``struct<annual, monthly>`` (or NULL) parsed from a text column.

    ``factor`` may be a column (the site's own conversion factor) instead of ``fmt.factor``.
    """
    keep = [c for c in df.columns if c != out]
    factor = F.lit(fmt.factor).cast("bigint") if factor is None else factor.cast("bigint")
    staged = df.select(*keep, F.lower(text).alias("_lowered"), factor.alias("_factor"))
    staged = staged.select(
        "*", F.replace("_lowered", F.lit(fmt.thousands), F.lit("")).alias("_plain")
    )
    names = ("_year1", "_month1", "_year2", "_month2")
    staged = staged.select(
        *keep, "_factor",
        *[c.alias(n) for c, n in zip(rungs(F.col("_lowered"), F.col("_plain"), fmt), names)],
    )
    # A rung only counts when the earlier ones found nothing.
    year = F.coalesce(F.col("_year1"), F.when(F.col("_month1").isNull(), F.col("_year2")))
    month = F.when(year.isNull(), F.coalesce("_month1", "_month2"))
    staged = staged.select(*keep, "_factor", year.alias("_year"), month.alias("_month"))
    guessed = F.when(
        F.col("_year").isNotNull(),
        F.struct(
            F.col("_year").alias("annual"),
            F.expr("_year div _factor").alias("monthly"),
        ),
    ).when(
        F.col("_month").isNotNull(),
        F.struct(
            (F.col("_month") * F.col("_factor")).alias("annual"), F.col("_month").alias("monthly")
        ),
    )
    return materialize(staged, {out: guessed}).select(*keep, out)


def with_salary_from_description(
    df: DataFrame, text: Column, out: str = "salary_guessed", fmt: NumberFormat = NumberFormat(),
    patterns=config.SALARY_SECTION_PATTERNS, factor: Column | None = None,
) -> DataFrame:
    """Pick the salary section of a description, then parse that section only."""
    staged = df.withColumn("_section", section(text, patterns))
    return with_salary_from_text(staged, F.col("_section"), out, fmt, factor).drop("_section")


def with_salary_dual_locale(
    df: DataFrame, text: Column, out: str = "salary_guessed", factor: int = 12
) -> DataFrame:
    """Read ``1,234.50`` style numbers first, then ``1.234,50`` style."""
    point = NumberFormat(thousands=",", decimal=".", factor=factor)
    comma = NumberFormat(thousands=".", decimal=",", factor=factor)
    both = df.withColumn("_section", section(text))
    both = with_salary_from_text(both, F.col("_section"), "_point", point)
    both = with_salary_from_text(both, F.col("_section"), "_comma", comma)
    return both.withColumn(out, F.coalesce("_point", "_comma")).drop("_section", "_point", "_comma")


def site_factor(source: Column, factors: dict[str, int] = config.SITE_SALARY_FACTORS, default: int = 12) -> Column:
    """The number of monthly salaries a site counts per year."""
    expr = F.lit(default)
    for name, factor in factors.items():
        expr = F.when(source == name, F.lit(factor)).otherwise(expr)
    return expr


def salary_points(
    salary: Column, root: int | None = None, ratio: Decimal = config.SALARY_RATIO,
    dropoff: bool = True, knee: Decimal = config.KNEE_DEFAULT,
) -> Column:
    """Linear points above the root salary; beyond ``root * knee`` the slope mirrors."""
    root_value = Decimal(root or config.DEFAULT_ROOT)
    ratio, knee = Decimal(str(ratio)), Decimal(str(knee))
    points = (salary - F.lit(int(root_value))) * F.lit(ratio)
    if not dropoff:
        return points
    peak = (root_value * knee - root_value) * ratio
    return F.when(salary > F.lit(root_value * knee), F.lit(2 * peak) - points).otherwise(points)
