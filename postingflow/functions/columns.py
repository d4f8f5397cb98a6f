"""Scalar column helpers: urls, locations, text cleaning, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postingflow.functions.once import let


def any_of(tests) -> Column:
    """OR of the tests; no tests means no match."""
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def all_of(tests) -> Column:
    """AND of the tests; no tests means no match, as for ``any_of``."""
    tests = list(tests)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def contains_any(text: Column, words) -> Column:
    """Whether any literal word occurs. For short texts: stays in generated code."""
    return any_of(F.contains(text, F.lit(w)) for w in words)


def word_array(words) -> Column:
    """The words as one array literal."""
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def long_contains_any(text: Column, words) -> Column:
    """``contains_any`` for long texts: ``text`` (say, a lowered description) runs once."""
    words = tuple(words)
    if not words:
        return F.lit(False)
    return let(text, lambda t: F.exists(word_array(words), lambda w: F.contains(t, w)))


# --- urls ------------------------------------------------------------------------------


def reduce_url(url: Column) -> Column:
    """Text between the first and second ``www.``, else after ``://``, else unchanged."""
    return (
        F.when(F.contains(url, F.lit("www.")), F.split_part(url, F.lit("www."), F.lit(2)))
        .when(F.contains(url, F.lit("://")), F.split_part(url, F.lit("://"), F.lit(2)))
        .otherwise(url)
    )


def hyperlink(url: Column) -> Column:
    """Give a non-empty url a scheme."""
    has_scheme = F.startswith(url, F.lit("https://")) | F.startswith(url, F.lit("http://"))
    return F.when((url == "") | has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def url_build(base: Column, *parts: Column) -> Column:
    """Base url (one trailing slash dropped) and path parts."""
    trimmed = F.when(F.endswith(base, F.lit("/")), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    return F.concat_ws("/", trimmed, *parts)


def query_from_url(url: Column, base: str) -> Column:
    """The search word in a search url: after the base, up to the first ``&``."""
    rest = F.substr(url, F.lit(len(base) + 1))
    return F.when(F.startswith(url, F.lit(base)), F.substring_index(rest, "&", 1))


def id_from_url(url: Column) -> Column:
    """First run of digits."""
    return F.nullif(F.regexp_extract(url, "[0-9]+", 0), F.lit(""))


def trailing_id_from_url(url: Column) -> Column:
    """Digits of a trailing ``/123/`` path part."""
    return F.nullif(F.regexp_extract(url, "/([0-9]+)/$", 1), F.lit(""))


def dash(word: Column) -> Column:
    return F.replace(word, F.lit(" "), F.lit("-"))


# --- text cleaning ----------------------------------------------------------------------

# The characters Python's str.strip() treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Strip Unicode whitespace, then turn newline, tab, return and nbsp into spaces."""
    return F.translate(strip(text), "\n\t\r\u00a0", "    ")


def strip_control(text: Column) -> Column:
    """Remove control characters a spreadsheet cell cannot hold."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")


def preview(text: Column, max_length: int | None) -> Column:
    """Strings longer than ``max_length`` end in ``...`` after that many characters."""
    if not max_length:
        return text
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("..."))
    ).otherwise(text)


# --- locations --------------------------------------------------------------------------


def location_match(locations: Column, terms) -> Column:
    """Whether any location contains any term, ignoring case."""
    terms = [t.lower() for t in terms]
    if not terms:
        return F.lit(False)
    hit = F.exists(locations, lambda loc: contains_any(F.lower(loc), terms))
    return F.coalesce(hit, F.lit(False))


def reorder_locations(locations: Column, primary) -> Column:
    """Locations naming a primary city first; order is otherwise kept."""
    terms = tuple(primary)

    def hit(loc):
        return F.coalesce(contains_any(F.lower(loc), terms), F.lit(False))

    return F.concat(F.filter(locations, hit), F.filter(locations, lambda loc: ~hit(loc)))


# --- dates ------------------------------------------------------------------------------


def business_day(ts: Column) -> Column:
    """The working day a moment belongs to: days turn over at 8 in the morning."""
    return F.to_date(ts - F.expr("INTERVAL 8 HOURS"))


def timespan_days(first: Column, last: Column) -> Column:
    """Days between two dates; dates given as text may be malformed, giving NULL."""
    return F.date_diff(F.try_to_date(last.cast("string")), F.try_to_date(first.cast("string")))
