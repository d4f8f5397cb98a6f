"""Building the list of pages to search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.functions.columns import url_build, word_array


def pairs(words: DataFrame, word: str, locations) -> DataFrame:
    """Every word with every configured location.

    The locations are a configured list in the plan, so this is a row generator and no join.
    """
    return words.select(F.col(word).alias("word"), F.explode(word_array(tuple(locations))).alias("location"))


def url_frontier(words: DataFrame, word: str, locations, base: str, dedupe: bool = True) -> DataFrame:
    """Urls ``base/word/location`` of all pairs."""
    urls = pairs(words, word, locations).select(
        url_build(F.lit(base), F.col("word"), F.col("location")).alias("url")
    )
    return urls.distinct() if dedupe else urls


def zipped_urls(rows: DataFrame, first: str, second: str, base: str, dedupe: bool = True) -> DataFrame:
    """Urls from two lists walked side by side, as long as the shorter one."""
    n = F.least(F.size(first), F.size(second))
    both = F.arrays_zip(
        F.slice(first, F.lit(1), n).alias("a"), F.slice(second, F.lit(1), n).alias("b")
    )
    urls = rows.select(F.explode(both).alias("z")).select(
        url_build(F.lit(base), F.col("z.a"), F.col("z.b")).alias("url")
    )
    return urls.distinct() if dedupe else urls


def keyword_universe(lists: DataFrame) -> DataFrame:
    """Distinct words over several lists given as (list, word) rows."""
    return lists.select("word").distinct()
