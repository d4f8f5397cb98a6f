"""Counts over companies, keywords and title words.

All of them explode or project first and aggregate with partials, so a word or company
that holds a third of the rows is a few counters per task by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions.columns import location_match
from postingflow.operators.skew import rows_of_light_keys
from postingflow.schema import KEY
from postingflow.session import settle

RARE_LIMIT = 3


def project(df: DataFrame, columns, order=config.COLUMN_ORDER) -> DataFrame:
    """Only the wanted columns that exist, in the stated order; others of them at the end."""
    wanted = [c for c in columns if c in df.columns]
    return df.select(*[c for c in order if c in wanted], *[c for c in wanted if c not in order])


def companies_in_city(df: DataFrame, order: str, terms=config.COMPANY_CITY_TERMS) -> DataFrame:
    """Companies with a location in the city; ``first_seen`` gives their report order."""
    return (
        df.where(location_match(F.col("locations"), terms))
        .groupBy("company")
        .agg(F.min(order).alias("first_seen"))
    )


def keyword_counts(df: DataFrame, keywords=config.MAIN_KEYWORDS) -> DataFrame:
    """For each keyword, the postings whose ``keywords`` hold it; zero counts stay.

    The keyword list is plan-time data and the counts have one row per listed keyword, so
    both sides of the join are as small as the list.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "pos int, keyword string")
    hits = (
        df.select(F.explode(F.array_distinct("keywords")).alias("keyword"))
        .where(F.col("keyword").isin(list(keywords)))
        .groupBy("keyword")
        .agg(F.count("*").alias("postings"))
    )
    return listed.join(hits, "keyword", "left").select(
        "pos", "keyword", F.coalesce("postings", F.lit(0).cast("bigint")).alias("postings")
    )


def company_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("company").agg(F.count("*").alias("n"))


def rare_companies(df: DataFrame, limit: int = RARE_LIMIT) -> DataFrame:
    """Companies with at most ``limit`` postings."""
    return company_counts(df).where(F.col("n") <= limit)


def rare_company_postings(df: DataFrame, limit: int = RARE_LIMIT) -> DataFrame:
    """Postings of companies with at most ``limit`` postings."""
    return rows_of_light_keys(df.where(F.col("company").isNotNull()), "company", limit)


def word_profile(df: DataFrame, words: str = "matched_titlewords") -> DataFrame:
    """Per word: postings it matched, and postings where it was the only match.

    One shuffle answers the mandatory, optional and sole-match questions below.
    """
    return (
        df.select((F.size(words) == 1).cast("bigint").alias("sole"), F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("postings"), F.sum("sole").alias("sole_matches"))
    )


def mandatory_words(df: DataFrame, words: str = "matched_titlewords") -> DataFrame:
    """Words that are the only match of at least one posting."""
    return word_profile(df, words).where(F.col("sole_matches") > 0).select("word")


def optional_words(df: DataFrame, words: str = "matched_titlewords") -> DataFrame:
    """Words that are never the only match."""
    return word_profile(df, words).where(F.col("sole_matches") == 0).select("word")


def sole_match_counts(df: DataFrame, words: str = "matched_titlewords") -> DataFrame:
    return word_profile(df, words).where(F.col("sole_matches") > 0).select("word", "sole_matches")


def removal_impact(df: DataFrame, removed, words: str = "matched_titlewords") -> DataFrame:
    """Postings lost, kept and never matched when a set of words is no longer searched."""
    kept = F.array_except(words, F.array(*[F.lit(w) for w in removed]))
    matched = F.size(words) > 0
    return df.agg(
        F.count_if(matched & (F.size(kept) == 0)).alias("lost"),
        F.count_if(matched & (F.size(kept) > 0)).alias("kept"),
        F.count_if(F.coalesce(~matched, F.lit(True))).alias("unmatched"),
    )


EXACT_WORDS = 12


def smallest_word_set(df: DataFrame, words: str = "matched_titlewords", exact: int = EXACT_WORDS) -> DataFrame:
    """Words that are enough to find every posting some word found: ``pos``, ``word`` and
    ``newly_found`` (postings found by none of the words before).

    Postings are first reduced to their distinct word sets with counts. Up to ``exact`` words,
    every subset is tried and the smallest taken; of equals, the one whose last word by name
    comes first, then the last but one, and so on. Beyond, the words that some posting needs
    alone come first, then each time the word that finds most of what is left: at most
    1 + ln(m) times the
    smallest number, where m is the largest number of distinct word sets that hold one word
    (postings weigh equally there, so the most distinct sets decide). The words of a search
    are a configured list: one small job each. Null and empty lists are found by no word.
    """
    sets = settle(
        df.where(F.size(words) > 0).select(F.array_sort(F.array_distinct(F.array_compact(words))).alias("words"))
        .where(F.size("words") > 0).groupBy("words").agg(F.count("*").alias("postings")),
        "word_sets",
    )
    listed = [r["word"] for r in sets.select(F.explode("words").alias("word")).distinct().orderBy("word").collect()]
    chosen = _fewest(sets, listed) if len(listed) <= exact else _greedy(sets)
    return _in_order(sets, chosen)


def _without(sets: DataFrame, chosen) -> DataFrame:
    """The word sets that none of the chosen words finds."""
    return sets.where(~F.arrays_overlap("words", F.array(*[F.lit(w) for w in chosen]))) if chosen else sets


def _fewest(sets: DataFrame, listed: list[str]) -> list[str]:
    """Of all subsets of a short list, the smallest that meets every word set."""
    if not listed:
        return []
    bits = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(1 << i).alias("bit")) for i, w in enumerate(listed)])
    held = F.filter(bits, lambda b: F.array_contains("words", b["word"]))
    mask = F.aggregate(held, F.lit(0), lambda acc, b: acc + b["bit"])
    masks = [r["mask"] for r in sets.select(mask.alias("mask")).distinct().collect()]  # 2**exact at most
    needed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
    subsets = sets.sparkSession.range(1, 1 << len(listed)).where(F.forall(needed, lambda m: m.bitwiseAND(F.col("id")) != 0))
    best = subsets.orderBy(F.bit_count("id"), "id").first()["id"]
    return [w for i, w in enumerate(listed) if best >> i & 1]


def _greedy(sets: DataFrame) -> list[str]:
    alone = sets.where(F.size("words") == 1).select(F.get("words", F.lit(0)).alias("word"))
    chosen = [r["word"] for r in alone.orderBy("word").collect()]
    while best := _most_found(_without(sets, chosen), F.count("*")):
        chosen.append(best)
    return chosen


def _most_found(sets: DataFrame, worth) -> str | None:
    found = sets.select("postings", F.explode("words").alias("word")).groupBy("word").agg(worth.alias("worth"))
    best = found.orderBy(F.desc("worth"), "word").first()
    return best["word"] if best else None


def _in_order(sets: DataFrame, chosen: list[str]) -> DataFrame:
    """The chosen words by name, with the postings that the words before do not find."""
    spark = sets.sparkSession
    order = F.array(*[F.lit(w) for w in sorted(chosen)]) if chosen else F.array().cast("array<string>")
    first = F.get(F.array_intersect(order, F.col("words")), F.lit(0))
    found = sets.select(first.alias("word"), "postings").groupBy("word").agg(F.sum("postings").alias("newly_found"))
    listed = spark.createDataFrame(list(enumerate(sorted(chosen))), "pos int, word string")
    return listed.join(found, "word", "left").select("pos", "word", F.coalesce("newly_found", F.lit(0)).alias("newly_found"))


def column_coverage(df: DataFrame, columns=None) -> DataFrame:
    """Per column: in any row, in all rows, and in how many; one pass over the table."""
    columns = [c for c in df.columns if columns is None or c in columns]
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("present")) for c in columns]
    )
    return counts.select("_rows", F.explode(pairs).alias("c")).select(
        F.col("c.name").alias("column_name"),
        F.col("c.present").alias("present"),
        (F.col("c.present") > 0).alias("in_any"),
        (F.col("c.present") == F.col("_rows")).alias("in_all"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def run_counts(results: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Totals of a run as one table of three rows."""
    parts = [
        d.agg(F.count(KEY).alias("postings")).select(F.lit(name).alias("part"), "postings")
        for name, d in (("results", results), ("added", added), ("removed", removed))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def written_counts(parts: dict[str, DataFrame], write: Callable[[str, DataFrame], object], key: str = KEY) -> DataFrame:
    """Write tables by ``write(name, table)`` and give their totals (as ``run_counts``), counted
    as the rows are written: no table is computed or read again for its count.

    The count is taken in the tasks that write, each of which counts once however often it is
    tried, provided that ``write`` saves the rows as they come (a shuffle or a sort within
    ``write`` moves the count to tasks that a lost executor may repeat). Rows without a key are written
    and not counted; a table that is not written in ``write`` would wait for ever, so ``write`` must run.
    """
    totals = []
    for name, df in parts.items():
        seen = Observation(f"written_{name}")
        write(name, df.observe(seen, F.count(key).alias("postings")))
        totals.append((name, seen.get["postings"]))
    return next(iter(parts.values())).sparkSession.createDataFrame(totals, "part string, postings bigint")
