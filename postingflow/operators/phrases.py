"""Text statistics, service cost, and phrase mining.

Phrases are runs of one to three words of a document; the longest run at each word is dealt by
its first two words and counted there, and shorter phrases are counted from the distinct runs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions import gramlang
from postingflow.functions.once import explode_once, let
from postingflow.functions.text import language, ngrams, nlp_units, word_count, words
from postingflow.session import settle

# Runs that are looked at to find starts so frequent that one task would count too many of them.
HOT_SAMPLE = 10_000


def default_stopwords() -> tuple[str, ...]:
    """English and German stop words as shipped with Spark ML."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(
        dict.fromkeys(
            StopWordsRemover.loadDefaultStopWords("english")
            + StopWordsRemover.loadDefaultStopWords("german")
        )
    )


def text_stats(df: DataFrame, text: str = "description") -> DataFrame:
    """Rows, non-empty rows, and characters and words in total and per non-empty row."""
    filled = F.coalesce(F.length(text) > 0, F.lit(False))
    chars = F.when(filled, F.length(text))
    counted = df.select(
        filled.alias("filled"), chars.alias("chars"),
        F.when(filled, word_count(F.col(text))).alias("n_words"),
    )
    return counted.agg(
        F.count("*").alias("postings"),
        F.count_if("filled").alias("with_text"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.avg("chars").alias("avg_chars"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"),
        F.avg("n_words").alias("avg_words"),
    )


def nlp_cost(df: DataFrame, text: str = "description") -> DataFrame:
    """Price of sending every non-empty text to the service: one language probe of fixed
    size and one phrase request of the whole text each."""
    sent = df.where(F.length(text) > 0)
    units = nlp_units(F.col(text))
    price = F.lit(config.NLP_UNIT_PRICE)
    return sent.agg(
        F.count("*").alias("texts"),
        F.coalesce(F.sum(F.lit(config.NLP_MIN_UNITS)), F.lit(0)).alias("probe_units"),
        F.coalesce(F.sum(units), F.lit(0)).alias("phrase_units"),
    ).withColumn(
        "usd", ((F.col("probe_units") + F.col("phrase_units")) * price).cast("decimal(20,4)")
    )


def is_stopword(phrase: Column, stopwords) -> Column:
    return F.lower(phrase).isin(list(stopwords))


def keep_keywords(phrases: Column, stopwords) -> Column:
    """Phrases that are not themselves a stop word."""
    return F.filter(phrases, lambda p: ~is_stopword(p, stopwords))


def keep_keyphrases(phrases: Column, stopwords) -> Column:
    """Phrases of several words, none of them a stop word."""

    def good(phrase):
        parts = F.split(F.lower(phrase), " ")
        return (F.size(parts) > 1) & ~F.exists(parts, lambda w: w.isin(list(stopwords)))

    return F.filter(phrases, good)


def not_language(phrase: Column, code: str = "de") -> Column:
    """Longer than two characters and not detected as the language (undecided passes)."""
    return (F.length(phrase) > 2) & ~language(phrase).eqNullSafe(F.lit(code))


def known_other_language(phrase: Column, model: gramlang.PhraseModel, code: str = "de", margin: int = 0) -> Column:
    """Longer than two characters and detected as another language (undecided is dropped)."""
    found = gramlang.phrase_language(phrase, model, margin)
    return (F.length(phrase) > 2) & F.coalesce(found != code, F.lit(False))


def runs(tokens: Column, least: int = 1) -> Column:
    """For each token the longest run of up to three tokens that starts there; NULL where it
    has fewer than ``least``. A NULL token ends a run."""

    def longest(w, i):
        second, third = F.get(tokens, i + 1), F.get(tokens, i + 2)
        enough = w.isNotNull() if least < 2 else w.isNotNull() & second.isNotNull()
        return F.when(enough, F.concat_ws(" ", w, second, F.when(second.isNotNull(), third)))

    return F.transform(tokens, longest)


def word_runs(found: DataFrame, column: str = "tokens", stopwords=(), least: int = 1) -> DataFrame:
    """The runs of ``runs`` as rows: ``start``, the first two words (one, if there is no second),
    and ``third``. A stop word or a NULL token ends a run."""

    def kept(word):
        return F.when(~word.isin(list(stopwords)), word) if stopwords else word

    # The outer form, as in explode_once: a plain generator would evaluate the tokens again.
    at = found.select(column, F.posexplode_outer(column).alias("i", "first"))
    first, second, third = (kept(w) for w in (F.col("first"), F.get(column, F.col("i") + 1), F.get(column, F.col("i") + 2)))
    at = at.where(first.isNotNull() if least < 2 else first.isNotNull() & second.isNotNull())
    return at.select(F.concat_ws(" ", "first", second).alias("start"), F.when(second.isNotNull(), third).alias("third"))


def hot_starts(each: DataFrame) -> list[str]:
    """Starts that make up a hundredth of ``HOT_SAMPLE`` runs or more; at most a hundred.

    They only say which rows are spread over tasks, so counts are exact whatever runs are seen.
    """
    seen = each.limit(HOT_SAMPLE).groupBy("start").count().where(F.col("count") >= HOT_SAMPLE // 100)
    return [row["start"] for row in seen.collect()]


def run_counts(each: DataFrame, least: int = 1, min_count: int = 2) -> DataFrame:
    """Occurrences of the phrases of ``least`` to three words that begin a run, rarer ones left out.

    A token gives one run instead of up to three phrases. Most runs are rare, so they are dealt by
    ``start`` without counting them first; then runs of three words and those of two at their
    beginning are counted where they lie. Only for single words or hot starts is what is frequent
    enough shuffled again: a hot start's rows have a part for each task that read them, and the
    counts of the parts are summed there.
    """
    keys, enough = ["start"], F.col("n") >= min_count
    if hot := hot_starts(each):
        each = each.withColumn("part", F.when(F.col("start").isin(hot), F.spark_partition_id()))
        keys, enough = ["start", "part"], enough | F.col("part").isNotNull()
    whole = each.repartition(*keys).groupBy(*keys, "third").agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.lit(None).cast("string").alias("third"), F.lit(True).alias("some")),
                   F.struct("third", (F.col("third").isNotNull() & enough).alias("some")))
    counted = whole.select(*keys, "n", F.inline_outer(both)).where("some").groupBy(*keys, "third").agg(F.sum("n").alias("n"))
    if least > 1 and not hot:
        return counted.where(enough).select(F.concat_ws(" ", "start", "third").alias("phrase"), "n")
    word = F.substring_index("start", " ", 1)
    several = F.when(enough & (F.col("start") != word), F.concat_ws(" ", "start", "third"))
    found = [several] if least > 1 else [several, F.when(F.col("third").isNull(), word)]
    cut = counted.select("n", F.explode_outer(F.array(*found)).alias("phrase")).where("phrase IS NOT NULL")
    return cut.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def mine_keywords(df: DataFrame, stopwords, text: str = "description", min_count: int = 2) -> DataFrame:
    """Counts of all phrases that are not a stop word."""
    found = df.select(words(F.col(text)).alias("tokens"))
    return run_counts(word_runs(found), min_count=min_count).where(~is_stopword(F.col("phrase"), stopwords))


def _without(text: Column, stopwords) -> Column:
    """The words of a text, NULL in place of stop words."""
    return F.transform(words(text), lambda w: F.when(~w.isin(list(stopwords)), w))


def keyphrases(text: Column, stopwords) -> Column:
    """The phrases of several words of a text that hold no stop word."""
    return let(_without(text, stopwords), lambda tokens: F.concat(ngrams(tokens, 2), ngrams(tokens, 3)))


def mine_keyphrases(df: DataFrame, stopwords, text: str = "description", min_count: int = 2) -> DataFrame:
    """Counts of phrases of several words free of stop words.

    Stop words end a run before phrases are built, so no phrase is made to be dropped.
    """
    found = df.select(words(F.col(text)).alias("tokens"))
    return run_counts(word_runs(found, stopwords=tuple(stopwords), least=2), least=2, min_count=min_count)


def top_phrases(counts: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent phrases; ties in alphabetical order."""
    return counts.orderBy(F.desc("n"), "phrase").limit(n)


def bucket_of(phrase: Column, bits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), phrase), F.lit(1 << bits))


def frequent_phrases(
    phrases: DataFrame, n: int = 15, column: str = "phrases", min_count: int = 2, bits: int = 16, seed: int = 7,
) -> DataFrame:
    """The ``n`` most frequent phrases (ties in alphabetical order) without shuffling every phrase.

    Phrases are first counted by hash bucket, so a task sends at most 2**bits counters. The
    phrases of the fullest buckets, counted exactly, tell how often the ``n``-th phrase occurs
    at least; a bucket whose total is lower holds no phrase of the result. The phrases of the
    others are counted exactly, so the result is that of counting all, for every ``bits`` and
    ``seed``. The texts are read three times, or two if the first buckets were enough; that
    pays where distinct phrases are many. Null phrases do not count; no phrases, no rows.
    Buckets (2**bits at most) are broadcast.
    """
    each = explode_once(phrases, F.col(column), "phrase").withColumn("_bucket", bucket_of(F.col("phrase"), bits, seed))
    totals = settle(each.groupBy("_bucket").agg(F.count("*").alias("_total")), "buckets")

    def counted(buckets: DataFrame) -> DataFrame:
        held = each.join(F.broadcast(buckets.select("_bucket")), "_bucket", "left_semi")
        found = held.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
        return settle(top_phrases(found, n), "counted")

    fullest = totals.orderBy(F.desc("_total"), "_bucket").limit(4 * n)
    first = settle(fullest, "fullest")
    best = counted(first)
    known = best.agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    least = known["least"] if known["rows"] == n else min_count
    more = totals.where(F.col("_total") >= least).join(F.broadcast(first), "_bucket", "left_anti")
    if more.isEmpty():
        return top_phrases(best, n)
    return top_phrases(best.unionByName(counted(more)), n)
