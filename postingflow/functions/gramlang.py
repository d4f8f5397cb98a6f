"""Language of short phrases by character trigrams, as a JVM expression.

Each word, with a space at both ends, gives its trigrams; a trigram falls in one of ``SLOTS``
slots by its code points. A model holds one weight for each language and slot, so its size
depends on the number of languages alone. Weights are whole thousandths of log likelihoods:
sums are exact and the same anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow.functions.once import explode_once, let
from postingflow.functions.text import words

SLOTS = 8191  # a prime
BASE = 131


def slots(word: Column, size: int = SLOTS) -> Column:
    """The slots of a word's trigrams, repeats included; linear in the word."""
    letters = F.filter(F.split(F.concat(F.lit(" "), word, F.lit(" ")), ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.ascii(c).cast("bigint"))

    def tripled(c):
        last = F.greatest(F.size(c) - 3, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.pmod((F.get(c, i) * BASE + F.get(c, i + 1)) * BASE + F.get(c, i + 2), F.lit(size)).cast("int"),
        )

    return let(codes, tripled)


@dataclass(frozen=True)
class PhraseModel:
    """Weights by language, one for each slot, and the weight of a slot never met."""

    languages: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]


def weigh(n: Column, total: Column, size: int = SLOTS) -> Column:
    """Log likelihood of a slot met ``n`` times of ``total``, one added to every slot."""
    return F.round(F.log((n + 1) / (total + size)) * 1000).cast("bigint")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = SLOTS) -> PhraseModel:
    """Learn from all labelled texts; rows without text or label teach nothing.

    Words are counted first, so a word's trigrams are built once; the driver gets languages x
    slots rows. Without labelled words the model has no languages.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words(F.col(text)).alias("words"))
    each = explode_once(rows, F.col("words"), "word", "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    hit = each.select("lang", "n", F.explode(slots(F.col("word"), size)).alias("slot"))
    counts = hit.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    unseen = totals.select("lang", F.lit(-1).alias("slot"), weigh(F.lit(0), F.col("total"), size).alias("weight"))
    seen = counts.join(F.broadcast(totals), "lang").select("lang", "slot", weigh(F.col("n"), F.col("total"), size).alias("weight"))
    table: dict[str, list[int]] = {}
    found = unseen.unionByName(seen).collect()
    for row in found:
        if row["slot"] < 0:
            table[row["lang"]] = [row["weight"]] * size
    for row in found:
        if row["slot"] >= 0:
            table[row["lang"]][row["slot"]] = row["weight"]
    names = tuple(sorted(table))
    return PhraseModel(names, tuple(tuple(table[name]) for name in names))


def phrase_language(phrase: Column, model: PhraseModel, margin: int = 0) -> Column:
    """The likeliest language of a phrase; ties go to the first by name.

    NULL for a null phrase, for one without a word, where the best is no more than ``margin``
    thousandths ahead of the second (0 never asks), and where the model has no languages.
    """
    if not model.languages:
        return F.lit(None).cast("string")
    size = len(model.weights[0])
    tables = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>") for w in model.weights]

    def cost(found, table):
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, i: acc - F.get(table, i))

    def scored(found):
        costs = [
            F.struct(cost(found, table).alias("cost"), F.lit(name).alias("lang"))
            for name, table in zip(model.languages, tables, strict=True)
        ]
        return F.array_sort(F.array(*costs))

    def decided(ranked):
        best = F.get(ranked, F.lit(0))
        if margin <= 0 or len(model.languages) < 2:
            return best["lang"]
        return F.when(F.get(ranked, F.lit(1))["cost"] - best["cost"] > margin, best["lang"])

    found = F.flatten(F.transform(words(phrase), lambda w: slots(w, size)))
    return let(found, lambda f: F.when(F.size(f) > 0, let(scored(f), decided)))
