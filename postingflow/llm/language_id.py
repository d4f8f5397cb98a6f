"""Language identification as a mixture: a document may hold several languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended
from postingflow.llm.letters import Letters
from postingflow.llm.tokens import slices

BINS = 1 << 16
SMOOTH = 0.5
ROUNDS, AGAIN = 6, 4
FLOOR = 1e-30
BATCH_BYTES = 4 << 20


def trigrams(text: Letters) -> np.ndarray:
    """The bin of each letter with its two neighbours (a word's edge counts as a space)."""
    c = text.codes
    at = np.flatnonzero(c)
    padded = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    h = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA6B) + padded[at + 2] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


@dataclass
class LanguageModel:
    """Log-likelihoods of trigram bins, one column per language: BINS x languages floats."""

    languages: list[str]
    logs: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count trigrams per language over all rows with a language.

    Tasks count into one array per language and give out sums, so what is shuffled is at
    most tasks x languages x BINS counts, and what the driver gets languages x BINS.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            tags = np.array(batch.column(lang).to_pylist(), object)
            for a, b in slices(batch.column(text), BATCH_BYTES):
                texts = batch.column(text).slice(a, b - a).to_pylist()
                for tag in set(tags[a:b]):
                    bins = trigrams(Letters([t for t, g in zip(texts, tags[a:b], strict=True) if g == tag]))
                    sums[tag] = sums.get(tag, 0) + np.bincount(bins, minlength=BINS)
        for tag, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tag] * len(used), pa.string()), pa.array(used), pa.array(total[used])], names=["lang", "bin", "n"]
            )

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias(lang), text)
    counts = known.mapInArrow(count, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    tags = np.array(counts["lang"].to_pylist(), object)
    languages = sorted(set(tags))
    table = np.full((BINS, len(languages)), SMOOTH)
    column = {g: i for i, g in enumerate(languages)}
    np.add.at(table, (counts["bin"].to_numpy(), np.array([column[g] for g in tags], int)), counts["n"].to_numpy())
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _fit(likes, sizes, weights, rounds):
    """EM for all documents at once: shares and log-likelihoods.

    ``likes`` are the words' likelihoods, document after document, ``sizes`` their numbers.
    """
    first = np.cumsum(sizes) - sizes
    ones = np.ones(likes.shape[1], np.float32)
    for _ in range(rounds):
        mixed = likes * np.repeat(weights, sizes, axis=0)
        total = mixed @ ones
        mixed /= total[:, None]
        weights = np.add.reduceat(mixed, first, axis=0) / sizes[:, None].astype(np.float32)
    total = (likes * np.repeat(weights, sizes, axis=0)) @ ones
    return weights, np.add.reduceat(np.log(total, dtype=np.float64), first)


def mixtures(text: Letters, texts: int, model: LanguageModel, price: float = 1.0) -> np.ndarray:
    """Shares of the languages in each text (rows of zeros for texts without a letter).

    A word is drawn from one language of the text's mixture; expectation-maximisation finds
    the shares. Then, one language at a time, the smallest is taken out and the others are
    fitted again, as long as the likelihood loses less than the language costs: half the
    log of the number of words, and ``price``.
    """
    shares = np.zeros((texts, len(model.languages)))
    if not len(text.starts) or not model.languages:
        return shares
    inside = np.cumsum(text.sizes) - text.sizes
    logs = np.add.reduceat(model.logs[trigrams(text)], inside, axis=0)
    likes = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), FLOOR).astype(np.float32)
    docs, sizes = np.unique(text.owner, return_counts=True)
    cost = 0.5 * np.log(sizes) + price
    even = np.full((len(docs), likes.shape[1]), 1 / likes.shape[1], np.float32)
    weights, fit = _fit(likes, sizes, even, ROUNDS)
    going = np.arange(len(docs))
    while len(going):
        going = going[(weights[going] > 0).sum(axis=1) > 1]
        if not len(going):
            break
        fewer = weights[going].copy()
        least = np.where(fewer > 0, fewer, np.inf).argmin(axis=1)
        fewer[np.arange(len(going)), least] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        some = np.zeros(len(docs), bool)
        some[going] = True
        fewer, now = _fit(likes[np.repeat(some, sizes)], sizes[going], fewer, AGAIN)
        better = now + cost[going] >= fit[going]
        going, fewer, now = going[better], fewer[better], now[better]
        weights[going], fit[going] = fewer, now
    shares[docs] = weights
    return shares


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", price: float = 1.0) -> DataFrame:
    """Replace ``text`` by ``lang_pred`` (largest share), ``score`` (that share) and ``mixture``.

    ``mixture`` has the chosen languages as ``tag:share`` by falling share. Texts without a
    letter, null ones included, get ``und``, 0 and an empty mixture, as do all texts if
    nothing was learned. Ties go to the language first in order. Each row is looked at for
    itself; input columns of the three names are replaced.
    """
    made = ("lang_pred", "score", "mixture")
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    schema = extended(docs.select(*rest), "lang_pred string, score double, mixture string")

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(text), BATCH_BYTES):
                part = batch.slice(a, b - a)
                shares = mixtures(Letters(part.column(text).to_pylist()), b - a, model, price)
                tags, scores, mixes = [], [], []
                for row in shares:
                    order = np.argsort(-row, kind="stable")
                    order = order[row[order] > 0]
                    tags.append(model.languages[order[0]] if len(order) else "und")
                    scores.append(min(1.0, float(row[order[0]])) if len(order) else 0.0)
                    mixes.append(",".join(f"{model.languages[i]}:{row[i]:.4f}" for i in order))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in rest] + [pa.array(tags, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())],
                    names=schema.names,
                )

    return docs.select(*rest, text).mapInArrow(run, schema)
