"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

All of it is column expressions within a row: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow.functions.once import let, materialize
from postingflow.llm.common import fresh


@dataclass(frozen=True)
class Pattern:
    """A fixed kind: the length of a group of the match decides whether the match counts."""

    kind: str
    regex: str
    group: int
    least: int


@dataclass(frozen=True)
class Alphabet:
    """A character class whose runs are candidates, and when a window of one is random.

    Characters that ``needs`` name must all occur in the run. ``bits`` is the least Shannon
    entropy of a window of ``window`` characters.
    """

    kind: str
    characters: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return f"[{self.characters.replace('-', '')}{'-' if '-' in self.characters else ''}]{{{self.window},}}"

    @property
    def limit(self) -> int:
        """Largest sum of weight(count) over a window's characters that is still random."""
        return round(self.window * (math.log2(self.window) - self.bits) * MICRO)


MICRO = 1_000_000
PATTERNS = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16),
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 is found at the run's start either way
)
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    Alphabet("entropy_hex", DIGITS + "ABCDEFabcdef", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    Alphabet("entropy_base64", DIGITS + LETTERS.upper() + LETTERS + "+/_=-", 24, 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
)
# Runs that look random and are public by purpose, and the words of examples: a window that
# touches such a word does not count, the rest of its run does.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^sha(256|384|512)-",
)
ALLOWED_WORDS = (
    r"(?i:example|sample|placeholder|changeme|dummy|redacted)",
    r"(?i:0123456789abcdef|abcdefghijklmnop)",
)


def weight(count: int) -> int:
    """count * log2(count) in millionths: entropy by sums of whole numbers, exact anywhere."""
    return round(count * math.log2(count) * MICRO) if count > 1 else 0


BLOCK = 256  # matches, or characters of a run, whose results are put together at once


def running(lengths: Column) -> Column:
    """Running sums of an array of whole numbers, as array<int> of the same length.

    Summed in blocks: an array that grows by one at each step would be copied each time.
    """
    none = F.array().cast("array<int>")
    size = F.size(lengths)

    def within(block):
        grown = F.aggregate(
            F.slice(lengths, block * BLOCK + 1, F.lit(BLOCK)),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")),
        )
        return grown

    def joined_(blocks):
        # The sum before each block: the same again over the blocks' own sums, a row in 256.
        before = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: x + at)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / BLOCK).cast("int"), F.lit(0))), within)
    return F.when(size > 0, let(blocks, joined_)).otherwise(none)


def placed(text: Column, regex: str) -> Column:
    """Matches with their places: array of (start, end, hit), leftmost non-overlapping.

    The pieces between matches and the matches take turns, so places are running sums of
    their lengths in code points.
    """
    kind = "array<struct<start:int,end:int,hit:string>>"
    none = F.array().cast(kind)

    def walked(found):
        hits, gaps = found["hits"], found["gaps"]
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        return F.zip_with(
            running(both), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"))
        ).cast(kind)

    found = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("gaps"))
    return F.when(text.rlike(regex), let(found, walked)).otherwise(none)


def _span(rank: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def pattern_spans(text: Column, pattern: Pattern, rank: int) -> Column:
    def long_enough(x):
        value = x["hit"] if not pattern.group else F.regexp_extract(x["hit"], pattern.regex, pattern.group)
        return F.length(value) >= pattern.least

    return F.transform(
        F.filter(placed(text, pattern.regex), long_enough),
        lambda x: _span(rank, pattern.kind, x["start"], x["end"]),
    )


def random_parts(run: Column, alphabet: Alphabet) -> Column:
    """Merged windows of a run whose entropy reaches the limit: array of (start, end).

    One pass: a character enters and another leaves, two counts change by one, and the
    window's sum of weights changes by the differences at those two counts.
    """
    w, size = alphabet.window, len(alphabet.characters)
    weights = F.array(*[F.lit(weight(c)).cast("bigint") for c in range(w + 1)])
    parts = "array<struct<start:int,end:int>>"
    # A run is ASCII; the split leaves an empty string at its end.
    letters = F.filter(F.split(run, "(?!^)"), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(alphabet.characters), c) - 1)

    def walk(codes):
        def step(acc, code):
            i = acc["i"]
            leaving = F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            changed = F.transform(
                acc["counts"],
                lambda n, k: n + F.when(k == code, 1).otherwise(0) - F.when(k == leaving, 1).otherwise(0),
            )
            entered = F.get(acc["counts"], code) + F.when(code == leaving, 0).otherwise(1)
            left = F.when(code == leaving, F.lit(0)).otherwise(F.coalesce(F.get(acc["counts"], leaving), F.lit(0)))
            total = (
                acc["sum"]
                + F.when(code == leaving, 0).otherwise(F.get(weights, entered) - F.get(weights, entered - 1))
                - F.when(left > 0, F.get(weights, left) - F.get(weights, left - 1)).otherwise(0)
            )
            hot = (i >= w - 1) & (total <= alphabet.limit)
            start, end = i - (w - 1), i + 1
            joins = hot & (acc["end"] >= start)
            done = F.when(hot & ~joins & (acc["end"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])
            return F.struct(
                end.alias("i"), changed.alias("counts"), total.alias("sum"),
                F.when(hot & ~joins, start).otherwise(acc["start"]).alias("start"),
                F.when(hot, end).otherwise(acc["end"]).alias("end"),
                done.alias("out"),
            )

        zero = F.struct(
            F.lit(0).alias("i"), F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
            F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(parts).alias("out"),
        )
        last = lambda acc: F.when(
            acc["end"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
        ).otherwise(acc["out"])
        return F.aggregate(codes, zero, step, last)

    return let(codes, walk)


def between(run: Column, regex: str) -> Column:
    """The parts of a run between the leftmost non-overlapping matches: array of (start, run)."""
    kind = "array<struct<start:int,run:string>>"

    def walked(found):
        # One gap more than hits: the last gap has no hit after it.
        lengths = F.zip_with(found["gaps"], found["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        ends = F.zip_with(running(lengths), found["hits"], lambda end, h: end - F.coalesce(F.length(h), F.lit(0)))
        return F.zip_with(ends, found["gaps"], lambda end, g: F.struct((end - F.length(g)).alias("start"), g.alias("run"))).cast(kind)

    found = F.struct(F.regexp_extract_all(run, F.lit(regex), F.lit(0)).alias("hits"), F.split(run, regex, -1).alias("gaps"))
    whole = F.array(F.struct(F.lit(0).alias("start"), run.alias("run"))).cast(kind)
    return F.when(run.rlike(regex), let(found, walked)).otherwise(whole)


def entropy_spans(text: Column, alphabet: Alphabet, rank: int, allowed=ALLOWED, words=ALLOWED_WORDS) -> Column:
    def candidate(x):
        wanted = F.lit(True)
        for need in alphabet.needs:
            wanted = wanted & x["hit"].rlike(need)
        for known in allowed:
            wanted = wanted & ~x["hit"].rlike(known)
        return wanted

    def parts(x):
        if not words:
            return F.array(F.struct(x["start"].alias("start"), x["hit"].alias("run")))
        return F.transform(
            between(x["hit"], "|".join(words)),
            lambda p: F.struct((x["start"] + p["start"]).alias("start"), p["run"].alias("run")),
        )

    def shifted(x):
        return F.transform(
            random_parts(x["run"], alphabet),
            lambda p: _span(rank, alphabet.kind, x["start"] + p["start"], x["start"] + p["end"]),
        )

    runs = F.flatten(F.transform(F.filter(placed(text, alphabet.regex), candidate), parts))
    return F.flatten(F.transform(F.filter(runs, lambda x: F.length(x["run"]) >= alphabet.window), shifted))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    df: DataFrame, text: str = "text", patterns=PATTERNS, alphabets=ALPHABETS, allowed=ALLOWED,
    words=ALLOWED_WORDS,
) -> DataFrame:
    """Add ``base`` and ``found``: spans (start, rank, kind, end) in code points, end exclusive.

    ``base`` are the matches of the fixed patterns. ``found`` adds the random-looking parts
    of candidate runs that no base span contains; allow-listed runs are left out, and so are
    windows that touch an allow-listed word. Null and empty texts have no spans; input columns of these two names are replaced. Rows are
    looked at one by one, so ties, repeats and empty tables need no rule.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("base", "found")])
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[pattern_spans(whole, p, i) for i, p in enumerate(patterns)])
    more = F.concat(*[entropy_spans(whole, a, len(patterns) + i, allowed, words) for i, a in enumerate(alphabets)])
    extra = fresh(df, "extra")
    spans = materialize(df, {"base": base, extra: more})
    outside = F.filter(
        F.col(extra), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    )
    return spans.withColumn("found", F.concat("base", outside)).drop(extra)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
