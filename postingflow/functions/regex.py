"""Python ``re`` patterns as literals for Spark's Java regex engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes whose digits or letters belong to them (\\x41, \\101, \\N{...}), and repeats.
_NUMBERED = re.compile(r"\\[xuUN0-9]")
_META = set(r".^$*+?{}[]\|()")


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Java spelling of a Python pattern.

    ``U`` gives Python's Unicode ``\\b \\w \\s``, ``u`` its Unicode case folding and ``d``
    its line-end rule (only ``\\n`` ends a line).
    """
    flags = "(?iuUd)" if ignore_case else "(?Ud)"

    def escape(found: re.Match) -> str:
        if found[1]:
            return rf"\0{found[1]}"  # three octal digits
        return r"\z" if found[0] == r"\Z" else found[0]

    return flags + re.sub(r"\\(?:([0-3][0-7]{2})|.)", escape, pattern, flags=re.DOTALL).replace("(?P<", "(?<")


def is_valid(pattern: str) -> bool:
    """Whether Python accepts the pattern (an invalid one is used as a literal)."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def is_literal(pattern: str) -> bool:
    return not any(ch in _META for ch in pattern)


def required_words(pattern: str) -> tuple[str, ...]:
    """Literal texts of which at least one must occur wherever the pattern matches.

    Either one plain run of the pattern, or the branches of a group of plain words such as
    ``(netto|brutto|gross)``. Empty when there is no safe answer; looking for these words
    first is far cheaper than running the regex over a long text.
    """
    if re.search(r"\\[()\[\]|]|\(\?[^:!]", pattern) or _NUMBERED.search(pattern):
        return ()
    flat = re.sub(r"\[[^\]]*\]", "\0", pattern)
    branches: tuple[str, ...] = ()
    while True:
        group = re.search(r"\((\?[:!])?([^()]*)\)([?*+]|\{[^}]*\})?", flat)
        if group is None:
            break
        words = group[2].split("|")
        needed = group[1] != "?!" and group[3] in (None, "+")
        outermost = "(" not in flat[: group.start()]
        if needed and outermost and not branches and all(len(w) > 1 and w.isalpha() for w in words):
            branches = tuple(words)
        flat = flat[: group.start()] + "\0" + flat[group.end():]
    if "|" in flat:
        return ()
    # A character before an optional quantifier may be absent; escapes are classes or edges.
    flat = re.sub(r"\\.", "\0", flat)
    flat = re.sub(r".[?*{][^\0]*?(?=[^?*}0-9,]|$)", "\0", flat)
    runs = [r for r in re.split(r"[\0.^$*+?{}]", flat) if len(r) > 1]
    if runs:
        return (max(runs, key=len),)
    return branches


def gated(text: Column, lowered: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``matches`` behind a ``contains`` test of the words the pattern needs."""
    test = matches_lowered(text, lowered, pattern) if ignore_case else matches(text, pattern)
    words = required_words(pattern)
    if not words:
        return test
    haystack = lowered if ignore_case else text
    gate = None
    for word in words:
        hit = F.contains(haystack, F.lit(word.lower() if ignore_case else word))
        gate = hit if gate is None else gate | hit
    return gate & test


def literal_first(pattern: str) -> str:
    """The same pattern with a leading word edge tested after the literal that follows it.

    ``\\bword`` tests for an edge at every character of a text; ``word(?<=\\bword)`` only
    where the word stands.
    """
    found = re.match(r"\\b([^\W\d_]{2,})(?![?*+{|])", pattern)
    if found is None or "|" in pattern:
        return pattern
    word = found[1]
    return f"{word}(?<=\\b{word}){pattern[found.end():]}"


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``re.search`` as a boolean column; the pattern is a literal, so it compiles once."""
    return F.rlike(text, F.lit(java_pattern(literal_first(pattern), ignore_case)))


def matches_lowered(text: Column, lowered: Column, pattern: str) -> Column:
    """``matches`` ignoring case, on text already lowered where the pattern allows it.

    A lowered pattern on lowered text needs no case-insensitive matching, which is slow.
    """
    if re.search(r"\\[A-Z]|\[|\(\?P", pattern) or _NUMBERED.search(pattern):
        return matches(text, pattern, ignore_case=True)
    return matches(lowered, pattern.lower())


def search(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """First match of a pattern that cannot match the empty string, else NULL."""
    return F.nullif(
        F.regexp_extract(text, java_pattern(pattern, ignore_case), group), F.lit("")
    )


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
