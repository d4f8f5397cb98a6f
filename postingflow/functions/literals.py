"""Finding many literal texts in one pass: a trie as a regex, tried at every position.

A lookahead consumes nothing, so it is tried at each character, and its group holds the
longest literal that starts there. Shorter ones that start at the same place are its
prefixes, which are known beforehand; literals inside it start at a later place and are found
there. So the cost of a text hardly grows with the number of literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this many literals single ``contains`` tests are as fast.
MANY = 64


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() and ch.isascii() else f"\\x{{{ord(ch):x}}}"


def trie_pattern(words) -> str:
    """A Java regex that matches the longest of the words at a place."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [_quoted(ch) + written(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{body})?" if "" in node else body

    first = "".join(_quoted(ch) for ch in sorted(root))
    return f"(?=[{first}])(?=({written(root)}))"


def prefixes(words) -> dict[str, list[str]]:
    """For each word that begins with others: itself and those."""
    known = set(words)
    found = {w: [w[:n] for n in range(1, len(w) + 1) if w[:n] in known] for w in known}
    return {w: p for w, p in found.items() if len(p) > 1}


def literals_in(text: Column, words) -> Column:
    """The distinct words (not empty ones) that occur in the text, in no stated order."""
    words = sorted({w for w in words if w})
    if not words:
        return F.array().cast("array<string>")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(trie_pattern(words)), F.lit(1)))
    more = prefixes(words)
    if not more:
        return found
    closure = F.create_map(*[c for w, p in sorted(more.items()) for c in (F.lit(w), F.array(*map(F.lit, p)))])
    spread = F.transform(found, lambda w: F.coalesce(F.try_element_at(closure, w), F.array(w)))
    return F.array_distinct(F.flatten(spread))
