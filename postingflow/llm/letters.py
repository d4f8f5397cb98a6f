"""Texts as arrays of code points and letter words, for work on many texts at a time."""

from __future__ import annotations

import numpy as np

KNOWN = 0x3000  # below it, whether a code point is a letter is looked up in a table


class Letters:
    """Lower-cased texts end to end: ``codes`` with 0 for what is no letter, and the words.

    A word is a run of letters; ``starts`` and ``sizes`` give its place, ``owner`` its text.
    """

    table = None

    def __init__(self, texts: list[str | None]):
        if Letters.table is None:
            Letters.table = np.array([chr(i).isalpha() for i in range(KNOWN)])
        low = [(t or "").lower() for t in texts]
        raw = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), "<u4")
        letter = Letters.table[np.minimum(raw, KNOWN - 1)]
        rare = np.flatnonzero(raw >= KNOWN)
        if len(rare):
            kinds, which = np.unique(raw[rare], return_inverse=True)
            letter[rare] = np.array([chr(k).isalpha() for k in kinds.tolist()])[which]
        self.raw = raw
        self.codes = np.where(letter, raw, 0).astype(np.uint32)
        edges = np.diff(letter.astype(np.int8), prepend=0)
        self.starts = np.flatnonzero(edges == 1)
        self.sizes = np.flatnonzero(edges == -1) - self.starts  # a line end closes the last text
        lengths = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
        self.begins = np.cumsum(lengths) - lengths
        self.owner = np.searchsorted(self.begins, self.starts, side="right") - 1
