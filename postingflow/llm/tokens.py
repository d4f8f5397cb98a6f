"""Token ids of whole texts by a public vocabulary with word ends (word_bpe_49k.json).

The vocabulary's splitter drops white space and never joins across it, and the last id of a
word ends with the word-end mark. A space can stand for that mark: it is no part of any
token. So the vocabulary is read as ranks of byte strings, and texts of ordinary characters
are tokenized as runs that end with a space, several times faster than by its own file.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
# Characters that the normalizer only lowers and the splitter classes as here, and runs short
# enough for the rank reader, which is quadratic in the length of a run.
TAME = re.compile("[\t\n\r\x20-\x7e\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\xff\u2013\u2014\u2018-\u201e\u2026]*")
RUN = re.compile(r"\S{400}")
APART = "('(?:re|ve|ll|[stmd])|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9 ]+)"


class WordEncoder:
    """Ids by the vocabulary file at ``path``, as the plain library call gives them.

    Special tokens' strings in a text become those tokens; with ``plain_specials`` they are
    ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        # A task has one core: threads of its own would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.plain_specials = path, plain_specials
        with open(path, encoding="utf-8") as f:
            source = json.load(f)
        self.specials = [] if plain_specials else [t["content"] for t in source["added_tokens"]]
        # A byte-level vocabulary writes a byte that isn't a visible character from 0x100 on.
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = {t["content"] for t in source["added_tokens"]}
        ranks = {}
        for token, i in source["model"]["vocab"].items():
            if token not in added:
                word = token.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in word) + (b" " if word != token else b"")] = i
        self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The file's own tokenizer, read when a text asks for it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = self.plain_specials
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has; null is empty."""
        plain = pc.fill_null(texts, "").to_pylist()
        rough = [
            k for k, t in enumerate(plain) if not TAME.fullmatch(t) or RUN.search(t) or any(s in t for s in self.specials)
        ]
        ids: list = [None] * len(plain)
        if rough:
            for k, e in zip(rough, self.full.encode_batch_fast([plain[k] for k in rough], add_special_tokens=False), strict=True):
                ids[k] = np.array(e.ids, np.uint32)
                plain[k] = ""
        # Marks, digits and endings such as 's are words of their own.
        lowered = pa.array([t.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ") + " " for t in plain])
        for k, t in enumerate(pc.replace_substring_regex(lowered, APART, r" \1 ").to_pylist()):
            if ids[k] is None:
                ids[k] = np.array(self.ranks.encode_ordinary(t), np.uint32)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([*ids, np.array([], np.uint32)]), counts


@lru_cache(maxsize=2)
def word_encoder(path: str, plain_specials: bool = False) -> WordEncoder:
    """Kept by the Python worker, which serves several tasks."""
    return WordEncoder(path, plain_specials)


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Cut a batch's texts into runs of about ``most`` bytes, a text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
