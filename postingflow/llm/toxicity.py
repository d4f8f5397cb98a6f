"""Toxicity: a learned lexicon, misspellings of its terms, and the words around a hit."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh
from postingflow.llm.letters import Letters
from postingflow.llm.tokens import slices
from postingflow.session import settle

SAMPLE = 12_000
STEMS = (4, 5, 6, 7)
LEAST_GAIN, STEM_GAIN, LEAST_SHARE, LEAST_TEXTS, MOST_ALIKE = 18.0, 40.0, 0.85, 2, 0.35
FUZZY_FROM, FUZZY_STEM_FROM = 5, 7
WINDOW = 6
BATCH_BYTES = 4 << 20
# Words that report someone's speech, and words that address someone (fixed values).
REPORTING = frozenset(
    "said says saying say wrote writes written called calls quote quoted quotes reported according word term "
    "sagte schrieb nannte zitat laut dijo escribió llamó cita según dit écrit appelé citation selon".split()
)
ADDRESSING = frozenset("you your youre u du dich dein ihr tú tu te eres vous toi ton".split())
QUOTES = np.array([ord(c) for c in '"“”„«»'], np.uint32)
FEATURES = ("hits", "fuzzy", "quoted", "addressed", "density")
PRIOR = np.array([-2.0, 2.0, -0.1, -0.5, 0.5, 1.0])  # bias, then the features


class Speller:
    """All lexicon terms within one edit, as the product of a Levenshtein automaton and a trie.

    A state is a set of (trie node, edits so far); states and moves are made when a text
    first needs them. Terms ending in ``*`` are stems, found at the start of a word. An edit
    is allowed in terms from a length on. Move 0 leads nowhere for good.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[int, int]] = [{}]
        self.edits, self.accepts, self.sticky = [-1], [-1], [-1]
        for term in terms:
            stem, letters = term.endswith("*"), term.rstrip("*")
            allowed = int(len(letters) >= (FUZZY_STEM_FROM if stem else FUZZY_FROM))
            node = 0
            self.edits[0] = max(self.edits[0], allowed)
            for c in map(ord, letters):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for per_node in (self.edits, self.accepts, self.sticky):
                        per_node.append(-1)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            (self.sticky if stem else self.accepts)[node] = allowed
        alphabet = sorted({c for kids in self.children for c in kids})
        self.classes = {c: i + 1 for i, c in enumerate(alphabet)}  # class 0: any other letter
        self.letters = [0, *alphabet]
        self.found: list[int] = []  # edits if the word ends here, -1 if it is no term
        self.held: list[int] = []  # edits if a stem has been read
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves = np.full((64, len(self.letters)), -1, np.int32)
        self._number(frozenset())
        self.moves[0] = 0
        self.start = self._number(self._skipped({(0, 0)})) if terms else 0
        self.class_table = np.zeros(max(alphabet, default=0) + 2, np.int32)
        for c, i in self.classes.items():
            self.class_table[c] = i

    def _skipped(self, states) -> frozenset:
        """With the states that leaving out letters of a term leads to."""
        out, todo = set(states), list(states)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if self.edits[child] > edits and (child, edits + 1) not in out:
                    out.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return frozenset(out)

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            n = self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.found.append(min((e for s, e in states if self.accepts[s] >= e), default=-1))
            self.held.append(min((e for s, e in states if self.sticky[s] >= e), default=-1))
            if n >= len(self.moves):
                self.moves = np.concatenate((self.moves, np.full_like(self.moves, -1)))
        return self.numbers[states]

    def _move(self, state: int, kind: int) -> int:
        out = set()
        for node, edits in self.sets[state]:
            for c, child in self.children[node].items():
                if c == self.letters[kind]:
                    out.add((child, edits))
                elif self.edits[child] > edits:
                    out.add((child, edits + 1))
            if self.edits[node] > edits:
                out.add((node, edits + 1))
        return self._number(self._skipped(out))

    def edits_of(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, edits) of the words that the automaton accepts; all words move at once."""
        words, edits = [], []
        live = np.arange(len(starts))
        state = np.full(len(starts), self.start, np.int32)
        step = 0
        while len(live):
            code = np.minimum(codes[starts[live] + step], len(self.class_table) - 1)
            kind = self.class_table[code]
            to = self.moves[state, kind]
            new = np.flatnonzero(to < 0)
            if len(new):
                for s, k in {*zip(state[new].tolist(), kind[new].tolist(), strict=True)}:
                    self.moves[s, k] = self._move(s, k)
                to = self.moves[state, kind]
            step += 1
            on = to > 0
            live, state = live[on], to[on]
            held, found = np.array(self.held)[state], np.array(self.found)[state]
            done = sizes[live] == step
            hit = held >= 0
            ended = done & ~hit & (found >= 0)
            words += [live[hit], live[ended]]
            edits += [held[hit], found[ended]]
            on = ~done & ~hit
            live, state = live[on], state[on]
        if not words:
            return np.array([], int), np.array([], int)
        words, edits = np.concatenate(words), np.concatenate(edits)
        order = np.argsort(words, kind="stable")
        return words[order], edits[order]


def _word(text: Letters, i: int) -> str:
    a = text.starts[i]
    return "".join(map(chr, text.raw[a : a + text.sizes[i]].tolist()))


def features(texts: list[str | None], speller: Speller, usual: frozenset = frozenset()) -> np.ndarray:
    """One row of ``FEATURES`` per text: hits by kind, with their context.

    Misspelled hits count as hits, and once more for themselves; ``usual`` words are no
    misspellings. A hit is quoted if an odd number of quotation marks stands before it in its line, or a
    reporting word stands within ``WINDOW`` words before it; it is addressed if an
    addressing word stands within the window.
    """
    text = Letters(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    words, edits = speller.edits_of(text.codes, text.starts, text.sizes)
    if not len(words):
        return out
    marks = np.cumsum(np.isin(text.raw, QUOTES))
    lines = np.flatnonzero(text.raw == 10)
    counts = np.bincount(text.owner, minlength=len(texts))
    for i, edit in zip(words.tolist(), edits.tolist(), strict=True):
        if edit and _word(text, i) in usual:
            continue
        doc, at = text.owner[i], text.starts[i]
        line = np.searchsorted(lines, at) - 1
        begin = max(text.begins[doc], lines[line] + 1 if line >= 0 else 0)
        open_ = (marks[at] - (marks[begin - 1] if begin else 0)) % 2 == 1
        near = [(j, _word(text, j)) for j in range(max(0, i - WINDOW), min(len(text.starts), i + WINDOW + 1)) if text.owner[j] == doc and j != i]
        quoted = bool(open_) or any(j < i and w in REPORTING for j, w in near)
        out[doc, 2 if quoted else 0] += 1
        out[doc, 1] += not quoted and edit > 0
        out[doc, 3] += not quoted and any(w in ADDRESSING for _, w in near)
    density = 20 * out[:, 0] / np.maximum(counts, 1)
    out[:, :4] = np.log1p(out[:, :4])
    out[:, 4] = np.minimum(density, 1)
    return out


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    usual: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())


def lexicon(sample: DataFrame) -> list[str]:
    """Terms and stems of (text, toxic) rows that stand out in toxic texts.

    Texts that share their least sentence hash are copies or near copies and count once, and
    they lie in one half of the sample: a term must stand out in both halves, so the rare
    words of a family of copies do not. It needs ``LEAST_TEXTS`` toxic texts and a share of
    ``LEAST_SHARE`` in each half and a log-likelihood ratio of ``LEAST_GAIN`` (a stem, which
    has more words to fit by chance, ``STEM_GAIN``) in all, and it
    must stand in different contexts (see ``varied``). Whole words of any length compete; the
    lengths limit stems alone. A stem must bring in more texts than
    any word of it, and takes the place of its words.
    """
    sentences = F.filter(F.split("text", r"[.\n]"), lambda x: F.length(x) >= 20)
    family = F.coalesce(F.array_min(F.transform(sentences, lambda x: F.xxhash64(x))), F.xxhash64("text"))
    once = settle(sample.groupBy(family.alias("family")).agg(F.max(F.struct("toxic", "text")).alias("row")).select("family", "row.*"), "once")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))

    def stems(n):
        longer = F.filter(F.col("w"), lambda w: F.length(w) > n)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))))

    listed = once.select("toxic", F.pmod("family", F.lit(2)).alias("half"), words.alias("w"))
    terms = listed.select("toxic", "half", F.explode(F.concat("w", *map(stems, STEMS))).alias("term"))
    n1, n0 = once.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return []
    sums = {f"{name}{half}": F.sum(F.when(F.col("half") == half, value).otherwise(0)) for half in (0, 1) for name, value in (("a", F.col("toxic")), ("n", F.lit(1)))}
    counts = terms.groupBy("term").agg(*[v.alias(k) for k, v in sums.items()])
    for half in (0, 1):
        counts = counts.where(f"a{half} >= {LEAST_TEXTS} AND a{half} >= {LEAST_SHARE} * n{half}")
    share = n1 / (n1 + n0)
    chosen = {}
    for r in counts.toLocalIterator():
        a, n = r["a0"] + r["a1"], r["n0"] + r["n1"]
        gain = 2 * (a * math.log(a / (n * share)) + ((n - a) * math.log((n - a) / (n * (1 - share))) if n > a else 0))
        if gain >= (STEM_GAIN if r["term"].endswith("*") else LEAST_GAIN):
            chosen[r["term"]] = a
    chosen = varied(once, chosen)
    kept: list[str] = []
    for term in sorted(chosen, key=lambda t: (len(t.rstrip("*")), t)):
        bare = term.rstrip("*")
        if any(k.endswith("*") and bare.startswith(k[:-1]) for k in kept):
            continue
        if term.endswith("*"):
            widest = max((n for t, n in chosen.items() if not t.endswith("*") and t.startswith(bare)), default=0)
            if chosen[term] < 1.25 * widest:
                continue
        kept.append(term)
    return kept


def varied(texts: DataFrame, chosen: dict[str, int]) -> dict[str, int]:
    """The terms that do not mostly follow one and the same word.

    Near copies repeat a word with its neighbours; an insult turns up anywhere.
    """

    def contexts(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = re.findall(r"[^\W\d_]+", text.lower())
                seen = set()
                for before, word in zip(["", *words], words, strict=False):
                    for term in (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)):
                        if term in chosen:
                            seen.add((term, before))
                found += seen
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["term", "before"])

    pairs = texts.select("text").mapInArrow(contexts, "term string, before string").groupBy("term", "before").agg(F.count("*").alias("n"))
    shares = pairs.groupBy("term").agg(F.sum("n").alias("n"), F.max("n").alias("top")).collect()
    return {r["term"]: chosen[r["term"]] for r in shares if r["top"] <= max(1, MOST_ALIKE * r["n"])}


def _weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards the prior weights."""
    x = np.column_stack([np.ones(len(x)), x])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + pull * ((w - PRIOR) ** 2).sum() / 2

    w = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def usual_words(sample: DataFrame, terms: list[str]) -> frozenset:
    """Words one edit from a term that stand in clean texts as often as in toxic ones."""

    def near(batches):
        speller = Speller(terms)
        for batch in batches:
            for a, b in slices(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                text = Letters(part.column("text").to_pylist())
                words, edits = speller.edits_of(text.codes, text.starts, text.sizes)
                words = words[edits > 0]
                forms = pa.array([_word(text, i) for i in words.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([forms, part.column("toxic").take(pa.array(text.owner[words]))], names=["form", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(near, "form string, toxic int").groupBy("form").agg(F.avg("toxic").alias("share"))
    return frozenset(r["form"] for r in counts.where("share <= 0.5").collect())


def _featured(docs: DataFrame, text: str, terms: list[str], usual: frozenset, name: str) -> DataFrame:
    """``docs`` without its text, with the text's features as an array."""
    rest = [c for c in docs.columns if c != text]
    schema = extended(docs.select(*rest), f"`{name}` array<double>")

    def run(batches):
        speller = Speller(terms)
        for batch in batches:
            for a, b in slices(batch.column(text), BATCH_BYTES):
                part = batch.slice(a, b - a)
                x = features(part.column(text).to_pylist(), speller, usual)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                found = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [found], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)


def train(labelled: DataFrame, text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn the lexicon and the weights of the context features.

    ``labelled`` is a sample of a size its caller bounds: only counts of terms that stand
    out and one row of features per text reach the driver.
    """
    sample = settle(labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(text, F.lit("")).alias("text"), F.col(label).cast("int").alias("toxic")), "sample")
    terms = lexicon(sample)
    usual = usual_words(sample, terms)
    rows = _featured(sample, "text", terms, usual, "x").toArrow()
    if not rows.num_rows:
        return ToxicityModel(terms, usual)
    x = np.array(rows["x"].to_pylist())
    return ToxicityModel(terms, usual, _weights(x, rows["toxic"].to_numpy().astype(float)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "toxic", bound: int = SAMPLE) -> DataFrame:
    """Documents with a label, at most ``bound`` label rows: those with the smallest id hash.

    One row per id, 1 if any of its labels is. The sample's ids are few enough to broadcast.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1))
    chosen = known.groupBy(id_column).agg(F.max(label).cast("int").alias(label)).orderBy(F.xxhash64(id_column), id_column).limit(bound)
    rest = docs.drop(*[c for c in docs.columns if c.lower() == label])
    return rest.join(F.broadcast(chosen), id_column)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (score >= 0.5), replacing such columns; keeps ``text`` out.

    Each row is scored for itself from its whole text; null and empty texts have no hit and
    get the score of a text without one.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    found = fresh(docs, "features")
    total = F.lit(float(model.weights[0]))
    for k, weight in enumerate(model.weights[1:].tolist()):
        total = total + F.get(found, F.lit(k)) * weight
    scored = _featured(docs, text, model.terms, model.usual, found).withColumn("score", 1 / (1 + F.exp(-total))).drop(found)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
