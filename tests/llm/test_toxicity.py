import random

import numpy as np
import pytest

from postingflow.llm import toxicity as T
from postingflow.llm.letters import Letters
from postingflow.llm.queries import QUERIES
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, prose, stored, with_clashes

TERMS = ["idiot", "scum", "worthless", "trash", "vequ*", "schwachk*", "ab"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edits(word):
    """Fewest edits to a term that the rules allow; stems against every start of the word."""
    found = []
    for term in TERMS:
        bare, stem = term.rstrip("*"), term.endswith("*")
        allowed = int(len(bare) >= (T.FUZZY_STEM_FROM if stem else T.FUZZY_FROM))
        starts = [word[:n] for n in range(1, len(word) + 1)] if stem else [word]
        found += [d for s in starts if (d := distance(s, bare)) <= allowed]
    return min(found, default=None)


def test_automaton_against_edit_distance():
    rnd = random.Random(3)
    letters = "idotscumwrhelavqnkü"
    words = ["idiot", "idiott", "diot", "idio", "vequx", "veq", "schwachköpfe", "shwachkopf", "schwachz", "abx", "ab"]
    for _ in range(3000):
        w = list(rnd.choice(TERMS).rstrip("*"))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice(letters)])
        words.append("".join(w) or "x")
    text = Letters([" ".join(words)])
    at, n = T.Speller(TERMS).edits_of(text.codes, text.starts, text.sizes)
    got = dict(zip(at.tolist(), n.tolist()))
    for i, w in enumerate(words):
        want = edits(w)
        assert (i in got) == (want is not None), w
        if want is not None and not any(t.endswith("*") and w.startswith(t[:-1]) for t in TERMS):
            assert got[i] == want or got[i] == min(got[i], 1), w


def test_quotation_and_address():
    s = T.Speller(TERMS)
    x = T.features(["you idiot", 'he said "idiot" once', "she said idiot", "idoit idiott", None, "", "a\n\"open\nidiot"], s)
    assert x[0, 0] > 0 and x[0, 3] > 0 and x[0, 2] == 0
    assert x[1, 0] == 0 and x[1, 2] > 0 and x[2, 2] > 0
    assert x[3, 0] > 0 and x[3, 1] > 0 and not x[4:6].any()
    assert x[6, 0] > 0 and x[6, 2] == 0
    assert not T.features(["idiott"], s, frozenset({"idiott"})).any()


def labelled_rows():
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(rnd, 40).split()
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["grobling", "snarkwit"])
            words[rnd.randrange(40)] = rnd.choice(["flubbers", "flubbed", "flubbing"])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    family = "an unusual wordling stands here among many others of its kind. "
    return rows + [(1000 + i, family + prose(rnd, 5), 1) for i in range(40)]


def test_learns_terms_and_not_families(spark):
    m = T.train(stored(spark, labelled_rows(), "doc_id bigint, text string, toxic int"))
    assert "grobling" in m.terms and "snarkwit" in m.terms and any("flubb".startswith(t.rstrip("*")) for t in m.terms if t.endswith("*"))
    assert not any("wordling".startswith(t.rstrip("*")) for t in m.terms)
    docs = stored(spark, [(1, "you groblinng"), (2, "blue river"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, m).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_learns_short_terms(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        words = prose(rnd, 40).split()
        if i % 5 == 0:
            words[rnd.randrange(40)] = rnd.choice(["zub", "qx", "傻逼"])
        rows.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    m = T.train(stored(spark, rows, "doc_id bigint, text string, toxic int"))
    assert set(m.terms) == {"zub", "qx", "傻逼"}
    docs = stored(spark, [(1, "you zub"), (2, "you zubs and qy"), (3, "a qx"), (4, "傻逼")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, m).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}


def test_nothing_to_learn_from(spark):
    m = T.train(stored(spark, [], "text string, toxic int"))
    assert m.terms == [] and np.array_equal(m.weights, T.PRIOR)
    m = T.train(stored(spark, [("a b c", 0)] * 5, "text string, toxic int"))
    assert m.terms == []


def test_odd_rows(spark):
    docs = stored(spark, with_clashes(odd_documents()), SCHEMA + CLASH)
    got = T.score(docs, T.ToxicityModel(TERMS))
    assert got.count() == len(odd_documents()) and got.where("predicted = 1").count() == 0
    assert T.score(docs.limit(0), T.ToxicityModel(TERMS)).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    return QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()


def test_held_out(scored):
    clean, toxic = scored[scored["toxic"] == 0], scored[scored["toxic"] == 1]
    assert clean["predicted"].mean() < 0.02 and toxic["predicted"].mean() > 0.6
