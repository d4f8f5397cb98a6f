import numpy as np

from postingflow.llm import language_id as L
from postingflow.llm.letters import Letters
from postingflow.llm.queries import QUERIES
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes


def test_letters_and_words():
    text = Letters(["Ab1c é", None, "", "你好 x", "'"])
    words = ["".join(map(chr, text.raw[s : s + n])) for s, n in zip(text.starts, text.sizes)]
    assert words == ["ab", "c", "é", "你好", "x"] and text.owner.tolist() == [0, 0, 0, 3, 3]
    assert len(L.trigrams(text)) == 7
    same = L.trigrams(Letters(["é. é"]))
    assert same[0] == same[1]


def model():
    rng = np.random.default_rng(0)
    return L.LanguageModel(["aa", "bb", "cc"], np.log(rng.dirichlet(np.ones(L.BINS) * 0.1, 3).T + 1e-9).astype(np.float32))


def plain_mixture(words, m, cost):
    """The same model fitted one text at a time, straight from its definition."""
    likes = np.exp([m.logs[L.trigrams(Letters([w]))].sum(axis=0) for w in words])
    likes = np.maximum(likes / likes.max(axis=1, keepdims=True), L.FLOOR)

    def fit(w, rounds):
        for _ in range(rounds):
            r = likes * w
            w = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return w, np.log(likes @ w).sum()

    w, best = fit(np.full(3, 1 / 3), L.ROUNDS)
    while (w > 0).sum() > 1:
        fewer = w.copy()
        fewer[np.where(w > 0, w, 9).argmin()] = 0
        fewer, now = fit(fewer / fewer.sum(), L.AGAIN)
        if now + cost < best:
            break
        w, best = fewer, now
    return w


def test_mixtures_against_one_by_one():
    rng = np.random.default_rng(5)
    m = model()
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(n)) for n in (1, 5, 40, 300, 2)] + ["", None, "12"]
    got = L.mixtures(Letters(texts), len(texts), m)
    for row, text in zip(got, texts):
        words = [w for w in (text or "").split() if w.isalpha()]
        want = plain_mixture(words, m, 0.5 * np.log(len(words)) + 1.0) if words else np.zeros(3)
        assert np.allclose(row, want, atol=2e-3)


def test_two_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = L.train(docs.where("doc_id % 2 = 0"))
    half = {r["lang"]: r["text"][:600] for r in docs.where("doc_id % 2 = 1 AND length(text) > 900").select("lang", "text").collect()}
    mixed = half["de"] + "\n" + half["es"]
    shares = dict(zip(m.languages, L.mixtures(Letters([mixed]), 1, m)[0]))
    assert shares["de"] > 0.3 and shares["es"] > 0.3 and shares["en"] == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and held["score"].between(0, 1).all()


def test_odd_rows(spark):
    docs = stored(spark, with_clashes(odd_documents()), SCHEMA + CLASH)
    m = L.train(docs)
    got = L.identify(docs, m).collect()
    assert len(got) == len(odd_documents())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (100, 101, 102)} == {"und"}
    nothing = L.train(docs.limit(0))
    assert nothing.languages == [] and {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), m).count() == 0
