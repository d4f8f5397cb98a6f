"""Bounded phrase counts, and the language of short phrases, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postingflow.functions import gramlang
from postingflow.functions.text import language
from postingflow.operators import phrases
from postingflow.session import settle

SF = "/root/testdata/sf0.01"


def _phrases(spark, rows):
    return settle(spark.createDataFrame([(r,) for r in rows], "phrases array<string>"), "test")


@pytest.mark.parametrize("bits,seed", [(0, 1), (2, 1), (2, 5), (6, 3), (12, 9)])
def test_frequent_phrases_equal_full_counts(spark, bits, seed):
    rnd = random.Random(seed)
    rows = [[f"p{int(rnd.paretovariate(0.6)) % 400}" for _ in range(rnd.randint(0, 30))] for _ in range(300)]
    rows += [None, [], [None, "p1"]] + [["hot phrase"] * 3] * 100
    for n in (1, 15, 2000):
        counts = Counter(p for r in rows for p in r or [] if p is not None)
        want = sorted(((-c, p) for p, c in counts.items() if c > 1))[:n]
        got = phrases.frequent_phrases(_phrases(spark, rows), n, bits=bits, seed=seed).collect()
        assert [(-r["n"], r["phrase"]) for r in got] == want


def test_frequent_phrases_keep_ties_and_rare_ones_out(spark):
    rows = [["b", "a", "c", "d"], ["a", "b", "c"], ["e"]]
    got = phrases.frequent_phrases(_phrases(spark, rows), 2, bits=3).collect()
    assert [(r["phrase"], r["n"]) for r in got] == [("a", 2), ("b", 2)]
    assert phrases.frequent_phrases(_phrases(spark, [["x", "y"]]), 5).isEmpty()
    assert phrases.frequent_phrases(_phrases(spark, [["x", "y"]]).limit(0), 5).isEmpty()


def _slots(word):
    w = f" {word} "
    return [((ord(a) * gramlang.BASE + ord(b)) * gramlang.BASE + ord(c)) % gramlang.SLOTS for a, b, c in zip(w, w[1:], w[2:])]


def test_slots_of_words(spark):
    words = ["a", "übung", "x" * 30_000, "ok😀k"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    got = {r["id"]: r["s"] for r in df.select("id", gramlang.slots(F.col("w")).alias("s")).collect()}
    assert all(got[i] == _slots(w) for i, w in enumerate(words))


def test_phrase_language_rules(spark):
    rows = [("the house and the garden", "en"), ("das haus und der garten", "de"), (None, "en"), ("nur text", None), ("", "de")]
    model = gramlang.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("de", "en") and all(len(w) == gramlang.SLOTS for w in model.weights)
    asked = spark.createDataFrame([("the garden",), ("Das Haus",), (None,), ("",), (" - ",), ("the garden " * 5000,)], "p string")
    found = [r[0] for r in asked.select(gramlang.phrase_language(F.col("p"), model)).collect()]
    assert found == ["en", "de", None, None, None, "en"]
    unsure = [r[0] for r in asked.select(gramlang.phrase_language(F.col("p"), model, margin=10**9)).collect()]
    assert unsure == [None] * 6
    kept = [r[0] for r in asked.where(phrases.known_other_language(F.col("p"), model)).collect()]
    assert kept == ["the garden", "the garden " * 5000]
    none = gramlang.train(spark.createDataFrame([], "text string, lang string"))
    assert asked.select(gramlang.phrase_language(F.col("p"), none).alias("l")).where("l IS NOT NULL").isEmpty()


def held_out_accuracy(spark, sf=SF):
    """Phrases of one to three words of held-out English and German texts: share right by
    trigrams learned from the other texts, and by the word lists."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = gramlang.train(docs.where(~held))
    cut = F.expr("regexp_extract_all(text, '[\\\\p{L}]+( [\\\\p{L}]+){0,2}', 0)")
    asked = docs.where(held & F.col("lang").isin("en", "de")).select("lang", F.explode(cut).alias("p")).distinct()
    answers = asked.select("lang", gramlang.phrase_language(F.col("p"), model).alias("grams"), language(F.col("p")).alias("lists"))
    row = answers.agg(
        F.count("*").alias("n"), F.avg(F.col("grams").eqNullSafe(F.col("lang")).cast("int")).alias("grams"),
        F.avg(F.col("lists").eqNullSafe(F.col("lang")).cast("int")).alias("lists"),
    ).first()
    return row["n"], row["grams"], row["lists"]


def test_held_out_phrases(spark):
    n, grams, lists = held_out_accuracy(spark)
    print(n, grams, lists)
    assert n > 1000 and grams > 0.8 and grams > lists


def _grams(tokens, least):
    return [" ".join(tokens[i : i + k]) for k in range(least, 4) for i in range(len(tokens) - k + 1) if None not in tokens[i : i + k]]


@pytest.mark.parametrize("min_count", [1, 2])
def test_mined_phrases_equal_plain_counts(spark, min_count):
    rnd = random.Random(8)
    pool = ["the", "und", "a", "b1", "c", "über", "x_y", "İ", "straße", "Q"]
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choices(pool, k=rnd.randint(0, 12))) for _ in range(300)] + [None, "", " - ", "the", "a b1"]
    stop = ("the", "und")
    df = settle(spark.createDataFrame([(t,) for t in texts], "description string"), "test")
    tokens = [[r for r in x[0] or []] for x in df.selectExpr("filter(split(lower(description), '[^\\\\p{L}\\\\p{N}_]+'), w -> w <> '')").collect()]
    many = Counter(p for t in tokens for p in _grams(t, 1) if p not in stop)
    several = Counter(p for t in tokens for p in _grams([None if w in stop else w for w in t], 2))
    for mined, want in ((phrases.mine_keywords, many), (phrases.mine_keyphrases, several)):
        got = [(r["phrase"], r["n"]) for r in mined(df, stop, min_count=min_count).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {p: n for p, n in want.items() if n >= min_count}


def test_a_word_gives_one_run(spark):
    """Not three phrases: these are counted from the distinct runs, which are shuffled once."""
    df = spark.createDataFrame([(["a", "b", None, "c", "d", "e"],), ([],), (None,)], "t array<string>")
    one, two = (df.select(phrases.runs(F.col("t"), least)).collect() for least in (1, 2))
    assert [r[0] for r in one] == [["a b", "b", None, "c d e", "d e", "e"], [], None]
    assert [r[0] for r in two] == [["a b", None, None, "c d e", "d e", None], [], None]


def test_phrase_language_equals_plain_costs(spark):
    rnd = random.Random(6)
    weights = tuple(tuple(rnd.randint(-9000, -1) for _ in range(gramlang.SLOTS)) for _ in range(3))
    model = gramlang.PhraseModel(("aa", "bb", "cc"), weights)
    pool = ["a", "Über", "straße", "o\U0001f600k", "x_1", "你好", "zz" * 40, "-", "..."]
    asked = [" ".join(rnd.choices(pool, k=rnd.randint(0, 7))) for _ in range(400)] + [None]
    df = settle(spark.createDataFrame([(t,) for t in asked], "p string"), "test")
    cells = F.filter(F.split(F.lower("p"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    for margin in (0, 3000):
        for words, got in df.select(cells, gramlang.phrase_language(F.col("p"), model, margin)).collect():
            costs = sorted((-sum(w[s] for x in words or [] for s in _slots(x)), name) for w, name in zip(weights, model.languages))
            sure = words and (not margin or costs[1][0] - costs[0][0] > margin)
            assert got == (costs[0][1] if sure else None)


def test_runs_as_rows_equal_runs(spark):
    rows = [(["a", "b", None, "c", "d", "e", "the", "f"],), ([],), (None,), ([None],)]
    df = spark.createDataFrame(rows, "t array<string>")
    for least in (1, 2):
        blanked = df.select(F.explode(phrases.runs(F.expr("transform(t, w -> if(w = 'the', null, w))"), least)).alias("r")).where("r IS NOT NULL")
        got = phrases.word_runs(df, "t", ("the",), least).collect()
        assert Counter(" ".join(w for w in r if w is not None) for r in got) == Counter(r["r"] for r in blanked.collect())


@pytest.mark.parametrize("min_count", [1, 2])
def test_hot_starts_are_spread_and_counted_whole(spark, min_count):
    texts = ["a b c"] * 150 + ["a b"] * 60 + ["a b the a", "x a b y", "a", "q r", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "description string").repartition(7)
    tokens = df.selectExpr("split(description, ' ') AS tokens")
    assert set(phrases.hot_starts(phrases.word_runs(tokens))) == {"a b", "b c", "c"}
    split = [(t or "").split() for t in texts]
    many = Counter(p for t in split for p in _grams(t, 1) if p != "the")
    several = Counter(p for t in split for p in _grams([None if w == "the" else w for w in t], 2))
    for mined, want in ((phrases.mine_keywords, many), (phrases.mine_keyphrases, several)):
        got = [(r["phrase"], r["n"]) for r in mined(df, ("the",), min_count=min_count).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {p: n for p, n in want.items() if n >= min_count}


def test_runs_are_shuffled_and_counted_once(spark):
    """One shuffle of the runs, one more where single words count; no run is built in a lambda."""
    df = spark.createDataFrame([("a b c a b c",)], "description string")
    for mined, shuffles in ((phrases.mine_keywords, 2), (phrases.mine_keyphrases, 1)):
        plan = mined(df, ("the",))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and "transform(" not in plan
