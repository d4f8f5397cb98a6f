"""Hand-derived rows for the text ladders and column helpers."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from postingflow import config
from postingflow.functions import columns as C
from postingflow.functions import literals, regex, scoring
from postingflow.functions import salary as S
from postingflow.functions.text import find_keywords, language, ngrams, tag_keywords, word_count, words
from postingflow.operators.enrich import location_penalty, split_sections
from postingflow.operators.filters import pattern_match

SALARY_CASES = [
    ("Gehalt: 30000 EUR brutto p.a.", (30000, 2500), (30000, 2500)),
    ("Salary: 2013,50 per month", (24156, 2013), (24156, 2013)),
    ("54321,00", (51852, 4321), (51852, 4321)),
    ("50000,00 gross", (50000, 4166), (50000, 4166)),
    ("Vergütung: 45.000 jährlich", (45000, 3750), (45000, 3750)),
    ("VERGÜTUNG: 45.000 JÄHRLICH", (45000, 3750), (45000, 3750)),
    ("ab 3.500,00 monatlich brutto", (42000, 3500), (42000, 3500)),
    ("2800", (33600, 2800), None),
    ("Salary: negotiable. 45000 gross", (45000, 3750), (45000, 3750)),
    ("Salary: negotiable\n45000 gross", (45000, 3750), None),
    ("45.000 brutto jährlich", (45000, 3750), (45000, 3750)),
    (None, None, None),
    ("no number", None, None),
]


def pair(row):
    return None if row is None else (row["annual"], row["monthly"])


def test_salary_fixtures(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SALARY_CASES)], "i int, t string")
    df = S.with_salary_from_text(df, F.col("t"), "whole")
    df = S.with_salary_from_description(df, F.col("t"), "section")
    for r in df.orderBy("i").collect():
        assert (pair(r["whole"]), pair(r["section"])) == SALARY_CASES[r["i"]][1:], r["t"]


def ladder_by_hand(text, factor=12):
    """The ladder in plain Python, from its written description."""
    if text is None:
        return None
    low = text.lower()
    plain = low.replace(".", "")

    def first(*patterns):
        for p in patterns:
            found = re.search(p, plain)
            if found:
                return int(found.group().split(",")[0])
        return 0

    year = month = 0
    if any(k in low for k in config.ANNUAL_KEYWORDS):
        year = first("[0-9]{6}", "[0-9]{5}")
    if not year:
        month = first("[0-9]{4},[0-9]{2}")
        if not month and any(k in low for k in config.MONTHLY_KEYWORDS):
            month = first("[0-9]{4}")
    if not year and not month:
        year = first("[0-9]{6},[0-9]{2}", "[0-9]{5},[0-9]{2}", "[0-9]{6}", "[0-9]{5}")
        if not year:
            month = first("[0-9]{4},[0-9]{2}", "[0-9]{4}")
    if year:
        return year, year // factor
    return (month * factor, month) if month else None


def section_by_hand(text):
    for p in config.SALARY_SECTION_PATTERNS:
        found = re.search(p, text, re.IGNORECASE)
        if found:
            return found.group()
    return None


def test_salary_against_python_on_random_text(spark):
    rng = random.Random(7)
    pieces = [
        "45.000", "3.500,00", "54321,00", "50000,00", "0000,00", "120000", "61500", "2800", "2.800", "12,345.67",
        " brutto", " Netto", " gross", " net", " tax", " p.a.", " jährlich", " monatlich", " per month", "Salary: ",
        "Gross: ", "Gehalt:", "\n", " und ", " EUR ", ".", ", ", " Vergütung: ", "99", " Grossbank ",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    df = S.with_salary_from_text(df, F.col("t"), "whole")
    df = S.with_salary_from_description(df, F.col("t"), "section")
    found = 0
    for r in df.collect():
        assert pair(r["whole"]) == ladder_by_hand(r["t"]), repr(r["t"])
        assert pair(r["section"]) == ladder_by_hand(section_by_hand(r["t"])), repr(r["t"])
        found += r["section"] is not None
    assert found > 300


def test_salary_dual_locale_and_site_factor(spark):
    df = spark.createDataFrame([("a", "EUR 3,500.00 monthly gross"), ("b", "3.500,00 brutto"), ("c", "none")], "k string, t string")
    rows = {r["k"]: pair(r["salary_guessed"]) for r in S.with_salary_dual_locale(df, F.col("t")).collect()}
    # The point style is tried first: there "3.500,00" holds the digits 50000.
    assert rows == {"a": (42000, 3500), "b": (50000, 4166), "c": None}
    factor = S.site_factor(F.lit("karriere.at"))
    row = S.with_salary_from_text(df, F.col("t"), factor=factor).where("k = 'b'").first()
    assert pair(row["salary_guessed"]) == (49000, 3500)


def test_salary_points(spark):
    points = S.salary_points(F.col("s"), 4100, knee=config.KNEE_RANKING)
    df = spark.createDataFrame([(s,) for s in (4100, 5100, 5740, 6740, 3100)], "s bigint")
    got = [r[0] for r in df.select(points).collect()]
    assert got == [Decimal(x) for x in ("0", "1.5", "2.46", "0.96", "-1.5")]


@pytest.mark.parametrize("text,expected", [
    ("We will build and support this product", "en"), ("Wir suchen und bieten", "de"), ("was", None),
    ("", None), ("für die Abteilung", "de"), (None, None),
])
def test_language(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(language(F.col("t"))).first()[0] == expected


def test_keywords_and_words(spark):
    df = spark.createDataFrame([("AI and graph ETL",)], "t string")
    tags = df.select(tag_keywords(F.col("t"), ["ETL", "graph", "AI", "Graph theory"])).first()[0]
    assert tags == ["ETL", "AI", "graph"]
    df = spark.createDataFrame([(" a b \n c ",), ("",), ("x",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [3, 0, 1]
    tri = df.select(F.array_compact(ngrams(words(F.lit("one two, three four")), 3)).alias("g")).first()[0]
    assert tri == ["one two three", "two three four"]


def test_locations(spark):
    df = spark.createDataFrame(
        [(["Graz", "Wien 04", "Linz", "Wien"],), (["Linz"],), (["Berlin"],), ([],), (["Berlin", "Vienna"],), (None,)],
        "l array<string>",
    )
    assert df.select(C.reorder_locations(F.col("l"), ["wien"])).first()[0] == ["Wien 04", "Wien", "Graz", "Linz"]
    penalty = location_penalty(F.col("l"), ("wien", "vienna", "remote"), ("linz", "graz"))
    assert [r[0] for r in df.select(penalty).collect()] == [0, -1, -2, 0, 0, 0]


def test_urls_and_cleaning(spark):
    def one(col):
        return spark.range(1).select(col).first()[0]

    for url, short in (("https://www.a.at/x", "a.at/x"), ("http://b.at/y", "b.at/y"), ("c.at", "c.at"), ("https://www.a.at/www.z", "a.at/")):
        assert one(C.reduce_url(F.lit(url))) == short
    assert one(C.hyperlink(F.lit("c.at"))) == "https://c.at"
    assert one(C.hyperlink(F.lit("http://c.at"))) == "http://c.at"
    assert one(C.url_build(F.lit("https://x.at/"), F.lit("a"), F.lit("b"))) == "https://x.at/a/b"
    assert one(C.query_from_url(F.lit("https://s?q=data engineer&p=2"), "https://s?q=")) == "data engineer"
    assert one(C.query_from_url(F.lit("https://other"), "https://s?q=")) is None
    assert one(C.trailing_id_from_url(F.lit("https://x/job/a/123/"))) == "123"
    assert one(C.clean_text(F.lit("  a\tb c\r\n"))) == "a b c"
    assert one(C.strip_control(F.lit("a\x00b\x0bc\td"))) == "abc\td"


def test_pattern_match(spark):
    df = spark.createDataFrame([("Straße mit Python",), (None,)], "t string")

    def run(*args, **kwargs):
        return [r[0] for r in df.select(pattern_match(F.col("t"), *args, **kwargs)).collect()]

    assert run(["STRASSE"], casefold=True) == [True, False]
    assert run(["STRASSE"]) == [False, False]
    assert run(["python", "rust"], casefold=True, mode="all") == [False, False]
    assert run([], mode="all") == [False, False]
    assert run([r"\bpython\b"], use_regex=True, ignore_case=True) == [True, False]
    assert run(["(ab"], use_regex=True) == [False, False]


def test_sections(spark):
    rows = [(list("abcdef"[:n]),) for n in range(7)]
    df = split_sections(spark.createDataFrame(rows, "sections array<string>"))
    got = [(r["role"], r["requirements"], r["nice_to_have"], r["benefits"]) for r in df.collect()]
    assert got == [
        (None, None, None, None), ("a", None, None, None), ("a", "b", None, None), ("a", "b", None, "c"),
        ("a", "b", "c", "d"), ("a", "b", None, "c\n d\n e"), ("a", "b", None, "c\n d\n e\n f"),
    ]


PATTERNS = [r[2] for r in config.STARTER_RULES + config.COMPANY_SCORING + config.TITLE_SCORING] + [
    *config.SALARY_SECTION_PATTERNS, *config.DROP_DESCRIPTION_PATTERNS, *config.GERMAN_HINTS, *config.ENGLISH_HINTS,
    r"(ab){0,2}cd", r"((netto|brutto) lohn)?x", r"(a(netto|brutto)|bb)", r"colou?r", r"consulting?", r"x{2,3}yz",
]


def test_required_words_are_sound():
    rng = random.Random(3)
    pieces = ["netto", "brutto lohn", "x", "abb", "bb", "anetto", "cd", "abcd", "color", "colour", "consultin", "consulting",
              "xxyz", "45000,00", " ", "deutsch", "sehr gut", "Salary:", "Gross:", "tax", "12.345,6", "lead", "AI", "Python", "ait"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 6)))
        for p in PATTERNS:
            needs = regex.required_words(p)
            if needs and re.search(p, text, re.IGNORECASE):
                assert any(w.lower() in text.lower() for w in needs), (p, text, needs)


def test_escapes_with_digits_and_named_groups(spark):
    cases = [(r"\x41bcd", "xAbcdx"), (r"ab\101cd", "abAcd"), (r"(?P<n>t)est", "TEST test"), (r"\u00e9cole", "école"), (r"\\101x", "\\101x"), (r"a\Z", "ba")]
    for pattern, text in cases:
        lowered = F.lower(F.lit(text))
        got = spark.range(1).select(
            regex.gated(F.lit(text), lowered, pattern), regex.gated(F.lit(text), lowered, pattern, True), regex.matches(F.lit("none"), pattern)
        ).first()
        assert list(got) == [bool(re.search(pattern, text)), bool(re.search(pattern, text, re.IGNORECASE)), False], pattern


def test_literal_first_is_equivalent():
    rng = random.Random(9)
    pieces = ["python", "Python", "pythons", " ", "-", "x", "_", "5", "ö"]
    for p in (r"\bpython\b", r"\bpython", r"\bpython\s+x", r"\bpythons?"):
        q = regex.literal_first(p)
        assert q != p or "?" in p
        for _ in range(800):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
            for flags in (0, re.IGNORECASE):
                assert bool(re.search(p, text, flags)) == bool(re.search(q, text, flags)), (p, text)


def test_scores_match_python(spark):
    rng = random.Random(5)
    pieces = ["graph data", "Graph", "machine learning", "(AI)", "HR", "x", "ETL pipelines", "öSAP", "Python", "home office", "python, sql", "German", "SAP ", "engineer"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.score(F.col("t"), config.STARTER_RULES).alias("s"))
    for r in df.collect():
        want = sum(
            Decimal(pts) for _, ic, p, pts in config.STARTER_RULES if re.search(p, r["t"], re.IGNORECASE if ic else 0)
        )
        assert r["s"] == want, r["t"]


def test_rule_set_forms(spark, tmp_path):
    nested = {"a": {"ignore_case": {"flags": int(re.IGNORECASE), "patterns": {"graph": 1.5}}, "case_sensitive": {"flags": 0, "patterns": {r"\bAI\b": 0.25}}},
              "b": {"deep": {"flags": 2, "patterns": {"x": -1}}}}
    rules = scoring.RuleSet.from_nested(nested)
    assert [(r.category, r.ignore_case, r.pattern, str(r.points)) for r in rules.rules] == [
        ("a", True, "graph", "1.5"), ("a", False, r"\bAI\b", "0.25"), ("deep", True, "x", "-1")]
    scoring.rules_frame(spark, rules).write.parquet(str(tmp_path / "rules.parquet"))
    assert set(scoring.RuleSet.load(spark, str(tmp_path / "rules.parquet")).rules) == set(rules.rules)
    taxonomy = scoring.RuleSet.from_nested({"tools": {"ignore_case": ["sql"], "case_sensitive": ["API"]}})
    tags = spark.range(1).select(scoring.tag_categories(F.lit("An api"), taxonomy), scoring.tag_categories(F.lit("An API"), taxonomy)).first()
    assert list(tags) == [[], ["tools"]]


def test_many_rules_compile(spark):
    rows = [("c", True, f"word{i}", "0.5") for i in range(400)] + [("c", False, rf"\bW{i}\b", "0.25") for i in range(60)]
    df = spark.createDataFrame([("word7 word70 W5 w6",), ("",)], "t string")
    got = [r[0] for r in df.select(scoring.score(F.col("t"), rows)).collect()]
    assert got == [Decimal("1.25"), Decimal(0)]


def _literal_pool(n, seed):
    rng = random.Random(seed)
    syllables = ["da", "ta", "sci", "en", "ce", "graph", " ", "-", "c++", "(ai)", ".net", "ö", "ß", "é", "x", "😀", "a", "an", "ana"]
    return list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n * 3)))[:n]


def test_literals_in_one_pass(spark):
    words = _literal_pool(300, 1) + [""]
    rng = random.Random(2)
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None, "banana " * 400, "\n\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", literals.literals_in(F.col("t"), words).alias("w"))
    for r in df.collect():
        assert r["w"] is None if r["t"] is None else sorted(r["w"]) == sorted(w for w in words if w and w in r["t"]), r["t"]
    assert spark.range(1).select(literals.literals_in(F.lit("a"), [""])).first()[0] == []


def test_large_rule_sets_match_python(spark):
    words = _literal_pool(260, 3)
    rng = random.Random(4)
    rules = [("c" + str(i % 7), i % 3 > 0, w if rng.random() < 0.3 else w.upper(), str(rng.randint(-9, 9) / 4)) for i, w in enumerate(words) if regex.is_literal(w)]
    rules += [("c" + str(i % 7), i % 2 > 0, p, "0.125") for i, p in enumerate([r"\bdata\b", r"(graph|sci)x?", r"^a", r"en\Z", r"d\w+ta", r"\s{2}"] + [rf"\b{w}" for w in words if w.isalpha()][:60])]
    rules += [("c9", True, "", "3"), ("c1", False, "data", "0.5"), ("c1", False, "data", "0.25")]
    assert sum(r[1] for r in rules) > literals.MANY < sum(not r[1] for r in rules)
    texts = ["".join(rng.choice([w, w.upper(), w.title(), " "]) for w in rng.choices(words, k=rng.randint(0, 9))) for _ in range(250)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", scoring.score(F.col("t"), rules).alias("s"), scoring.tag_categories(F.col("t"), rules).alias("tags")
    )

    def occurs(rule, text):
        _, ignore, p, _ = rule
        if regex.is_literal(p):  # as the lower-cased text holds the lower-cased word
            return p.lower() in text.lower() if ignore else p in text
        return re.search(p, text, re.IGNORECASE if ignore else 0) is not None

    categories = list(dict.fromkeys(r[0] for r in rules))
    for r in df.collect():
        hits = [rule for rule in rules if occurs(rule, r["t"] or "")]
        assert r["s"] == sum((Decimal(h[3]) for h in hits), Decimal(0)), r["t"]
        assert r["tags"] == [c for c in categories if any(h[0] == c for h in hits)], r["t"]


def test_many_keywords_match_python(spark):
    words = _literal_pool(150, 5)
    words += [words[0], words[1].upper(), "SQL", ""]
    rng = random.Random(6)
    texts = ["".join(rng.choice([w, w.upper(), " "]) for w in rng.choices(words, k=rng.randint(0, 9))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", find_keywords(F.col("t"), words).alias("loose"), find_keywords(F.col("t"), words, case_sensitive=True).alias("exact")
    )
    for r in df.collect():
        t = r["t"]
        assert r["exact"] == ([] if t is None else [w for w in words if w in t]), t
        assert r["loose"] == ([] if t is None else [w.lower() for w in words if w.lower() in t.lower()]), t
