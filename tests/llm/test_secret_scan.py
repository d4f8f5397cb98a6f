import hashlib
import math
import random
import re

from postingflow.llm import secret_scan as S
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy_spans(text, rank, a, base):
    """Every window's entropy from scratch."""
    out = []
    for m in re.finditer(a.regex, text or ""):
        run = m[0]
        if any(re.search(k, run) for k in S.ALLOWED) or not all(re.search(n, run) for n in a.needs):
            continue
        public = [k.span() for k in re.finditer("|".join(S.ALLOWED_WORDS), run)]
        merged = []
        for i in range(len(run) - a.window + 1):
            window = run[i : i + a.window]
            if any(s < i + a.window and e > i for s, e in public):
                continue
            if sum(S.weight(window.count(c)) for c in set(window)) <= a.limit:
                h = -sum(window.count(c) / a.window * math.log2(window.count(c) / a.window) for c in set(window))
                assert h >= a.bits - 1e-4
                if merged and merged[-1][1] >= i:
                    merged[-1][1] = i + a.window
                else:
                    merged.append([i, i + a.window])
        out += [(m.start() + s, rank, a.kind, m.start() + e) for s, e in merged]
    return [s for s in out if not any(b[0] <= s[0] and b[3] >= s[3] for b in base)]


def texts():
    rnd = random.Random(9)
    hexs = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rnd.choice(S.ALPHABETS[1].characters[:62]) for _ in range(n))
    out = [None, "", "é TOKEN = 'abcdefgh1'", "token=secret: abcdefgh123", "token == x", "AKIAAKIA" + "B" * 10, "AKIA", hexs(31), "é" + hexs(32) + "g" + hexs(64)]
    out += ["api_key:" + b64(30), b64(60), "a" * 50 + b64(30) + "a" * 60 + b64(30), "123e4567-e89b-12d3-a456-426614174000", "X" + b64(20) + "example" + b64(20)]
    out += [b64(40) + "example" + b64(40), "docs/examples/" + b64(44), b64(30) + "SAMPLEdummy" + b64(30) + "Example", "sha256-" + b64(43)]
    bits = ["password", "Secret", "apikey", ":", "=", " ", "'", '"', "AKIA", "é", "\n", "-", "."]
    out += ["".join(rnd.choice([*bits, hexs(9), b64(12), hexs(40).upper(), b64(40), "example", "0123456789abcdef"]) for _ in range(rnd.randint(1, 14))) for _ in range(250)]
    return [*out, "x " * 20000 + "token=" + b64(20), b64(3000)]


def test_spans_against_brute_force(spark):
    rows = list(enumerate(texts()))
    found = S.scan_secrets(stored(spark, rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in found.select("doc_id", "base", "found", S.joined(found["found"]).alias("spans"), S.joined(found["base"]).alias("b")).collect()}
    more = 0
    for i, text in rows:
        base = base_spans(text)
        every = sorted(base + [s for k, a in enumerate(S.ALPHABETS) for s in entropy_spans(text, 3 + k, a, base)])
        more += len(every) > len(base)
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        assert got[i]["b"] == joined(base), text
        assert got[i]["spans"] == joined(every), text
    assert more > 50


def test_words_of_examples_hide_only_the_windows_that_touch_them(spark):
    secret = "q7Zp0XvK2mWc9RtB4sLh8NdYf1GjTe6UaQo3Iw5EyPz"
    df = stored(spark, [(1, secret), (2, "docs/examples/" + secret), (3, "sha256-" + secret)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["found"] for r in S.scan_secrets(df).collect()}
    assert len(got[1]) == 1 and len(got[2]) == 1 and not got[3]
    assert got[2][0]["start"] >= 12 and got[2][0]["end"] == 14 + len(secret)


def test_many_candidates_take_linear_time(spark):
    import time

    def seconds(n):
        text = " ".join(["0123456789abcdef0123456789abcdef"] * n)
        df = stored(spark, [(1, text)], "doc_id bigint, text string")
        start = time.time()
        row = S.scan_secrets(df).selectExpr("size(base) AS n", "element_at(base, -1).end AS last").first()
        assert row["n"] == n and row["last"] == len(text)
        return time.time() - start

    seconds(100)
    small, large = seconds(20_000), seconds(40_000)
    assert large < 3 * small + 2 and large < 60


def test_odd_rows_and_names(spark):
    rows = with_clashes(odd_documents())
    df = stored(spark, rows, SCHEMA + CLASH).withColumnRenamed("slot", "base")
    out = S.scan_secrets(df)
    assert out.count() == len(rows) and out.columns.count("base") == 1
    assert S.scan_secrets(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = S.scan_secrets(stored(spark, [(1, "x")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_query_digest(spark):
    from postingflow.llm.queries import QUERIES

    row = QUERIES["op1_secret_scan"](spark, "/root/testdata/sf0.001").where("spans = ''").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()
