import random
import re

from pyspark.sql import functions as F

from postingflow.llm import url_filter as U
from postingflow.llm.queries import RULES
from tests.llm.helpers import stored


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(url):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def urls():
    rnd = random.Random(2)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "x.net", "net", "notexample.com", "com", "a.org", "ÄB.net", ""]
    paths = ["", "/", "/en/", "/en/1", "/en", "/fr/x", "/es/?q=/en/", "?a=://b.com/en/", "#/en/", "/EN/"]
    out = [None, "", "no scheme", "://", "http://", "a://b://c/d", "x?y=http://example.com/en/", "http://example.com/en/" + "z" * 5000, "http://h\n.net/es/\nq"]
    return out + [f"{rnd.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]


def test_rules_against_brute_force(spark):
    rows = list(enumerate(urls()))
    pages = stored(spark, [(*r, "h", "x") for r in rows], "page_id bigint, url string, host string, hit string")
    got = {r["page_id"]: r for r in U.judge(pages, "url", None, RULES).collect()}
    for i, url in rows:
        rule = rule_of(url)
        assert (got[i]["host"], got[i]["path"]) == parts(url), url
        assert got[i]["rule"] == (rule.text if rule else None)
        assert got[i]["verdict"] == (rule.verdict if rule else "allow")


def make_urls(n):
    rnd = random.Random(7)
    out = []
    for i in range(n):
        bad = i % 3 == 0
        host = f"{rnd.choice(['cheap', 'win', 'free'])}-{rnd.randrange(10**6)}.{rnd.choice(['biz', 'info'])}" if bad else f"{rnd.choice(['news', 'blog', 'docs'])}.site{rnd.randrange(20)}.org"
        path = f"/{rnd.randrange(10**9)}?id={rnd.randrange(10**6)}&ref=x" if bad else f"/{rnd.choice(['a', 'guide', 'post'])}/{rnd.choice(['intro', 'about'])}"
        out.append((i, f"https://{host}{path}", int(bad if rnd.random() > 0.02 else not bad)))
    return out


def test_held_out_accuracy(spark):
    rows = make_urls(900)
    labelled = stored(spark, [r for r in rows if r[0] % 4], "page_id bigint, url string, bad int")
    model = U.train(labelled, "url", "bad")
    held = stored(spark, [r for r in rows if not r[0] % 4] + [(10**6, None, 0), (10**6 + 1, "", 0)], "page_id bigint, url string, bad int")
    judged = U.judge(held, "url", model, ())
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    got = judged.where("url IS NOT NULL AND url <> ''").agg(F.avg(((F.col("verdict") == "block").cast("int") == F.col("bad")).cast("int")), F.count("*")).first()
    assert got[0] > 0.94 and got[1] == 225 and judged.count() == 227
    assert U.judge(held.limit(0), "url", model, RULES).count() == 0


def test_features_against_brute_force(spark):
    import math

    rows = list(enumerate(urls()))
    df = stored(spark, rows, "page_id bigint, url string")
    host, path = U.host_and_path(F.col("url"))
    got = df.select("url", *[v.alias(k) for k, v in U.lexical(F.col("url"), host, path).items()]).collect()
    for r in got:
        url = r["url"] or ""
        h, p = parts(url)
        assert r["length"] == len(url) and r["depth"] == len([s for s in p.split("/") if s])
        assert abs(r["digit_ratio"] - sum(c in "0123456789" for c in url) / max(1, len(url))) < 1e-9
        want = -sum(h.count(c) / len(h) * math.log2(h.count(c) / len(h)) for c in set(h))
        assert abs(r["host_entropy"] - want) < 1e-6
        assert r["parameters"] == (url.count("&") + 1 if "?" in url else 0)


def test_nothing_to_learn_from(spark):
    assert U.train(stored(spark, [], "url string, bad int"), "url", "bad") is None
    assert U.train(stored(spark, [("http://a.b/", 1)], "url string, bad int"), "url", "bad") is None
