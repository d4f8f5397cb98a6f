"""The registered queries' columns against plain Python: op2, op4, op7, op10 (op9 has its own)."""

import zlib
from collections import Counter

import numpy as np
import pytest

from postingflow.llm.queries import QUERIES
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, with_clashes
from tests.llm.test_simhash import fingerprint, roots
from tests.llm.test_url_filter import parts, rule_of, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The given tables, and odd rows under clashing names."""
    odd = str(tmp_path_factory.mktemp("contract"))
    spark.createDataFrame(with_clashes(odd_documents()), SCHEMA + CLASH).write.parquet(f"{odd}/documents.parquet")
    rows = [(i, u, "x") for i, u in enumerate(urls())]
    spark.createDataFrame(rows, "page_id bigint, url string, verdict string").write.parquet(f"{odd}/pages.parquet")
    return {"given": SF, "odd": odd}


def _run(spark, folder, name, table, columns):
    given = spark.read.parquet(f"{folder}/{table}.parquet").select(*columns).collect()
    return given, QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("which", ["given", "odd"])
def test_sharding(spark, folders, which):
    docs, rows = _run(spark, folders[which], "op2_sharding", "documents", ["doc_id", "text"])
    text = lambda d: (d["text"] or "").encode()
    want = Counter((d["doc_id"], len(text(d)) + 1, zlib.crc32(text(d))) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)}
    assert sum(map(len, slots.values())) == len(docs)
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("which", ["given", "odd"])
def test_near_copies(spark, folders, which):
    docs, rows = _run(spark, folders[which], "op4_simhash_near_dedup", "documents", ["doc_id", "text"])
    marks = [fingerprint(d["text"]) for d in docs]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((d["doc_id"], f"{m:016x}") for d, m in zip(docs, marks, strict=True))
    distinct = sorted(set(marks))
    root = dict(zip(distinct, roots(np.array(distinct, np.uint64)).tolist(), strict=True))
    least = {}
    for d, m in zip(docs, marks, strict=True):
        if d["doc_id"] is not None:
            least[root[m]] = min(d["doc_id"], least.get(root[m], d["doc_id"]))
    by_mark = {f"{m:016x}": least.get(root[m]) for m in distinct}
    assert all(r["component_id"] == by_mark[r["fingerprint"]] for r in rows)


@pytest.mark.parametrize("which", ["given", "odd"])
def test_mixing(spark, folders, which):
    docs, rows = _run(spark, folders[which], "op7_mixing", "documents", ["doc_id", "source"])
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter(map(tuple, docs))
    rows.sort(key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(docs)))
    assert all(r["release"] <= r["turn"] < r["deadline"] for r in rows)
    assert [r["turn"] for r in rows] == sorted(r["turn"] for r in rows)
    assert max(Counter((r["source"], r["block"]) for r in rows).values()) <= 16


@pytest.mark.parametrize("which", ["given", "odd"])
def test_url_rules(spark, folders, which):
    pages, rows = _run(spark, folders[which], "op10_url_filter", "pages", ["page_id", "url"])
    assert sorted(r["page_id"] for r in rows) == sorted(p["page_id"] for p in pages)
    urls_ = {p["page_id"]: p["url"] for p in pages}
    for r in rows:
        rule = rule_of(urls_[r["page_id"]])
        assert (r["host"], r["path"]) == parts(urls_[r["page_id"]])
        assert r["rule"] == (rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
