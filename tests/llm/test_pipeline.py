"""Each stage against a brute-force reading of what it must keep, and the whole pipeline."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postingflow.llm import mixing, queries, toxicity
from postingflow.session import settle
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, with_clashes
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_simhash import fingerprint, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, SF), name)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_stages_keep_columns(tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name in names[:-1]:
        assert tables[name][0].dtypes == tables[name][1].dtypes


def test_toxicity_stage(spark, tables):
    before, after = tables["toxicity"]
    bad = {r["doc_id"] for r in queries.QUERIES["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad


def test_exact_stage(tables):
    before, after = tables["exact_dedup"]
    best = {}
    for r in before.collect():
        key = hashlib.sha256(lowered(r["text"]).encode()).digest()
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())


def test_near_stage(tables):
    before, after = tables["simhash_near_dedup"]
    marks = {r["doc_id"]: fingerprint(r["text"]) for r in before.collect()}
    order = sorted(set(marks.values()))
    root = dict(zip(order, roots(order).tolist()))
    least = {}
    for i, m in marks.items():
        least[root[m]] = min(i, least.get(root[m], i))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least.values())


def test_mixing_stage(tables):
    before, after = tables["mixing"]
    assert sorted(map(tuple, before.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)


def test_packing_stage(tables):
    before, after = tables["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    sums = {}
    for r in rows:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 4096


def test_packing_follows_the_mix(spark, tables):
    """A sequence is opened by the first document of the mix that has no place yet."""
    mixed, packed = tables["mixing"][1], tables["packing"][1]
    place = {r["doc_id"]: (r["f"], r["r"]) for r in mixing.with_turns(mixed, "f", "r").collect()}
    firsts = {}
    for r in packed.collect():
        at = (*place[r["doc_id"]], r["start"])
        firsts[r["sequence_id"]] = min(at, firsts.get(r["sequence_id"], at))
    assert len(firsts) > 2 and [firsts[s] for s in sorted(firsts)] == sorted(firsts.values())


def test_run_gives_the_last_stage(spark, tables):
    got = entry.queries()["pipeline"](spark, SF)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, tables["packing"][1].collect()))


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls, repeats and clashing names, and labels without some rows."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(with_clashes(odd_documents()), SCHEMA + CLASH).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(40)] + [(None, None, None), (1, None, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_clean_keeps_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    model = queries.toxic_model(docs, queries.read(spark, odd_folder, "labels"))
    scores = toxicity.score(docs.select("doc_id", "text"), model)
    want = sorted(str(r["doc_id"]) for r in scores.where("predicted = 0").collect())
    kept = corpus_pipeline.clean(spark, docs, odd_folder)
    assert kept.dtypes == docs.dtypes
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert corpus_pipeline.clean(spark, docs.limit(0), odd_folder).isEmpty()


def test_run_over_odd_rows_and_empty_tables(spark, odd_folder, tmp_path):
    got = corpus_pipeline.run(spark, odd_folder)
    rows = got.collect()
    assert rows and all(r["length"] > 0 for r in rows)
    for name in ("documents", "labels"):
        queries.read(spark, odd_folder, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path))
    assert empty.columns == got.columns and empty.isEmpty()
