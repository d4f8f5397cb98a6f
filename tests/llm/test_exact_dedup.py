import hashlib

import pytest
from pyspark.sql import functions as F

from postingflow.llm import exact_dedup as E
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_owners_against_brute_force(spark):
    rows = odd_documents() + [(500, "ÉCOLE", "fr", "s"), (501, "École", "fr", "s"), (502, "école", "fr", "s"), (503, "éCOLE", "fr", "s")]
    docs = stored(spark, with_clashes(rows), SCHEMA + CLASH)
    index = E.open_scratch_index(spark, 4)
    got = E.assign_owners(docs, index, loads=3).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("d")).collect()
    index.close()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256(lowered(t).encode()).hexdigest(), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["d"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r["d"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)
    out = E.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len(groups)


def test_index_persists(spark):
    index = E.open_scratch_index(spark, 4)
    first = stored(spark, [(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert E.assign_owners(first, index).where("kept").count() == 2
    index.close()
    again = E.DigestIndex(spark, index.path, 4)
    got = E.assign_owners(stored(spark, [(7, "A"), (8, "c"), (9, "c")], "doc_id bigint, text string"), again)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()} == {(7, 1, False), (8, 9, False), (9, 9, True)}
    again.close()
    assert again.owners().count() == 3


def test_buckets_are_kept_with_the_index(spark):
    assert [E.buckets_for(n) for n in (0, 1, 128_000_000, 128_000_001, 100_000_000_000)] == [32, 32, 32, 64, 32768]
    index = E.open_scratch_index(spark, 4)
    index.append(spark.range(50).select(E.digest_of(F.col("id").cast("string")).alias("digest"), F.col("id").alias("keep_id"), F.col("id").alias("keep_row")))
    index.close()
    with pytest.raises(ValueError):
        E.DigestIndex(spark, index.path, 8)
    again = E.DigestIndex(spark, index.path)
    assert again.buckets == 4
    rows = spark.range(45, 60).select("id", E.digest_of(F.col("id").cast("string")).alias("digest"))
    assert sorted(r["id"] for r in again.unknown(rows).collect()) == list(range(50, 60))
    again.close()


def test_anti_join_moves_no_row_of_the_index(spark):
    index = E.open_scratch_index(spark, 4)
    rows = spark.range(3).select(E.digest_of(F.col("id").cast("string")).alias("digest"))
    plan = index.unknown(rows)._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    docs = stored(spark, [], "doc_id bigint, text string")
    assert E.drop_copies(docs).count() == 0
