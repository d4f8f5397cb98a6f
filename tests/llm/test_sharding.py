from collections import Counter

import numpy as np
import pytest

from postingflow.llm import sharding as S
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes


def test_exact_sizes_and_whole_rows(spark):
    rows = odd_documents()
    docs = stored(spark, with_clashes(rows), SCHEMA + CLASH)
    for shards in (1, 8, 200):
        got = S.shard_rows(docs, shards, per_bucket=3).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_same_in_every_run_and_other_by_seed(spark):
    docs = stored(spark, [(i,) for i in range(500)], "doc_id bigint")
    at = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in S.shard_rows(docs, 4, seed).collect()}
    assert at(1) == at(1) != at(2)


def test_empty_and_bad(spark):
    docs = stored(spark, [], SCHEMA)
    assert S.shard_rows(docs, 8).columns == [*docs.columns, "shard", "slot"] and S.shard_rows(docs, 8).count() == 0
    with pytest.raises(ValueError):
        S.shard_rows(docs, 0)


def test_matrix_rows_and_columns():
    sizes = [50, 0, 7, 1000, 3]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rows = [S.matrix_row(p, starts, 7, 5) for p in range(5)]
    assert [int(r.sum()) for r in rows] == sizes
    total = np.sum(rows, axis=0)
    assert total.max() - total.min() <= 1 and total.sum() == 1060


def test_matrix_law():
    """Mean and variance of an entry are the hypergeometric ones."""
    starts = np.array([0, 30, 100])
    got = np.array([S.matrix_row(0, starts, 4, seed)[0] for seed in range(4000)])
    assert abs(got.mean() - 7.5) < 0.15
    assert abs(got.var() - 30 * 0.25 * 0.75 * 70 / 99) < 0.4


def test_large_draws_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    plain = np.array([S.hypergeometric(rng, 400, 900, 300) for _ in range(3000)])
    monkeypatch.setattr(S, "EXACT_ROWS", 10)
    own = np.array([S.hypergeometric(rng, 400, 900, 300) for _ in range(3000)])
    assert abs(plain.mean() - own.mean()) < 0.7 and abs(plain.std() / own.std() - 1) < 0.08
    assert S.hypergeometric(rng, 5, 6, 0) == 0 and S.hypergeometric(rng, 5, 6, 11) == 5
    monkeypatch.undo()
    assert abs(S.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**10) - 3 * 10**9) < 10**6
