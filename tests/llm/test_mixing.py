from collections import Counter
from fractions import Fraction

import pytest

from postingflow.llm import mixing as M
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, None: 2}, {f"s{i}": 1 / (i + 1) for i in range(40)}])
def test_lag_below_one_block(weights):
    slots = M.whole_weights(weights, 1000)
    assert sum(slots.values()) == 1000
    plan = M.schedule(slots)
    assert [p[2] for p in plan] == list(range(1000))
    done = Counter()
    for name, block, now in plan:
        assert done[name] == block
        done[name] += 1
        for s, w in slots.items():
            assert abs(done[s] - Fraction(w * (now + 1), 1000)) < 1


def test_mix_against_weights(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(3000)]
    got = M.mix(stored(spark, rows, SCHEMA), {"big": 3, "small": 1}, block_rows=4, per_bucket=200).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(3000)) and sorted(r["doc_id"] for r in got) == list(range(3000))
    for n in (400, 800, 1600, 2000):
        share = sum(r["source"] == "big" for r in got[:n]) / n
        assert abs(share - 0.75) * n <= 2 * 4 + 4
    assert all(r["release"] <= r["turn"] < r["deadline"] for r in got)
    blocks = Counter((r["source"], r["block"]) for r in got)
    assert set(blocks.values()) == {4}
    order = [r["doc_id"] for r in got]
    assert order != sorted(order)


def test_odd_rows(spark):
    rows = with_clashes(odd_documents())
    docs = stored(spark, rows, SCHEMA + CLASH)
    mixed = M.mix(docs, per_bucket=5)
    got = mixed.collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    back = M.ordered(mixed, [c for c in docs.columns if c not in ("block", "position")], 10)
    assert back.count() == len(rows)
    assert M.mix(stored(spark, [], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, {"s0": 1})


@pytest.mark.parametrize("weights", [{"a": 7, "b": 2, "c": 1}, {"a": 30, **{f"s{i}": 70 / 19 for i in range(19)}}, {"a": 999, **{f"s{i}": 1 for i in range(999)}}])
def test_lag_against_the_given_weights(weights):
    slots = M.whole_weights(weights)
    names, total = list(slots), sum(slots.values())
    exact = [Fraction(weights[s]) / sum(map(Fraction, weights.values())) for s in names]
    seen = Counter()
    for n, (i, j, release, deadline, now) in enumerate(M.turns([slots[s] for s in names], total, [10**9] * len(names))):
        if n == 30_000:
            break
        assert now == n and seen[i] == j and release <= now < deadline
        assert abs(seen[i] - exact[i] * now) < 1
        seen[i] += 1
        assert abs(seen[i] - exact[i] * (now + 1)) < 1
    assert all(abs(seen[i] - p * 30_000) < 1 for i, p in enumerate(exact))


def test_mix_keeps_exact_shares(spark):
    rows = [(i, "t", "en", "abbbcccccc"[i % 10]) for i in range(35_000)]
    got = M.mix(stored(spark, rows, SCHEMA), {"a": 1, "b": 2, "c": 7}, block_rows=1).orderBy("position").select("source", "turn").collect()
    assert len(got) == len(rows)
    # c runs out after 30,000 slots: until then all slots are taken.
    done = Counter()
    for n, r in enumerate(got[:30_000]):
        assert r["turn"] == n
        done[r["source"]] += 1
        assert all(abs(done[s] - Fraction(w * (n + 1), 10)) < 1 for s, w in (("a", 1), ("b", 2), ("c", 7)))


def test_more_sources_than_ten_thousand(spark):
    rows = [(i, "t", "en", f"s{i}") for i in range(10_500)] + [(20_000 + i, "t", "en", None) for i in range(10_500)]
    weights = {None: 10_500, **{f"s{i}": 1 for i in range(10_500)}}
    got = M.mix(stored(spark, rows, SCHEMA), weights, block_rows=1).orderBy("position").select("source").collect()
    assert len(got) == len(rows)
    had = 0
    for n, r in enumerate(got):
        had += r["source"] is None
        assert abs(had - Fraction(n + 1, 2)) < 1


def test_sources_that_run_out_and_weights_of_zero(spark):
    rows = [(i, "t", "en", "few" if i < 3 else "many") for i in range(2000)]
    got = M.mix(stored(spark, rows, SCHEMA), {"few": 10**9, "many": 1}, block_rows=1).orderBy("position").collect()
    assert [r["source"] for r in got][:3] == ["few"] * 3 and len(got) == 2000
    assert all(r["release"] <= r["turn"] < r["deadline"] for r in got)
    with pytest.raises(ValueError):
        M.mix(stored(spark, rows, SCHEMA), {"few": 0, "many": 1})
