import random

import numpy as np
import pytest

from postingflow.llm import whitening as W
from postingflow.llm.queries import QUERIES
from tests.llm.helpers import stored

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n=300, d=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d)) @ rng.normal(0, 1, (d, d))
    return [[float(c) for c in np.float32(row)] for row in x]


def plain(rows, counts=False):
    """(id, x) of the rows that take part, and n, sums and covariance of the fit list."""
    good = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in rows]
    xs = [x for _, x in good] if counts else list(dict.fromkeys(x for _, x in good))
    n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    y = np.array([[a - s / n for a, s in zip(x, sums, strict=True)] for x in xs])
    return good, n, sums, y.T @ y / n


def check(got, rows, counts=False, k=16):
    good, n, sums, cov = plain(rows, counts)
    values = np.linalg.eigvalsh(cov)[::-1][:k]
    assert sorted(r["vec_id"] for r in got) == sorted(i for i, _ in good)
    by_id = {i: x for i, x in good}
    w = {}
    for r in got:
        x = by_id[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert np.allclose(r["explained"], values / np.trace(cov), rtol=1e-9) and 0 <= r["identity_error"] < 1e-8
        w[x] = r["whitened"]
    xs = [x for _, x in good] if counts else list(w)
    y = np.array([w[x] for x in xs])
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-8
    # The whitened values are the projections: x is got back from them in the plane they span.
    centred = np.array([[a - s / n for a, s in zip(x, sums, strict=True)] for x in xs])
    for j in range(k):
        direction = centred.T @ y[:, j] / n  # sqrt(e) times the unit eigenvector
        assert np.isclose(direction @ direction, values[j], rtol=1e-9)
        assert np.allclose(cov @ direction, values[j] * direction, atol=1e-6 * values[j])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy_with_copies_and_odd_rows(spark, weights):
    some = vectors()
    rows = [(i, v) for i, v in enumerate(some)] + [(1000 + i, some[i % 3]) for i in range(150)]
    odd = [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [float("inf")] * 24), (2004, []), (2005, [1.0] * 5)]
    table = stored(spark, [(i, v, 1, 7, "k", "w", 3) for i, v in rows + odd], SCHEMA + ", x int, key string, whitened string, n int")
    got = W.whiten(table, "embedding", weights)
    assert "key" in got.columns and "embedding" not in got.columns and got.columns.count("n") == 1
    check(got.collect(), rows, weights == "count")


def test_repeated_null_ids_and_no_variance(spark):
    got = W.whiten(stored(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA), "embedding").collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in got] == [(1, 0, [], 0.0)] * 3
    line = W.whiten(stored(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SCHEMA), "embedding").collect()
    assert all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-9 for r in line)
    with pytest.raises(ValueError):
        W.whiten(stored(spark, [], SCHEMA), "embedding", "two")


def test_huge_entries_are_exact_or_null(spark):
    rows = [(i, [float(1 << 40) * random.Random(i).randint(-8, 8), 1.0]) for i in range(12)]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(stored(spark, [(i, v, 0) for i, v in rows], SCHEMA), "embedding").collect()}
    good, n, sums, _ = plain(rows)
    for i, x in good:
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert got[i] == (want if want < 1 << 63 else None)
    far = W.whiten(stored(spark, [(1, [3.0e38], 0), (2, [-3.0e38], 0)], SCHEMA), "embedding").collect()
    assert len(far) == 2


def test_empty_table(spark):
    got = W.whiten(stored(spark, [], SCHEMA), "embedding")
    assert got.count() == 0 and "whitened" in got.columns


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = QUERIES["op11_whitening"](spark, sf_dir)
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    got = []
    for i, parts in by_id.items():
        assert sorted(parts) == list(range(1, 17))
        ordered = [parts[c] for c in sorted(parts)]
        got.append({
            "vec_id": i, "n": ordered[0]["n"], "deviation": ordered[0]["deviation"], "identity_error": ordered[0]["identity_error"],
            "whitened": [p["whitened"] for p in ordered], "explained": [p["explained"] for p in ordered],
        })
    check(got, [(r["vec_id"], r["embedding"]) for r in table.collect()])
