import math

import numpy as np

from postingflow.llm import embedding_dedup as E
from postingflow.llm.queries import QUERIES
from tests.llm.helpers import stored

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """{place: (n_links, component_id, kept)} by comparing all pairs."""
    good = []
    for i, v, label in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and label is not None
        good.append(np.array(v, np.float32).astype(float) if ok else None)
    linked = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if (x / np.sqrt(x @ x)) @ (y / np.sqrt(y @ y)) >= cosine - 1e-12:
                    linked[a].add(b)
                    linked[b].add(a)
    out = []
    for a, (i, *_) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        component = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(linked[a]), component, component == i))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check(spark, rows, schema=SCHEMA, more=(), **settings):
    got = E.near_copies(stored(spark, [(*r, *more) for r in rows], schema), "vec_id", "embedding", "label", **settings)
    columns = got.columns
    assert "embedding" not in columns and columns[-3:] == ["n_links", "component_id", "kept"] and len(set(columns)) == len(columns)
    assert ordered(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == ordered(brute(rows))
    return got


def vectors(rng, n, d, spread):
    """Chains and clusters: each vector is a new one or near an earlier one."""
    out = [rng.normal(0, 1, d)]
    for _ in range(n - 1):
        base = out[rng.integers(len(out))]
        out.append(rng.normal(0, 1, d) if rng.random() < 0.3 else base + rng.normal(0, spread * np.sqrt(base @ base / d), d))
    return [[float(c) for c in np.float32(v)] for v in out]


def test_cells_and_blocks_lose_no_link(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rng, 700, 8, 0.4))]
    check(spark, rows, cell_rows=40, block_rows=30)


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(2)
    some = vectors(rng, 60, 6, 0.3)
    rows = [(i, v, 1) for i, v in enumerate(some)]
    rows += [(100 + i, some[0], 1) for i in range(40)] + [(200, some[0], 2), (201, some[0], None), (202, some[1], None)]
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [1.0] * 5, 1), (304, [None] * 6, 1), (305, [], 1)]
    rows += [(306, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 9), (307, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 9), (308, [1.0, 2.0], 1), (309, [1.0, 2.0], 1)]
    rows += [(None, some[0], 1), (None, [5.0, 5.0], 4), (None, [5.0, 5.0], 4), (310, some[2], 1), (310, some[2], 1), (310, some[3], 1)]
    rows += [(400, [3e38] * 6, 7), (401, [1e-38] * 6, 7)]
    got = check(spark, rows, SCHEMA + ", node string, cell int, kept string, group int, key string", ("n", 1, "k", 2, "x"), cell_rows=20, block_rows=16)
    assert {"node", "cell", "group", "key"} <= set(got.columns)


def test_tight_group_meets_by_the_bound(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, 16)
    rows = [(i, [float(c) for c in np.float32(base + rng.normal(0, 0.05, 16))], 0) for i in range(400)]
    rows += [(1000 + i, [float(c) for c in np.float32(rng.normal(0, 1, 16))], 0) for i in range(200)]
    rows += [(2000 + i, [float(c) for c in np.float32(base + rng.normal(0, 0.3, 16))], 0) for i in range(100)]
    check(spark, rows, cell_rows=50, block_rows=64)


def test_a_guest_goes_wherever_a_link_may_be():
    rng = np.random.default_rng(4)
    x = E._unit(rng.normal(0, 1, (400, 5)))
    for cosine in (0.8, 0.93, 0.99):
        c = E.fit_cells(x, 7)
        row, cell, home = E.places(x, np.ones(len(x), bool), c, cosine)
        assert home.sum() == len(x)
        at = dict(zip(row[home].tolist(), cell[home].tolist(), strict=True))
        where = {}
        for r, k in zip(row.tolist(), cell.tolist(), strict=True):
            where.setdefault(r, set()).add(k)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            first = min(at[a], at[b])
            assert first in where[a] and first in where[b]
            guest_cells = E.places(x[[b]], np.zeros(1, bool), c, cosine)[1]
            assert at[a] in guest_cells


def test_compare_counts_and_forest():
    x = E._unit(np.array([[1, 0], [1, 0.01], [0, 1], [1, 1.0]]))
    nx, ny, root = E.compare(x, x, np.ones(4, int), np.array([5, 1, 1, 1]), None, 0.9)
    assert nx.tolist() == [6, 6, 1, 1] and ny.tolist() == [2, 2, 1, 1]
    assert root.tolist() == [0, 0, 2, 3, 0, 0, 2, 3]
    limit = math.cos(0.3)
    pair = np.array([[1.0, 0.0], [math.cos(0.3), math.sin(0.3)]])
    assert E.compare(pair[:1], pair[1:], np.ones(1, int), np.ones(1, int), None, limit)[0].tolist() == [1]


def test_empty_table_and_no_labels(spark):
    assert E.near_copies(stored(spark, [], SCHEMA), "vec_id", "embedding", "label").count() == 0
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2), (3, [0.0, 1.0], None)]
    got = E.near_copies(stored(spark, rows, SCHEMA), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op12_embedding_near_dedup"](spark, sf_dir)
    assert dict(df.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert ordered(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()) == ordered(brute(rows))
