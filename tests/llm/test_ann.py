import numpy as np
import pytest

from postingflow.llm import ann as A
from postingflow.llm.queries import QUERIES
from tests.llm.helpers import stored

KIND = "vec_id bigint, embedding array<float>, label int"


def exact(rows, k=20, step=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % step == 0]:
        scores = np.cumsum(x * good[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def search(spark, rows, **options):
    vectors = A.prepared(stored(spark, rows, KIND), "vec_id", "embedding")
    index = A.build(vectors, list_rows=16)
    out = {}
    for r in A.nearest(vectors, vectors.where("id % 20 = 0"), index, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_all_lists_give_the_exact_answer(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).tolist(), 0) for i in range(300)]
    rows += [(i, [1.0] * 8, 0) for i in range(300, 420)]  # equal vectors: ties go to the smaller id
    rows += [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [None] * 8, 0), (1080, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    want = exact([r for r in rows if r[0] != 1080])
    got = search(spark, rows, ratio=1e9, lists=10**6)
    assert got == want


def answers(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_both_sides_of_a_list_that_cannot_be_cut_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 40)
    monkeypatch.setattr(A, "QUERY_ROWS", 25)
    monkeypatch.setattr(A, "LEVELS", 0)
    sides = []
    dealt = A._dealt
    monkeypatch.setattr(A, "_dealt", lambda *tables: sides.append(dealt(*tables)) or sides[-1])
    rng = np.random.default_rng(7)
    rows = [(i * 5, rng.normal(size=6).tolist(), 0) for i in range(600)]  # 150 queries, all in one list
    vectors = A.prepared(stored(spark, rows, KIND), "vec_id", "embedding")
    index = A.build(vectors, list_rows=1000)
    got = answers(A.nearest(vectors, vectors.where("id % 20 = 0"), index, k=7))
    assert len(index.centroids) == 1 and got == exact(rows, k=7)
    for side, most in zip(sides[0], (40, 25)):
        sizes = [r["count"] for r in side.groupBy("list", "block", "query_block").count().collect()]
        assert len(sizes) == 16 * 7 and max(sizes) < 3 * most


@pytest.mark.parametrize("clusters", [0, 25])
def test_lists_grow_with_the_table(spark, monkeypatch, clusters):
    """Cut lists of bounded length, at two sizes from the same small sample; recall on both kinds."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 64)
    monkeypatch.setattr(A, "ROUTE_ROWS", 100)
    sides = []
    dealt = A._dealt
    monkeypatch.setattr(A, "_dealt", lambda *tables: sides.append(dealt(*tables)) or sides[-1])
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(max(1, clusters), 8)) * (3 if clusters else 0)
    lists, read = [], []
    for size in (1000, 3000):
        rows = [(i, (centres[i % len(centres)] + rng.normal(size=8)).tolist(), 0) for i in range(size)]
        vectors = A.prepared(stored(spark, rows, KIND), "vec_id", "embedding")
        index = A.build(vectors, sample=200, list_rows=50)
        got = answers(A.nearest(vectors, vectors.where("id % 20 = 0"), index, k=10))
        want = exact(rows, k=10)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in top}) for q, top in want.items())
        assert hits >= 0.9 * sum(map(len, want.values()))
        assert all(got[q] == top for q, top in want.items() if {i for i, _ in got[q]} == {i for i, _ in top})
        made = [r["count"] for r in sides[-1][0].groupBy("list").count().collect()]
        assert max(made) <= 2 * 64 and sides[-1][0].select("id").distinct().count() == size
        lists.append(len(made))
        read.append(sides[-1][1].count() / len(want) / len(made))
    assert len(index.centroids) <= 8 and lists[1] > 2 * lists[0] > 16
    assert not clusters or read[1] < 0.5


def test_equal_vectors_leave_only_those_that_can_be_answers(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(400)] + [(i, [float(i), 1.0], 0) for i in range(400, 420)] + [(7, [1.0, 2.0], 0)] * 30
    vectors = A.prepared(stored(spark, rows, KIND), "vec_id", "embedding")
    kept = [r["id"] for r in A.first_of_equals(vectors, 5).collect()]
    assert sorted(kept) == [*range(6), *range(400, 420)]
    got = answers(A.nearest(vectors, vectors.where("id % 20 = 0"), A.build(vectors), k=30, ratio=1e9))
    assert got == exact(rows, k=30)


def test_repeated_query_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_ROWS", 25)
    vectors = A.prepared(stored(spark, [(i, [1.0, float(i)], 0) for i in range(1, 50)], KIND), "vec_id", "embedding")
    queries = A.prepared(stored(spark, [(20, [1.0, 20.0], 0)] * 300, KIND), "vec_id", "embedding")
    index = A.build(vectors)
    sides = A._dealt(*(A._routed(t, index, 2.0, 5, q) for t, q in ((vectors, False), (queries, True))))
    assert max(r["count"] for r in sides[1].groupBy("list", "block", "query_block").count().collect()) < 3 * 25
    assert [r["vec_id"] for r in A.nearest(vectors, queries, index, k=3).orderBy("rank").collect()] == [49, 48, 47]


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows)
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in top}) for q, top in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(700, 10))
    index = A.Index(c, A.neighbour_graph(c), np.arange(0, 700, 30), 1.0)
    x = rng.normal(size=(200, 10))
    ids, dist = A.search(index, x, 20)
    true = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    found = np.mean([len(set(a) & set(np.argsort(t)[:20])) / 20 for a, t in zip(ids, true)])
    assert found > 0.95 and np.allclose(np.take_along_axis(true, ids, 1), dist)
    few = A.Index(c[:3], A.neighbour_graph(c[:3]), np.arange(3), 1.0)
    assert A.search(few, x, 20)[0].shape == (200, 3)


def test_balance():
    x = np.concatenate([np.zeros((500, 4)), np.random.default_rng(1).normal(size=(500, 4))])
    assert len(A.balanced(x, 50)) > 8 and len(A.balanced(x[:500], 50)) == 1


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(20, [1.0], 0)], [(20, [1.0], 0), (21, [2.0], 0)]])
def test_small(spark, rows):
    vectors = A.prepared(stored(spark, rows, KIND), "vec_id", "embedding")
    index = A.build(vectors)
    if index is None:
        assert not any(r[1] for r in rows)
    else:
        assert A.nearest(vectors, vectors.where("id % 20 = 0"), index).count() == max(0, len(rows) - 1)
