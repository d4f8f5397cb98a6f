import random
import re

import numpy as np
import xxhash

from postingflow.llm import graph
from postingflow.llm import simhash as H
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, prose, stored, with_clashes


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def roots(marks, radius=4):
    """Least member of each component, comparing all pairs."""
    u = np.array(marks, np.uint64)
    label = np.arange(len(u))
    p, q = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        if (new == label).all():
            return label
        label = new


def clusters(rnd, groups, size):
    out = []
    for _ in range(groups):
        mark = rnd.getrandbits(64)
        for _ in range(size):
            for b in rnd.sample(range(64), rnd.randint(0, 3)):
                mark ^= 1 << b
            out.append(mark)
    return sorted(set(out))


def same_parts(marks, links):
    want = roots(marks)
    place = {m: i for i, m in enumerate(marks)}
    label = list(range(len(marks)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        i, j = place[a & (2**64 - 1)], place[b & (2**64 - 1)]
        assert bin(marks[i] ^ marks[j]).count("1") <= 64
        label[max(find(i), find(j))] = min(find(i), find(j))
    assert [find(i) for i in range(len(marks))] == want.tolist()


def test_fingerprints():
    rnd = random.Random(2)
    texts = [None, "", " \n", "one", "Two words", "a b c", "a  b\tc d", "É b c d e", "a\x0bb\x0cc d e f", prose(rnd, 70000)]
    texts += [prose(rnd, rnd.randint(1, 50)) for _ in range(50)]
    got = H.fingerprints(texts).astype(np.uint64).tolist()
    small = [i for i, t in enumerate(texts) if not t or len(t) < 1000]
    assert [got[i] for i in small] == [fingerprint(texts[i]) for i in small]
    assert got[9] == fingerprint(texts[9])


def test_tree_links_connect_all():
    for seed in range(6):
        rnd = random.Random(seed)
        marks = clusters(rnd, 8, 60) + [rnd.getrandbits(64) for _ in range(200)]
        marks = sorted(set(marks))
        x = np.array(marks, np.uint64)
        same_parts(marks, [(marks[i], marks[j]) for p, q in H.tree_links(x) for i, j in zip(p.tolist(), q.tolist())])


def test_links_in_spark_with_cut_shards(spark):
    rnd = random.Random(8)
    marks = sorted(set(clusters(rnd, 5, 80) + [rnd.getrandbits(20) for _ in range(300)] + [0]))
    df = stored(spark, [(m - 2**64 if m >> 63 else m,) for m in marks], "mark bigint")
    for most in (40, 50_000):
        got = [(r["a"], r["b"]) for r in H.links(df, most=most).collect()]
        same_parts(marks, got)


def test_tight_shards_are_spread_and_others_cut(spark):
    rnd = random.Random(5)
    middle = rnd.getrandbits(62)
    tight = sorted({middle ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a)})  # all within 4 bits
    loose = sorted(set(clusters(rnd, 6, 150)))
    signed = lambda m: m - 2**64 if m >> 63 else m
    rows = [(1, signed(m)) for m in tight] + [(2, signed(m)) for m in loose]
    got = H.split_large(stored(spark, rows, "shard bigint, mark bigint"), 300).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["shard"], []).append(r["mark"] & (2**64 - 1))
    assert max(map(len, parts.values())) < 450
    for marks in (tight, loose):
        u, met = np.array(marks, np.uint64), np.zeros((len(marks), len(marks)), bool)
        for part in parts.values():
            at = np.flatnonzero(np.isin(u, np.array(part, np.uint64)))
            met[np.ix_(at, at)] = True
        assert met[np.bitwise_count(u[:, None] ^ u[None, :]) <= 4].all()
    links = [(r["a"], r["b"]) for r in H.links(stored(spark, [(signed(m),) for m in tight + loose], "mark bigint").distinct(), most=300).collect()]
    same_parts(sorted({*tight, *loose}), links)


def test_links_of_tight_families_are_contracted(monkeypatch):
    monkeypatch.setattr(H, "LINKS", 1000)
    monkeypatch.setattr(H.Links, "most", 1000)
    monkeypatch.setattr(H, "COLUMNS", 50)
    rnd = random.Random(6)
    marks = sorted({*clusters(rnd, 3, 300), *(sum(1 << b for b in rnd.sample(range(64), 4)) for _ in range(900))})
    links = H.tree_links(np.array(marks, np.uint64))
    assert sum(len(p) for p, _ in links) < 1000 + 256 * 50 + 2 * len(marks)
    same_parts(marks, [(marks[i], marks[j]) for p, q in links for i, j in zip(p.tolist(), q.tolist())])


def test_near_groups_odd_rows(spark):
    rows = odd_documents()
    docs = stored(spark, with_clashes(rows), SCHEMA + CLASH)
    got = H.near_groups(docs).collect()
    assert len(got) == len(rows)
    marks = {r["mark"] & (2**64 - 1) for r in got}
    assert marks == {fingerprint(t) for _, t, *_ in rows}
    order = sorted(marks)
    root = dict(zip(order, roots(order).tolist()))
    least = {}
    for i, t, *_ in rows:
        r = root[fingerprint(t)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    for r in got:
        assert r["component_id"] == least.get(root[r["mark"] & (2**64 - 1)])
    out = H.drop_near_copies(docs)
    assert out.columns == docs.columns and out.count() == len(set(root.values()))
    assert H.drop_near_copies(stored(spark, [], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(stored(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}}
