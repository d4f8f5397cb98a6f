"""SimHash near-deduplication: fingerprints, vantage-point trees, connected components.

Two fingerprints at most ``RADIUS`` bits apart agree on at least two of six blocks of their
bits. Each of the fifteen pairs of blocks is the root of a tree: its shards hold the
fingerprints at distance zero from each other on these blocks, so a linked pair meets in
one shard at least. A shard is a vantage-point tree over the whole fingerprints: shells of
Hamming distance around a vantage point, and the triangle inequality tells which rows near
the cut the other side must see. Shards above a size are cut by shells in Spark, with the
boundary rows going to both sides; smaller ones are searched within a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh, keep_rows, with_row
from postingflow.llm.graph import components
from postingflow.session import settle

SHINGLE, RADIUS, SEED = 4, 4, 42
WIDTHS = (11, 11, 11, 11, 10, 10)
SHARD_ROWS = 50_000
HELPS = 0.9  # a cut of a shard must leave at most this share of the pairs to compare
COLUMNS = 8192  # points of the other side that a block of 256 is compared with at once
LINKS = 1 << 22  # links of a task that are held before they are contracted
TASK_ROWS = 500_000


# ---- fingerprints -------------------------------------------------------------------


def shingle_digests(text: str | None, size: int) -> list[bytes]:
    """XXH64 digests (big-endian) of the word shingles; of the whole text if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(digests: list[bytes]) -> np.ndarray:
    """How often each of the 64 bits is set, most significant first, in steps of bounded size."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(digests), 1 << 16):
        block = np.frombuffer(b"".join(digests[i : i + (1 << 16)]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(texts, size: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints as signed integers; a bit is 1 if set in over half the shingles."""
    bits = np.zeros((len(texts), 64), bool)
    for i, text in enumerate(texts):
        digests = shingle_digests(text, size)
        if digests:
            bits[i] = 2 * majority(digests) > len(digests)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def with_fingerprints(docs: DataFrame, text: str, name: str, size: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with the fingerprint of the whole text."""
    rest = [c for c in docs.columns if c != text]
    schema = extended(docs.select(*rest), f"`{name}` bigint")

    def run(batches):
        for batch in batches:
            marks = fingerprints(batch.column(text).to_pylist(), size)
            arrays = [batch.column(c) for c in rest] + [pa.array(marks)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, name])

    return docs.select(*rest, text).mapInArrow(run, schema)


# ---- links within a shard ------------------------------------------------------------


def _distance(a, b):
    return np.bitwise_count(a ^ b)


class Links(list):
    """Pairs of arrays of ends, contracted whenever many have come together."""

    held, most = 0, LINKS

    def append(self, pair):
        super().append(pair)
        self.held += len(pair[0])
        if self.held > self.most:
            self[:] = [contracted(*(np.concatenate([f[k] for f in self]) for k in (0, 1)))]
            self.held = len(self[0][0])
            self.most = max(LINKS, 2 * self.held)


def _hits(x, left, right, radius, links):
    """All links between two lists of positions, in blocks of both."""
    for i in range(0, len(left), 256):
        part = left[i : i + 256]
        for j in range(0, len(right), COLUMNS):
            some = right[j : j + COLUMNS]
            p, q = np.nonzero(_distance(x[part][:, None], x[some][None, :]) <= radius)
            if len(p):
                links.append((part[p], some[q]))


def _cross(x, left, right, radius, links):
    """Links between two sides of a cut: vantage points of the left side prune both."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= 1 << 14 or len(a) <= 16:
            _hits(x, a, b, radius, links)
            continue
        da, db = _distance(x[a], x[a[0]]).astype(np.int64), _distance(x[b], x[a[0]]).astype(np.int64)
        cut = int(np.median(da))
        if not (da > cut).any():
            cut -= 1
        if not (da <= cut).any():
            near = b[(db >= da.min() - radius) & (db <= da.max() + radius)]
            _hits(x, a, near, radius, links)
            continue
        stack.append((a[da <= cut], b[db <= cut + radius]))
        stack.append((a[da > cut], b[db > cut - radius]))


def tree_links(x: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all points of ``x`` (uint64) that chains of links connect.

    At a node, everything within the radius of the vantage point is linked to it and is one
    component, so of these pairs only the links to the vantage point are reported, and of
    the links from there to the rest one for each point. The rest is cut at the median
    distance; rows within the radius of the cut are compared across it.
    """
    links = Links()
    stack = [np.arange(len(x))]
    while stack:
        a = stack.pop()
        if len(a) <= 64:
            if len(a) > 1:
                p, q = np.nonzero(np.triu(_distance(x[a][:, None], x[a][None, :]) <= radius, 1))
                links.append((a[p], a[q]))
            continue
        d = _distance(x[a], x[a[0]]).astype(np.int64)
        ball, rest, d = a[d <= radius], a[d > radius], d[d > radius]
        links.append((np.full(len(ball) - 1, a[0]), ball[1:]))
        around = rest[d <= 2 * radius]
        for i in range(0, len(around), 256):
            part = around[i : i + 256]
            for j in range(0, len(ball), COLUMNS):
                near = ball[j : j + COLUMNS]
                close = _distance(x[part][:, None], x[near][None, :]) <= radius
                some = close.any(axis=1)
                links.append((part[some], near[close[some].argmax(axis=1)]))
                part = part[~some]
        if not len(rest):
            continue
        cut = int(np.median(d))
        if not (d > cut).any():
            cut -= 1
        inner, outer = rest[d <= cut], rest[d > cut]
        stack += [inner, outer]
        _cross(x, inner[d[d <= cut] > cut - radius], outer[d[d > cut] <= cut + radius], radius, links)
    return links


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (values) reduced to one from each value to the least of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    p, q = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def shard_links(shards: np.ndarray, marks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of all shards of a task, contracted."""
    order = np.lexsort((marks, shards))
    shards, marks = shards[order], marks[order]
    x = marks.view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(x) else np.array([], int)
    sizes = np.diff(np.append(starts, len(x)))
    found = []
    small = np.repeat(sizes <= 16, sizes)
    for step in range(1, 16):  # shards of up to 16 rows, all at once
        same = small[:-step] & (shards[:-step] == shards[step:])
        i = np.flatnonzero(same)
        i = i[_distance(x[i], x[i + step]) <= radius]
        found.append((i, i + step))
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        found += [(p + start, q + start) for p, q in tree_links(x[start : start + size], radius)]
    if not found:
        return marks[:0], marks[:0]
    a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
    return contracted(marks[a], marks[b])


# ---- shards --------------------------------------------------------------------------


def block_keys(mark: str):
    """The shard of each tree: its number, then the bits of its two blocks."""
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    bits = [f"(shiftright({mark}, {s}) & {(1 << w) - 1})" for s, w in zip(starts, WIDTHS, strict=True)]
    keys = [
        f"{tree}L * {1 << 22} + {bits[i]} * {1 << WIDTHS[j]} + {bits[j]}"
        for tree, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))
    ]
    return F.expr(f"array({', '.join(keys)})")


def split_large(shards: DataFrame, most: int, radius: int = RADIUS, levels: int = 24) -> DataFrame:
    """Cut shards (shard, mark) of over ``most`` rows by distance from a vantage point.

    Rows up to the median distance go inside, the others outside; those of the outside
    within the radius of the cut go inside too. Only rows of large shards move. Whether a
    cut helps is decided for each shard by the pairs that it leaves to compare; a shard that
    it does not help, as all its points are within the radius of the cut, is compared in
    pairs of blocks instead (see ``paired``).
    """
    done = None
    for level in range(levels + 1):
        sizes = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("mark").alias("vp"))
        large = settle(sizes.where(F.col("n") > most), "large")
        if large.isEmpty():
            break
        rest = shards.join(large, "shard", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        away = F.bit_count(F.col("mark").bitwiseXOR(F.col("vp")))
        rows = settle(shards.join(large, "shard").withColumn("away", away), "far")
        shells = rows.groupBy("shard", "away", "n").agg(F.count("*").alias("m"))
        below = F.expr("sum(m) OVER (PARTITION BY shard ORDER BY away)")
        cuts = shells.withColumn("below", below).where("2 * below >= n").groupBy("shard").agg(F.min("away").alias("cut"))
        inside, outside = (F.sum(F.when(c, F.col("m")).otherwise(0)).cast("double") for c in (F.col("away") <= F.col("cut") + radius, F.col("away") > F.col("cut")))
        left = shells.join(cuts, "shard").groupBy("shard", "n", "cut").agg((inside * inside + outside * outside).alias("pairs"))
        helps = F.lit(level < levels) & (F.col("pairs") <= HELPS * F.col("n").cast("double") * F.col("n"))
        cuts = settle(left.where(helps).select("shard", "cut"), "cuts")
        done = done.unionByName(settle(paired(rows.join(cuts, "shard", "left_anti"), most), "pairs"))
        side = F.when(F.col("away") > F.col("cut") + radius, F.array(F.lit(1))).when(
            F.col("away") > F.col("cut"), F.array(F.lit(0), F.lit(1))
        ).otherwise(F.array(F.lit(0)))
        both = rows.join(cuts, "shard").select("shard", "mark", F.explode(side).alias("side"))
        shards = settle(both.select(F.xxhash64("shard", "side").alias("shard"), "mark"), "parts")
    return shards if done is None else done.unionByName(shards)


def paired(rows: DataFrame, most: int) -> DataFrame:
    """Shards (shard, mark) of about ``most`` rows in which any two rows of a shard meet.

    The rows (shard, mark, n) of a shard of n rows are dealt into blocks of half that size,
    and any two blocks make a shard.
    """
    blocks = F.ceil(2 * F.col("n") / most)
    dealt = rows.select("shard", "mark", blocks.alias("blocks"), F.pmod(F.xxhash64("mark"), blocks).alias("i"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("i != j")
    return pairs.select(F.xxhash64(F.lit("pair"), "shard", F.least("i", "j"), F.greatest("i", "j")).alias("shard"), "mark")


def links(marks: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in ``marks`` (mark)."""
    if radius > len(WIDTHS) - 2:
        raise ValueError(f"six blocks find links of up to {len(WIDTHS) - 2} bits")
    shards = marks.select(F.explode(block_keys("mark")).alias("shard"), "mark")
    shards = split_large(shards, most, radius)
    tasks = shards.count() // TASK_ROWS + 1

    def run(batches):
        got = [(b.column("shard").to_numpy(), b.column("mark").to_numpy()) for b in batches]
        if got:
            a, b = shard_links(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return shards.repartition(tasks, "shard").mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, fingerprint, component_id) for every row of ``docs`` (a plain read).

    Texts are lower-cased in A-Z and cut at ASCII white space; null and wordless texts have
    fingerprint zero and are linked like any other. Equal fingerprints are one point, so
    copies are never compared; ``component_id`` is the least id of all linked documents,
    null ids left out (null where all are). Repeated rows and ids each keep their row.
    """
    row = fresh(docs, "row")
    numbered = with_row(docs, row).select(
        F.col(row).alias("row"), F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text")
    )
    marked = settle(with_fingerprints(numbered, "text", "mark"), "marks")
    points = settle(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "points")
    stars = components(links(points.select("mark")))
    rooted = points.join(stars, F.col("mark") == F.col("node"), "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    rooted = settle(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(settle(least, "least"), "root").select("mark", "root", "component_id"), "named")
    return marked.join(named, "mark")


def hexed(mark):
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (a plain read) with one row of each component: the least id, then the first row."""
    row = fresh(docs, "row")
    groups = near_groups(docs, id_column, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return keep_rows(docs, kept, row)
