"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors lie in posting lists around centroids; those near the border of several clusters
are in each of these lists. A graph over the centroids, held in memory, finds the lists
close to a vector, and a query reads those whose distance is within a ratio of the nearest.
The first lists come from a bounded sample; a list that outgrows a block is cut around
centroids of its own vectors, again and again, so the number of lists grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingflow.llm.common import with_row
from postingflow.session import settle

SAMPLE = 32_768  # vectors that centroids are fitted on
LIST_ROWS = 128  # vectors of one list, as far as the sample's size lets it
FIT_ROWS = 8192  # vectors of a list that is cut which its new centroids are fitted on
LEAST_FIT = 16  # such vectors for each new centroid, at least
LEVELS = 3  # times that lists are cut; beyond that, and where equal vectors lie, blocks are by hash
FAN = 1 << 16  # lists below one list are numbered in so many places
BLOCK_ROWS = 4096  # vectors of a list that one task compares at once; longer lists are cut
ROUTE_ROWS = 8192  # vectors of a list that one task deals to the list's parts
QUERY_ROWS = 4096  # queries of a list that one task compares with them
COPIES = 4  # lists that a vector may lie in
PARTS = 2  # parts that a vector of a list that is cut may lie in
CLOSURE = 1.05  # a vector lies in lists up to this ratio of its nearest distance
RATIO = 1.25  # a query reads lists up to this ratio of its nearest distance
FLOOR = 8  # nearest lists that a query reads whatever the ratio, where lists are small
LISTS = 160  # centroids that a query's graph search keeps
NEIGHBOURS = 24
BEAM = 12  # centroids that a search keeps at least


@dataclass
class Index:
    """Centroids in the widened space, and their graph; at most ``SAMPLE`` of them."""

    centroids: np.ndarray
    graph: np.ndarray
    doors: np.ndarray
    longest: float


def usable(vector: Column) -> Column:
    """Not null or zero, and all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def widened(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """One more dimension that brings all vectors to one length: the nearest by distance is
    then the one with the largest inner product. Queries get a zero there."""
    x = np.asarray(x, np.float64)
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def balanced(x: np.ndarray, rows: int, seed: int = 3) -> np.ndarray:
    """Centroids of clusters of at most ``rows`` vectors: halves along two means, again and again.

    A cluster is halved at the median of the difference of the distances to its two means,
    so halves are equal in size, also where all vectors are the same.
    """
    rng = np.random.default_rng(seed)
    parts, out = [np.arange(len(x))], []
    while parts:
        part = parts.pop()
        if len(part) <= rows:
            out.append(x[part].mean(axis=0))
            continue
        a, b = x[rng.choice(part, 2, replace=False)]
        for _ in range(6):
            side = x[part] @ (a - b)
            order = np.argsort(side, kind="stable")
            low, high = part[order[: len(part) // 2]], part[order[len(part) // 2 :]]
            a, b = x[high].mean(axis=0), x[low].mean(axis=0)
        parts += [low, high]
    return np.unique(np.array(out), axis=0)


def neighbour_graph(c: np.ndarray, degree: int = NEIGHBOURS) -> np.ndarray:
    """Each centroid's nearest ones, and the next on a ring so that all are connected.

    A row names no centroid twice but its own.
    """
    near = np.empty((len(c), min(degree, len(c))), np.int64)
    norms = (c * c).sum(axis=1)
    for i in range(0, len(c), 1024):
        d = norms[None, :] - 2 * c[i : i + 1024] @ c.T
        near[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
    own = np.arange(len(c))
    ring = (own + 1) % len(c)
    ring = np.where((near == ring[:, None]).any(axis=1), own, ring)
    return np.concatenate((near, ring[:, None]), axis=1)


def indexed(centroids: np.ndarray, longest: float) -> Index:
    doors = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), 32)).astype(np.int64))
    return Index(centroids, neighbour_graph(centroids), doors, longest)


def search(index: Index, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` nearest centroids found in the graph, with squared distances, for all rows.

    All rows walk at once: each opens the nearest centroid that it has not opened, meets its
    neighbours, and keeps the nearest; a row ends when all that it kept are open.
    """
    c, n = index.centroids, len(x)
    keep = min(keep, len(c))
    width = min(max(keep, BEAM), len(c))
    norms = (c * c).sum(axis=1)
    own = (x * x).sum(axis=1)[:, None]
    met = np.zeros((n, len(c)), bool)
    met[:, index.doors] = True
    ids = np.tile(index.doors, (n, 1))
    dist = norms[index.doors] - 2 * x @ c[index.doors].T + own
    if ids.shape[1] > width:
        first = np.argpartition(dist, width - 1, axis=1)[:, :width]
        ids, dist = np.take_along_axis(ids, first, axis=1), np.take_along_axis(dist, first, axis=1)
    opened = np.zeros(ids.shape, bool)
    if ids.shape[1] < width:
        more = ((0, 0), (0, width - ids.shape[1]))
        ids, dist = np.pad(ids, more), np.pad(dist, more, constant_values=np.inf)
        opened = np.pad(opened, more, constant_values=True)
    live = np.arange(n)
    while len(live):
        best = np.where(opened[live], np.inf, dist[live]).argmin(axis=1)
        on = ~opened[live, best]
        live, best = live[on], best[on]
        opened[live, best] = True
        seen = index.graph[ids[live, best]]
        new = ~met[live[:, None], seen]
        met[live[:, None], seen] = True
        away = np.matmul(c[seen], x[live][:, :, None])[:, :, 0] * -2 + norms[seen] + own[live]
        all_ids = np.concatenate((ids[live], seen), axis=1)
        all_dist = np.concatenate((dist[live], np.where(new, away, np.inf)), axis=1)
        all_open = np.concatenate((opened[live], ~new), axis=1)
        first = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(all_ids, first, axis=1)
        dist[live] = np.take_along_axis(all_dist, first, axis=1)
        opened[live] = np.take_along_axis(all_open, first, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, axis=1), np.maximum(np.take_along_axis(dist, order, axis=1), 0)


def build(vectors: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> Index | None:
    """Fit centroids and graph on at most ``sample`` vectors, those with the smallest hash.

    ``vectors`` (id, v array<double>) hold usable vectors of one length. None if empty.
    """
    longest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if longest is None:
        return None
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].to_pylist()
    longest = float(longest) ** 0.5
    c = balanced(widened(np.array(rows), longest), list_rows)
    if len(c) > FAN:
        raise ValueError(f"{len(c)} lists from the sample, more than {FAN}")
    return indexed(c, longest)


def array_of(column) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def within(index: Index, x: np.ndarray, ratio: float, lists: int, query: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, distance): the centroids within the ratio of the nearest one's distance."""
    ids, dist = search(index, widened(x, index.longest, query), lists)
    dist = np.sqrt(dist)
    near = dist <= ratio * dist[:, :1] + 1e-12
    if query:
        near[:, :FLOOR] = True
    rows, places = np.nonzero(near)
    return rows, ids[rows, places], dist[rows, places]


def first_of_equals(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors those with the k + 1 smallest ids; no answer of k can hold another.

    Equal vectors are equally near to any query, ties go to the smaller id, and one id may be
    the query's own. Spark cuts a group to its first ids in each task before the shuffle.
    """
    place = F.expr("dense_rank() OVER (PARTITION BY v ORDER BY id)")
    return vectors.select("id", "v", place.alias("place")).where(F.col("place") <= k + 1).select("id", "v").dropDuplicates()


def _routed(table: DataFrame, index: Index, ratio: float, lists: int, query: bool) -> DataFrame:
    """(row, id, v, list, dist): each row in every list within the ratio of the nearest centroid.

    The settled table holds a vector once, with its lists. Lists are numbered from 1.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows, found, dist = within(index, array_of(part.column("v")), ratio, lists, query)
                ends = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(found + 1), pa.array(dist)], names=["list", "dist"])
                lists_of = pa.ListArray.from_arrays(ends, pairs)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists_of], names=["id", "v", "lists"])

    kind = "id bigint, v array<double>, lists array<struct<list:bigint,dist:double>>"
    routed = settle(table.select("id", "v").mapInArrow(run, kind), "lists")
    return with_row(routed, "row").select("row", "id", "v", F.inline("lists"))


def _parted(table: DataFrame, models: DataFrame, longest: float, ratio: float, lists: int, query: bool) -> DataFrame:
    """``table`` (row, id, v, list, dist) of lists that are cut, in the lists' parts.

    A list's rows meet its centroids in blocks of about ``ROUTE_ROWS``; each block builds the
    graph over these (at most ``FIT_ROWS / LEAST_FIT`` x 2) and searches it.
    """

    def route(rows: pa.Table, model: pa.Table) -> pa.Table:
        at = found = np.empty(0, np.int64)
        dist = np.empty(0)
        if rows.num_rows and model.num_rows:
            index = indexed(np.array(model["centroids"][0].as_py()), longest)
            met = [within(index, array_of(rows["v"].slice(a, 512)), ratio, lists, query) for a in range(0, rows.num_rows, 512)]
            at = np.concatenate([m[0] + 512 * i for i, m in enumerate(met)])
            found, dist = (np.concatenate([m[i] for m in met]) for i in (1, 2))
            found = found + rows["list"][0].as_py() * FAN + 1
        columns = [rows.column(c).take(pa.array(at)) for c in ("row", "id", "v")]
        return pa.table([*columns, pa.array(found), pa.array(dist)], names=["row", "id", "v", "list", "dist"])

    counts = table.groupBy("list").agg((F.floor(F.count("*") / ROUTE_ROWS) + 1).alias("blocks"))
    models = settle(models.join(counts, "list"), "blocks")
    blocks = models.select("list", "blocks")
    dealt = table.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks")
    model = models.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    met = dealt.groupBy("list", "block").cogroup(model.groupBy("list", "block"))
    return met.applyInArrow(route, "row bigint, id bigint, v array<double>, list bigint, dist double")


def _models(large: DataFrame, longest: float, rows: int) -> DataFrame:
    """(list, centroids): for each list of ``large`` (with its size n) the centroids of its parts,
    of about half of ``rows`` vectors, fitted on at most about ``FIT_ROWS`` of its vectors."""

    def fit(part: pa.Table) -> pa.Table:
        x, n = widened(array_of(part["v"]), longest), part["n"][0].as_py()
        c = balanced(x, max(LEAST_FIT, len(x) * rows // (2 * n)))
        return pa.table([part["list"].slice(0, 1), pa.array([c.tolist()])], names=["list", "centroids"])

    some = large.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FIT_ROWS)) == 0)
    return some.select("list", "n", "v").groupBy("list").applyInArrow(fit, "list bigint, centroids array<array<double>>")


def cut_lists(posted: DataFrame, asked: DataFrame, longest: float, ratio: float, lists: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (row, id, v, list, dist) with the lists of over ``BLOCK_ROWS`` vectors cut.

    A vector goes to at most ``PARTS`` parts of a list, a query to those within the ratio of
    the nearest. Once lists are cut, a query's lists are held against its nearest one again.
    A list whose vectors all lie on one centroid stays whole.
    """
    done = None
    for level in range(LEVELS):
        sizes = posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
        if done is not None:
            sizes = sizes.join(done, "list", "left_anti")
        sizes = settle(sizes, "sizes")
        if sizes.isEmpty():
            break
        models = _models(posted.join(sizes, "list"), longest, BLOCK_ROWS)
        models = settle(models, "centroids").where(F.size("centroids") > 1)
        kept = sizes.join(models, "list", "left_anti").select("list")
        done = settle(kept if done is None else done.unionByName(kept), "whole")
        cut = models.select("list")
        posted, asked = (
            side.join(cut, "list", "left_anti").unionByName(settle(
                _parted(side.join(cut, "list", "left_semi"), models, longest, r, n, query), "parts"
            ))
            for side, r, n, query in ((posted, CLOSURE, PARTS, False), (asked, ratio, lists, True))
        )
    if done is not None:
        own = Window.partitionBy("row")
        place = F.row_number().over(own.orderBy("dist", "list"))
        asked = asked.withColumns({"least": F.min("dist").over(own), "place": place})
        asked = asked.where((F.col("dist") <= ratio * F.col("least") + 1e-12) | (F.col("place") <= FLOOR)).drop("least", "place")
    return posted, asked


def _dealt(posted: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, block, query_block, id, v) of vectors and queries, both routed.

    Both sides of a list are cut, into as many blocks as their sizes ask for, and each block
    of vectors meets each block of queries under a key of its own. Vectors are dealt by the
    hash of the id, queries by that of their scan number, so repeated ids are spread. Lists
    are of one block, but for those that could not be cut.
    """

    def parts(table: DataFrame, rows: int, name: str) -> DataFrame:
        return table.groupBy("list").agg((F.floor(F.count("*") / rows) + 1).alias(name))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    sizes = settle(parts(posted, BLOCK_ROWS, "blocks").join(parts(asked, QUERY_ROWS, "query_blocks"), "list"), "blocks")
    vectors = posted.join(sizes, "list")
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("query_block", every("query_blocks"))
    queries = asked.join(sizes, "list")
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64("row"), "query_blocks")).withColumn("block", every("blocks"))
    columns = ["list", "block", "query_block", "id", "v"]
    return vectors.select(columns), queries.select(columns)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in order of the components, the same wherever a pair meets."""
    return np.cumsum(x * q, axis=1)[:, -1]


def k_best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k largest products of each query with vectors of other ids,
    ties to the smaller id."""
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if len(x) > k:  # rounding may differ by the place in a product
        least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)
        rows, places = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
    else:
        rows, places = np.nonzero(np.isfinite(rough))
    scores = exact_scores(x[places], q[rows])
    order = np.lexsort((ids[places], -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], places[rank < k], scores[rank < k]


def nearest(vectors: DataFrame, queries: DataFrame, index: Index, k: int = 20, ratio: float = RATIO, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product.

    Both tables are (id, v). A vector is no answer to the query of its own id. Every vector
    is in a list, but for equal vectors of larger ids than any answer holds. Lists are cut to
    about ``BLOCK_ROWS`` vectors, so what a query hands on is at most k rows for each list it
    reads; those of one task shrink to the k best before the shuffle. A list that cannot be cut, and a
    list of many queries, is compared in pairs of blocks, and no task holds more than a pair.
    Ties go to the smaller id; repeated rows count once; of an id's several vectors each is an
    answer of its own, and several queries of one id are answered together.
    """
    posted = _routed(first_of_equals(vectors, k), index, CLOSURE, COPIES, False)
    asked = _routed(queries, index, ratio, lists, True)
    dealt, asked = _dealt(*cut_lists(posted, asked, index.longest, ratio, lists))
    pair = ("list", "block", "query_block")

    def compare(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if rows.num_rows and wanted.num_rows:
            x, ids = array_of(rows["v"]), rows["id"].to_numpy()
            q, own = array_of(wanted["v"]), wanted["id"].to_numpy()
            for i in range(0, len(q), 128):
                some, places, scores = k_best(x, ids, q[i : i + 128], own[i : i + 128], k)
                out.append((own[i + some], ids[places], scores))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    met = dealt.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(
        compare, "query_id bigint, vec_id bigint, score double"
    )
    # A vector met in several lists has one score and one rank.
    ranked = met.withColumn("rank", F.expr("dense_rank() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").dropDuplicates()


def prepared(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): usable vectors in double precision, of the commonest length; null ids take no part."""
    v = F.col(vector).cast("array<double>")
    good = table.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (sizes["n"] if sizes else 0))
