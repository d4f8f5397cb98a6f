"""Near copies of embeddings: spherical k-means cells, cosine products within cells.

Distinct vectors of one label are the nodes. Cells are cut by spherical k-means, again and
again where they are large. A vector is at home in the cell of its nearest centroid, and a
guest in each sibling cell that could hold a linked vector: one within the link angle of it,
on that cell's side of the border. So no link is lost, and each pair meets once, in one cell.
Within a cell, vectors that are all within half the link angle of the centroid are linked
to each other without a product; the others meet in pairs of bounded blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh
from postingflow.llm.graph import components
from postingflow.session import settle

COSINE = 0.93
CELL_ROWS = 2048  # cells with more home vectors are cut
CELLS = 32  # centroids of one cut
SAMPLE = 2048  # vectors that the centroids of one cut are fitted on, about
LEVELS = 12  # cuts below each other, at most: a cell left large is compared in more blocks
GAIN = 0.8  # a cut stays if it leaves at most this share of the products
BLOCK_ROWS = 8192  # vectors of a cell that a task holds on either side
STRIP = 256  # rows of a block's product at once
SLACK = 1e-9  # rounding of products and angles


def usable(vector: Column) -> Column:
    """Not null or zero, and all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _doubles(column) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def keyed(table: DataFrame, vector: str, key: str) -> DataFrame:
    """The table with ``key``: the vector's doubles, little-endian; null if it takes no part.

    Zeros have one sign. Vectors of different lengths are never linked.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(vector)
            values = column.flatten().to_numpy(zero_copy_only=False) + 0.0
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
            blobs = [values[a:b].astype("<f8").tobytes() or None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            rest = [c for c in batch.schema.names if c != vector]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(blobs, pa.binary())], names=[*rest, key])

    rest = table.drop(vector)
    v = F.col(vector).cast("array<double>")
    ready = table.withColumn(vector, F.when(usable(v), v))
    return ready.select(*rest.columns, vector).mapInArrow(run, extended(rest, f"`{key}` binary"))


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by spherical k-means: unit means, starting from vectors far from each other."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)) and near.min() < 1 - SLACK:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > SLACK, sums / np.maximum(size, SLACK), c)
    return np.unique(c, axis=0)


def places(x: np.ndarray, home: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of all cells that unit vectors ``x`` go to.

    A vector within the angle of x lies on the other side of the border between x's centroid
    and another one only if x is within that angle of the border. Where x is at home it is a
    guest in earlier cells alone, so that a pair meets in the earlier of its two cells; a
    guest goes wherever a linked vector could be at home.
    """
    near = x @ c.T
    best = near.argmax(axis=1)
    gaps = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[best]
    reach = near - near[np.arange(len(x)), best][:, None] >= -math.sqrt(max(1 - cosine * cosine, 0)) * gaps - SLACK
    own = np.arange(len(c))[None, :] == best[:, None]
    go = np.where(home[:, None], own | reach & (np.arange(len(c))[None, :] < best[:, None]), reach | own)
    row, cell = np.nonzero(go)
    return row, cell, own[row, cell] & home[row]


ROW = "cell string, node bigint, w bigint, home boolean, v binary"

MOVED = pa.schema([
    ("parent", pa.string()), ("cell", pa.string()), ("node", pa.int64()), ("w", pa.int64()), ("home", pa.bool_()), ("v", pa.binary()),
])


def _blocked(table: DataFrame, counted: DataFrame, rows: int) -> DataFrame:
    """Deal each cell's rows into blocks of about ``rows``."""
    sizes = counted.select("cell", F.ceil(F.col("rows") / rows).alias("blocks"))
    return table.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks")


def _counted(table: DataFrame) -> DataFrame:
    """(cell, homes, rows, work): the products that comparing the cell as it is takes."""
    homes = F.sum(F.col("home").cast("bigint"))
    return table.groupBy("cell").agg(homes.alias("homes"), F.count("*").alias("rows")).withColumn(
        "work", F.col("homes") * (F.col("rows") - F.col("homes") / 2)
    )


def cut(table: DataFrame, cosine: float, cell_rows: int = CELL_ROWS, cells: int = CELLS, levels: int = LEVELS) -> DataFrame:
    """Cut the cells of ``table`` (cell, node, w, home, v) until they are small or a cut doesn't help.

    Every cut fits ``cells`` centroids on about ``SAMPLE`` home vectors of the cell (by
    their node's hash), in one task per cell, and moves the rows in blocks. Whether it helps is
    decided for each cell by the products that it saves.
    """
    parts, table = [], settle(table, "cells")
    for _ in range(levels):
        counted = settle(_counted(table), "sizes")
        large = counted.where(F.col("homes") > cell_rows)
        if large.isEmpty():
            break
        parts.append(table.join(large.select("cell"), "cell", "left_anti"))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            c = fit_cells(_doubles(rows.sort_values("node")["v"]), cells)
            return pd.DataFrame({"cell": rows["cell"].iloc[:1], "model": [c.tobytes()], "d": [c.shape[1]]})

        share = F.pmod(F.xxhash64("node", F.lit("fit")), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("homes")
        sampled = table.where("home").join(large.select("cell", "homes"), "cell").where(share).select("cell", "node", "v")
        models = settle(sampled.groupBy("cell").applyInPandas(fit, "cell string, model binary, d int"), "models")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("rows") / BLOCK_ROWS) - 1))
        beside = models.join(large.select("cell", "rows"), "cell").withColumn("block", every)

        def move(key, rows: pa.Table, model: pa.Table) -> pa.Table:
            out = []
            if rows.num_rows and model.num_rows:
                c = _doubles(model.column("model")).reshape(-1, model.column("d")[0].as_py())
                home = rows.column("home").to_numpy()
                row, cell, at_home = places(_doubles(rows.column("v")), home, c, cosine)
                name = key[0].as_py()
                taken = rows.select(["node", "w", "v"]).take(pa.array(row))
                child = pa.array([f"{name}.{i}" for i in range(len(c))]).take(pa.array(cell))
                parent = pa.array([name] * len(row), pa.string())
                out = [parent, child, taken.column("node"), taken.column("w"), pa.array(at_home), taken.column("v")]
            return pa.Table.from_arrays(out, schema=MOVED) if out else MOVED.empty_table()

        moved = _blocked(table, large, BLOCK_ROWS).groupBy("cell", "block").cogroup(beside.groupBy("cell", "block"))
        moved = settle(moved.applyInArrow(move, f"parent string, {ROW}"), "moved")
        after = _counted(moved).withColumn("parent", F.regexp_replace("cell", r"\.\d+$", "")).groupBy("parent").agg(F.sum("work").alias("after"))
        better = settle(
            large.join(after, F.col("cell") == F.col("parent")).where(F.col("after") <= F.col("work") * GAIN).select("parent"), "better"
        )
        held = large.join(better, F.col("cell") == F.col("parent"), "left_anti").select("cell")
        parts.append(table.join(held, "cell"))
        table = settle(moved.join(better, "parent").drop("parent"), "cells")
    parts.append(table)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return settle(whole, "cells")


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is linked with, by repeated minima."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, skip, cosine: float):
    """Weighted link counts of the rows of x and of y, and a spanning forest of their links.

    Products are matrix products in strips; those within rounding of the limit are summed
    again in the order of the components. ``skip`` gives the pairs of a strip's rows that
    are counted elsewhere.
    """
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    root = np.arange(len(x) + len(y))
    for i in range(0, len(x), STRIP):
        near = x[i : i + STRIP] @ y.T
        linked = near >= cosine + SLACK
        p, q = np.nonzero((near >= cosine - SLACK) & ~linked)
        if len(p):
            linked[p, q] = np.cumsum(x[i + p] * y[q], axis=1)[:, -1] >= cosine
        if skip is not None:
            linked &= ~skip(np.arange(i, i + len(near)))
        nx[i : i + STRIP] += linked @ wy
        ny += wx[i : i + STRIP] @ linked
        p, q = np.nonzero(linked)
        if len(p):
            # The strip's links and the forest so far.
            old = np.flatnonzero(root != np.arange(len(root)))
            root = _local_roots(len(root), np.concatenate((i + p, old)), np.concatenate((len(x) + q, root[old])))
    return nx, ny, root


def _with_core(cells: DataFrame, cosine: float) -> DataFrame:
    """The rows with ``kind``: 0 for a cell's core, 1 for its other home vectors, 2 for guests.

    The core lies within half the link angle of one of the cell's vectors: of about
    ``SAMPLE`` of them, the one that most of the others are so near to.
    """
    near = math.cos(math.acos(cosine) / 2 - 1e-6)
    homes = settle(cells.where("home").groupBy("cell").agg(F.count("*").alias("homes")), "homes")
    share = F.pmod(F.xxhash64("node", F.lit("core")), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("homes")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        x = _doubles(rows.sort_values("node")["v"])
        met = sum((x @ x[i : i + STRIP].T >= near).sum(axis=1) for i in range(0, len(x), STRIP))
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "middle": [x[int(met.argmax())].tobytes()]})

    sampled = cells.where("home").join(homes, "cell").where(share).select("cell", "node", "v")
    middles = settle(sampled.groupBy("cell").applyInPandas(pick, "cell string, middle binary"), "middles")

    def run(batches):
        for batch in batches:
            home = batch.column("home").to_numpy(zero_copy_only=False)
            kind = np.where(home, 1, 2)
            if batch.num_rows:
                # Batches mix cells, and cells may differ in their vectors' length.
                kind[[
                    bool(h and m is not None and np.frombuffer(v) @ np.frombuffer(m) >= near)
                    for h, v, m in zip(home, batch.column("v").to_pylist(), batch.column("middle").to_pylist(), strict=True)
                ]] = 0
            columns = [batch.column(c) for c in ("cell", "node", "w", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kind, pa.int32())], names=["cell", "node", "w", "v", "kind"])

    joined = cells.join(middles, "cell", "left").select("cell", "node", "w", "home", "v", "middle")
    return settle(joined.mapInArrow(run, "cell string, node bigint, w bigint, v binary, kind int"), "kinds")


def links(cells: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, n, low): parts of a node's number of links (by weight), and a node it is linked with.

    ``cells`` (cell, node, w, home, v) holds unit vectors. Each pair is counted once in all,
    for both of its nodes; ``n`` leaves out the node's own weight. A core's nodes are linked
    by the bound, all other pairs of a cell meet in two blocks.
    """
    rows = _with_core(cells, cosine)
    core = settle(rows.where("kind = 0").groupBy("cell").agg(F.sum("w").alias("total"), F.min("node").alias("low")), "cores")
    bound = rows.where("kind = 0").join(core, "cell").select("node", (F.col("total") - F.col("w")).alias("n"), "low")

    counts = rows.groupBy("cell").agg(
        *(F.ceil(F.count_if(F.col("kind") == k) / block_rows).cast("bigint").alias(f"b{k}") for k in range(3))
    )
    blocks = settle(counts.where("b1 + b2 > 0"), "blocks")
    place = F.expr("CASE kind WHEN 0 THEN 0L WHEN 1 THEN b0 ELSE b0 + b1 END + pmod(xxhash64(node), CASE kind WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END)")
    dealt = rows.join(blocks, "cell").withColumn("place", place)
    columns = ["cell", "i", "j", "node", "w", "v"]

    def upto(low: str, high: str) -> Column:
        return F.explode(F.expr(f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) END"))

    left = dealt.where("kind < 2").withColumn("i", F.col("place")).withColumn("j", upto("greatest(place, b0)", "b0 + b1 + b2 - 1"))
    right = dealt.where("kind > 0").withColumn("j", F.col("place")).withColumn("i", upto("0L", "least(place, b0 + b1 - 1)"))
    shape = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return shape.empty_table()
        a, b = a.sort_by("node"), b.sort_by("node")
        same = key[1].as_py() == key[2].as_py()
        places = np.arange(b.num_rows)
        skip = (lambda at: places[None, :] <= at[:, None]) if same else None
        nx, ny, root = compare(
            _doubles(a.column("v")), _doubles(b.column("v")), a.column("w").to_numpy(), b.column("w").to_numpy(), skip, cosine
        )
        node = np.concatenate((a.column("node").to_numpy(), b.column("node").to_numpy()))
        n, low = np.concatenate((nx, ny)), node[root]
        some = n > 0
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(low[some])], schema=shape)

    key = ("cell", "i", "j")
    # Both sides come from one table: new aliases tell their columns apart.
    right = right.select(*(F.col(c).alias(c) for c in columns))
    met = left.select(columns).groupBy(*key).cogroup(right.groupBy(*key))
    return settle(met.applyInArrow(meet, "node bigint, n bigint, low bigint").unionByName(bound), "links")


def near_copies(
    table: DataFrame, id_column: str, vector: str, label: str | None = None, cosine: float = COSINE,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows, without their vector, with ``n_links``, ``component_id`` and ``kept``.

    Rows link when their labels are equal and not null (all rows where ``label`` is None) and
    the cosine in double precision is at least ``cosine`` (above 0, at most 1). ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable by
    links, and a row is kept if that is its own id: one representative per group.

    Equal vectors of one label are one node with a weight: their rows link with each other
    and share the rest. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Rows with a null id
    take part, but lend a group no id; a group of such rows alone has a null id and is kept.
    Repeated ids stay rows of their own. An empty table gives no rows. Input columns with the
    added names are replaced.
    """
    added = ("n_links", "component_id", "kept")
    table = table.drop(*[c for c in table.columns if c.lower() in added and c not in (id_column, vector, label)])
    group, key = fresh(table, "group"), fresh(table, "key")
    labelled = table.withColumn(group, F.lit("") if label is None else F.col(label).cast("string"))
    rows = keyed(labelled, vector, key)
    digest = fresh(rows, "digest")
    rows = settle(rows.withColumn(digest, F.unhex(F.sha2(key, 256))), "vectors")
    used = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull())
    classes = used.groupBy(F.col(group).alias("label"), F.col(digest).alias("digest"), F.col(key).alias("raw")).agg(
        F.count("*").alias("w"), F.min(F.col(id_column).cast("bigint")).alias("least")
    )
    classes = settle(classes, "classes").withColumn("node", F.monotonically_increasing_id())

    def units(batches):
        for batch in batches:
            made = [_unit(np.frombuffer(v)[None, :]).tobytes() for v in batch.column("raw").to_pylist()]
            home = pa.array([True] * len(made), pa.bool_())
            columns = [batch.column("cell"), batch.column("node"), batch.column("w"), home, pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "node", "w", "home", "v"])

    start = classes.select(F.concat_ws(":", "label", F.octet_length("raw")).alias("cell"), "node", "w", "raw")
    cells = cut(start.mapInArrow(units, ROW), cosine, cell_rows)
    found = links(cells, cosine, block_rows)
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    known = classes.select("label", "digest", "w", "least", "node").join(counted, "node", "left").join(roots, "node", "left")
    known = settle(known.withColumn("root", F.coalesce("root", "node")), "known")
    groups = settle(known.groupBy("root").agg(F.min("least").alias("component")), "groups")
    facts = known.join(groups, "root").select(
        F.col("label").alias(group), F.col("digest").alias(digest), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component"
    )
    met = rows.drop(key).join(settle(facts, "facts"), [group, digest], "left")
    own = F.col(id_column).cast("bigint")
    whole = F.coalesce("component", own)
    return met.withColumns({
        "n_links": F.coalesce("n_links", F.lit(0)).cast("bigint"), "component_id": whole, "kept": own.eqNullSafe(whole),
    }).select(*[c for c in table.columns if c != vector], *added)
