"""Whitening embeddings with a covariance over distinct vectors and their multiplicities.

Rows with the same grid vector are one entry of the fit list, weighted by one or by their
count. Means are exact integers over the total weight, each task multiplies its own centred
block, and only sums of such products (dimension x dimension) reach the driver. Each distinct
vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh
from postingflow.session import settle

STEP, SHIFT = 64, 1_000_000  # the grid: x = floor(STEP * c) + SHIFT
COMPONENTS = 16
EDGE = 1 << 53  # entries beyond it are held there, so that sums stay exact
LONG = float(1 << 62)


@dataclass
class Moments:
    """Total weight, exact sums by dimension, and the covariance's leading components."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components kept, falling
    vectors: np.ndarray  # their unit vectors, one per column
    trace: float


def finite(vector: Column) -> Column:
    """Not null, at least one component, and all of them finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0)


def on_grid(table: DataFrame, vector: str) -> DataFrame:
    """The table with ``x`` (the grid vector's 64-bit entries, little-endian) for its vector.

    Rows without a finite vector of the commonest length (ties: the shorter) are left out.
    """
    v = F.col(vector).cast("array<double>")
    good = table.withColumn(vector, v).where(finite(F.col(vector)))
    sizes = good.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size(vector) == (sizes["n"] if sizes else -1))
    rest = [c for c in table.columns if c.lower() not in (vector.lower(), "x")]

    def run(batches):
        for batch in batches:
            column = batch.column(vector)
            c = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.clip(np.floor(c * STEP), -EDGE, EDGE).astype("<i8") + SHIFT
            blobs = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(r) for r in rest), blobs], names=[*rest, "x"])

    return good.select(*rest, vector).mapInArrow(run, extended(table.select(*rest), "x binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Total weight and the exact weighted sum of each dimension."""

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column("x")), batch.column("weight").to_numpy()
            small = float(np.abs(x).max()) * float(w.sum()) < LONG
            part = (x * w[:, None]).sum(axis=0) if small else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
            part = [int(p) for p in part]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(map(str, total))], names=["dimension", "total"]
            )

    parts = fit.select("x", "weight").mapInArrow(run, "dimension int, total string")
    rows = parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n = fit.agg(F.sum("weight")).first()[0] or 0
    return n, [int(r["total"]) for r in sorted(rows, key=lambda r: r["dimension"])]


class Centre:
    """Exact differences from the mean: n * x - S, without large intermediate numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.low = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; None where a long cannot hold it."""
        rough = (np.square(self.centred(x) * self.n)).sum(axis=1)
        if rough.max(initial=0) < LONG:
            return np.square(self.n * (x - self.low) - self.rest).sum(axis=1).tolist()
        exact = ((self.n * (x - self.low).astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def _product(table: DataFrame, rows_of, columns: list[str], n: int) -> np.ndarray:
    """Weighted sum of outer products over n; ``rows_of`` takes a batch to (matrix, weights).

    A task sums its own product and hands on one row for each dimension.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y, w = rows_of(batch)
                part = y.T @ (y * w[:, None])
                total = part if total is None else total + part
        if total is not None:
            blobs = pa.array([row.tobytes() for row in total], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), blobs], names=["i", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in parts["part"])
        return pd.DataFrame({"i": parts["i"].iloc[:1], "part": [total.tobytes()]})

    parts = table.select(*columns).mapInArrow(run, "i int, part binary")
    rows = parts.groupBy("i").applyInPandas(add, "i int, part binary").collect()
    return np.array([np.frombuffer(r["part"]) for r in sorted(rows, key=lambda r: r["i"])]) / n


def fit_moments(fit: DataFrame, most: int = COMPONENTS) -> Moments | None:
    """Moments of a fit list (x, weight); None if it is empty.

    Up to ``most`` components by falling eigenvalue; those without variance (to rounding)
    cannot be whitened and are left out.
    """
    n, sums = _sums(fit)
    if not n:
        return None
    centre = Centre(n, sums)
    v = _product(fit, lambda b: (centre.centred(_matrix(b.column("x"))), b.column("weight").to_numpy()), ["x", "weight"], n)
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    some = values > len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)
    return Moments(n, sums, values[some], vectors[:, some], float(np.trace(v)))


def _whitened(fit: DataFrame, m: Moments) -> DataFrame:
    centre, turn = Centre(m.n, m.sums), m.vectors / np.sqrt(m.values)
    k = len(m.values)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.empty((0, len(m.sums)), np.int64)
            y = centre.centred(x) @ turn
            ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), pa.array(centre.deviation(x), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(y.ravel()))],
                names=["key", "weight", "deviation", "whitened"],
            )

    return fit.select("key", "weight", "x").mapInArrow(run, "key binary, weight bigint, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not k:
        return 0.0
    sums = whitened.agg(*(F.sum(F.col("whitened")[i] * F.col("weight")).alias(str(i)) for i in range(k))).first()
    mean = np.array(sums) / n

    def rows_of(batch):
        y = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, k)
        return y - mean, batch.column("weight").to_numpy()

    return float(np.abs(_product(whitened, rows_of, ["whitened", "weight"], n) - np.eye(k)).max())


def whiten(table: DataFrame, vector: str, weights: str = "one", most: int = COMPONENTS) -> DataFrame:
    """The rows that take part, their vector replaced by what the fit list makes of it.

    Adds ``n`` (total weight of the fit list), ``deviation`` (sum over dimensions of
    (n*x - S)^2, exact; null beyond a long), ``whitened`` (one double per component),
    ``explained`` (each component's share of the variance) and ``identity_error``. The fit
    list has each distinct grid vector once, with weight 1 (``weights="one"``) or the number
    of its rows (``"count"``).

    Rows whose vector is null, empty, of an uncommon length, or holds null or non-finite
    entries are left out. Repeated rows and repeated or null ids stay rows of their own. All
    vectors equal: no variance, so no components. An empty table gives no rows. Input columns
    with the added names are replaced.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are one or count, not {weights}")
    spark = table.sparkSession
    added = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    names = [a.split()[0] for a in added.split(", ")]
    kept = table.drop(*[c for c in table.columns if c.lower() in names and c != vector])
    rows = on_grid(kept, vector)
    key = fresh(rows, "key")
    rows = settle(rows.withColumn(key, F.unhex(F.sha2("x", 256))), "grid")
    fit = rows.groupBy("x").agg(F.count("*").alias("weight"))
    fit = fit.select(F.unhex(F.sha2("x", 256)).alias("key"), "x", F.col("weight") if weights == "count" else F.lit(1).cast("bigint").alias("weight"))
    fit = settle(fit, "fit")
    moments = fit_moments(fit, most)
    rows = rows.drop("x")
    if moments is None:
        return spark.createDataFrame([], extended(rows.drop(key), added))
    done = settle(_whitened(fit, moments), "whitened")
    error = identity_error(done, moments.n, len(moments.values))
    shares = moments.values / moments.trace if moments.trace else moments.values
    explained = F.array(*(F.lit(float(s)) for s in shares)).cast("array<double>")
    met = rows.join(done.select(F.col("key").alias(key), "deviation", "whitened"), key).drop(key)
    return met.withColumns({"n": F.lit(moments.n).cast("bigint"), "explained": explained, "identity_error": F.lit(error)}).select(
        *rows.drop(key).columns, *names
    )
