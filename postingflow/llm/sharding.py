"""Uniform shuffles into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh, ranked

EXACT_ROWS = 10**9  # numpy's sampler takes fewer rows than this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows out of good + bad are good.

    Above numpy's range: inversion over the probabilities around the mode, twelve standard
    deviations to each side (what lies outside is below double precision).
    """
    if good + bad < EXACT_ROWS:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    total = good + bad
    share = good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1)) + 1
    mode = int((drawn + 1) * (good + 1) / (total + 2))
    low, high = max(0, drawn - bad, mode - int(12 * spread)), min(good, drawn, mode + int(12 * spread))
    k = np.arange(low, high, dtype=float)  # log of p(k + 1) / p(k)
    steps = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def multivariate(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows come from each of the shards' places."""
    out, rest = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        out[i] = hypergeometric(rng, size, rest, drawn)
        drawn -= int(out[i])
    return out


def matrix_row(partition: int, starts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix: its number of rows for each shard.

    ``starts`` are the partitions' first rows, and the number of all rows at the end. The
    places of the shards are dealt down a binary tree over the partitions; a node's draw
    depends on the seed and the node alone, so each task finds its own row, the same in any
    attempt, and row and column sums are exact.
    """
    total = int(starts[-1])
    sizes = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    low, high = 0, len(starts) - 1
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = multivariate(rng, sizes, int(starts[mid] - starts[low]))
        if partition < mid:
            sizes, high = left, mid
        else:
            sizes, low = sizes - left, mid
    return sizes


def shard_rows(df: DataFrame, shards: int, seed: int = 11, per_bucket: int = 50_000) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within a shard).

    ``df`` must be a plain read of files, possibly with columns computed row by row: its
    partitions are read twice, and a task that finds other than the counted rows fails.
    First the partitions' rows are counted. Each task then draws its row of the matrix,
    deals the shards out among its rows in random order (the local permutation), and gives
    each row 63 random bits; rows move once, to buckets of their shard by these bits, and a
    row's slot is its rank by them (the second permutation). Shards hold numbers of rows at
    most one apart whatever the rows hold: repeats, ties and nulls have no part in it. Only
    the counts, one number for each partition, pass through the driver. Input columns named
    ``shard`` or ``slot`` are replaced; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    bits = fresh(df, "bits")
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = {r["p"]: r["count"] for r in counts}
    last = max(sizes, default=-1)
    starts = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(last + 1)], dtype=np.int64)))

    def deal(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, 1, p])
        rows = int(starts[p + 1] - starts[p]) if p <= last else 0
        labels = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(p, starts, shards, seed)) if rows else np.array([], np.int32)
        rng.shuffle(labels)
        seen = 0
        for batch in batches:
            part = labels[seen : seen + batch.num_rows]
            if len(part) < batch.num_rows:
                raise RuntimeError("the input's partitions changed between two reads")
            seen += batch.num_rows
            more = [pa.array(part), pa.array(rng.integers(0, 2**63, len(part), dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "shard", bits])
        if seen != len(labels):
            raise RuntimeError("the input's partitions changed between two reads")

    def dealt(table: DataFrame) -> DataFrame:
        return table.mapInArrow(deal, extended(table, f"shard int, `{bits}` bigint"))

    # The counts of shards and buckets need no column of the input, but batches need one.
    numbered = ranked(
        dealt(df), ["shard"], bits, [], "slot", per_bucket, total=int(starts[-1]), counted=dealt(df.select(F.lit(0).alias("none")))
    )
    return numbered.drop(bits)
