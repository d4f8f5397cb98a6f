"""Keyed stores in buckets of the key's hash: a run reads and rewrites only what it touches.

A store is a folder with ``data/version=V/store_bucket=B`` (rows), ``filters/version=V`` (the
keys of the buckets written then, as Bloom filters) and ``commits``. The last commit row is the
manifest: for each bucket the version that holds it, or -1. A bucket that a run does not touch
stays where an earlier version wrote it. Nothing is changed in place, and a version counts once
its commit row is there, so a run that fails half-way leaves the store as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingflow.operators.skew import cols, rows_without_key
from postingflow.schema import COMPRESSION, KEY
from postingflow.session import settle

BUCKETS = 16
BUCKET = "store_bucket"
COMMIT = "version int, batch string, buckets int, held array<int>, fields string"

# Bloom filters: blocks of one Spark bitmap each, four bits a key within its block.
BLOCK_BITS = 32_768
BITS_PER_KEY = 12
PROBES = 4


@dataclass(frozen=True)
class Manifest:
    """Where each bucket of a store is, and the fields of its rows."""

    version: int
    held: tuple[int, ...]
    schema: T.StructType

    @property
    def buckets(self) -> int:
        return len(self.held)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> Manifest | None:
    """The latest manifest (or the latest below ``before``); None where there is none."""
    try:
        rows = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = rows.where("held IS NOT NULL")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    if not last:
        return None
    return Manifest(last[0]["version"], tuple(last[0]["held"]), T.StructType.fromJson(json.loads(last[0]["fields"])))


def bucket_of(key, buckets: int) -> Column:
    """The bucket of a key; a null key has one as well."""
    return F.pmod(F.xxhash64(*cols(key)), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, key, buckets: int) -> list[int]:
    """The buckets that the rows' keys fall in; at most the number of buckets reaches the driver."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect())


def read_buckets(spark: SparkSession, path: str, state: Manifest | None, some=None, schema: T.StructType | None = None) -> DataFrame:
    """The rows of some buckets (all, if not said), from the folders that hold them."""
    if state is None:
        return spark.createDataFrame([], schema if schema is not None else f"{KEY} string")
    chosen = range(state.buckets) if some is None else some
    folders = [f"{path}/data/version={state.held[b]}/{BUCKET}={b}" for b in chosen if state.held[b] >= 0]
    if not folders:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(*folders)


def rewrite_buckets(
    df: DataFrame, path: str, key, state: Manifest | None, some: list[int], version: int, buckets: int, batch: str | None = None,
    grouped: bool = False, before_commit: Callable[[DataFrame], None] | None = None,
) -> Manifest:
    """Write ``df``, all rows of the buckets ``some``, and commit them as a version.

    ``rebalance`` gathers each bucket into few files and splits a large one. Rows that come
    ``grouped`` from a shuffle by key are written as they come, so they are not moved a second
    time; a bucket then has a file of each task. ``before_commit`` gets the written rows.
    """
    spark = df.sparkSession
    if BUCKET in df.columns:
        raise ValueError(f"a stored table has no column {BUCKET}")
    folder = f"{path}/data/version={version}"
    placed = df.withColumn(BUCKET, bucket_of(key, buckets))
    placed = placed if grouped else placed.hint("rebalance", BUCKET)
    placed.write.mode("overwrite").option("compression", COMPRESSION).partitionBy(BUCKET).parquet(folder)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(folder)
    write_filters(written.select(*cols(key), BUCKET), path, key, version)
    full = {r[BUCKET] for r in spark.read.schema(f"{BUCKET} int").parquet(f"{path}/filters/version={version}").distinct().collect()}
    if not full <= set(some):
        raise ValueError(f"rows of buckets {sorted(full - set(some))} would replace what was not read")
    held = list(state.held) if state else [-1] * buckets
    for b in some:
        held[b] = version if b in full else -1
    if before_commit:
        before_commit(written.drop(BUCKET))
    commit = spark.createDataFrame([(version, batch, buckets, held, schema.json())], COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return Manifest(version, tuple(held), schema)


def merge_rows(
    rows: DataFrame, path: str, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int, key=KEY,
    buckets: int = BUCKETS, batch: str | None = None, **writing,
) -> tuple[Manifest, list[int]]:
    """Merge ``rows`` (settled, as they are read more than once) into a store.

    ``combine`` gets the stored rows of the touched buckets (with no columns but the rows' own
    in a new store) and the new rows, and returns what these buckets hold from now on. Returns
    the new manifest and the buckets. ``buckets`` counts for a new store only; ``writing`` goes
    to ``rewrite_buckets``.
    """
    spark = rows.sparkSession
    state = manifest(spark, path)
    n = state.buckets if state else buckets
    some = touched(rows, key, n)
    past = read_buckets(spark, path, state, some, rows.schema)
    return rewrite_buckets(combine(past, rows), path, key, state, some, version, n, batch, **writing), some


def rebucket(spark: SparkSession, path: str, buckets: int, version: int, key=KEY) -> Manifest:
    """Write a whole store anew in another number of buckets, when they have grown too large."""
    state = manifest(spark, path)
    if state is None:
        raise ValueError(f"no store at {path}")
    return rewrite_buckets(read_buckets(spark, path, state), path, key, None, list(range(buckets)), version, buckets)


def bucket_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(store_bucket, version, stored rows) of the buckets that hold rows."""
    state = manifest(spark, path)
    empty = spark.createDataFrame([], f"{BUCKET} int, version int, rows bigint")
    folders = [f"{path}/data/version={v}/{BUCKET}={b}" for b, v in enumerate(state.held) if v >= 0] if state else []
    if not folders:
        return empty
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders)
    return rows.groupBy(BUCKET, "version").agg(F.count("*").alias("rows"))


# --- key filters ---------------------------------------------------------------------------


def _probes(key) -> list[Column]:
    """The bit positions of a key within its block."""
    bits = F.xxhash64(F.lit("bits"), *cols(key))
    return [F.shiftrightunsigned(bits, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("bigint")) for i in range(PROBES)]


def _block(key, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *cols(key)), blocks).cast("int")


def write_filters(keys: DataFrame, path: str, key, version: int) -> None:
    """The keys (with their bucket) of a version as one row per bucket and block of bits.

    A bucket has as many blocks as its rows ask for; bits are set by map-side aggregates, so a
    block is one 4 KB row however many keys it has.
    """
    sizes = keys.groupBy(BUCKET).agg(F.ceil(F.count("*") * BITS_PER_KEY / BLOCK_BITS).cast("int").alias("blocks"))
    placed = keys.join(sizes, BUCKET).select(
        BUCKET, "blocks", _block(key, F.col("blocks")).alias("block"), F.explode(F.array(*_probes(key))).alias("bit")
    )
    made = placed.groupBy(BUCKET, "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    made.write.mode("overwrite").parquet(f"{path}/filters/version={version}")


def read_filters(spark: SparkSession, path: str, state: Manifest, some: list[int]) -> DataFrame:
    """(store_bucket, blocks, block, bits) of the given buckets, each from the version that holds it."""
    by_version: dict[int, list[int]] = {}
    for b in some:
        if state.held[b] >= 0:
            by_version.setdefault(state.held[b], []).append(b)
    parts = [
        spark.read.parquet(f"{path}/filters/version={v}").where(F.col(BUCKET).isin(own)) for v, own in sorted(by_version.items())
    ]
    found = spark.createDataFrame([], f"{BUCKET} int, blocks int, block int, bits binary")
    for part in parts:
        found = found.unionByName(part)
    return found


def _set(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substr(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1


def with_maybe_known(rows: DataFrame, path: str, state: Manifest, key=KEY, name: str = "maybe_known") -> DataFrame:
    """The rows with ``name``: False where the filters rule out that the store has the key."""
    spark = rows.sparkSession
    placed = rows.withColumn(BUCKET, bucket_of(key, state.buckets))
    some = touched(rows, key, state.buckets)
    filters = read_filters(spark, path, state, some)
    sizes = filters.select(BUCKET, "blocks").distinct()
    block = placed.join(sizes, BUCKET, "left").withColumn("block", _block(key, F.col("blocks"))).drop("blocks")
    met = block.join(filters.select(BUCKET, "block", "bits"), [BUCKET, "block"], "left")
    hit = F.lit(True)
    for position in _probes(key):
        hit = hit & _set(F.col("bits"), position)
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).select(*rows.columns, name)


def added_rows(rows: DataFrame, path: str, state: Manifest | None, key=KEY) -> DataFrame:
    """The rows (settled) whose key the store does not have.

    Keys that the filters deny are new without a look at the history; for the others the keys
    of their own buckets alone are read and joined.
    """
    if state is None:
        return rows
    tested = settle(with_maybe_known(rows, path, state, key), "tested")
    maybe = tested.where("maybe_known")
    past = read_buckets(rows.sparkSession, path, state, touched(maybe, key, state.buckets)).select(*cols(key))
    return tested.where("NOT maybe_known").unionByName(rows_without_key(maybe, past, key)).drop("maybe_known")


def added_keys(rows: DataFrame, path: str, key=KEY) -> DataFrame | None:
    """The distinct keys of the rows that the store does not have (settled), by ``added_rows``;
    None where there is no store yet, so that all are new. A null key is always new."""
    state = manifest(rows.sparkSession, path)
    if state is None:
        return None
    keys = settle(rows.select(*cols(key)).distinct(), "keys")
    return settle(added_rows(keys, path, state, key), "added")
