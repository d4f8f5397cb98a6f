"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, more: str) -> StructType:
    """The table's schema and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 text, null as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, actions hand texts to Python in batches of so many rows, to save memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Number the rows by their place in the scan.

    ``df`` must be a plain read of files: then any two passes split it alike, whatever
    columns they take, and a repeated task gives its rows the same numbers.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def keep_rows(docs: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` (a plain read) whose scan number is in ``kept``.

    Numbers are all different, so the join has no hot key.
    """
    return with_row(docs, row).join(kept.select(row), row, "left_semi").select(*docs.columns)


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], name: str, per_bucket: int = 50_000,
           total: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Gapless ranks from 0 within each key by a long column ``order``, no key in one task.

    ``order`` must spread over all longs (a hash or random bits). Its top bits cut each key
    into buckets of about ``per_bucket`` rows; a bucket is ranked in one task and its offset
    is the sum of the counts before it. Only counts, one row per key and bucket, are summed
    in order. ``df`` is read twice, so it should be cheap or settled; ``total`` is its number
    of rows if known, and ``counted`` a cheaper table with the same keys and orders.
    """
    bits = ((df.count() if total is None else total) // per_bucket).bit_length()
    bucket, base = fresh(df, "bucket"), fresh(df, "base")
    # Never null, so that the join has the partitioning of the window and moves no row again.
    tokens = {fresh(df, f"token_{k}"): F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys}
    place = {**tokens, bucket: F.shiftright(F.col(order), 63 - bits)}
    cut = df.withColumns(place)
    before = Window.partitionBy(*tokens).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = (df if counted is None else counted).withColumns(place).groupBy(*place).agg(F.count("*").alias(base))
    offsets = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*place).orderBy(order, *ties)
    rank = fresh(df, "rank")
    numbered = cut.withColumn(rank, F.row_number().over(inside) - F.lit(1)).join(offsets, list(place))
    columns = [c for c in df.columns if c != name]
    return numbered.select(*columns, (F.col(rank) + F.col(base)).alias(name))
