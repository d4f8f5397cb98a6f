"""Joins by key that Spark can split where one key holds a large share of the rows.

Adaptive execution cuts a large partition of the left side of an inner, left, semi or anti
join by its bytes, provided that both sides come straight from a shuffle of plain rows. So
these joins take plain tables, and a table of results per key is settled first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.session import settle


def cols(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def rows_with_key(rows: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows whose key is in ``other``."""
    return rows.join(other.select(*cols(key)), cols(key), "left_semi")


def rows_with_same_key(rows: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows whose key is in ``other``, where a null key is a key like any other."""
    named = other.select(*[F.col(c).alias(f"_o_{c}") for c in cols(key)])
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in cols(key)]
    return rows.join(named, same, "left_semi")


def rows_without_key(rows: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return rows.join(other.select(*cols(key)), cols(key), "left_anti")


def join_per_key(rows: DataFrame, per_key: DataFrame, key, how: str = "inner") -> DataFrame:
    """Join rows to computed results with one row per key, which are settled first."""
    return rows.join(settle(per_key, "per_key"), cols(key), how)


def rows_of_light_keys(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows whose key occurs at most ``limit`` times.

    Heavy keys go with the partial counts; the rows left to find are few per key.
    """
    light = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") <= limit).select(key)
    return rows_with_key(rows, settle(light, "light"), key)
