"""Keeping Catalyst from evaluating an expensive expression more than once.

Filter pushdown and projection merging substitute an alias by its definition at every use.
That is free for columns and costly for text work, so the two barriers below are used
around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialize(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set columns behind a one-row generator: later filters on them use the result.

    Filters on the other columns still move below it. The ``outer`` form is used because
    Catalyst infers a filter from a plain generator that would evaluate its input again.
    """
    rest = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*rest, F.inline_outer(F.array(row)))


def explode_once(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """One row per element of a computed array, which is evaluated once."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
