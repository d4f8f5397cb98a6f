"""A corpus pipeline: toxicity, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir), with ``docs`` a read of the table that the stage
before wrote, and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postingflow.llm import exact_dedup, mixing, queries, simhash, toxicity
from postingflow.llm.common import fresh, keep_rows, with_row
from postingflow.session import settle


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are more likely toxic than not."""
    model = queries.toxic_model(docs, queries.read(spark, sf_dir, "labels"))
    row = fresh(docs, "row")
    scored = toxicity.score(with_row(docs, row).select(row, "text"), model)
    return keep_rows(docs, scored.where("predicted = 0"), row)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the schedule."""
    return mixing.ordered(mixing.mix(docs), docs.columns, docs=docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' ids with their places in the sequences, which follow the mix's order."""
    return queries.packed(docs, mixed=True)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# Learned scores, fingerprints and token ids are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
