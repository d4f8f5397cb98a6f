"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm.common import ascii_lower, fresh, keep_rows, with_row
from postingflow.session import scratch_dir, settle

BUCKETS = 32  # of an index, at least
BUCKET_ROWS = 4_000_000  # digests that a bucket is meant for, some 200 MB
INDEX = "digest binary, keep_id bigint, keep_row bigint"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many digests: a power of two, ``BUCKETS`` at least."""
    return max(BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


class DigestIndex:
    """A table of known digests at ``path``: one row per digest, and the row that owns it.

    The table is bucketed and sorted by digest. New digests come in the same buckets, so
    the sort-merge anti-join that finds the unknown ones moves no row of the index, and an
    append adds one sorted file to each bucket. The files are the index, and a one-row table
    beside them keeps the number of buckets: any session that opens the path goes on with it.
    Asking for another number is an error, as digests would be looked for in wrong buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        kept = self._kept_buckets(spark, path)
        if kept and buckets not in (None, kept):
            raise ValueError(f"the index at {path} has {kept} buckets, not {buckets}")
        self.spark, self.path, self.buckets = spark, path, kept or buckets or BUCKETS
        if not kept:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{path}.buckets")
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        self.append(spark.createDataFrame([], INDEX))  # makes the folder

    @staticmethod
    def _kept_buckets(spark: SparkSession, path: str) -> int | None:
        try:
            return spark.read.parquet(f"{path}.buckets").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def unknown(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, ...) whose digest the index does not have."""
        return rows.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add rows (digest, keep_id, keep_row); each digest once, and unknown so far."""
        rows.select("digest", "keep_id", "keep_row").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def owners(self) -> DataFrame:
        """All rows, read as plain files: a join with them may then split a hot digest."""
        return self.spark.read.schema(INDEX).parquet(self.path)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def ingest(rows: DataFrame, index: DigestIndex) -> None:
    """Take a load of (row, doc_id, digest) into the index.

    Copies inside the load shrink to their owner before the shuffle: the largest id, and of
    equal ids the largest row number. Owners of unknown digests are appended.
    """
    owners = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("owner"))
    new = index.unknown(owners).select("digest", F.col("owner.doc_id").alias("keep_id"), F.col("owner.row").alias("keep_row"))
    index.append(new)


def assign_owners(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text: str = "text", loads: int = 2) -> DataFrame:
    """(row, doc_id, digest, keep_id, keep_row, group_size, kept) for every row of ``docs``.

    ``docs`` must be a plain read of files (rows are known by their scan number). Loads go
    in from large ids to small ones, cut at quantiles of the id, so of equal texts the
    largest id owns the digest; a digest that the index knew before keeps its owner, and no
    new row of it stays. Null texts equal empty ones; null ids are smaller than all others;
    of repeated rows one stays; an empty table gives an empty result. Copies are counted
    before the shuffle, and the join that brings owners back to rows is between two plain
    scans, where Spark splits a hot digest.
    """
    spark = docs.sparkSession
    row = fresh(docs, "row")
    rows = with_row(docs, row).select(
        F.col(row).alias("row"), F.col(id_column).cast("bigint").alias("doc_id"), digest_of(F.col(text)).alias("digest")
    )
    rows = settle(rows, "digests")
    known = settle(index.owners(), "known")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / loads for i in range(loads - 1, 0, -1)], 1000)).first()[0]
    load, id_ = F.lit(0), F.coalesce("doc_id", F.lit(-(2**63)))
    for cut in cuts or ():
        load = load + F.when(id_ < cut, 1).otherwise(0)
    for i in range(loads):
        ingest(rows.where(load == i), index)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    old = known.select("digest", F.lit(True).alias("old"))
    groups = sizes.join(index.owners(), "digest").join(old, "digest", "left")
    groups = settle(groups, "groups")
    kept = F.col("old").isNull() & (F.col("row") == F.col("keep_row"))
    return rows.join(groups, "digest").withColumn("kept", kept).drop("old")


def open_scratch_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared scratch folder."""
    return DigestIndex(spark, scratch_dir(spark, "index"), buckets)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (a plain read) without all but the owner of each group of equal texts."""
    index = open_scratch_index(docs.sparkSession, buckets_for(docs.count()))
    row = fresh(docs, "row")
    owned = assign_owners(docs, index, id_column, text)
    index.close()
    return keep_rows(docs, owned.where("kept").select(F.col("row").alias(row)), row)
