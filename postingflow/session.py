"""Session settings, the shared scratch folder, and input spreading."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings for a cluster run; a job may override any of them. AQE sizes the shuffle
# partitions, so no fixed partition count is set here.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole pages travel to the HTML functions: keep an Arrow batch small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "postingflow", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="run-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session (tests, a laptop) may do without ``spark.checkpoint.dir``: a folder
    on one machine of a cluster would lose what the other machines write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master or 'the cluster'} share")
        base = _local_base()
    return f"{base.rstrip('/')}/postingflow/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str, **options) -> DataFrame:
    """Write a computed table to the shared scratch folder and read it back.

    For results that several outputs, or a global sort (which samples its input first),
    would otherwise compute again; it also cuts the lineage a lost executor would replay.
    ``options`` are the writer's, such as ``compression``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows over the given number of partitions before CPU-bound work, if one is given.

    The number comes from the caller or from ``postingflow.inputPartitions``, for runs whose
    input is too few files or row groups to share out; without it the table is left as is.
    """
    asked = partitions or df.sparkSession.conf.get("postingflow.inputPartitions", None)
    return df.repartition(int(asked)) if asked else df
