"""Snapshot files and the versioned stores built from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingflow.functions.columns import word_array
from postingflow.functions.once import explode_once, materialize
from postingflow.schema import COMPRESSION, KEY, SNAPSHOT_VALUE, conform, empty_postings
from postingflow.session import settle
from postingflow.sources import buckets


def record_end(indent: int, newline: str = "\n") -> str:
    """The text that ends every posting but the last in a file written with ``indent``.

    A JSON string holds no raw newline and nested objects are indented further, so the file
    can be split between tasks there.
    """
    return newline + " " * indent + "}," + newline


def parse_snapshot(
    chunks: DataFrame, value: str = "value", schema: T.StructType = SNAPSHOT_VALUE, others: str | None = None
) -> DataFrame:
    """Postings from JSON objects ``{posting_id: posting}``, whole or cut at record ends.

    ``others`` names a column ``map<string, variant>`` for each posting's fields outside the
    schema, as they stand in the file (an empty map where there are none); without it they
    are left out.
    """
    text = F.rtrim(F.replace(F.col(value), F.lit("\r\n"), F.lit("\n")))
    opened = F.startswith(text, F.lit("{"))
    # Only the end of the file holds an unindented brace; a file on one line is complete.
    closed = F.endswith(text, F.lit("\n}")) | (opened & ~F.contains(text, F.lit("\n")))
    body = F.concat(
        F.when(opened, F.lit("")).otherwise(F.lit("{")),
        text,
        F.when(closed, F.lit("")).otherwise(F.lit("}}")),
    )
    parsed = chunks.where(text != "").withColumn("_body", body).withColumn(
        "_map", F.from_json("_body", T.MapType(T.StringType(), T.VariantType() if others else schema))
    )
    checked = F.when(
        F.col("_map").isNull(),
        F.raise_error(F.concat(F.lit("unreadable snapshot text: "), F.substring("_body", 1, 200))),
    ).otherwise(F.col("_map"))
    rest = [c for c in chunks.columns if c != value]
    rows = parsed.select(*rest, F.explode_outer(checked).alias(KEY, "_v"))
    rows = rows.where(F.col(KEY).isNotNull())
    if not others:
        return rows.select(KEY, "_v.*", *rest)
    known = word_array(schema.fieldNames())
    fields = F.coalesce(_fields(F.col("_v")), F.create_map().cast("map<string,variant>"))
    split = materialize(rows, {
        "_v": F.from_json(F.to_json("_v"), schema), others: F.map_filter(fields, lambda k, _: ~F.array_contains(known, k)),
    })
    return split.select(KEY, "_v.*", others, *rest)


def _fields(value: Column) -> Column:
    """The fields of a variant object; NULL for any other value."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value.cast("map<string,variant>"))


def key_coverage(df: DataFrame, column: str) -> DataFrame:
    """The keys that the rows' own maps or variant objects hold: ``column_name``, ``present``
    (rows with the key and a value), and whether it is in any row and in all of them.

    Keys come from the data, not from a schema. A row without fields counts as a row, so then
    no key is in all; a key whose value is null everywhere is listed and in none.
    """
    fields = _fields(F.col(column)) if isinstance(df.schema[column].dataType, T.VariantType) else F.col(column)
    is_variant = isinstance(df.select(fields.alias("f")).schema["f"].dataType.valueType, T.VariantType)

    def pair(entry):
        value = entry["value"]
        filled = value.isNotNull() & ~F.is_variant_null(value) if is_variant else value.isNotNull()
        return F.struct(entry["key"].alias("column_name"), filled.alias("filled"))

    # Each row also counts under the null key, which no field has: one pass gives both counts.
    row = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(True).alias("filled")))
    pairs = F.concat(row, F.coalesce(F.transform(F.map_entries(fields), pair), F.slice(row, 1, 0)))
    each = df.select(F.inline(pairs))
    counts = settle(each.groupBy("column_name").agg(F.count_if("filled").alias("present")), "keys")
    total = counts.where("column_name IS NULL").first()
    return counts.where("column_name IS NOT NULL").select(
        "column_name", "present", (F.col("present") > 0).alias("in_any"),
        (F.col("present") == F.lit(total["present"] if total else 0)).alias("in_all"),
    )


def read_snapshots(
    spark: SparkSession, paths, nested: bool = False, modified_after: str | None = None, indent: int = 4,
    glob: str = "*.json", newline: str = "\n", others: str | None = None,
) -> DataFrame:
    """All postings of snapshot files or folders, with ``snapshot_file`` and its time.

    ``indent`` and ``newline`` are those of the files (files on one line need none; files
    written on Windows have ``\\r\\n``); text that does not fit fails the job instead of losing
    postings, and a file with other line ends is read whole, in one task. ``others`` names a
    column for fields outside the schema (see ``parse_snapshot``).
    """
    reader = spark.read.option("lineSep", record_end(indent, newline))
    chunks = _folder_options(reader, nested, modified_after, glob).text(paths)
    with_file = chunks.select(
        "value",
        F.col("_metadata.file_path").alias("snapshot_file"),
        F.col("_metadata.file_modification_time").alias("snapshot_time"),
    )
    return parse_snapshot(with_file, others=others)


def _folder_options(reader, nested: bool, modified_after: str | None, glob: str):
    reader = reader.option("pathGlobFilter", glob)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file as one row per line."""
    return spark.read.text(path)


def read_list(spark: SparkSession, path: str, column: str = "company") -> DataFrame:
    """A flat JSON array of names (a dimension file) as rows."""
    return parse_list(spark.read.text(path, wholetext=True), column)


def parse_list(chunks: DataFrame, column: str, value: str = "value") -> DataFrame:
    return explode_once(chunks, F.from_json(value, "array<string>"), column)


def collection_date(collected: Column, file: Column, modified: Column | None = None, overwrite: bool = False) -> Column:
    """Stated date, else a date in the file name, else the file's modification date."""
    options = [] if overwrite else [F.try_to_date(F.nullif(collected.cast("string"), F.lit("")))]
    options.append(F.try_to_date(F.nullif(F.regexp_extract(file, r"20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))))
    if modified is not None:
        options.append(F.to_date(modified))
    return F.coalesce(*options)


def dated(df: DataFrame) -> DataFrame:
    """Give every row of a snapshot scan its collection date."""
    return df.withColumn(
        "collected_on",
        collection_date(F.col("collected_on"), F.col("snapshot_file"), F.col("snapshot_time")),
    )


def nth_snapshot(df: DataFrame, n: int = 0, column: str = "snapshot_id", ascending: bool = False) -> DataFrame:
    """Rows of the n-th snapshot by name (0 = latest); none when out of range.

    Only the snapshot names are sorted (top ``n+1``); the chosen one comes back as a
    one-row broadcast that prunes the scan.
    """
    ids = df.select(column).distinct()
    top = ids.orderBy(F.asc(column) if ascending else F.desc(column)).limit(n + 1)
    chosen = top.agg(
        F.count("*").alias("_c"), (F.max(column) if ascending else F.min(column)).alias(column)
    ).where(F.col("_c") == n + 1).select(column)
    return df.join(F.broadcast(chosen), column, "left_semi")


def list_files(spark: SparkSession, path: str, nested: bool = False, glob: str = "*.json") -> DataFrame:
    """Path, time and size of the files of a folder, and its partition columns; no file is opened."""
    reader = _folder_options(spark.read.format("binaryFile"), nested, None, glob)
    return reader.load(path).drop("content")


def nth_name(names: DataFrame, n: int = 0, ascending: bool = False) -> str | None:
    """The n-th of a column of names (0 = last by name, or first); None when out of range."""
    column = names.columns[0]
    top = names.distinct().orderBy(F.asc(column) if ascending else F.desc(column)).limit(n + 1).collect()
    return top[n][0] if len(top) == n + 1 else None


def read_nth_file(
    spark: SparkSession, path: str, n: int = 0, ascending: bool = False, glob: str = "*.json", **options
) -> DataFrame | None:
    """The n-th snapshot file of a folder by name; only that file is read. None when out of range."""
    files = list_files(spark, path, glob=glob)
    name = nth_name(files.select("path"), n, ascending)
    # The name is used as it is: a glob character in it must not match other files.
    return None if name is None else read_snapshots(spark, re.sub(r"([\\*?\[\]{}])", r"\\\1", name), glob="*", **options)


def read_nth_partition(spark: SparkSession, path: str, column: str, n: int = 0, ascending: bool = False) -> DataFrame:
    """The n-th partition by name of a table written by ``column``; no rows when out of range.

    Names come from the listing of folders. The scan gets a literal partition filter, so it
    opens the files of one partition.
    """
    names = list_files(spark, path, glob="*").select(F.col(column).cast("string"))
    name = nth_name(names, n, ascending)
    rows = spark.read.parquet(path)
    wanted = F.lit(name).cast(rows.schema[column].dataType)
    return rows.where(F.lit(False) if name is None else F.col(column) == wanted)


def write_snapshot(df: DataFrame, path: str, partition_by=("profile", "snapshot_date"), fmt: str = "parquet", mode: str = "append") -> None:
    """Write postings partitioned by profile and date where those columns exist.

    ``rebalance`` gathers each output partition into few files and splits a large one.
    """
    parts = [c for c in partition_by if c in df.columns]
    if not parts:
        df.write.mode(mode).format(fmt).save(path)
        return
    df.hint("rebalance", *parts).write.mode(mode).format(fmt).partitionBy(*parts).save(path)


def append_log(lines: DataFrame, path: str) -> None:
    """Append the lines of one run; an empty run leaves the log as it was."""
    lines.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, newest run first."""
    return spark.read.parquet(path).orderBy(F.desc("run_ts"), KEY)


# --- versioned tables ----------------------------------------------------------------------


def _commits(spark: SparkSession, path: str) -> list:
    """Completed versions of a table: (version, batch) rows, added when a version is written."""
    try:
        rows = spark.read.schema("version int, batch string").parquet(f"{path}/commits").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: r["version"])


def next_version(spark: SparkSession, path: str) -> int:
    commits = _commits(spark, path)
    return commits[-1]["version"] + 1 if commits else 0


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch of a stream is in the table already."""
    return any(r["batch"] == batch for r in _commits(spark, path))


def read_store(
    spark: SparkSession, path: str, before: int | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The latest version of a stored table (or the latest below ``before``), written whole or
    in buckets; empty before the first write."""
    commits = [c for c in _commits(spark, path) if before is None or c["version"] < before]
    if not commits:
        return empty_postings(spark) if schema is None else spark.createDataFrame([], schema)
    state = buckets.manifest(spark, path, before)
    if state is not None and state.version == commits[-1]["version"]:
        return buckets.read_buckets(spark, path, state)
    return spark.read.parquet(f"{path}/version={commits[-1]['version']}")


def write_store(df: DataFrame, path: str, batch: str | None = None) -> int:
    """Write the next version; readers see it once its commit row is there.

    The version being read is never touched, so a job may derive the next one from it, and
    what a failed attempt left is overwritten. ``batch`` names the batch of a stream that
    the version holds.
    """
    spark = df.sparkSession
    version = next_version(spark, path)
    df.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{path}/version={version}")
    commit = spark.createDataFrame([(version, batch)], "version int, batch string")
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def merge_store(
    rows: DataFrame, path: str, combine: Callable[[DataFrame, DataFrame], DataFrame], key=KEY, batch: str | None = None,
    number: int = buckets.BUCKETS, **writing,
) -> tuple[buckets.Manifest, list[int]]:
    """Merge settled rows into a store in buckets: only those that their keys fall in are read
    and written anew (see ``buckets``, also for ``writing``). Returns the new manifest and the touched buckets."""
    spark = rows.sparkSession
    return buckets.merge_rows(rows, path, combine, next_version(spark, path), key, number, batch, **writing)


def read_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings in the fixed schema, empty if there are none yet."""
    return conform(read_store(spark, path))
