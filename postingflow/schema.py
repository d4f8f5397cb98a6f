"""The posting schema and the rule for values that count as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "posting_id"

SALARY_TYPE = T.StructType(
    [T.StructField("annual", T.LongType()), T.StructField("monthly", T.LongType())]
)
POSTING_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("title", "company", "url", "source")]
    + [
        T.StructField(c, T.ArrayType(T.StringType()))
        for c in ("locations", "keywords", "matched_titlewords")
    ]
    + [T.StructField(c, T.StringType()) for c in ("salary", "snippet", "description", "date")]
    + [
        T.StructField("salary_guessed", SALARY_TYPE),
        T.StructField("salary_monthly_guessed", T.LongType()),
        T.StructField("points", T.DecimalType(12, 2)),
        T.StructField("language", T.StringType()),
        T.StructField("employmentTypes", T.ArrayType(T.StringType())),
        T.StructField("isHomeOffice", T.BooleanType()),
        T.StructField("isActive", T.BooleanType()),
        T.StructField("id", T.StringType()),
    ]
    + [
        T.StructField(c, T.StringType())
        for c in ("role", "requirements", "nice_to_have", "benefits")
    ]
    + [
        T.StructField(c, T.DateType())
        for c in ("collected_on", "first_collected_on", "last_collected_on")
    ]
    + [T.StructField("timespan_days", T.IntegerType())]
)
# How stores and settled postings are written: texts take about a quarter less than by default.
COMPRESSION = "zstd"
# The value object of a snapshot file: dates arrive as ISO text there.
SNAPSHOT_VALUE = T.StructType(
    [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType)
        for f in POSTING_SCHEMA.fields
        if f.name != KEY
    ]
)


def empty_postings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSTING_SCHEMA)


def conform(df: DataFrame) -> DataFrame:
    """Project to the fixed schema: missing columns become NULL, unknown ones are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in POSTING_SCHEMA.fields
        ]
    )


def truthy(c: str | Column, dtype: T.DataType) -> Column:
    """NULL, 0, false, '' and [] count as missing when snapshots are merged."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.StringType):
        test = col != ""
    elif isinstance(dtype, T.NumericType):
        test = col != 0
    elif isinstance(dtype, T.BooleanType):
        test = col
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(col) > 0
    else:
        test = col.isNotNull()
    return F.coalesce(test, F.lit(False))


def falsy_value(dtype: T.DataType) -> Column | None:
    """What a column holds when it is present but never truthy."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    return None
