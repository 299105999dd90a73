"""File scans. Every reader takes an explicit schema, so nothing is scanned twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_with_header(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV whose first line names the columns. Without a schema, types are inferred."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def csv_headerless(
    spark: SparkSession, path: str, schema: T.StructType, na_token: str = "?", keep_na_token: bool = False
) -> DataFrame:
    """CSV without header: names come from ``schema``, blanks after commas are trimmed.

    ``keep_na_token=True`` leaves the token in text columns as a value of its
    own, which is what a token spelled with the (already trimmed) blank does.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    if not keep_na_token:
        reader = reader.option("nullValue", na_token)
    return reader.csv(path)


def whitespace_delimited(
    spark: SparkSession, path: str, schema: T.StructType, na_token: str = "?"
) -> DataFrame:
    """Columns separated by runs of blanks; a quoted last column may hold blanks."""
    tokens = F.regexp_extract_all(F.trim("value"), F.lit(r"(\"[^\"]*\"|\S+)"), 1)
    lines = spark.read.text(path).filter(F.trim("value") != "").select(tokens.alias("token"))
    columns = []
    for i, field in enumerate(schema.fields):
        raw = F.trim(F.get("token", F.lit(i)))
        raw = F.when(raw != F.lit(na_token), F.regexp_replace(raw, '^"|"$', ""))
        columns.append(raw.try_cast(field.dataType).alias(field.name))
    return lines.select(*columns)


def concat_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """One table out of parts that share a schema (for example train and test images)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vector_columns(df: DataFrame, vector: str, width: int, prefix: str = "pixel_") -> DataFrame:
    """Spread an array column over ``width`` columns."""
    rest = [c for c in df.columns if c != vector]
    return df.select(
        *rest, *[F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)]
    )
