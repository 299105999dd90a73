"""Projection, guards on missing values and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.scalar import nan_to_null
from scoreweave.operators.order_stats import exact_quantiles

ONE = "_all"


def features_only(df: DataFrame, label: str) -> DataFrame:
    return df.drop(label)


def label_only(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.select(key, label)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the named columns; names that do not exist are ignored."""
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def with_small_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row table of statistics by an equi-join on a constant key."""
    keyed = stats.withColumn(ONE, F.lit(1))
    return df.withColumn(ONE, F.lit(1)).join(F.broadcast(keyed), ONE).drop(ONE)


def fill_with(df: DataFrame, stats: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Replace nulls of each column by the statistic named beside it."""
    joined = with_small_row(df, stats)
    return joined.select(
        *[F.coalesce(c, pairs[c]).alias(c) if c in pairs else F.col(c) for c in df.columns]
    )


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact median, found without gathering a column in one task."""
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.*")
    medians = (
        exact_quantiles(cells, ["feature"], "value", [0.5])
        .groupBy()
        .agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_fill_{c}") for c in columns])
    )
    return fill_with(df, medians, {c: f"_fill_{c}" for c in columns})


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent text of each column; the smallest wins ties.

    Counting (column, value) pairs first keeps the aggregate's state bounded
    per group instead of one map of all values in a single buffer.
    """
    counts = (
        df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
            ).alias("cell")
        )
        .select("cell.*")
        .filter("value is not null")
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return best.groupBy().agg(
        *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_fill_{c}") for c in columns]
    )


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_with(df, modes(df, columns), {c: f"_fill_{c}" for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean imputation; NaN counts as missing. A column without any value is dropped."""
    clean = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns])
    stats = clean.agg(*[F.avg(c).alias(f"_fill_{c}") for c in columns])
    empty = [c for c, v in zip(columns, stats.first(), strict=True) if v is None]
    return fill_with(clean, stats, {c: f"_fill_{c}" for c in columns}).drop(*empty)


def fill_column_mean(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Replace a missing target by the mean target of its group."""
    means = df.groupBy(*keys).agg(F.avg(nan_to_null(F.col(column))).alias("_mean"))
    return df.join(means, list(keys), "left").select(
        *[F.coalesce(nan_to_null(F.col(c)), "_mean").alias(c) if c == column else F.col(c) for c in df.columns]
    )
