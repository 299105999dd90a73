"""Standardisation with population deviations: fit on one set of rows, apply to any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.scalar import nan_to_null
from scoreweave.operators.cleaning import with_small_row
from scoreweave.session import measured


def centred(value: Column, mean: Column, std: Column) -> Column:
    """``(v - mean) / std``; a column without spread is only centred."""
    return F.when(std > 0, (value - mean) / std).otherwise(value - mean)


def restored(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, value * std + mean).otherwise(value + mean)


def fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``<c>_mean, <c>_std`` per column; missing values are left out."""
    clean = {c: nan_to_null(F.col(c).cast("double")) for c in columns}
    return df.agg(
        *[F.avg(v).alias(f"{c}_mean") for c, v in clean.items()],
        *[F.stddev_pop(v).alias(f"{c}_std") for c, v in clean.items()],
    )


def apply(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _map(df, stats, columns, centred)


def invert(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _map(df, stats, columns, restored)


def _map(df, stats, columns, how) -> DataFrame:
    joined = with_small_row(df, stats)
    return joined.select(
        *[
            how(F.col(c).cast("double"), F.col(f"{c}_mean"), F.col(f"{c}_std")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def fit_long(df: DataFrame, columns: Sequence[str], name: str = "metric") -> DataFrame:
    """The fitted statistics as rows ``(metric, mean, std)``: the form that is stored."""
    cells = df.select(*columns).unpivot([], list(columns), name, "value")
    return cells.groupBy(name).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# -- many tables at once, in array form ---------------------------------------


def fit_arrays(matrix: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """Per table, an array of (pos, mean, std) over its feature positions.

    Missing entries take the mean before the deviation is measured, so they
    shrink it by ``sqrt(present / all)``. A position without any value keeps a
    null mean and is dropped on application.
    """
    cells = matrix.select(*keys, F.posexplode("features").alias("pos", "value"))
    per_column = cells.groupBy(*keys, "pos").agg(
        F.avg("value").alias("mean"),
        (F.stddev_pop("value") * F.sqrt(F.count("value") / F.count("*"))).alias("std"),
    )
    return per_column.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("stats")
    )


def apply_arrays(matrix: DataFrame, stats: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """Impute with the mean and standardise. ``stats`` holds one row per table."""
    scaled = F.transform(
        F.filter(F.arrays_zip("features", "stats"), lambda z: z["stats"]["mean"].isNotNull()),
        lambda z: centred(F.coalesce(z["features"], z["stats"]["mean"]), z["stats"]["mean"], z["stats"]["std"]),
    )
    return (
        matrix.join(measured(stats), list(keys))
        .withColumn("features", scaled)
        .drop("stats")
        .select(*matrix.columns)
    )
