"""Report tables over predicted scores. All datasets, splits and metrics in one job each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.scalar import abs_error, direction

SPLIT_NAMES = {"val": "Validation", "test": "Test"}


def named_split(predictions: DataFrame) -> DataFrame:
    """Spell the split names out."""
    spelled = F.col("split")
    for short, full in SPLIT_NAMES.items():
        spelled = F.when(F.col("split") == short, F.lit(full)).otherwise(spelled)
    return predictions.withColumn("split", spelled)


def union_predictions(val: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of both splits; a column only one side has is null on the other."""
    return val.unionByName(test, allowMissingColumns=True)


def with_abs_errors(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return predictions.withColumns(
        {f"{m}_abs_error": abs_error(F.col(f"predicted_{m}"), F.col(m)) for m in metrics}
    )


def mean_abs_errors(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean absolute error per metric and split, missing scores left out."""
    errors = with_abs_errors(predictions, metrics)
    return errors.groupBy("split").agg(*[F.avg(f"{m}_abs_error").alias(m) for m in metrics])


def mae_summary(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean_abs_error_val, mean_abs_error_test)."""
    long = mean_abs_errors(predictions, metrics).unpivot("split", list(metrics), "metric", "error")
    return (
        long.groupBy("metric")
        .pivot("split", ["val", "test"])
        .agg(F.first("error"))
        .withColumnsRenamed({"val": "mean_abs_error_val", "test": "mean_abs_error_test"})
    )


def comparison_columns(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The score columns beside their predictions, for reading."""
    pairs = [c for m in metrics for c in (m, f"predicted_{m}")]
    return predictions.select("dataset_name", "model_name", "split", *pairs)


def comparison(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(dataset, split, metric, model, actual, predicted, difference, direction): means per model."""
    means = named_split(predictions).groupBy("dataset_name", "split", "model_name").agg(
        *[F.struct(F.avg(m).alias("actual"), F.avg(f"predicted_{m}").alias("predicted")).alias(m) for m in metrics]
    )
    keys = ["dataset_name", "split", "model_name"]
    long = means.unpivot(keys, list(metrics), "metric", "pair")
    difference = F.col("pair.predicted") - F.col("pair.actual")
    return long.select(
        *keys,
        "metric",
        F.col("pair.actual").alias("actual"),
        F.col("pair.predicted").alias("predicted"),
        difference.alias("difference"),
        direction(F.col("metric"), difference).alias("direction"),
    )


def comparison_long(compared: DataFrame) -> DataFrame:
    """The comparison as (…, Metric_Type, Value) rows, ready to plot."""
    keys = ["dataset_name", "split", "metric", "model_name"]
    return (
        compared.withColumnsRenamed({"actual": "Actual", "predicted": "Predicted"})
        .unpivot(keys, ["Actual", "Predicted"], "Metric_Type", "Value")
    )
