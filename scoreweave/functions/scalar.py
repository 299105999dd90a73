"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guard added to denominators and histogram counts, and the bin count.
EPSILON = 1e-10
HISTOGRAM_BINS = 10

# Metrics where a smaller number is the better one.
LOWER_IS_BETTER = ("mae", "mse", "rmse")


def abs_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual)


def root(value: Column) -> Column:
    return F.sqrt(value)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``a / (b + 1e-10)``; null instead of an ANSI error if that sum is 0."""
    return F.try_divide(numerator, denominator + F.lit(EPSILON))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Map ``[low, high]`` onto ``[0, 1]``; a constant range maps to 0."""
    return (value - low) / (high - low + F.lit(EPSILON))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def nan_to_zero(value: Column) -> Column:
    return F.coalesce(nan_to_null(value), F.lit(0.0))


def mean_or_zero(value: Column) -> Column:
    """Mean that is 0 as soon as one input is missing.

    An array mean turns NaN if one entry is NaN and the record's NaN is then
    replaced by 0, whereas ``avg`` would silently skip the entry.
    """
    missing = value.isNull() | F.isnan(value)
    return F.when(F.bool_or(missing), F.lit(0.0)).otherwise(F.avg(value))


def edge_bin(value: Column, low: Column, high: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """0-based equal-width bin, found by comparing with the explicit edges.

    Comparing with ``low + i * width`` rather than dividing keeps values that
    sit on an edge in the upper bin, the maximum in the last bin, and a
    constant column in one bin.
    """
    width = (high - low) / F.lit(float(bins))
    hits = [(value >= low + F.lit(float(i)) * width).cast("int") for i in range(1, bins)]
    return reduce(lambda a, b: a + b, hits)


def direction(metric: Column, difference: Column) -> Column:
    """``green`` where the prediction errs towards the better side, else ``red``."""
    good = F.when(metric.isin(*LOWER_IS_BETTER), difference <= 0).otherwise(difference >= 0)
    return F.when(good, F.lit("green")).otherwise(F.lit("red"))


def equals_trimmed(value: Column, literal: str) -> Column:
    """1 where the trimmed text equals ``literal``, else 0 (also for null)."""
    return F.when(F.trim(value) == F.lit(literal), F.lit(1)).otherwise(F.lit(0))


def flatten_image(rows: Column) -> Column:
    """Array of pixel rows to one pixel array."""
    return F.flatten(rows)


def binary_search(sorted_values: Column, value: Column, steps: int) -> Column:
    """How many of ``2**steps - 1`` ascending values lie strictly below ``value``."""
    jumps = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(
        jumps,
        F.lit(0),
        lambda at, jump: F.when(F.get(sorted_values, at + jump - 1) < value, at + jump).otherwise(at),
    )
