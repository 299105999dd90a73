"""Descriptors of many tables at once.

Input is the prepared table: one row per observation with ``features`` as an
array. Feature cells are exploded inside the scan stage and aggregated by
(table, split, feature) with map-side combine, so what is shuffled is one
partial row per feature and task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.scalar import (
    EPSILON,
    HISTOGRAM_BINS,
    edge_bin,
    guarded_ratio,
    mean_or_zero,
)
from scoreweave.operators.order_stats import exact_quantiles
from scoreweave.session import cut_lineage, measured
from scoreweave.sources.registry import BINARY, MULTICLASS, REGRESSION

KEYS = ("dataset_name", "split")
MAX_WIDTH = 2_000


class TooWide(ValueError):
    pass


def cells(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return matrix.select(*keys, F.posexplode("features").alias("feature", "value"))


def column_profile(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per feature: count, mean, variance, shape and range."""
    flat = F.col("low") == F.col("high")
    return (
        cells(matrix, keys)
        .groupBy(*keys, "feature")
        .agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("variance"),
            F.skewness("value").alias("skewness"),
            F.kurtosis("value").alias("kurtosis"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .withColumn("variance", F.when(flat, F.lit(0.0)).otherwise(F.col("variance")))
        .withColumn("skewness", F.when(~flat, F.col("skewness")))
        .withColumn("kurtosis", F.when(~flat, F.col("kurtosis")))
    )


def summarise(profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Roll feature rows up to one row per table: size, location, spread and shape."""
    std = F.sqrt("variance")
    return profile.groupBy(*keys).agg(
        F.max("n").alias("n_samples"),
        F.count("*").alias("n_features"),
        F.avg("mean").alias("feature_mean"),
        F.avg(std).alias("feature_std"),
        F.avg(guarded_ratio(std, F.col("mean"))).alias("coeff_variation"),
        mean_or_zero(F.col("skewness")).alias("avg_skewness"),
        mean_or_zero(F.col("kurtosis")).alias("avg_kurtosis"),
        F.count_if(F.col("low") == F.col("high")).alias("n_zero_variance_features"),
        F.avg("variance").alias("mean_variance"),
        # One value per feature goes in: at most MAX_WIDTH.
        F.median("variance").alias("median_variance"),
    )


def class_counts(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per class of the classification tables."""
    return (
        matrix.filter(F.col("task") != REGRESSION)
        .groupBy(*keys, "task", "label")
        .agg(F.count("*").alias("n"))
    )


def class_balance(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean label of a binary table; classes per row of a multiclass one."""
    counts = class_counts(matrix, keys)
    positives = F.sum(F.col("label") * F.col("n")) / F.sum("n")
    return counts.groupBy(*keys, "task").agg(
        F.when(F.col("task") == BINARY, positives)
        .when(F.col("task") == MULTICLASS, F.count("label") / F.sum("n"))
        .alias("class_balance")
    ).drop("task")


def class_moments(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per class and feature: rows, mean and variance (all a Gaussian naive Bayes model holds)."""
    return (
        matrix.filter(F.col("task") != REGRESSION)
        .select(*keys, "label", F.posexplode("features").alias("feature", "value"))
        .groupBy(*keys, "label", "feature")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    )


# -- histograms ----------------------------------------------------------------


def bounds(profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per table, the array of (low, high) over its features."""
    return (
        profile.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("feature", "low", "high"))).alias("range"))
    )


def label_bounds(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return matrix.groupBy(*keys).agg(F.min("label").alias("label_low"), F.max("label").alias("label_high"))


def binned_counts(matrix: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contingency counts (table, feature, bin, class) over 10 equal-width bins.

    A class is the label itself, or for a continuous target its own bin. The
    counts are written out: every measure below reads them several times.
    """
    keys = list(keys)
    ranged = matrix.join(measured(bounds(profile, keys)), keys).join(
        measured(label_bounds(matrix, keys)), keys
    )
    klass = F.when(
        F.col("task") == REGRESSION, edge_bin(F.col("label"), F.col("label_low"), F.col("label_high"))
    ).otherwise(F.col("label").cast("int"))
    exploded = ranged.select(
        *keys, klass.alias("klass"), F.posexplode(F.arrays_zip("features", "range")).alias("feature", "z")
    )
    binned = exploded.select(
        *keys,
        "feature",
        "klass",
        edge_bin(F.col("z.features"), F.col("z.range.low"), F.col("z.range.high")).alias("bin"),
    )
    return cut_lineage(binned.groupBy(*keys, "feature", "bin", "klass").agg(F.count("*").alias("n")))


def feature_entropy(binned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean entropy of the 10-bin histograms, each count raised by 1e-10."""
    per_bin = binned.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    total = F.sum("n") + F.lit(HISTOGRAM_BINS * EPSILON)
    # sum over bins of -(p ln p) with p = (n + eps) / total, expanded so that one pass suffices
    raised = F.col("n") + F.lit(EPSILON)
    filled = F.sum(raised * F.ln(raised)) + (F.lit(HISTOGRAM_BINS) - F.count("*")) * F.lit(
        float(EPSILON * np.log(EPSILON))
    )
    per_feature = per_bin.groupBy(*keys, "feature").agg((F.ln(total) - filled / total).alias("entropy"))
    return per_feature.groupBy(*keys).agg(F.avg("entropy").alias("mean_feature_entropy"))


def binned_mutual_info(binned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean plug-in mutual information of binned features with the label, in nats."""
    terms = info_terms(binned, keys)
    return terms.groupBy(*keys).agg(F.avg("mut_inf").alias("avg_mutual_info_binned"))


def info_terms(binned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per feature: attribute, class and joint entropy and mutual information."""
    of = [*keys, "feature"]
    n_log_n = F.sum(F.col("n") * F.ln(F.col("n")))
    joint = binned.groupBy(*of).agg(F.sum("n").alias("total"), n_log_n.alias("sj"))
    attr = (
        binned.groupBy(*of, "bin").agg(F.sum("n").alias("n")).groupBy(*of).agg(n_log_n.alias("sa"))
    )
    klass = (
        binned.groupBy(*of, "klass").agg(F.sum("n").alias("n")).groupBy(*of).agg(n_log_n.alias("sc"))
    )
    entropy = lambda s: F.ln("total") - F.col(s) / F.col("total")
    return (
        joint.join(attr, of)
        .join(klass, of)
        .select(*of, "total", entropy("sa").alias("attr_ent"), entropy("sc").alias("class_ent"), entropy("sj").alias("joint_ent"))
        .withColumn("mut_inf", F.col("attr_ent") + F.col("class_ent") - F.col("joint_ent"))
    )


# -- co-moments ----------------------------------------------------------------


def comoments(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairwise co-moments: (keys, i, j, n, mean_i, mean_j, c) for i <= j.

    Each task folds its rows into one centred cross-product per table and
    ships ``d * (d + 1) / 2`` numbers; the fold of two parts corrects for their
    different means, so nothing cancels on columns far from zero.
    """
    keys = list(keys)

    def fold(batches):
        state: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                x = np.vstack(part["features"].to_numpy())
                n, mean = len(x), x.mean(axis=0)
                c = (x - mean).T @ (x - mean)
                if key in state:
                    n0, m0, c0 = state[key]
                    delta = mean - m0
                    c = c0 + c + np.outer(delta, delta) * (n0 * n / (n0 + n))
                    mean = m0 + delta * (n / (n0 + n))
                    n = n0 + n
                state[key] = (n, mean, c)
        for key, (n, mean, c) in state.items():
            i, j = np.triu_indices(len(mean))
            out = {k: v for k, v in zip(keys, key, strict=True)}
            yield pd.DataFrame({**out, "i": i, "j": j, "n": n, "mi": mean[i], "mj": mean[j], "c": c[i, j]})

    typed = ", ".join(f"{k} {matrix.schema[k].dataType.simpleString()}" for k in keys)
    parts = matrix.select(*keys, "features").mapInPandas(
        fold, f"{typed}, i int, j int, n bigint, mi double, mj double, c double"
    )
    total = F.sum("n")
    mean_i, mean_j = F.sum(F.col("n") * F.col("mi")) / total, F.sum(F.col("n") * F.col("mj")) / total
    between = F.sum(F.col("n") * F.col("mi") * F.col("mj")) - total * mean_i * mean_j
    return parts.groupBy(*keys, "i", "j").agg(
        total.alias("n"), mean_i.alias("mean_i"), mean_j.alias("mean_j"), (F.sum("c") + between).alias("c")
    )


def correlations(comoment: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pearson correlation of every feature pair i < j; null beside a constant feature."""
    keys = list(keys)
    # A diagonal entry per feature: at most MAX_WIDTH rows per table.
    spread = profile.select(
        *keys, "feature", F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(F.col("variance") * F.col("n")).alias("ss")
    )
    left = spread.select(*keys, F.col("feature").alias("i"), F.col("ss").alias("ss_i"))
    right = spread.select(*keys, F.col("feature").alias("j"), F.col("ss").alias("ss_j"))
    return (
        comoment.filter("i < j")
        .join(left, [*keys, "i"])
        .join(right, [*keys, "j"])
        .withColumn("r", F.try_divide(F.col("c"), F.sqrt(F.col("ss_i") * F.col("ss_j"))))
        .select(*keys, "i", "j", "n", "c", "r")
    )


def mean_abs_correlation(correlation: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean |r| over feature pairs: 0 for a single feature or next to a constant one."""
    keys = list(keys)
    found = correlation.groupBy(*keys).agg(mean_or_zero(F.abs("r")).alias("r"))
    return (
        profile.select(*keys)
        .distinct()
        .join(found, keys, "left")
        .select(*keys, F.coalesce("r", F.lit(0.0)).alias("mean_abs_correlation"))
    )


def covariance_matrix(pdf: pd.DataFrame, value: str = "c") -> np.ndarray:
    """Dense symmetric matrix from (i, j, value) rows of one table."""
    d = int(pdf["j"].max()) + 1
    if d > MAX_WIDTH:
        raise TooWide(f"{d} features; a dense solve is limited to {MAX_WIDTH}")
    out = np.zeros((d, d))
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    out[i, j] = pdf[value].to_numpy()
    out[j, i] = pdf[value].to_numpy()
    return out


def pca_explained(comoment: DataFrame, components: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of variance in the leading ``min(5, d)`` principal components."""
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.clip(np.linalg.eigvalsh(covariance_matrix(pdf)), 0.0, None)
        total = values.sum()
        share = float(values[::-1][:components].sum() / total) if total > 0 else None
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "pca_explained_variance": [share]})

    typed = ", ".join(f"{k} {comoment.schema[k].dataType.simpleString()}" for k in keys)
    return comoment.groupBy(*keys).applyInPandas(solve, f"{typed}, pca_explained_variance double")


# -- target --------------------------------------------------------------------


def target_stats(matrix: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """Moments and 1.5-IQR outlier count of a continuous target."""
    keys = list(keys)
    rows = matrix.filter(F.col("task") == REGRESSION)
    moments = rows.groupBy(*keys).agg(
        F.avg("label").alias("target_mean"),
        F.stddev_pop("label").alias("target_std"),
        F.skewness("label").alias("target_skewness"),
        F.kurtosis("label").alias("target_kurtosis"),
    )
    quartiles = exact_quantiles(rows, keys, "label", [0.25, 0.75])
    fences = quartiles.groupBy(*keys).agg(
        F.max(F.when(F.col("probability") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("probability") == 0.75, F.col("value"))).alias("q3"),
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    outliers = (
        rows.join(measured(fences), keys)
        .groupBy(*keys)
        .agg(
            F.count_if((F.col("label") < F.col("q1") - reach) | (F.col("label") > F.col("q3") + reach)).alias(
                "n_target_outliers"
            )
        )
    )
    return moments.join(outliers, keys)


def target_correlation(matrix: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    """Mean |corr(feature, target)| with constant features left out."""
    per_feature = (
        matrix.filter(F.col("task") == REGRESSION)
        .select(*keys, "label", F.posexplode("features").alias("feature", "value"))
        .groupBy(*keys, "feature")
        .agg(
            F.try_divide(
                F.covar_pop("value", "label"), F.stddev_pop("value") * F.stddev_pop("label")
            ).alias("r")
        )
    )
    return per_feature.groupBy(*keys).agg(F.avg(F.abs("r")).alias("avg_feature_target_correlation"))


# -- the full record -----------------------------------------------------------


def meta_features(
    matrix: DataFrame, keys: Sequence[str] = KEYS, mutual_info: DataFrame | None = None, found: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The meta-feature record of every (table, split), missing values set to 0.

    ``matrix`` is read several times: pass a written table. ``mutual_info``
    (keys, avg_mutual_info) adds the neighbour-based estimate; ``found`` holds
    its column profile, co-moments and binned counts where they are there already.
    """
    keys = list(keys)
    if found is None:
        # Feature-sized tables that several parts below read; the rows behind them are read once each.
        profile = cut_lineage(column_profile(matrix, keys))
        found = profile, cut_lineage(comoments(matrix, keys)), binned_counts(matrix, profile, keys)
    profile, co, binned = found
    parts = [
        class_balance(matrix, keys),
        pca_explained(co, keys=keys),
        mean_abs_correlation(correlations(co, profile, keys), profile, keys),
        feature_entropy(binned, keys),
        binned_mutual_info(binned, keys),
    ]
    if mutual_info is not None:
        parts.append(mutual_info)
    out = summarise(profile, keys)
    for part in parts:
        out = out.join(part, keys, "left")
    return out.select(
        *keys,
        *[
            (F.coalesce(F.col(c), F.lit(0)) if c.startswith("n_") else F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))).alias(c)
            for c in out.columns
            if c not in keys
        ],
    )
