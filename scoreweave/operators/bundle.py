"""The default descriptor bundle: general, statistical and information measures.

Definitions follow the published meta-feature literature (Rivolli et al. 2022;
Alcobaca et al. 2020). Each measure that has one value per feature is given as
its mean and its sample deviation over the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.scalar import HISTOGRAM_BINS, mean_or_zero
from scoreweave.operators.order_stats import Point, exact_counted_points
from scoreweave.operators.profile import KEYS, bounds, cells, class_counts, covariance_matrix
from scoreweave.session import cut_lineage, measured

# Trimmed share on each side, outlier reach in IQRs, normal-consistency factor of
# the median deviation, and threshold of a notable correlation.
TRIM = 0.2
WHISKER = 1.5
MAD_FACTOR = 1.4826
NOTABLE = 0.5
#: Features whose bins are counted against each other in one array.
PAIR_BLOCK = 64
#: Bytes of such arrays that a task keeps before it sends them.
PAIR_BYTES = 64 << 20


def spread(values: Sequence[str]) -> list[Column]:
    """Mean and sample deviation over features; 0 if one feature has no value."""
    out = []
    for v in values:
        out.append(mean_or_zero(F.col(v)).alias(f"{v}_mean"))
        gap = F.bool_or(F.col(v).isNull())
        out.append(F.when(gap, F.lit(0.0)).otherwise(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{v}_sd"))
    return out


def general(matrix: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and ratios. Prepared features are numeric, so there are no categorical ones.

    A feature is binary if every value equals its minimum or its maximum.
    """
    keys = list(keys)
    size = profile.groupBy(*keys).agg(F.max("n").alias("nr_inst"), F.count("*").alias("nr_attr"))
    at_ends = (
        matrix.join(measured(bounds(profile, keys)), keys)
        .select(*keys, F.posexplode(F.arrays_zip("features", "range")).alias("feature", "z"))
        .groupBy(*keys, "feature")
        .agg(
            F.bool_and(
                (F.col("z.features") == F.col("z.range.low")) | (F.col("z.features") == F.col("z.range.high"))
            ).alias("two"),
            F.max(F.col("z.range.low") < F.col("z.range.high")).alias("varies"),
        )
        .groupBy(*keys)
        .agg(F.count_if(F.col("two") & F.col("varies")).alias("nr_bin"))
    )
    counts = class_counts(matrix, keys)
    share = F.col("n") / F.col("total")
    classes = (
        counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("nr_class"), F.avg(share).alias("freq_class_mean"), F.stddev_samp(share).alias("freq_class_sd"))
    )
    out = size.join(at_ends, keys).join(classes, keys, "left")
    return out.select(
        *keys,
        "nr_inst",
        "nr_attr",
        F.col("nr_attr").alias("nr_num"),
        F.lit(0).cast("bigint").alias("nr_cat"),
        "nr_bin",
        "nr_class",
        "freq_class_mean",
        "freq_class_sd",
        (F.col("nr_attr") / F.col("nr_inst")).alias("attr_to_inst"),
        (F.col("nr_inst") / F.col("nr_attr")).alias("inst_to_attr"),
        F.lit(0.0).alias("cat_to_num"),
        F.lit(0.0).alias("num_to_cat"),
    )


COLUMN_MEASURES = (
    "mean", "median", "min", "max", "range", "sd", "var", "skewness", "kurtosis", "iq_range", "mad", "t_mean",
    "g_mean", "h_mean", "sparsity",
)


def column_measures(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per feature with all the per-column measures and an outlier flag.

    Equal values are counted first, in the only pass over the rows; all
    measures come from the counts.
    """
    of = [*keys, "feature"]
    counted = cut_lineage(cells(matrix, keys).groupBy(*of, "value").agg(F.count("*").alias("c")))
    v, c = F.col("value"), F.col("c")
    low, high = F.min("value"), F.max("value")
    n, present = F.sum("c"), F.sum(F.when(v.isNotNull(), c))
    weighted = lambda x: F.sum(c * x)
    location = counted.groupBy(*of).agg(
        n.alias("n"),
        present.alias("present"),
        F.count("*").alias("n_values"),
        # The mean of equal values is that value, so that their deviations are 0.
        F.when(low == high, low).otherwise(weighted(v) / present).alias("mean"),
        low.alias("min"),
        high.alias("max"),
        (high - low).alias("range"),
        F.when(low < 0, None).when(low == 0, 0.0)
        .otherwise(F.exp(weighted(F.when(v > 0, F.ln("value"))) / F.sum(F.when(v > 0, c)))).alias("g_mean"),
        F.when(low < 0, None).when(low == 0, 0.0)
        .otherwise(n / weighted(F.when(v > 0, 1 / v))).alias("h_mean"),
    )
    cut = F.floor(F.lit(TRIM) * F.col("_n"))
    found = exact_counted_points(
        counted,
        of,
        "value",
        "c",
        [
            Point("q1", 0.25, 0.25 * (F.col("_n") - 1)),
            Point("median", 0.5, 0.5 * (F.col("_n") - 1)),
            Point("q3", 0.75, 0.75 * (F.col("_n") - 1)),
            Point("from", TRIM, cut),
            Point("to", 1 - TRIM, F.col("_n") - 1 - cut),
        ],
    )
    pick = lambda name: F.max(F.when(F.col("point") == name, F.col("value"))).alias(name)
    ranks = found.groupBy(*of).agg(*[pick(p) for p in ("q1", "median", "q3", "from", "to")])
    # A row per feature, which stands beside every counted value.
    known = cut_lineage(location.join(ranks, of))
    placed = counted.join(known.select(*of, "mean", "median", "from", "to"), of)
    off = v - F.col("mean")
    sums = placed.groupBy(*of, "from", "to").agg(
        *[weighted(F.pow(off, F.lit(p))).alias(f"_m{p}") for p in (2, 3, 4)],
        F.sum("c").alias("_n"),
        F.sum(F.when((v > F.col("from")) & (v < F.col("to")), c * v).otherwise(0.0)).alias("_inner"),
        F.sum(F.when(v <= F.col("from"), c).otherwise(0)).alias("_below"),
        F.sum(F.when(v >= F.col("to"), c).otherwise(0)).alias("_above"),
    )
    kept = F.floor(F.lit(TRIM) * F.col("_n"))
    summed = sums.select(
        *of,
        "_m2",
        "_m3",
        "_m4",
        F.when(F.col("from") == F.col("to"), F.col("from"))
        .otherwise(
            (F.col("_inner") + F.col("from") * (F.col("_below") - kept) + F.col("to") * (F.col("_above") - kept))
            / (F.col("_n") - 2 * kept)
        )
        .alias("t_mean"),
    )
    deviations = placed.select(*of, F.abs(v - F.col("median")).alias("value"), "c")
    middle = [Point(0.5, 0.5, 0.5 * (F.col("_n") - 1))]
    mad = exact_counted_points(deviations, of, "value", "c", middle).select(*of, (F.col("value") * MAD_FACTOR).alias("mad"))
    rows, seen = F.col("n"), F.col("present")
    shape = F.pow((rows - 1) / rows, 1.5)
    varies = F.col("_m2") != 0
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    outer = (F.col("min") < F.col("q1") - reach) | (F.col("max") > F.col("q3") + reach)
    return (
        known.drop("from", "to")
        .join(summed, of)
        .join(mad, of)
        .withColumn("var", F.when(seen > 1, F.col("_m2") / (seen - 1)))
        .withColumn("sd", F.sqrt("var"))
        .withColumn("skewness", F.when(varies, F.sqrt(seen) * F.col("_m3") / F.sqrt(F.pow("_m2", F.lit(3)))) * shape)
        .withColumn("kurtosis", F.when(varies, seen * F.col("_m4") / (F.col("_m2") * F.col("_m2"))) * F.pow((rows - 1) / rows, 2) - 3)
        .withColumn("iq_range", F.col("q3") - F.col("q1"))
        .withColumn(
            "sparsity", F.coalesce(F.try_divide(rows / F.col("n_values") - 1, rows - 1.0), F.lit(0.0))
        )
        .withColumn("outlier", outer)
        .drop("_m2", "_m3", "_m4", "present")
    )


def column_stats(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return column_measures(matrix, keys).groupBy(*keys).agg(
        *spread(COLUMN_MEASURES), F.count_if("outlier").alias("nr_outliers")
    )


def pairwise(correlation: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """|correlation| and |covariance| over feature pairs, and the share of notable pairs."""
    pairs = correlation.select(
        *keys, F.coalesce(F.abs("r"), F.lit(0.0)).alias("cor"), F.abs(F.col("c") / (F.col("n") - 1)).alias("cov")
    )
    return pairs.groupBy(*keys).agg(
        *spread(["cor", "cov"]), (F.count_if(F.col("cor") >= NOTABLE) / F.count("*")).alias("nr_cor_attr")
    )


def eigenvalues(comoment: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and deviation of the covariance eigenvalues: a dense solve per table in a task."""
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(covariance_matrix(pdf) / max(1, int(pdf["n"].iloc[0]) - 1))
        sd = float(values.std(ddof=1)) if len(values) > 1 else 0.0
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "eigenvalues_mean": [float(values.mean())], "eigenvalues_sd": [sd]})

    return comoment.groupBy(*keys).applyInPandas(
        solve, _typed(comoment, keys) + ", eigenvalues_mean double, eigenvalues_sd double"
    )


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


# -- class-based statistics ------------------------------------------------------

CLASS_MEASURES = ("gravity", "sd_ratio", "can_cor_mean", "can_cor_sd", "w_lambda", "p_trace", "lh_trace", "roy_root")


def class_stats(class_comoments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Separation of the class centres and homogeneity of the class covariances.

    Input: co-moments keyed by table and label. What a task holds is one
    matrix per class, never rows.
    """
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = []
        for _, part in pdf.groupby("label"):
            diagonal = part[part["i"] == part["j"]].sort_values("i")
            groups.append((int(part["n"].iloc[0]), diagonal["mean_i"].to_numpy(), covariance_matrix(part)))
        sizes = np.array([g[0] for g in groups])
        n, k, d = sizes.sum(), len(groups), len(groups[0][1])
        centre = sum(g[0] * g[1] for g in groups) / n
        within = sum(g[2] for g in groups)
        between = sum(g[0] * np.outer(g[1] - centre, g[1] - centre) for g in groups)
        smallest, largest = groups[int(sizes.argmin())], groups[int(sizes.argmax())]
        if smallest is largest and k > 1:
            largest = groups[1]
        roots = np.sort(np.linalg.eigvals(np.linalg.pinv(within) @ between).real)[::-1][: max(1, min(d, k - 1))]
        roots = np.clip(roots, 0.0, None)
        shares = roots / (1 + roots)
        row = {
            "gravity": float(np.linalg.norm(smallest[1] - largest[1])),
            "sd_ratio": _box(groups, within, n, k, d),
            "can_cor_mean": float(np.sqrt(shares).mean()),
            "can_cor_sd": float(np.sqrt(shares).std(ddof=1)) if len(shares) > 1 else 0.0,
            "w_lambda": float(np.prod(1 / (1 + roots))),
            "p_trace": float(shares.sum()),
            "lh_trace": float(roots.sum()),
            "roy_root": float(roots.max()),
            "nr_disc": int((roots > 1e-12).sum()),
        }
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, **{c: [v] for c, v in row.items()}})

    typed = ", ".join(f"{c} double" for c in CLASS_MEASURES)
    return class_comoments.groupBy(*keys).applyInPandas(
        solve, f"{_typed(class_comoments, keys)}, {typed}, nr_disc bigint"
    )


def _box(groups, within, n, k, d) -> float | None:
    """Geometric-mean ratio of pooled and class deviations (Box's M); None where a class is singular."""
    if k < 2 or n <= k or any(g[0] < 2 for g in groups):
        return None
    pooled_sign, pooled = np.linalg.slogdet(within / (n - k))
    m = inverse = 0.0
    for size, _, c in groups:
        sign, log_det = np.linalg.slogdet(c / (size - 1))
        if sign <= 0 or pooled_sign <= 0:
            return None
        m += (size - 1) * (pooled - log_det)
        inverse += 1 / (size - 1)
    gamma = 1 - ((2 * d * d + 3 * d - 1) / (6 * (d + 1) * (k - 1))) * (inverse - 1 / (n - k))
    return float(np.exp(gamma * m / (d * (n - k))))


def normal_features(profile: DataFrame, keys: Sequence[str] = KEYS, level: float = 0.05) -> DataFrame:
    """Features whose skewness and kurtosis pass the D'Agostino-Pearson omnibus test.

    A moment test, because rank tests of normality are defined for samples of
    a few thousand rows only.
    """
    n, b1, b2 = F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis") + 3
    y = b1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.ln(y / alpha + F.sqrt(F.pow(y / alpha, 2) + 1))
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / (F.pow(n + 1, 2) * (n + 3) * (n + 5))
    x = (b2 - expected) / F.sqrt(variance)
    skew_b2 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew_b2 * (2 / skew_b2 + F.sqrt(1 + 4 / F.pow(skew_b2, 2)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    ratio = F.try_divide(1 - 2 / a, F.abs(denominator))
    term = F.signum(denominator) * F.pow(ratio, 1 / 3)
    z2 = (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))
    p_value = F.exp(-(z1 * z1 + z2 * z2) / 2)
    testable = (n >= 20) & b1.isNotNull()
    return profile.groupBy(*keys).agg(F.count_if(testable & (p_value > level)).alias("nr_norm"))


# -- information measures --------------------------------------------------------


def _concentration(counts: DataFrame, of: Sequence[str], given: str, about: str) -> DataFrame:
    """Goodman-Kruskal tau: how much knowing ``given`` helps to guess ``about``."""
    of = list(of)
    total = counts.groupBy(*of).agg(F.sum("n").alias("total"))
    row = counts.groupBy(*of, given).agg(F.sum("n").alias("row"))
    column = counts.groupBy(*of, about).agg(F.sum("n").alias("c")).join(total, of)
    base = column.groupBy(*of).agg(F.sum(F.pow(F.col("c") / F.col("total"), 2)).alias("base"))
    explained = (
        counts.groupBy(*of, given, about).agg(F.sum("n").alias("n"))
        .join(row, [*of, given])
        .join(total, of)
        .groupBy(*of)
        .agg(F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("total"))).alias("explained"))
    )
    return explained.join(base, of).select(
        *of, F.coalesce(F.try_divide(F.col("explained") - F.col("base"), 1 - F.col("base")), F.lit(0.0)).alias("tau")
    )


def info_measures(binned: DataFrame, terms: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entropies and mutual information in bits, with the ratios built from their means."""
    keys = list(keys)
    bits = terms.select(
        *keys, "feature", *[(F.col(c) / F.ln(F.lit(2.0))).alias(c) for c in ("attr_ent", "class_ent", "joint_ent", "mut_inf")]
    )
    means = bits.groupBy(*keys).agg(
        F.avg("class_ent").alias("class_ent"), *spread(["attr_ent", "joint_ent", "mut_inf"])
    )
    tau = _concentration(binned, [*keys, "feature"], "bin", "klass").withColumnRenamed("tau", "class_conc")
    return (
        means.join(tau.groupBy(*keys).agg(*spread(["class_conc"])), keys)
        .withColumn("eq_num_attr", F.try_divide(F.col("class_ent"), F.col("mut_inf_mean")))
        .withColumn("ns_ratio", F.try_divide(F.col("attr_ent_mean") - F.col("mut_inf_mean"), F.col("mut_inf_mean")))
    )


def feature_concentration(matrix: DataFrame, profile: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Concentration between all ordered pairs of features, binned.

    Rows are counted where they lie: the ranges go to them. A task counts bins
    of PAIR_BLOCK features against PAIR_BLOCK others in one array per key and
    sends the counts that are not zero; those of all tasks are added up by pair.
    """
    keys = list(keys)
    ends = bounds(profile, keys).select(*keys, F.col("range.low").alias("low"), F.col("range.high").alias("high"))
    ranged = matrix.join(measured(ends), keys).select(*keys, "features", "low", "high")
    types = {k: matrix.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join(f"{k} {t}" for k, t in types.items()) + ", i int, j int, bin_i int, bin_j int, n long"
    partial = ranged.mapInArrow(_pair_counts(keys), schema)
    counts = cut_lineage(partial.groupBy(*keys, "i", "j", "bin_i", "bin_j").agg(F.sum("n").alias("n")))
    tau = _concentration(counts, [*keys, "i", "j"], "bin_i", "bin_j").withColumnRenamed("tau", "attr_conc")
    return tau.groupBy(*keys).agg(*spread(["attr_conc"]))


def _pair_counts(keys: list[str]):
    """Counts per key and pair of bins. Those of a task are kept until they take PAIR_BYTES, then sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            for key, bins in _by_key(batch, keys):
                starts = range(0, bins.shape[1], PAIR_BLOCK)
                for left, right in ((x, y) for x in starts for y in starts if x <= y):
                    table = _pair_table(bins[:, left : left + PAIR_BLOCK], bins[:, right : right + PAIR_BLOCK])
                    at = (key, left, right)
                    if at in state:
                        state[at] += table
                    else:
                        state[at] = table
                        held += table.nbytes
                    if held > PAIR_BYTES:
                        yield from _sent(state, keys, batch.schema)
                        state, held = {}, 0
        if state:
            yield from _sent(state, keys, batch.schema)

    return count


def _by_key(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The bins of each key's rows, a column per feature."""
    place = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch[k].dictionary_encode()
        place = place * len(coded.dictionary) + coded.indices.to_numpy()
    _, first, of = np.unique(place, return_index=True, return_inverse=True)
    for g, row in enumerate(first):
        own = batch["features"].filter(pa.array(of == g))
        flat = own.flatten()
        if own.null_count or flat.null_count:
            raise ValueError("a feature without a value has no bin")
        low, high = (np.array(batch[c][int(row)].as_py(), float) for c in ("low", "high"))
        yield tuple(batch[k][int(row)].as_py() for k in keys), _edge_bins(flat.to_numpy().reshape(len(own), len(low)), low, high)


def _edge_bins(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """:func:`edge_bin` over columns, by the same comparisons; NaN is above all other values."""
    width = (high - low) / float(HISTOGRAM_BINS)
    bins = np.zeros(values.shape, np.int64)
    with np.errstate(invalid="ignore"):
        for i in range(1, HISTOGRAM_BINS):
            bins += values >= low + i * width
    bins[np.isnan(values)] = HISTOGRAM_BINS - 1
    return bins


def _pair_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows by feature and bin of ``a`` and feature and bin of ``b``."""
    width = b.shape[1] * HISTOGRAM_BINS
    at = b + np.arange(b.shape[1]) * HISTOGRAM_BINS
    out = np.empty((a.shape[1], HISTOGRAM_BINS, b.shape[1], HISTOGRAM_BINS), np.int64)
    for i in range(a.shape[1]):
        codes = at + (a[:, i] * width)[:, None]
        out[i] = np.bincount(codes.ravel(), minlength=HISTOGRAM_BINS * width).reshape(out.shape[1:])
    return out


def _sent(state: dict[tuple, np.ndarray], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (key, left, right), table in state.items():
        i, x, j, y = np.nonzero(table)
        n = table[i, x, j, y]
        i, j = i + left, j + right
        keep = i != j
        one = [v[keep] for v in (i, j, x, y)]
        # A block beside another one is counted once, for both orders.
        both = [one] if left == right else [one, [one[c] for c in (1, 0, 3, 2)]]
        for columns in both:
            named = [pa.array([v] * len(columns[0]), schema.field(k).type) for k, v in zip(keys, key, strict=True)]
            numbers = [pa.array(v.astype(np.int32)) for v in columns]
            yield pa.RecordBatch.from_arrays([*named, *numbers, pa.array(n[keep])], [*keys, "i", "j", "bin_i", "bin_j", "n"])
