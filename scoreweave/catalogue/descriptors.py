"""Meta-features of all registered datasets and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import (
    cells_sql,
    r,
    raw_cells_sql,
    raw_sql,
    rounded,
    shared_prepared,
    shared_split,
)
from scoreweave.learners.landmarks import landmark_summary, landmarks, tree_shape
from scoreweave.operators import bundle as b
from scoreweave.operators import mutual_info as mi
from scoreweave.operators import profile as p
from scoreweave.plans.prepare import load_matrices
from scoreweave.plans.record import full_record
from scoreweave.sources.registry import ALL, REGRESSION

CLASSIFIED = tuple(s.name for s in ALL if s.task != REGRESSION)
MEASURED = tuple(s.name for s in ALL if s.task == REGRESSION)

_PER_FEATURE = """per_feature AS (SELECT dataset_name, split, feature, count(*) AS n, avg(value) AS mean,
    var_pop(value) AS variance, min(value) AS low, max(value) AS high FROM cells GROUP BY ALL)"""


@register(f"""
    WITH {cells_sql()}, {_PER_FEATURE}
    SELECT dataset_name, split, max(n) AS n_samples, count(*) AS n_features, {r('avg(mean)', 6)} AS feature_mean,
      {r('avg(sqrt(variance))', 6)} AS feature_std FROM per_feature GROUP BY dataset_name, split""")
def mf_basic(spark, folder):
    profile = p.column_profile(shared_prepared(spark, folder, ids=False))
    out = p.summarise(profile).select("dataset_name", "split", "n_samples", "n_features", "feature_mean", "feature_std")
    return rounded(out, 6)


@register(f"""
    WITH {raw_sql()}, flat AS (SELECT dataset_name, unnest(range(len(features))) AS feature, unnest(features) AS v FROM raw),
    per AS (SELECT dataset_name, feature, stddev_pop(v) / (avg(v) + 1e-10::DOUBLE) AS cv FROM flat GROUP BY ALL)
    SELECT dataset_name, {r('avg(cv)', 3)} AS coeff_variation FROM per GROUP BY dataset_name""")
def mf_coeff_variation(spark, folder):
    """On unscaled columns: the ratio is ill-conditioned where means are near zero."""
    matrix = load_matrices(spark, folder, ALL).union()
    out = p.summarise(p.column_profile(matrix, ["dataset_name"]), ["dataset_name"])
    return rounded(out.select("dataset_name", "coeff_variation"), 3)


@register(f"""
    WITH {cells_sql()}, {_PER_FEATURE},
    shape AS (SELECT dataset_name, split, feature,
        avg(pow(value - mean, 3)) / pow(avg(pow(value - mean, 2)), 1.5) AS sk,
        avg(pow(value - mean, 4)) / pow(avg(pow(value - mean, 2)), 2) - 3 AS ku
      FROM cells JOIN per_feature USING (dataset_name, split, feature) WHERE low < high GROUP BY dataset_name, split, feature),
    all_features AS (SELECT * FROM per_feature LEFT JOIN shape USING (dataset_name, split, feature))
    SELECT dataset_name, split, CASE WHEN bool_or(sk IS NULL) THEN 0.0::DOUBLE ELSE {r('avg(sk)', 6)} END AS avg_skewness,
      CASE WHEN bool_or(ku IS NULL) THEN 0.0::DOUBLE ELSE {r('avg(ku)', 6)} END AS avg_kurtosis
    FROM all_features GROUP BY dataset_name, split""")
def mf_moments(spark, folder):
    out = p.summarise(p.column_profile(shared_prepared(spark, folder, ids=False)))
    return rounded(out.select("dataset_name", "split", "avg_skewness", "avg_kurtosis"), 6)


@register(f"""
    WITH {cells_sql()}, {_PER_FEATURE}
    SELECT dataset_name, split, count(*) FILTER (WHERE low = high) AS n_zero_variance_features,
      {r('avg(variance)', 6)} AS mean_variance, {r('median(variance)', 6)} AS median_variance
    FROM per_feature GROUP BY dataset_name, split""")
def mf_variance(spark, folder):
    out = p.summarise(p.column_profile(shared_prepared(spark, folder, ids=False)))
    return rounded(
        out.select("dataset_name", "split", "n_zero_variance_features", "mean_variance", "median_variance"), 6
    )


@register(f"""
    WITH {cells_sql()}, labels_only AS (SELECT DISTINCT dataset_name, task, split, row_id, label FROM cells)
    SELECT dataset_name, split, {r("CASE WHEN task = 'binary' THEN avg(label) ELSE count(DISTINCT label) / count(*)::DOUBLE END", 6)} AS class_balance
    FROM labels_only WHERE task <> 'regression' GROUP BY dataset_name, split, task""")
def mf_class_balance(spark, folder):
    return rounded(p.class_balance(shared_prepared(spark, folder, *CLASSIFIED, ids=False)), 6)


_PAIRS = """pairs AS (SELECT a.dataset_name, a.split, a.feature AS i, b.feature AS j,
      covar_pop(a.value, b.value) AS c, var_pop(a.value) AS va, var_pop(b.value) AS vb,
      min(a.value) < max(a.value) AND min(b.value) < max(b.value) AS varies
    FROM cells a JOIN cells b ON a.dataset_name = b.dataset_name AND a.row_id = b.row_id AND a.feature < b.feature
    GROUP BY a.dataset_name, a.split, a.feature, b.feature)"""


@register(f"""
    WITH {cells_sql()}, {_PAIRS}
    SELECT dataset_name, split, CASE WHEN bool_or(NOT varies) THEN 0.0::DOUBLE
      ELSE {r('avg(CASE WHEN varies THEN abs(c / sqrt(va * vb)) END)', 6)} END AS mean_abs_correlation
    FROM pairs GROUP BY dataset_name, split""")
def mf_correlation(spark, folder):
    matrix = shared_prepared(spark, folder, ids=False)
    profile = p.column_profile(matrix)
    found = p.correlations(p.comoments(matrix), profile)
    return rounded(p.mean_abs_correlation(found, profile), 6)


_BINNED = """edges AS (SELECT dataset_name, split, feature, min(value) AS lo, max(value) AS hi FROM cells GROUP BY ALL),
  target AS (SELECT dataset_name, split, min(label) AS llo, max(label) AS lhi FROM cells GROUP BY ALL),
  binned AS (SELECT dataset_name, split, feature,
      len(list_filter(range(1, 10), lambda i: value >= lo + i * ((hi - lo) / 10))) AS bin,
      CASE WHEN task = 'regression' THEN len(list_filter(range(1, 10), lambda i: label >= llo + i * ((lhi - llo) / 10)))
           ELSE CAST(label AS BIGINT) END AS klass
    FROM cells JOIN edges USING (dataset_name, split, feature) JOIN target USING (dataset_name, split))"""


@register(f"""
    WITH {raw_cells_sql()}, {_BINNED},
    counts AS (SELECT dataset_name, split, feature, bin, count(*) AS c FROM binned GROUP BY ALL),
    bins AS (SELECT dataset_name, split, feature, unnest(range(0, 10)) AS bin FROM edges),
    filled AS (SELECT dataset_name, split, feature, coalesce(c, 0) + 1e-10::DOUBLE AS c
      FROM bins LEFT JOIN counts USING (dataset_name, split, feature, bin)),
    shares AS (SELECT dataset_name, split, feature, c / sum(c) OVER (PARTITION BY dataset_name, split, feature) AS q FROM filled),
    per AS (SELECT dataset_name, split, feature, -sum(q * ln(q)) AS h FROM shares GROUP BY ALL)
    SELECT dataset_name, split, {r('avg(h)', 6)} AS mean_feature_entropy FROM per GROUP BY dataset_name, split""")
def mf_entropy(spark, folder):
    """On unscaled columns: values on a bin edge would move with the last digit of a scaled one."""
    matrix = shared_split(spark, folder, ids=False)
    return rounded(p.feature_entropy(p.binned_counts(matrix, p.column_profile(matrix))), 6)


_INFO = """joint AS (SELECT dataset_name, split, feature, bin, klass, count(*)::DOUBLE AS c FROM binned GROUP BY ALL),
  total AS (SELECT dataset_name, split, feature, sum(c) AS n FROM joint GROUP BY ALL),
  hj AS (SELECT dataset_name, split, feature, -sum(c / n * ln(c / n)) AS hj FROM joint JOIN total USING (dataset_name, split, feature) GROUP BY ALL),
  ha AS (SELECT dataset_name, split, feature, -sum(c / n * ln(c / n)) AS ha FROM (SELECT dataset_name, split, feature, bin, sum(c) AS c
         FROM joint GROUP BY ALL) JOIN total USING (dataset_name, split, feature) GROUP BY ALL),
  hc AS (SELECT dataset_name, split, feature, -sum(c / n * ln(c / n)) AS hc FROM (SELECT dataset_name, split, feature, klass, sum(c) AS c
         FROM joint GROUP BY ALL) JOIN total USING (dataset_name, split, feature) GROUP BY ALL),
  info AS (SELECT * FROM hj JOIN ha USING (dataset_name, split, feature) JOIN hc USING (dataset_name, split, feature)
           JOIN total USING (dataset_name, split, feature))"""


@register(f"""
    WITH {raw_cells_sql()}, {_BINNED}, {_INFO}
    SELECT dataset_name, split, {r('avg(ha + hc - hj)', 6)} AS avg_mutual_info_binned FROM info GROUP BY dataset_name, split""")
def mf_mi_binned(spark, folder):
    matrix = shared_split(spark, folder, ids=False)
    return rounded(p.binned_mutual_info(p.binned_counts(matrix, p.column_profile(matrix))), 6)


@register(f"""
    WITH {cells_sql('line_price', 'order_total', 'event_value')},
    y AS (SELECT DISTINCT dataset_name, split, row_id, label FROM cells),
    m AS (SELECT dataset_name, split, avg(label) AS mean, stddev_pop(label) AS std,
      quantile_cont(label, 0.25) AS q1, quantile_cont(label, 0.75) AS q3 FROM y GROUP BY ALL)
    SELECT dataset_name, split, {r('any_value(mean)', 3)} AS target_mean, {r('any_value(std)', 3)} AS target_std,
      {r('avg(pow((label - mean) / std, 3))', 6)} AS target_skewness, {r('avg(pow((label - mean) / std, 4)) - 3', 6)} AS target_kurtosis,
      count(*) FILTER (WHERE label < q1 - 1.5::DOUBLE * (q3 - q1) OR label > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_target_outliers
    FROM y JOIN m USING (dataset_name, split) GROUP BY dataset_name, split""")
def mf_target_stats(spark, folder):
    out = p.target_stats(shared_prepared(spark, folder, *MEASURED, ids=False), p.KEYS)
    return rounded(out, 6, target_mean=3, target_std=3)


@register(f"""
    WITH {cells_sql('line_price', 'order_total', 'event_value')},
    per AS (SELECT dataset_name, split, feature, covar_pop(value, label) / (stddev_pop(value) * stddev_pop(label)) AS r FROM cells GROUP BY ALL)
    SELECT dataset_name, split, {r('avg(abs(r))', 6)} AS avg_feature_target_correlation FROM per GROUP BY dataset_name, split""")
def mf_target_correlation(spark, folder):
    return rounded(p.target_correlation(shared_prepared(spark, folder, *MEASURED, ids=False), p.KEYS), 6)


@register(f"""
    WITH {cells_sql()}, fixed AS (SELECT dataset_name, split, row_id, feature, value FROM cells
      UNION ALL SELECT DISTINCT dataset_name, split, row_id, -1, 1.0::DOUBLE FROM cells),
    per AS (SELECT dataset_name, split, feature, min(value) = max(value) AS constant FROM fixed GROUP BY ALL)
    SELECT dataset_name, split, 0.0::DOUBLE AS avg_skewness, 0.0::DOUBLE AS avg_kurtosis,
      count(*) FILTER (WHERE constant) AS n_zero_variance_features FROM per GROUP BY dataset_name, split""")
def mf_nan_rule(spark, folder):
    """A constant column beside the others turns the shape averages into 0."""
    matrix = shared_prepared(spark, folder, ids=False)
    fixed = matrix.withColumn("features", F.concat(F.array(F.lit(1.0)), F.col("features")))
    out = p.summarise(p.column_profile(fixed))
    return out.select("dataset_name", "split", "avg_skewness", "avg_kurtosis", "n_zero_variance_features")


@register()
def mf_pca(spark, folder):
    return rounded(p.pca_explained(p.comoments(shared_prepared(spark, folder, ids=False))), 6)


@register()
def mf_all(spark, folder):
    """The whole record: meta-features, mutual information, target statistics and the bundle."""
    return rounded(full_record(shared_prepared(spark, folder, ids=False)), 6)


# -- the bundle --------------------------------------------------------------------


@register(f"""
    WITH {cells_sql()},
    per AS (SELECT dataset_name, split, feature, count(*) AS n, count(DISTINCT value) AS k FROM cells GROUP BY ALL),
    size AS (SELECT dataset_name, split, max(n) AS nr_inst, count(*) AS nr_attr, count(*) FILTER (WHERE k = 2) AS nr_bin FROM per GROUP BY ALL),
    freq AS (SELECT dataset_name, split, label, count(*) AS c FROM (SELECT DISTINCT dataset_name, task, split, row_id, label FROM cells)
      WHERE task <> 'regression' GROUP BY ALL),
    classes AS (SELECT dataset_name, split, count(*) AS nr_class, avg(c / t) AS m, stddev_samp(c / t) AS s FROM (
      SELECT *, sum(c) OVER (PARTITION BY dataset_name, split)::DOUBLE AS t FROM freq) GROUP BY ALL)
    SELECT dataset_name, split, nr_inst, nr_attr, nr_attr AS nr_num, 0::BIGINT AS nr_cat, nr_bin, nr_class,
      {r('m', 6)} AS freq_class_mean, {r('s', 6)} AS freq_class_sd, {r('nr_attr / nr_inst::DOUBLE', 6)} AS attr_to_inst,
      {r('nr_inst / nr_attr::DOUBLE', 6)} AS inst_to_attr, 0.0::DOUBLE AS cat_to_num, 0.0::DOUBLE AS num_to_cat
    FROM size LEFT JOIN classes USING (dataset_name, split)""")
def px_general(spark, folder):
    matrix = shared_prepared(spark, folder, ids=False)
    return rounded(b.general(matrix, p.column_profile(matrix)), 6)


def _spread_sql(names, digits=6):
    return ", ".join(
        f"""CASE WHEN bool_or("{c}" IS NULL) THEN 0.0::DOUBLE ELSE {r(f'avg("{c}")', digits)} END AS {c}_mean,
        CASE WHEN bool_or("{c}" IS NULL) THEN 0.0::DOUBLE ELSE {r(f'coalesce(stddev_samp("{c}"), 0.0)', digits)} END AS {c}_sd"""
        for c in names
    )


@register(f"""
    WITH {raw_cells_sql()},
    base AS (SELECT dataset_name, split, feature, count(*)::DOUBLE AS n, avg(value) AS mean, median(value) AS median, min(value) AS min,
      max(value) AS max, max(value) - min(value) AS range, stddev_samp(value) AS sd, var_samp(value) AS var,
      avg(value) AS mu, var_pop(value) AS v2, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iq_range,
      CASE WHEN min(value) < 0 THEN NULL WHEN min(value) = 0 THEN 0.0::DOUBLE ELSE exp(avg(ln(CASE WHEN value > 0 THEN value END))) END AS g_mean,
      CASE WHEN min(value) < 0 THEN NULL WHEN min(value) = 0 THEN 0.0::DOUBLE ELSE count(*) / sum(1 / CASE WHEN value > 0 THEN value END) END AS h_mean,
      coalesce((count(*)::DOUBLE / count(DISTINCT value) - 1) / nullif(count(*) - 1, 0), 0) AS sparsity FROM cells GROUP BY ALL),
    shape AS (SELECT dataset_name, split, feature, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4,
      median(abs(value - median)) * 1.4826::DOUBLE AS mad FROM cells JOIN base USING (dataset_name, split, feature) GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, split, feature ORDER BY value) - 1 AS rk,
      count(*) OVER (PARTITION BY dataset_name, split, feature) AS total FROM cells),
    trimmed AS (SELECT dataset_name, split, feature, avg(value) AS t_mean FROM ordered
      WHERE rk >= floor(0.2::DOUBLE * total) AND rk < total - floor(0.2::DOUBLE * total) GROUP BY ALL),
    per AS (SELECT *, CASE WHEN v2 > 0 THEN m3 / pow(v2, 1.5) * pow((n - 1) / n, 1.5) END AS skewness,
      CASE WHEN v2 > 0 THEN m4 / (v2 * v2) * pow((n - 1) / n, 2) - 3 END AS kurtosis
      FROM base JOIN shape USING (dataset_name, split, feature) JOIN trimmed USING (dataset_name, split, feature))
    SELECT dataset_name, split, {_spread_sql([c for c in b.COLUMN_MEASURES if c != 'var'], 5)}, {_spread_sql(['var'], 1)},
      count(*) FILTER (WHERE min < q1 - 1.5::DOUBLE * (q3 - q1) OR max > q3 + 1.5::DOUBLE * (q3 - q1)) AS nr_outliers
    FROM per GROUP BY dataset_name, split""")
def px_column_stats(spark, folder):
    """On unscaled columns, where geometric and harmonic means exist."""
    return rounded(b.column_stats(shared_split(spark, folder, ids=False)), 5, var_mean=1, var_sd=1)


@register(f"""
    WITH {cells_sql()}, {_PAIRS.replace('var_pop(b.value) AS vb', 'var_pop(b.value) AS vb, covar_samp(a.value, b.value) AS cs')},
    per AS (SELECT dataset_name, split, CASE WHEN varies THEN abs(c / sqrt(va * vb)) ELSE 0 END AS cor, abs(cs) AS cov FROM pairs)
    SELECT dataset_name, split, {_spread_sql(('cor', 'cov'))}, {r('count(*) FILTER (WHERE cor >= 0.5) / count(*)::DOUBLE', 6)} AS nr_cor_attr
    FROM per GROUP BY dataset_name, split""")
def px_pairwise(spark, folder):
    matrix = shared_prepared(spark, folder, ids=False)
    return rounded(b.pairwise(p.correlations(p.comoments(matrix), p.column_profile(matrix))), 6)


@register(f"""
    WITH {cells_sql()},
    pairs AS (SELECT a.dataset_name, a.split, a.feature AS i, b.feature AS j, covar_samp(a.value, b.value) AS c
      FROM cells a JOIN cells b ON a.dataset_name = b.dataset_name AND a.row_id = b.row_id GROUP BY ALL),
    sums AS (SELECT dataset_name, split, sum(CASE WHEN i = j THEN c ELSE 0 END) AS trace, sum(c * c) AS squares, sqrt(count(*)) AS d
      FROM pairs GROUP BY ALL)
    SELECT dataset_name, split, {r('trace / d', 6)} AS eigenvalues_mean,
      {r('CASE WHEN d > 1 THEN sqrt(greatest(squares - trace * trace / d, 0) / (d - 1)) ELSE 0 END', 6)} AS eigenvalues_sd FROM sums""")
def px_eigenvalues(spark, folder):
    """Their sum is the trace and the sum of their squares that of all covariances."""
    return rounded(b.eigenvalues(p.comoments(shared_prepared(spark, folder, ids=False))), 6)


@register(f"""
    WITH {raw_cells_sql()}, {_BINNED}, {_INFO},
    per AS (SELECT dataset_name, split, feature, ha / ln(2) AS attr_ent, hc / ln(2) AS class_ent, hj / ln(2) AS joint_ent,
      (ha + hc - hj) / ln(2) AS mut_inf FROM info),
    cond AS (SELECT dataset_name, split, feature, sum(c * c / (sum_bin * n)) AS explained FROM (
      SELECT *, sum(c) OVER (PARTITION BY dataset_name, split, feature, bin) AS sum_bin FROM joint JOIN total USING (dataset_name, split, feature)) GROUP BY ALL),
    prior AS (SELECT dataset_name, split, feature, sum(pow(c / n, 2)) AS base FROM (
      SELECT dataset_name, split, feature, klass, sum(c) AS c FROM joint GROUP BY ALL) JOIN total USING (dataset_name, split, feature) GROUP BY ALL),
    full_info AS (SELECT *, coalesce((explained - base) / nullif(1 - base, 0), 0) AS class_conc FROM per
      JOIN cond USING (dataset_name, split, feature) JOIN prior USING (dataset_name, split, feature))
    SELECT dataset_name, split, {r('avg(class_ent)', 6)} AS class_ent, {_spread_sql(('attr_ent', 'joint_ent', 'mut_inf', 'class_conc'))},
      {r('avg(class_ent) / avg(mut_inf)', 2)} AS eq_num_attr, {r('(avg(attr_ent) - avg(mut_inf)) / avg(mut_inf)', 2)} AS ns_ratio
    FROM full_info GROUP BY dataset_name, split""")
def px_info(spark, folder):
    matrix = shared_split(spark, folder, ids=False)
    binned = p.binned_counts(matrix, p.column_profile(matrix))
    return rounded(b.info_measures(binned, p.info_terms(binned)), 6, eq_num_attr=2, ns_ratio=2)


@register(f"""
    WITH {raw_cells_sql()}, {_BINNED.replace('binned AS (SELECT dataset_name, split, feature,', 'binned AS (SELECT dataset_name, split, row_id, feature,')},
    joint AS (SELECT a.dataset_name, a.split, a.feature AS i, b.feature AS j, a.bin AS x, b.bin AS y, count(*)::DOUBLE AS c
      FROM binned a JOIN binned b ON a.dataset_name = b.dataset_name AND a.row_id = b.row_id AND a.feature <> b.feature GROUP BY ALL),
    cond AS (SELECT dataset_name, split, i, j, sum(c * c / (sx * n)) AS explained FROM (SELECT *,
      sum(c) OVER (PARTITION BY dataset_name, split, i, j, x) AS sx, sum(c) OVER (PARTITION BY dataset_name, split, i, j) AS n FROM joint) GROUP BY ALL),
    prior AS (SELECT dataset_name, split, i, j, sum(pow(sy / n, 2)) AS base FROM (SELECT dataset_name, split, i, j, y, sum(c) AS sy,
      sum(sum(c)) OVER (PARTITION BY dataset_name, split, i, j) AS n FROM joint GROUP BY dataset_name, split, i, j, y) GROUP BY ALL),
    per AS (SELECT *, coalesce((explained - base) / nullif(1 - base, 0), 0) AS attr_conc FROM cond JOIN prior USING (dataset_name, split, i, j))
    SELECT dataset_name, split, {_spread_sql(('attr_conc',))} FROM per GROUP BY dataset_name, split""")
def px_feature_concentration(spark, folder):
    matrix = shared_split(spark, folder, ids=False)
    return rounded(b.feature_concentration(matrix, p.column_profile(matrix)), 6)


@register()
def px_class_stats(spark, folder):
    matrix = shared_prepared(spark, folder, ids=False)
    labelled = p.comoments(matrix.filter("task <> 'regression'"), (*p.KEYS, "label"))
    return rounded(b.class_stats(labelled).join(b.normal_features(p.column_profile(matrix)), list(p.KEYS)), 6)


def _per_classified(spark, folder, measure):
    """The measures of every classification dataset, one after the other, as each trains learners."""
    matrix = shared_prepared(spark, folder, *CLASSIFIED)
    parts = [measure(matrix.filter(F.col("dataset_name") == n)).select(F.lit(n).alias("dataset_name"), "*") for n in CLASSIFIED]
    return rounded(reduce(DataFrame.unionByName, parts), 6)


@register()
def px_tree(spark, folder):
    return _per_classified(spark, folder, tree_shape)


@register()
def px_landmarks(spark, folder):
    rows = shared_prepared(spark, folder, *CLASSIFIED)
    return rounded(landmark_summary(landmarks(rows)), 6)


@register()
def mf_mi_knn(spark, folder):
    return rounded(mi.average(mi.discrete_terms(shared_prepared(spark, folder, *CLASSIFIED, ids=False))), 6)


@register()
def mf_mi_knn_regression(spark, folder):
    """Against a continuous target."""
    values = shared_prepared(spark, folder, *MEASURED, ids=False)
    return rounded(mi.average(mi.continuous_terms(values)), 6)
