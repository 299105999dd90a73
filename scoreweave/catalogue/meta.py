"""Meta-dataset, score prediction, reports and sinks.

Scores come from fixed rules over the digest of a row's id, so that every
table here can be rebuilt in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.catalogue import register
from scoreweave.catalogue.common import cells_sql, r, rounded, shared_prepared
from scoreweave.functions.hashing import prefix
from scoreweave.operators import metrics, profile
from scoreweave.plans import meta, reports
from scoreweave.plans.record import full_record
from scoreweave.session import cut_lineage, ensure_checkpoint_dir
from scoreweave.sources import readers
from scoreweave.sources.readers import table
from scoreweave.sources.registry import BINARY, MULTICLASS, REGRESSION
from scoreweave.sources.sinks import RunLog, write_table

_BINARY_SETS = ("line_status", "doc_quality")
_VALUE_SETS = ("line_price", "order_total", "event_value")


def _held(spark, folder, names):
    u = F.conv(prefix(F.md5(F.concat(F.lit("rule:"), "row_id")), 8), 16, 10).cast("double") / float(1 << 32)
    return (
        shared_prepared(spark, folder, *names)
        .filter("split <> 'train'")
        .select("dataset_name", "split", "row_id", "label", u.alias("u"))
    )


def _rules(held, rules):
    """One prediction per row and rule."""
    return held.select(
        "dataset_name",
        "split",
        "label",
        F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), *cols) for n, cols in rules.items()])).alias("p"),
    ).select("dataset_name", "split", "label", "p.*")


def _binary_scores(spark, folder):
    u, y = F.col("u"), F.col("label")
    noisy = 0.6 * y + 0.4 * u
    out = lambda s, p: (s.alias("score"), p.cast("double").alias("prediction"))
    rules = {
        "Constant": out(F.lit(0.5), F.lit(1)),
        "Digest": out(u, u >= 0.5),
        "Noisy": out(noisy, noisy >= 0.5),
    }
    predictions = _rules(_held(spark, folder, _BINARY_SETS), rules)
    return metrics.accuracy_f1(metrics.confusion(predictions)).join(metrics.binary_auc(predictions), list(metrics.KEYS))


def _value_scores(spark, folder):
    u, y = F.col("u"), F.col("label")
    out = lambda p: (p.alias("prediction"),)
    rules = {"Constant": out(F.lit(100.0)), "Digest": out(y * u), "Noisy": out(y + (u - 0.5) * 10)}
    return metrics.regression_scores(_rules(_held(spark, folder, _VALUE_SETS), rules))


def _profiles(spark, folder, names):
    matrix = shared_prepared(spark, folder, *names)
    return profile.summarise(profile.column_profile(matrix)).select(
        "dataset_name", "split", "n_samples", "n_features", "feature_std", "mean_variance"
    )


_MF = """per_feature AS (SELECT dataset_name, split, feature, count(*) AS n, var_pop(value) AS v FROM cells GROUP BY ALL),
  mf AS (SELECT dataset_name, split, max(n) AS n_samples, count(*) AS n_features, avg(sqrt(v)) AS feature_std,
    avg(v) AS mean_variance FROM per_feature WHERE split <> 'train' GROUP BY ALL)"""
_U = """held AS (SELECT DISTINCT dataset_name, split, row_id, label,
    CAST(('0x' || substr(md5('rule:' || row_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM cells WHERE split <> 'train')"""
_BINARY_SQL = f"""{cells_sql(*_BINARY_SETS)}, {_MF}, {_U},
  predictions AS (
    SELECT dataset_name, split, 'Constant' AS model_name, label, 0.5::DOUBLE AS score, 1 AS prediction FROM held UNION ALL
    SELECT dataset_name, split, 'Digest', label, u, CASE WHEN u >= 0.5 THEN 1 ELSE 0 END FROM held UNION ALL
    SELECT dataset_name, split, 'Noisy', label, 0.6::DOUBLE * label + 0.4::DOUBLE * u,
      CASE WHEN 0.6::DOUBLE * label + 0.4::DOUBLE * u >= 0.5 THEN 1 ELSE 0 END FROM held),
  counted AS (SELECT dataset_name, split, model_name, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
    coalesce(2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) / nullif(sum(label) + sum(prediction), 0)::DOUBLE, 0) AS f1_score
    FROM predictions GROUP BY ALL),
  tally AS (SELECT dataset_name, split, model_name, score, sum(label) AS p, sum(1 - label) AS q FROM predictions GROUP BY ALL),
  run AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY dataset_name, split, model_name ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tally),
  area AS (SELECT dataset_name, split, model_name, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc_roc FROM run GROUP BY ALL),
  meta AS (SELECT * FROM counted JOIN area USING (dataset_name, split, model_name) JOIN mf USING (dataset_name, split))"""
_VALUE_SQL = f"""{cells_sql(*_VALUE_SETS)}, {_MF}, {_U},
  predictions AS (
    SELECT dataset_name, split, 'Constant' AS model_name, label, 100.0::DOUBLE AS prediction FROM held UNION ALL
    SELECT dataset_name, split, 'Digest', label, label * u FROM held UNION ALL
    SELECT dataset_name, split, 'Noisy', label, label + (u - 0.5::DOUBLE) * 10 FROM held),
  scored AS (SELECT dataset_name, split, model_name, avg(abs(label - prediction)) AS mae, avg(pow(label - prediction, 2)) AS mse,
    sqrt(avg(pow(label - prediction, 2))) AS rmse, 1 - avg(pow(label - prediction, 2)) / var_pop(label) AS r2 FROM predictions GROUP BY ALL),
  meta AS (SELECT * FROM scored JOIN mf USING (dataset_name, split))"""
_BINARY_METRICS, _VALUE_METRICS = ("accuracy", "f1_score", "auc_roc"), ("mae", "mse", "rmse", "r2")


def _binary_meta(spark, folder):
    return meta.meta_dataset(_profiles(spark, folder, _BINARY_SETS), _binary_scores(spark, folder))


def _value_meta(spark, folder):
    return meta.meta_dataset(_profiles(spark, folder, _VALUE_SETS), _value_scores(spark, folder))


@register(f"""
    WITH {_BINARY_SQL} SELECT dataset_name, split, model_name, n_samples, n_features,
      {', '.join(f'{r(c, 6)} AS {c}' for c in (*_BINARY_METRICS, 'feature_std', 'mean_variance'))} FROM meta""")
def meta_dataset(spark, folder):
    return rounded(_binary_meta(spark, folder), 6)


@register(f"""
    WITH {_VALUE_SQL} SELECT dataset_name, split, model_name, n_samples, n_features, {r('mse', 1)} AS mse,
      {', '.join(f'{r(c, 6)} AS {c}' for c in ('mae', 'rmse', 'r2', 'feature_std', 'mean_variance'))} FROM meta""")
def meta_dataset_regression(spark, folder):
    return rounded(_value_meta(spark, folder), 6, mse=1)


_COLUMNS = ("n_samples", "n_features", "feature_std", "mean_variance")


def _z(column, metric=False):
    spread = f"(SELECT stddev_pop({column}) FROM meta WHERE split = 'val')"
    centre = f"(SELECT avg({column}) FROM meta WHERE split = 'val')"
    return f"CASE WHEN {spread} > 0 THEN ({column} - {centre}) / {spread} ELSE {column} - {centre} END"


@register(f"""
    WITH {_BINARY_SQL},
    wide AS (SELECT *, [{', '.join(f'CAST({_z(c)} AS DOUBLE)' for c in _COLUMNS)}, {', '.join(f"CAST(model_name = '{m}' AS DOUBLE)" for m in ('Constant', 'Digest', 'Noisy'))}] AS f,
      coalesce(auc_roc, avg(auc_roc) OVER (PARTITION BY split)) AS auc_target FROM meta)
    SELECT dataset_name, split, model_name, CAST(i AS INTEGER) AS feature, {r('v', 6)} AS value,
      {r('accuracy', 6)} AS accuracy_target, {r('f1_score', 6)} AS f1_score_target, {r('auc_target', 6)} AS auc_roc_target FROM (
      SELECT *, unnest(range(len(f))) AS i, unnest(f) AS v FROM wide)""")
def meta_prepare(spark, folder):
    ready = meta.meta_prepare(_binary_meta(spark, folder), "binary")
    out = ready.rows.select(
        "dataset_name", "split", "model_name", F.posexplode("features").alias("feature", "value"),
        "accuracy_target", "f1_score_target", "auc_roc_target",
    )
    return rounded(out, 6, "accuracy_target", "f1_score_target", "auc_roc_target", value=6)


@register(f"""
    WITH {_VALUE_SQL} SELECT dataset_name, split, model_name,
      {', '.join(f'{r(_z(m), 6)} AS {m}_target' for m in _VALUE_METRICS)} FROM meta""")
def meta_prepare_targets(spark, folder):
    ready = meta.meta_prepare(_value_meta(spark, folder), "regression")
    return rounded(ready.rows.select("dataset_name", "split", "model_name", *[f"{m}_target" for m in _VALUE_METRICS]), 6)


@register(f"""
    WITH {_VALUE_SQL} SELECT 'mae' AS metric, {r('avg(mae)', 6)} AS mean, {r('stddev_pop(mae)', 6)} AS std FROM meta WHERE split = 'val'
    UNION ALL SELECT 'mse', {r('avg(mse)', 1)}, {r('stddev_pop(mse)', 1)} FROM meta WHERE split = 'val'
    UNION ALL SELECT 'rmse', {r('avg(rmse)', 6)}, {r('stddev_pop(rmse)', 6)} FROM meta WHERE split = 'val'
    UNION ALL SELECT 'r2', {r('avg(r2)', 6)}, {r('stddev_pop(r2)', 6)} FROM meta WHERE split = 'val'""")
def target_scalers(spark, folder):
    ready = meta.meta_prepare(_value_meta(spark, folder), "regression")
    return _by_metric(ready.scalers, "mean", "std")


# Training rows too: their profiles, a row per model, without scores.
_MF_EVERY = _MF.replace("mf AS", "every_mf AS").replace("WHERE split <> 'train' ", "").replace("per_feature", "every_feature")
_BINARY_EVERY_SQL = f"""{_BINARY_SQL}, {_MF_EVERY},
  every AS (SELECT dataset_name, split, model_name, accuracy, f1_score, auc_roc, n_samples, n_features, feature_std, mean_variance
    FROM every_mf JOIN (SELECT DISTINCT dataset_name, model_name FROM counted) USING (dataset_name)
    LEFT JOIN (SELECT * FROM counted JOIN area USING (dataset_name, split, model_name)) USING (dataset_name, split, model_name))"""


def _binary_every_split(spark, folder):
    return meta.meta_dataset(_profiles(spark, folder, _BINARY_SETS), _binary_scores(spark, folder), unscored=True)


@register(f"""
    WITH {_BINARY_EVERY_SQL} SELECT dataset_name, split, model_name, n_samples, n_features,
      {', '.join(f'{r(c, 6)} AS {c}' for c in (*_BINARY_METRICS, 'feature_std', 'mean_variance'))} FROM every""")
def meta_dataset_every_split(spark, folder):
    return rounded(_binary_every_split(spark, folder), 6)


@register(f"""
    WITH {_BINARY_EVERY_SQL},
    wide AS (SELECT *, [{', '.join(f'CAST({_z(c)} AS DOUBLE)' for c in _COLUMNS)}, {', '.join(f"CAST(model_name = '{m}' AS DOUBLE)" for m in ('Constant', 'Digest', 'Noisy'))}] AS f FROM every)
    SELECT dataset_name, split, model_name, CAST(i AS INTEGER) AS feature, {r('v', 6)} AS value, {r('accuracy', 6)} AS accuracy_target FROM (
      SELECT *, unnest(range(len(f))) AS i, unnest(f) AS v FROM wide)""")
def meta_prepare_every_split(spark, folder):
    """Training rows are scaled with the validation statistics and have no target."""
    rows = meta.meta_prepare(_binary_every_split(spark, folder), BINARY).rows
    out = rows.select("dataset_name", "split", "model_name", F.posexplode("features").alias("feature", "value"), "accuracy_target")
    return rounded(out, 6, "accuracy_target", value=6)


# A stand-in for the predicting model: a fixed affine map of the actual score.
def _predicted(df, names):
    return df.withColumns({f"predicted_{m}": F.col(m) * 0.9173031 + 0.0517193 for m in names})


def _predicted_sql(names):
    return ", ".join(f"{m} * 0.9173031::DOUBLE + 0.0517193::DOUBLE AS predicted_{m}" for m in names)


@register(f"""
    WITH {_BINARY_SQL}, p AS (SELECT *, {_predicted_sql(_BINARY_METRICS)} FROM meta)
    SELECT dataset_name, split, model_name, {', '.join(f'{r(f"abs(predicted_{m} - {m})", 6)} AS {m}_abs_error' for m in _BINARY_METRICS)} FROM p""")
def meta_abs_errors(spark, folder):
    out = reports.with_abs_errors(_predicted(_binary_meta(spark, folder), _BINARY_METRICS), _BINARY_METRICS)
    return rounded(out.select("dataset_name", "split", "model_name", *[f"{m}_abs_error" for m in _BINARY_METRICS]), 6)


@register(" UNION ALL ".join(
    f"""SELECT '{m}' AS metric, {r(f"avg(CASE WHEN split = 'val' THEN abs(predicted_{m} - {m}) END)", 6)} AS mean_abs_error_val,
      {r(f"avg(CASE WHEN split = 'test' THEN abs(predicted_{m} - {m}) END)", 6)} AS mean_abs_error_test FROM p"""
    for m in _BINARY_METRICS).join((f"WITH {_BINARY_SQL}, p AS (SELECT *, {_predicted_sql(_BINARY_METRICS)} FROM meta) ", "")))
def mae_summary(spark, folder):
    return rounded(reports.mae_summary(_predicted(_binary_meta(spark, folder), _BINARY_METRICS), _BINARY_METRICS), 6)


def _by_metric(df, *columns):
    """Rounded to six decimals; squared errors, which are as large as the squared target, to one."""
    squared = F.col("metric") == "mse"
    return df.withColumns({c: F.when(squared, F.round(c, 1)).otherwise(F.round(c, 6)) for c in columns})


def _compare_sql(names):
    digits_of = lambda m: 1 if m == "mse" else 6
    return " UNION ALL ".join(
        f"""SELECT dataset_name, CASE split WHEN 'val' THEN 'Validation' ELSE 'Test' END AS split, model_name, '{m}' AS metric,
          {r(f'avg({m})', digits_of(m))} AS actual, {r(f'avg(predicted_{m})', digits_of(m))} AS predicted,
          {r(f'avg(predicted_{m}) - avg({m})', digits_of(m))} AS difference,
          CASE WHEN avg(predicted_{m}) - avg({m}) {'<=' if m in ('mae', 'mse', 'rmse') else '>='} 0 THEN 'green' ELSE 'red' END AS direction
        FROM p GROUP BY dataset_name, split, model_name"""
        for m in names
    )


@register(f"WITH {_BINARY_SQL}, p AS (SELECT *, {_predicted_sql(_BINARY_METRICS)} FROM meta) {_compare_sql(_BINARY_METRICS)}")
def compare_table(spark, folder):
    return rounded(reports.comparison(_predicted(_binary_meta(spark, folder), _BINARY_METRICS), _BINARY_METRICS), 6)


@register(f"WITH {_VALUE_SQL}, p AS (SELECT *, {_predicted_sql(_VALUE_METRICS)} FROM meta) {_compare_sql(_VALUE_METRICS)}")
def compare_table_regression(spark, folder):
    compared = reports.comparison(_predicted(_value_meta(spark, folder), _VALUE_METRICS), _VALUE_METRICS)
    return _by_metric(compared, "actual", "predicted", "difference")


@register(f"""
    WITH {_BINARY_SQL}, p AS (SELECT *, {_predicted_sql(_BINARY_METRICS)} FROM meta), c AS ({_compare_sql(_BINARY_METRICS)})
    SELECT dataset_name, split, metric, model_name, 'Actual' AS "Metric_Type", actual AS "Value" FROM c
    UNION ALL SELECT dataset_name, split, metric, model_name, 'Predicted', predicted FROM c""")
def compare_long(spark, folder):
    compared = reports.comparison(_predicted(_binary_meta(spark, folder), _BINARY_METRICS), _BINARY_METRICS)
    return rounded(reports.comparison_long(compared), 6)


@register(f"""
    WITH {_BINARY_SQL}, p AS (SELECT *, {_predicted_sql(_BINARY_METRICS)} FROM meta)
    SELECT dataset_name, model_name, split, {', '.join(f'{r(c, 6)} AS {c}' for m in _BINARY_METRICS for c in (m, f'predicted_{m}'))} FROM p""")
def compare_columns(spark, folder):
    return rounded(reports.comparison_columns(_predicted(_binary_meta(spark, folder), _BINARY_METRICS), _BINARY_METRICS), 6)


@register(f"""
    WITH {_VALUE_SQL}
    SELECT dataset_name, split, model_name, CASE WHEN split = 'val' THEN {r('mae', 6)} END AS mae_val,
      CASE WHEN split = 'val' THEN {r('r2', 6)} END AS r2_val, CASE WHEN split = 'test' THEN {r('mae', 6)} END AS mae_test,
      CASE WHEN split = 'test' THEN {r('r2', 6)} END AS r2_test FROM meta""")
def union_predictions(spark, folder):
    scores = _value_scores(spark, folder).select("dataset_name", "split", "model_name", "mae", "r2")
    sides = [meta.with_scores_named_by_split(scores, ("mae", "r2"), s) for s in ("val", "test")]
    return rounded(reports.union_predictions(*sides), 6)


_RECORDS: dict[tuple, object] = {}


def _full_meta(spark, folder, names, scores):
    """The whole meta-feature record of the held-out splits beside their scores; the record is written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, names)
    if key not in _RECORDS:
        matrix = shared_prepared(spark, folder, *names).filter("split <> 'train'")
        _RECORDS[key] = cut_lineage(full_record(matrix))
    return meta.meta_dataset(_RECORDS[key], scores)


def _searched(spark, folder):
    """Trials of the accuracy search, and the prepared rows they come from."""
    ready = meta.meta_prepare(_full_meta(spark, folder, _BINARY_SETS, _binary_scores(spark, folder)), BINARY)
    train = ready.rows.filter("split = 'val'").select("row_id", "features", F.col("accuracy_target").alias("label"))
    n_iter, folds = meta.SEARCH[BINARY]
    return meta.search(train, None, "xgb", meta.spaces(BINARY)["xgb"], n_iter, folds)


@register()
def meta_search(spark, folder):
    return _searched(spark, folder).trials


@register(f"""
    WITH {_BINARY_SQL},
    folds AS (SELECT DISTINCT CAST(CAST('0x' || substr(md5('{meta.SEARCH_SEED}:' || concat_ws('|', dataset_name, split, model_name)), 1, 8) AS BIGINT) % {meta.SEARCH[BINARY][1]} AS INTEGER) AS fold
      FROM meta WHERE split = 'val')
    SELECT 'xgb' AS family, fold, CAST({meta.SEARCH[BINARY][0]} AS BIGINT) AS candidates, CAST({meta.SEARCH[BINARY][0]} AS BIGINT) AS scored,
      true AS plausible FROM folds""")
def meta_search_folds(spark, folder):
    """Every fold that has rows is scored under every setting drawn, with errors that accuracies can have; the winner has the least mean."""
    found = _searched(spark, folder)
    lowest = found.trials.groupBy("candidate").agg(F.avg("mae").alias("mean")).agg(F.min("mean")).first()[0]
    right = F.lit(abs(lowest - found.cv_error) < 1e-12)
    return found.trials.groupBy("family", "fold").agg(
        F.count_distinct("candidate").alias("candidates"),
        F.count("mae").alias("scored"),
        (F.min("mae") >= 0).alias("low"),
        (F.max("mae") <= 1).alias("high"),
    ).select("family", "fold", "candidates", "scored", (F.col("low") & F.col("high") & right).alias("plausible"))


@register()
def meta_predict(spark, folder):
    ready = meta.meta_prepare(_full_meta(spark, folder, _VALUE_SETS, _value_scores(spark, folder)), REGRESSION)
    return meta.predict_scores(ready, meta.train_meta_models(ready, REGRESSION), REGRESSION)


_CLASS_SETS = ("return_flag", "order_status", "emb_class")


def _class_scores(spark, folder):
    """Scores of rules on the multiclass tables, from hard labels."""
    held = _held(spark, folder, _CLASS_SETS)
    u, y = F.col("u"), F.col("label")
    out = lambda p: (p.cast("double").alias("prediction"),)
    rules = {"Constant": out(F.lit(0)), "Digest": out(F.floor(u * 3)), "Noisy": out(F.when(u < 0.7, y).otherwise(F.lit(1)))}
    return metrics.evaluate(_rules(held, rules), MULTICLASS)


@register()
def meta_predict_multiclass(spark, folder):
    """Five metrics of the multiclass task, predicted from the full record with the task's own space and budget."""
    ready = meta.meta_prepare(_full_meta(spark, folder, _CLASS_SETS, _class_scores(spark, folder)), MULTICLASS)
    return meta.predict_scores(ready, meta.train_meta_models(ready, MULTICLASS), MULTICLASS)


# Trials of a search whose errors are known: the price of parts by size, as (setting, fold) errors.
@register("""
    SELECT 'parts' AS family, CAST(c AS INTEGER) AS candidate, CAST(c AS VARCHAR) AS params, round(m, 6) AS cv_mae FROM (
      SELECT p_size AS c, avg(e) AS m FROM (SELECT p_size, p_brand, max(p_retailprice) AS e FROM part GROUP BY ALL) GROUP BY p_size)
    ORDER BY m, c LIMIT 1""")
def best_candidate(spark, folder):
    trials = table(spark, folder, "part").groupBy("p_size", "p_brand").agg(F.max("p_retailprice").alias("mae")).select(
        F.lit("parts").alias("family"), F.col("p_size").alias("candidate"), F.col("p_size").cast("string").alias("params"), "mae"
    )
    return rounded(meta.best_candidate(trials), 6)


# -- sinks and file scans --------------------------------------------------------


def _scratch(spark):
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


@register(" UNION ALL ".join(
    f"SELECT 'metric' AS kind, concat_ws('_', dataset_name, model_name, split, '{m}') AS key, {r(m, 6)} AS value FROM meta"
    for m in _BINARY_METRICS).join((f"WITH {_BINARY_SQL} ", """
    UNION ALL SELECT 'param', 'n_rows', CAST(count(*) AS DOUBLE) FROM held
    UNION ALL SELECT 'run', 'start', NULL UNION ALL SELECT 'run', 'end', NULL""")))
def run_log(spark, folder):
    log = RunLog(spark, _scratch(spark))
    log.start_run("rules")
    log.log_param("n_rows", _held(spark, folder, _BINARY_SETS).count())
    log.log_metrics_table(_binary_scores(spark, folder), metrics.KEYS, _BINARY_METRICS)
    log.end_run()
    value = F.when(F.col("kind") != "run", F.col("value").cast("double"))
    return rounded(log.read().select("kind", "key", value.alias("value")), 6)


@register("SELECT * FROM customer")
def sink_roundtrip(spark, folder):
    customers = table(spark, folder, "customer")
    path = write_table(customers, _scratch(spark))
    return spark.read.schema(customers.schema).parquet(path)


@register("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_scan(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return readers.csv_with_header(spark, write_table(orders, _scratch(spark), "csv"), orders.schema)


@register("""
    SELECT o_orderkey, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_totalprice FROM orders""")
def csv_scan_headerless(spark, folder):
    """Fields padded after the comma, unknown ones written as a question mark."""
    orders = table(spark, folder, "orders")
    known = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "?").otherwise(F.col("o_orderpriority"))
    path = _scratch(spark)
    orders.select(F.concat_ws(", ", "o_orderkey", known, "o_totalprice")).write.text(path)
    schema = T.StructType(
        [orders.schema["o_orderkey"], T.StructField("o_orderpriority", T.StringType()), orders.schema["o_totalprice"]]
    )
    return readers.csv_headerless(spark, path, schema)


@register("""
    SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS p_size, p_retailprice, p_name FROM part""")
def whitespace_scan(spark, folder):
    """Blank-separated fields, a quoted name, and question marks for the large sizes."""
    parts = table(spark, folder, "part")
    size = F.when(F.col("p_size") > 25, "?").otherwise(F.col("p_size").cast("string"))
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    path = _scratch(spark)
    parts.select(F.concat_ws("   ", "p_partkey", size, "p_retailprice", quoted)).write.text(path)
    schema = T.StructType([parts.schema[c] for c in ("p_partkey", "p_size", "p_retailprice", "p_name")])
    return readers.whitespace_delimited(spark, path, schema)
