"""Metrics over predictions of fixed rules, and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import r, rounded
from scoreweave.operators import metrics
from scoreweave.sources.readers import table
from scoreweave.sources.registry import DOC_QUALITY

# A rule that calls a line item final by its price, scored by a coarse price rank so that scores tie.
_BINARY = """predictions AS (
    SELECT l_returnflag AS split, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
      CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END AS prediction, floor(l_extendedprice / 100) AS score FROM lineitem)"""


def _binary(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("split"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("prediction"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("score"),
    )


# A rule that spreads orders over three classes, one of which (3) is never a label.
_MULTI = """predictions AS (
    SELECT o_orderpriority AS split, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
      CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 3 END AS prediction,
      o_totalprice AS t FROM orders)"""


def _multi(spark, folder):
    t = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("split"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.when(t < 100000, 0).when(t < 250000, 1).otherwise(3).alias("prediction"),
        F.array(1 - t / 600000.0, t / 600000.0, F.abs(t - 250000) / 600000.0).alias("probability"),
    )


_VALUES = """predictions AS (
    SELECT event_type AS split, value AS label, 20 + CAST(props->>'$.k' AS DOUBLE) / 2 AS prediction FROM events)"""


def _values(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("split"),
        F.col("value").alias("label"),
        (20 + F.get_json_object("props", "$.k").cast("double") / 2).alias("prediction"),
    )


@register(f"""
    WITH {_BINARY}, c AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS hit,
      count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 1) AS pos,
      count(*) FILTER (WHERE prediction = 1) AS guess FROM predictions GROUP BY split)
    SELECT split, {r('hit / n::DOUBLE', 6)} AS accuracy, {r('coalesce(2 * tp / nullif(pos + guess, 0)::DOUBLE, 0)', 6)} AS f1_score FROM c""")
def ev_accuracy_f1(spark, folder):
    return rounded(metrics.accuracy_f1(metrics.confusion(_binary(spark, folder), ["split"]), ["split"]), 6)


def _auc_sql(source):
    return f"""tally AS (SELECT split, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS q
      FROM {source} GROUP BY split, score),
    run AS (SELECT split, p, q, coalesce(sum(q) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tally),
    area AS (SELECT split, sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q)::DOUBLE, 0) AS auc FROM run GROUP BY split)"""


@register(f"WITH {_BINARY}, {_auc_sql('predictions')} SELECT split, {r('auc', 9)} AS auc_roc FROM area")
def ev_auc_binary(spark, folder):
    return rounded(metrics.binary_auc(_binary(spark, folder), ["split"]), 9)


@register(f"""
    WITH {_MULTI}, classes AS (SELECT split, label AS k FROM predictions UNION SELECT split, prediction FROM predictions),
    per AS (SELECT c.split, k, count(*) FILTER (WHERE label = k AND prediction = k)::DOUBLE AS tp,
        count(*) FILTER (WHERE label = k) AS actual, count(*) FILTER (WHERE prediction = k) AS guessed
      FROM classes c JOIN predictions p ON c.split = p.split GROUP BY c.split, k)
    SELECT split, {r('sum(tp) / sum(actual)', 6)} AS accuracy, {r('avg(coalesce(tp / nullif(guessed, 0), 0))', 6)} AS "precision",
      {r('avg(coalesce(tp / nullif(actual, 0), 0))', 6)} AS recall, {r('avg(coalesce(2 * tp / nullif(actual + guessed, 0), 0))', 6)} AS f1_score
    FROM per GROUP BY split""")
def ev_macro_prf(spark, folder):
    return rounded(metrics.macro_scores(metrics.confusion(_multi(spark, folder), ["split"]), ["split"]), 6)


_OVR = " UNION ALL ".join(
    f"SELECT split || '#{k}' AS split, CASE WHEN label = {k} THEN 1 ELSE 0 END AS label, {e} AS score FROM predictions"
    for k, e in enumerate(("1 - t / 600000.0::DOUBLE", "t / 600000.0::DOUBLE", "abs(t - 250000) / 600000.0::DOUBLE"))
)


@register(f"""
    WITH {_MULTI}, spread AS ({_OVR}), {_auc_sql('spread')}
    SELECT split_part(split, '#', 1) AS split, {r('avg(auc)', 9)} AS auc_roc FROM area GROUP BY split_part(split, '#', 1)""")
def ev_auc_ovr(spark, folder):
    return rounded(metrics.one_vs_rest_auc(_multi(spark, folder), ["split"]), 9)


@register(f"""
    WITH {_VALUES}, m AS (SELECT split, avg(abs(label - prediction)) AS mae, avg(pow(label - prediction, 2)) AS mse, var_pop(label) AS v
      FROM predictions GROUP BY split)
    SELECT split, {r('mae', 6)} AS mae, {r('mse', 4)} AS mse, {r('sqrt(mse)', 6)} AS rmse, {r('1 - mse / v', 6)} AS r2 FROM m""")
def ev_regression(spark, folder):
    return rounded(metrics.regression_scores(_values(spark, folder), ["split"]), 6, mse=4)


@register(f"""
    WITH {_BINARY}, span AS (SELECT split, min(score) AS lo, max(score) AS hi FROM predictions GROUP BY split)
    SELECT split, {r('avg((score - lo) / (hi - lo + 1e-10::DOUBLE))', 6)} AS mean_score, {r('avg(prediction)', 6)} AS mean_hard
    FROM predictions JOIN span USING (split) GROUP BY split""")
def ev_score_fallback(spark, folder):
    rows = _binary(spark, folder)
    decided = metrics.score_column(rows.withColumnRenamed("score", "decision"), ["split"])
    hard = metrics.score_column(rows.drop("score"), ["split"])
    soft = decided.groupBy("split").agg(F.avg("score").alias("mean_score"))
    return rounded(soft.join(hard.groupBy("split").agg(F.avg("score").alias("mean_hard")), "split"), 6)


@register(f"""
    WITH c AS (SELECT quality, count(*) AS n_class FROM documents JOIN labels USING (doc_id) GROUP BY quality)
    SELECT quality, n_class, {r('(SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * n_class)::DOUBLE', 9)} AS weight FROM c""")
def class_weights(spark, folder):
    return rounded(metrics.class_weights(DOC_QUALITY.build(spark, folder), "quality"), 9)


@register(f"""
    WITH c AS (SELECT count(*) FILTER (WHERE quality = 0) AS n_negative, count(*) FILTER (WHERE quality = 1) AS n_positive
      FROM documents JOIN labels USING (doc_id))
    SELECT n_negative, n_positive, {r('coalesce(n_negative / nullif(n_positive, 0)::DOUBLE, 1)', 9)} AS scale_pos_weight FROM c""")
def pos_weight(spark, folder):
    return rounded(metrics.positive_weight(DOC_QUALITY.build(spark, folder), "quality"), 9)


@register(f"""
    SELECT l_returnflag, {r('avg((l_extendedprice - lo) / (hi - lo + 1e-10::DOUBLE))', 6)} AS mean_scaled,
      {r('avg(sqrt(l_quantity))', 6)} AS mean_root, {r('avg(l_tax / (l_discount + 1e-10::DOUBLE))', 1)} AS mean_ratio
    FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY l_returnflag""")
def scalar_functions(spark, folder):
    from scoreweave.functions.scalar import guarded_ratio, min_max, root
    from scoreweave.operators.cleaning import with_small_row

    line = table(spark, folder, "lineitem")
    span = line.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    out = with_small_row(line, span).groupBy("l_returnflag").agg(
        F.avg(min_max(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))).alias("mean_scaled"),
        F.avg(root(F.col("l_quantity"))).alias("mean_root"),
        F.avg(guarded_ratio(F.col("l_tax"), F.col("l_discount"))).alias("mean_ratio"),
    )
    return rounded(out, 6, "mean_scaled", "mean_root", mean_ratio=1)
