"""Scores of predictions, for any number of (dataset, model, split) groups in one job.

Input: ``predictions`` with the grouping keys and label, prediction and, where
a curve is asked for, ``score`` or ``probability``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions.scalar import binary_search, min_max
from scoreweave.operators.cleaning import with_small_row
from scoreweave.session import cut_lineage, measured

KEYS = ("dataset_name", "model_name", "split")
#: Ways a range of scores is split at a time, as a power of two, and the distinct scores a range may keep.
SEARCH_STEPS = 8
SCORE_BUCKETS = 1 << SEARCH_STEPS
RANGE_ROWS = 50_000


def confusion(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per (label, prediction): all the class metrics need."""
    return predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))


def accuracy_f1(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and F1 of class 1 from confusion counts; F1 is 0 without positives."""
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    actual, guess = F.col("label") == 1, F.col("prediction") == 1
    return matrix.groupBy(*keys).agg(
        (count(F.col("label") == F.col("prediction")) / F.sum("n")).alias("accuracy"),
        F.coalesce(
            F.try_divide(2 * count(actual & guess), (count(actual) + count(guess)).cast("double")), F.lit(0.0)
        ).alias("f1_score"),
    )


def macro_scores(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and unweighted class means of precision, recall and F1.

    The classes averaged over are those seen as a label or as a prediction.
    """
    keys = list(keys)
    sides = matrix.select(
        *keys,
        "n",
        F.explode(
            F.array(
                F.struct(F.col("label").alias("klass"), F.lit(1).alias("is_label"), F.lit(0).alias("is_guess")),
                F.struct(F.col("prediction").alias("klass"), F.lit(0).alias("is_label"), F.lit(1).alias("is_guess")),
            )
        ).alias("s"),
        (F.col("label") == F.col("prediction")).cast("int").alias("hit"),
    ).select(*keys, "n", "hit", "s.*")
    per_class = sides.groupBy(*keys, "klass").agg(
        F.sum(F.col("n") * F.col("hit") * F.col("is_label")).alias("tp"),
        F.sum(F.col("n") * F.col("is_label")).alias("actual"),
        F.sum(F.col("n") * F.col("is_guess")).alias("guessed"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, actual, guessed = F.col("tp"), F.col("actual"), F.col("guessed")
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(share(tp, guessed)).alias("precision"),
        F.avg(share(tp, actual)).alias("recall"),
        F.avg(share(2 * tp, actual + guessed)).alias("f1_score"),
    )


def ranges(values: DataFrame, keys: Sequence[str], x: str, most: int | None = None) -> DataFrame:
    """Add ``_range``, the lower end of the range that holds ``x``; no range has more than ``most`` rows of a group.

    Values must be distinct within a group, and ranges of a group are in the
    order of their lower ends. A range with too many rows is split at sketched
    quantiles of its own, and its parts again, so rows per range stay bounded
    however large or uneven a group is. Small groups stay one range.
    """
    keys, most = list(keys), most or RANGE_ROWS
    placed = values.withColumn("_range", F.lit(float("-inf")))
    steps = [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)]
    while True:
        full = measured(placed.groupBy(*keys, "_range").count().filter(F.col("count") > most).drop("count"))
        if full.isEmpty():
            return placed
        within = placed.join(full, [*keys, "_range"])
        edges = measured(within.groupBy(*keys, "_range").agg(F.percentile_approx(x, steps, 4 * SCORE_BUCKETS).alias("_edges")))
        at = binary_search(F.col("_edges"), F.col(x), SEARCH_STEPS)
        lower = F.coalesce(F.get("_edges", at - 1), F.col("_range"))
        # Values at an edge belong below it, so that the last range is never empty of greater ones.
        placed = cut_lineage(placed.join(edges, [*keys, "_range"], "left").withColumn("_range", lower).select(*placed.columns))


def auc(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact area under the ROC curve per group, ties at mid-rank.

    ``scored`` has ``score`` and ``positive`` (0/1). Equal scores are counted
    together before anything is ordered; the distinct scores are then spread
    over ranges of RANGE_ROWS at most (`ranges`), accumulated inside each range,
    and shifted by the negatives of the ranges below. A group with one class
    only has no area: null.
    """
    keys = list(keys)
    tallies = scored.groupBy(*keys, "score").agg(
        F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("q")
    )
    placed = ranges(cut_lineage(tallies), keys, "score")
    below = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("_q_below", F.coalesce(F.sum("q").over(below), F.lit(0)))
    summed = inner.groupBy(*keys, "_range").agg(
        F.sum("p").alias("p"),
        F.sum("q").alias("q"),
        F.sum(F.col("p") * (F.col("_q_below") + F.col("q") / 2.0)).alias("wins"),
    )
    # A row per range from here on.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifted = summed.withColumn("_q_before", F.coalesce(F.sum("q").over(earlier), F.lit(0)))
    wins = F.sum(F.col("wins") + F.col("p") * F.col("_q_before"))
    pairs = F.sum("p").cast("double") * F.sum("q").cast("double")
    return shifted.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("auc_roc"))


def binary_auc(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return auc(
        predictions.select(*keys, "score", (F.col("label") == 1).cast("int").alias("positive")), keys
    )


def one_vs_rest_auc(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class mean of one-against-the-rest areas from the ``probability`` array.

    Null where a class of the array never occurs as a label (or is the only one).
    """
    keys = list(keys)
    per_class = predictions.select(
        *keys, "label", F.posexplode("probability").alias("klass", "score")
    ).select(*keys, "klass", "score", (F.col("label") == F.col("klass")).cast("int").alias("positive"))
    areas = auc(per_class, [*keys, "klass"])
    return areas.groupBy(*keys).agg(
        F.when(F.bool_and(F.col("auc_roc").isNotNull()), F.avg("auc_roc")).alias("auc_roc")
    )


def score_column(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``score``: probability of class 1, else min-max decision value, else the prediction."""
    if "probability" in predictions.columns:
        return predictions.withColumn("score", F.get("probability", F.lit(1)))
    if "decision" in predictions.columns:
        keys = list(keys)
        span = predictions.groupBy(*keys).agg(F.min("decision").alias("_lo"), F.max("decision").alias("_hi"))
        return (
            predictions.join(measured(span), keys)
            .withColumn("score", min_max(F.col("decision"), F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi")
        )
    return predictions.withColumn("score", F.col("prediction").cast("double"))


def regression_scores(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAE, MSE, RMSE and R2. A constant label has R2 0, or 1 if it is predicted exactly."""
    error = F.col("label") - F.col("prediction")
    sums = predictions.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop("label").alias("_var"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.try_divide(F.col("mse"), F.col("_var"))).otherwise(
        F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return sums.select(*keys, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def evaluate(predictions: DataFrame, task: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The performance record of every group for a task.

    Predictions that carry no probability (or decision) are ranked by their
    hard prediction, which only a binary curve can use.
    """
    keys = list(keys)
    if task == "regression":
        return regression_scores(predictions, keys)
    counts = confusion(predictions, keys)
    if task == "binary":
        return accuracy_f1(counts, keys).join(binary_auc(score_column(predictions, keys), keys), keys)
    scores = macro_scores(counts, keys)
    if "probability" not in predictions.columns:
        return scores.withColumn("auc_roc", F.lit(None).cast("double"))
    return scores.join(one_vs_rest_auc(predictions, keys), keys)


def class_weights(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    keys = list(keys)
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n_class"))
    table = counts.groupBy(*keys).agg(F.sum("n_class").alias("_n"), F.count("*").alias("_k"))
    joined = counts.join(table, keys) if keys else with_small_row(counts, table)
    return joined.select(
        *keys, label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight")
    )


def positive_weight(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weight ``negatives / positives`` for class 1, or 1 without positives."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.groupBy(*keys).agg(
        neg.alias("n_negative"),
        pos.alias("n_positive"),
        F.coalesce(F.try_divide(neg.cast("double"), pos.cast("double")), F.lit(1.0)).alias("scale_pos_weight"),
    )
