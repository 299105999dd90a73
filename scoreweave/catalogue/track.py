"""A task end to end with learners whose predictions SQL can rebuild, read back from the files it wrote, and saved models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import cells_sql, r, rounded, shared_prepared
from scoreweave.catalogue.meta import _BINARY_METRICS, _BINARY_SQL
from scoreweave.functions.hashing import prefix
from scoreweave.learners.base import load_model, save_note
from scoreweave.learners.roster import roster
from scoreweave.plans.track import run_track
from scoreweave.session import ensure_checkpoint_dir
from scoreweave.sources.registry import BINARY


class _Rule:
    """A model whose score is a fixed expression of the row's id and label; there is nothing to fit."""

    def __init__(self, name: str):
        self.name = name

    def fit(self, train):
        return self

    def predict(self, rows):
        u = F.conv(prefix(F.md5(F.concat(F.lit("rule:"), "row_id")), 8), 16, 10).cast("double") / float(1 << 32)
        score = {"Constant": F.lit(0.5), "Digest": u, "Noisy": 0.6 * F.col("label") + 0.4 * u}[self.name]
        out = rows.withColumn("probability", F.array(1.0 - score, score))
        return out.withColumn("prediction", (F.get("probability", F.lit(1)) >= 0.5).cast("double"))

    def save(self, path: str) -> None:
        save_note(path, {"kind": "rule", "name": self.name})


_RUNS: dict[tuple, str] = {}


def _ran(spark, folder: str) -> str:
    """Where the binary task of this session and folder was written; it runs once, with its own search budget."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RUNS:
        out = f"{ensure_checkpoint_dir(spark)}/track/{uuid.uuid4().hex}"
        run_track(spark, folder, BINARY, out, learners={n: _Rule(n) for n in ("Constant", "Digest", "Noisy")})
        _RUNS[key] = out
    return _RUNS[key]


def _splits(spark, path: str):
    parts = [spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{split}") for split in ("val", "test")]
    return parts[0].unionByName(parts[1])


@register(f"""
    WITH {_BINARY_SQL} SELECT dataset_name, split, model_name, CAST(n_samples AS DOUBLE) AS n_samples,
      {', '.join(f'{r(m, 6)} AS {m}' for m in _BINARY_METRICS)} FROM meta""")
def track_joined_scores(spark, folder):
    """The meta-dataset that the run wrote, without its other descriptors."""
    joined = _splits(spark, f"{_ran(spark, folder)}/joined_scores")
    names = ("n_samples", *_BINARY_METRICS)
    return rounded(joined.select("dataset_name", "split", "model_name", *[F.col(m).cast("double").alias(m) for m in names]), 6)


@register(f"""
    WITH {_BINARY_SQL} SELECT dataset_name, split, model_name, {', '.join(f'{r(m, 6)} AS {m}' for m in _BINARY_METRICS)},
      true AS has_predictions, true AS errors_fit FROM meta""")
def track_predicted_scores(spark, folder):
    """The predictions that the run wrote: beside the actual scores, each with the error that it makes."""
    rows = _splits(spark, f"{_ran(spark, folder)}/predicted_scores")
    num = lambda c: F.col(c).cast("double")
    fit = [F.abs(F.abs(num(f"predicted_{m}") - num(m)) - num(f"{m}_abs_error")) < 1e-9 for m in _BINARY_METRICS]
    both = [num(f"predicted_{m}").isNotNull() for m in _BINARY_METRICS]
    out = rows.select(
        "dataset_name", "split", "model_name", *[num(m).alias(m) for m in _BINARY_METRICS],
        F.forall(F.array(*both), lambda x: x).alias("has_predictions"), F.forall(F.array(*fit), lambda x: x).alias("errors_fit"),
    )
    return rounded(out, 6)


@register(" UNION ALL ".join(f"SELECT '{m}' AS metric, true AS val_fits, true AS test_fits" for m in _BINARY_METRICS))
def track_mean_errors(spark, folder):
    """The mean errors that the run wrote are those of the predictions that it wrote."""
    home = _ran(spark, folder)
    rows = _splits(spark, f"{home}/predicted_scores")
    long = rows.select("split", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_abs_error").cast("double").alias("e")) for m in _BINARY_METRICS
    ])).alias("x")).groupBy(F.col("x.metric").alias("metric")).agg(
        F.avg(F.when(F.col("split") == "val", F.col("x.e"))).alias("val"), F.avg(F.when(F.col("split") == "test", F.col("x.e"))).alias("test")
    )
    written = spark.read.option("header", True).option("inferSchema", True).csv(f"{home}/mean_errors")
    close = lambda a, b: F.abs(F.col(a) - F.col(b).cast("double")) < 1e-9
    return written.join(long, "metric").select(
        "metric", close("val", "mean_abs_error_val").alias("val_fits"), close("test", "mean_abs_error_test").alias("test_fits")
    )


@register(f"""
    WITH {_BINARY_SQL}
    SELECT 'metric' AS kind, count(*) * 3 + 2 * 3 AS n FROM meta
    UNION ALL SELECT 'model', count(DISTINCT dataset_name || model_name) + 3 FROM meta
    UNION ALL SELECT 'param', 3 UNION ALL SELECT 'artifact', 3 + 2 + 3 UNION ALL SELECT 'run', 2""")
def track_log(spark, folder):
    """Entries of the run's log by kind: every score and error, every saved model, the chosen settings and the files."""
    return spark.read.parquet(f"{_ran(spark, folder)}/run_log").groupBy("kind").agg(F.count("*").alias("n"))


_LEARNERS = (
    "Logistic Regression", "Random Forest", "Decision Tree", "K-Nearest Neighbors", "Bagging Classifier",
    "Stacking Classifier", "Voting Classifier", "XGBoost", "Naive Bayes",
)


@register(f"""
    WITH {cells_sql('doc_quality')}, test AS (SELECT count(DISTINCT row_id) AS n FROM cells WHERE split = 'test')
    SELECT unnest({list(_LEARNERS)}) AS model_name, n AS n_rows, n AS n_equal FROM test""")
def model_roundtrip(spark, folder):
    """Every learner of the task, saved, loaded and asked again. Small ones will do: it is the files that are tried."""
    rows = shared_prepared(spark, folder, "doc_quality")
    train = rows.filter("split = 'train'").select("row_id", "features", "label")
    held = rows.filter("split = 'test'").select("row_id", "features", "label")
    home, out = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}", None
    for name, learner in roster(BINARY, depth=4, trees=5, rounds=5).items():
        path = f"{home}/{name.replace(' ', '-')}"
        model = learner.fit(train)
        model.save(path)
        again = load_model(spark, path).predict(held).select("row_id", F.col("prediction").alias("_again"))
        both = model.predict(held).join(again, "row_id")
        part = both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction") == F.col("_again")).alias("n_equal"))
        part = part.select(F.lit(name).alias("model_name"), "n_rows", "n_equal")
        out = part if out is None else out.unionByName(part)
    return out
