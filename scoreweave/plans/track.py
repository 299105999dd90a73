"""One task end to end: profile, score, learn to predict the scores, report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from scoreweave.learners.roster import roster
from scoreweave.plans import meta, reports
from scoreweave.plans.prepare import Matrices, prepared_table
from scoreweave.plans.record import full_record
from scoreweave.plans.scores import Fitted, fit_and_predict, performance
from scoreweave.session import cut_lineage
from scoreweave.sources.registry import REGRESSION, Spec, load_all, track
from scoreweave.sources.sinks import RunLog, write_table


def run_track(
    spark: SparkSession,
    folder: str,
    task: str,
    out: str,
    specs: Iterable[Spec] | None = None,
    learners: dict | None = None,
    family: str = "xgb",
    n_iter: int | None = None,
    folds: int | None = None,
    space: dict | None = None,
    fit_on: str = "train",
) -> dict[str, DataFrame]:
    """Run a task on its registered datasets and write every table under ``out``."""
    metrics = meta.METRICS[task]
    log = RunLog(spark, f"{out}/run_log")
    log.start_run()
    matrices = Matrices(load_all(spark, folder, specs or track(task)))
    table = prepared_table(matrices, fit_on=fit_on)

    profiles = cut_lineage(full_record(table))
    fitted = Fitted()
    for name in matrices.specs:
        fit_and_predict(table, name, learners or roster(task), fitted)
    for (dataset, model), trained in fitted.models.items():
        log.log_model(trained, f"learner={dataset}.{model}".replace(" ", "-"), f"{out}/models")
    scores = cut_lineage(performance(fitted, task))
    log.log_metrics_table(scores, ("dataset_name", "model_name", "split"), metrics)

    joined = cut_lineage(meta.meta_dataset(profiles, scores, unscored=True))
    for split in ("train", "val", "test"):
        log.log_artifact(write_table(joined.filter(f"split = '{split}'"), f"{out}/joined_scores/{split}", "csv"))

    ready = meta.meta_prepare(joined, task)
    if task == REGRESSION:
        log.log_artifact(write_table(ready.scalers, f"{out}/scalers"))
    models = meta.train_meta_models(ready, task, family, n_iter, folds, space)
    for metric, found in models.items():
        if found.model is None:
            continue
        log.log_metric(f"{metric}.{family}.cv_error", found.cv_error)
        log.log_metric(f"{metric}.{family}.test_error", found.test_error)
        log.log_param(f"{metric}.{family}.chosen", found.params)
        log.log_model(found.model, f"predictor={metric}.{family}", f"{out}/models")

    predicted = cut_lineage(meta.predict_scores(ready, models, task))
    for split in ("val", "test"):
        part = reports.with_abs_errors(predicted, metrics).filter(f"split = '{split}'")
        log.log_artifact(write_table(part, f"{out}/predicted_scores/{split}", "csv"))
    compared = cut_lineage(reports.comparison(predicted, metrics))
    summary = reports.mae_summary(predicted, metrics)
    log.log_artifact(write_table(compared, f"{out}/comparison"))
    log.log_artifact(write_table(reports.comparison_long(compared), f"{out}/comparison_long"))
    log.log_artifact(write_table(summary, f"{out}/mean_errors", "csv"))
    log.end_run()
    return {
        "status": fitted.status(spark),
        "profiles": profiles,
        "scores": scores,
        "meta_dataset": joined,
        "predictions": predicted,
        "comparison": compared,
        "summary": summary,
        "run_log": log.read(),
    }
