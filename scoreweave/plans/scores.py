"""Fit learners on training rows, predict the held-out ones, and score all of it in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.learners.base import Learner, Model
from scoreweave.operators.metrics import evaluate
from scoreweave.session import cut_lineage


@dataclass
class Fitted:
    """Models by (dataset, learner), their predictions, and the learners that failed."""

    models: dict[tuple[str, str], Model] = field(default_factory=dict)
    predictions: list[DataFrame] = field(default_factory=list)
    failures: dict[tuple[str, str], str] = field(default_factory=dict)

    def status(self, spark) -> DataFrame:
        rows = [(d, m, "ok", "") for d, m in self.models] + [
            (d, m, "failed", why) for (d, m), why in self.failures.items()
        ]
        return spark.createDataFrame(rows, "dataset_name string, model_name string, status string, reason string")


def fit_and_predict(
    table: DataFrame, dataset: str, learners: dict[str, Learner], into: Fitted | None = None
) -> Fitted:
    """Train every learner on the train rows of one dataset; predict its val and test rows.

    A learner that fails is noted and skipped, the others go on.
    """
    into = into if into is not None else Fitted()
    rows = table.filter(F.col("dataset_name") == dataset)
    train = rows.filter("split = 'train'").select("row_id", "features", "label")
    held_out = rows.filter("split <> 'train'").select("split", "row_id", "features", "label")
    for name, learner in learners.items():
        try:
            model = learner.fit(train)
            scored = model.predict(held_out)
            keep = [c for c in ("split", "row_id", "label", "prediction", "probability") if c in scored.columns]
            into.predictions.append(
                cut_lineage(
                    scored.select(F.lit(dataset).alias("dataset_name"), F.lit(name).alias("model_name"), *keep)
                )
            )
            into.models[(dataset, name)] = model
        except Exception as err:  # one learner must not stop the others
            into.failures[(dataset, name)] = f"{type(err).__name__}: {err}"
    return into


def performance(fitted: Fitted, task: str) -> DataFrame:
    """Scores per (dataset, model, split) of every learner that trained."""
    if not fitted.predictions:
        raise ValueError("no learner trained")
    out = fitted.predictions[0]
    for part in fitted.predictions[1:]:
        out = out.unionByName(part)
    return evaluate(out, task)
