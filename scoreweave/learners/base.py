"""A common shape for learners: ``fit(train)`` gives a model with ``predict(rows)``.

Training rows have row_id, features (array), label and optionally weight.
Predicting adds ``prediction`` and, for classifiers, ``probability`` (array).
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.session import ensure_checkpoint_dir


class Model(Protocol):
    def predict(self, rows: DataFrame) -> DataFrame: ...


class Learner(Protocol):
    def fit(self, train: DataFrame) -> Model: ...


def with_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", array_to_vector(F.col("features")))


class SparkModel:
    """A fitted MLlib model."""

    def __init__(self, model, classifier: bool):
        self.model, self.classifier = model, classifier

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(with_vector(rows))
        extra = [F.col("prediction")]
        if self.classifier:
            extra.append(vector_to_array("probability").alias("probability"))
        return out.select(*rows.columns, *extra)

    def save(self, path: str) -> None:
        kind = type(self.model)
        self.model.write().overwrite().save(f"{path}/model")
        save_note(path, {"kind": "mllib", "class": f"{kind.__module__}.{kind.__name__}", "classifier": self.classifier})


# -- saved models ------------------------------------------------------------------
#
# A model is a folder with a note of its kind and settings; models it is made of
# are folders within it.

Loader = Callable[[SparkSession, str, dict], Model]
_LOADERS: dict[str, Loader] = {}


def loads(kind: str):
    """Register the function that reads models of a kind: (spark, path, note) to the model."""

    def keep(fn: Loader) -> Loader:
        _LOADERS[kind] = fn
        return fn

    return keep


def rows_session() -> SparkSession:
    return SparkSession.getActiveSession()


def save_note(path: str, note: dict) -> None:
    spark = rows_session()
    spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def load_model(spark: SparkSession, path: str) -> Model:
    """Any saved model, with the models it is made of."""
    from scoreweave.learners import batched, custom  # noqa: F401  they register their kinds

    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    return _LOADERS[note["kind"]](spark, path, note)


@loads("mllib")
def _load_mllib(spark: SparkSession, path: str, note: dict) -> SparkModel:
    module, name = note["class"].rsplit(".", 1)
    return SparkModel(getattr(importlib.import_module(module), name).load(f"{path}/model"), note["classifier"])


class SparkLearner:
    """An MLlib estimator; ``weighting`` is None, ``"balanced"`` or ``"positive"``."""

    def __init__(self, estimator, classifier: bool, weighting: str | None = None):
        self.estimator, self.classifier, self.weighting = estimator, classifier, weighting

    def fit(self, train: DataFrame) -> SparkModel:
        data, estimator = with_vector(train), self.estimator.copy()
        estimator.setFeaturesCol("vector").setLabelCol("label")
        if self.weighting:
            data = data.withColumn("weight", class_weight(train, self.weighting))
            estimator.setWeightCol("weight")
        return SparkModel(estimator.fit(data), self.classifier)


class RidgeLogistic:
    """Logistic regression whose L2 penalty is ``1 / (C n)`` per row, as ``C`` is usually defined."""

    def __init__(self, estimator, c: float = 1.0, weighting: str | None = None):
        self.estimator, self.c, self.weighting = estimator, c, weighting

    def fit(self, train: DataFrame) -> SparkModel:
        penalised = self.estimator.copy()
        penalised.setRegParam(1.0 / (self.c * train.count())).setElasticNetParam(0.0).setStandardization(False)
        return SparkLearner(penalised, True, self.weighting).fit(train)


def class_sizes(train: DataFrame) -> dict[float, int]:
    """Rows per class: one entry per class, so it fits the driver."""
    return {row["label"]: row["count"] for row in train.groupBy("label").count().collect()}


def class_weight(train: DataFrame, how: str) -> Column:
    """Row weight by class: balanced ``n / (k n_c)``, or neg/pos on the positives."""
    sizes = class_sizes(train)
    if how == "balanced":
        n, k = sum(sizes.values()), len(sizes)
        weights = {c: n / (k * size) for c, size in sizes.items()}
    else:
        pos = sizes.get(1.0, 0)
        weights = {1.0: sizes.get(0.0, 0) / pos if pos else 1.0}
    pairs = [F.lit(v) for c, w in weights.items() for v in (float(c), float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("label")), F.lit(1.0))


def n_classes(train: DataFrame) -> int:
    return int(train.agg(F.max("label")).first()[0]) + 1


def quantile_cuts(rows: DataFrame, cuts: int = 31) -> list[np.ndarray]:
    """Up to ``cuts`` ascending thresholds per feature, a value <= the first going lowest; as wide as the table, so it fits the driver."""
    marks = [(k + 1) / (cuts + 1) for k in range(cuts)]
    cells = rows.select(F.posexplode("features").alias("feature", "value"))
    found = cells.groupBy("feature").agg(F.percentile_approx("value", marks, 10_000).alias("cuts"), F.max("value").alias("top"))
    return [np.unique([c for c in r["cuts"] if c < r["top"]]) for r in found.orderBy("feature").collect()]


# -- trees as column expressions -------------------------------------------------


def tree_nodes(model) -> list[dict]:
    """Preorder nodes of a fitted tree: depth, feature, threshold, prediction, impurity, rows."""
    out: list[dict] = []

    def visit(node, depth: int, parent: int) -> None:
        at, leaf = len(out), node.subtreeDepth() == 0
        entry = {
            "node": at,
            "parent": parent,
            "depth": depth,
            "leaf": leaf,
            "prediction": float(node.prediction()),
            "impurity": float(node.impurity()),
            "feature": None,
            "threshold": None,
        }
        out.append(entry)
        if not leaf:
            split = node.split()
            entry["feature"], entry["threshold"] = int(split.featureIndex()), float(split.threshold())
            visit(node.leftChild(), depth + 1, at)
            visit(node.rightChild(), depth + 1, at)

    visit(model._call_java("rootNode"), 0, -1)
    return out


def saved_nodes(spark: SparkSession, model) -> pd.DataFrame:
    """Preorder nodes of a fitted tree with the rows each was grown on, read from the saved model instead of node by node."""
    path = f"{ensure_checkpoint_dir(spark)}/trees/{uuid.uuid4().hex}"
    model.save(path)
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", F.col("split.featureIndex").alias("feature"), F.col("rawCount").alias("n_rows")
    )
    # As large as the model, which the driver holds already.
    nodes = saved.toPandas().sort_values("node", ignore_index=True)
    depth = np.zeros(len(nodes), np.int64)
    for at, left, right in zip(nodes["node"], nodes["left"], nodes["right"], strict=True):
        if left >= 0:
            depth[left] = depth[right] = depth[at] + 1
    return nodes.assign(depth=depth, leaf=nodes["left"] < 0).drop(columns=["left", "right"])


def tree_expression(model, features: str = "features", leaf_value=None) -> Column:
    """The tree as nested conditions on the feature array; stays inside code generation.

    ``leaf_value`` maps a leaf node to its column, by default its prediction.
    """
    return nodes_expression(tree_nodes(model), features, leaf_value)


def nodes_expression(nodes: list[dict], features: str = "features", leaf_value=None) -> Column:
    """The same from the preorder nodes of a tree."""
    value = leaf_value or (lambda node: F.lit(node["prediction"]))
    children: dict[int, list[int]] = {}
    for node in nodes:
        children.setdefault(node["parent"], []).append(node["node"])

    def build(at: int) -> Column:
        node = nodes[at]
        if node["leaf"]:
            return value(node)
        left, right = children[at]
        goes_left = F.get(features, F.lit(node["feature"])) <= F.lit(node["threshold"])
        return F.when(goes_left, build(left)).otherwise(build(right))

    return build(0)
