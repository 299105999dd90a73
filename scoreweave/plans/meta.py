"""The meta-dataset and the models that predict scores from it."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.hashing import fold_of
from scoreweave.functions.scalar import nan_to_null
from scoreweave.learners.base import Learner, Model
from scoreweave.learners.batched import Run, Setting, TreeLearner, fit_trees, trial_errors
from scoreweave.learners.custom import AdaBoostRegressor, NearestNeighbours, SupportVectorRegressor
from scoreweave.operators.encoding import column_levels, indicator
from scoreweave.operators.scaling import centred, restored
from scoreweave.session import cut_lineage, measured
from scoreweave.sources.registry import BINARY, MULTICLASS, REGRESSION

METRICS = {
    BINARY: ("accuracy", "f1_score", "auc_roc"),
    MULTICLASS: ("accuracy", "precision", "recall", "f1_score", "auc_roc"),
    REGRESSION: ("mae", "mse", "rmse", "r2"),
}
KEYS = ("dataset_name", "split")


def meta_dataset(meta_features: DataFrame, scores: DataFrame, unscored: bool = False) -> DataFrame:
    """Meta-features of a (dataset, split) beside the scores of each model that trained on it.

    With ``unscored``, splits without scores stay too, as training rows do: a
    row per model of the dataset, its scores null. Preparing carries them along,
    and neither the search nor the predictions use them.
    """
    if not unscored:
        return scores.join(meta_features, list(KEYS), "inner")
    models = scores.select("dataset_name", "model_name").distinct()
    return meta_features.join(models, "dataset_name").join(scores, [*KEYS, "model_name"], "left").select(
        *scores.columns, *[c for c in meta_features.columns if c not in KEYS]
    )


def feature_columns(meta: DataFrame, task: str) -> list[str]:
    return [c for c in meta.columns if c not in (*KEYS, "model_name", *METRICS[task])]


@dataclass
class Prepared:
    rows: DataFrame  # dataset_name, model_name, split, row_id, features, metrics, <metric>_target
    scalers: DataFrame  # metric, mean, std


def meta_prepare(meta: DataFrame, task: str) -> Prepared:
    """Model-ready rows: scaled meta-features, then 0/1 columns for the model names.

    Scaling and the list of model names come from the validation split and are
    applied to both; a model seen in test only gets no column. Missing values
    are 0 after scaling. A missing AUC target takes its split's mean, and
    regression targets are standardised with the validation statistics.
    """
    metrics = METRICS[task]
    columns = feature_columns(meta, task)
    # Written once: the levels, the statistics and the rows read it, and what it is made from passes over all rows.
    clean = measured(
        meta.select(*KEYS, "model_name", *metrics, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    )
    fit = clean.filter("split = 'val'")
    names = column_levels(fit, ["model_name"])["model_name"]
    # One row of statistics: as wide as the meta-features, collected as plain numbers.
    moments = fit.agg(
        *[F.avg(c).alias(f"{c}__m") for c in (*columns, *metrics)],
        *[F.stddev_pop(c).alias(f"{c}__s") for c in (*columns, *metrics)],
    ).first()
    number = lambda v: F.lit(v).cast("double")
    scaled = [
        F.coalesce(centred(F.col(c), number(moments[f"{c}__m"]), number(moments[f"{c}__s"])), F.lit(0.0))
        for c in columns
    ]
    dummies = [indicator("model_name", name).cast("double") for name in names]
    if "auc_roc" in metrics:
        usual = clean.groupBy("split").agg(F.avg(nan_to_null(F.col("auc_roc"))).alias("_usual"))
        clean = clean.join(usual, "split")
    targets = []
    for metric in metrics:
        value = F.col(metric)
        if metric == "auc_roc":
            value = F.coalesce(nan_to_null(value), F.col("_usual"))
        if task == REGRESSION:
            value = centred(value, number(moments[f"{metric}__m"]), number(moments[f"{metric}__s"]))
        targets.append(value.alias(f"{metric}_target"))
    rows = clean.select(
        *KEYS,
        "model_name",
        F.concat_ws("|", *KEYS, "model_name").alias("row_id"),
        F.array(*scaled, *dummies).alias("features"),
        *metrics,
        *targets,
    )
    spark = meta.sparkSession
    scalers = spark.createDataFrame(
        [(m, moments[f"{m}__m"], moments[f"{m}__s"]) for m in metrics], "metric string, mean double, std double"
    )
    return Prepared(rows, scalers)


# -- search spaces -------------------------------------------------------------

# Candidate settings per meta-model family.
WIDE_SPACES: dict[str, dict[str, list]] = {
    "xgb": {
        "n_estimators": [100, 200, 300, 400, 500],
        "max_depth": [3, 5, 7, 9, 11, 13, 15, 17],
        "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
    },
    "rf": {
        "n_estimators": [100, 200, 300, 400, 500],
        "max_depth": [None, 10, 20, 30, 40, 50],
        "max_features": ["auto", "sqrt", "log2"],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "bootstrap": [True, False],
    },
    "lgbm": {
        "n_estimators": [100, 200, 300, 400, 500],
        "num_leaves": [31, 50, 100, 150],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
        "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
        "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
        "min_split_gain": [0, 0.1, 0.2, 0.3],
    },
    "svr": {
        "C": [0.1, 1, 10, 100],
        "gamma": ["scale", "auto", 0.001, 0.01, 0.1],
        "kernel": ["linear", "rbf", "poly", "sigmoid"],
        "epsilon": [0.1, 0.2, 0.5, 1],
    },
    "knn": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"], "p": [1, 2]},
    "ada": {
        "n_estimators": [50, 100, 200, 300],
        "learning_rate": [0.01, 0.05, 0.1, 0.2],
        "loss": ["linear", "square", "exponential"],
    },
}
# The smaller settings of the multiclass task.
NARROW_SPACES: dict[str, dict[str, list]] = {
    "xgb": {
        "n_estimators": [100, 300, 500],
        "max_depth": [5, 7, 9],
        "subsample": [0.8, 1.0],
        "learning_rate": [0.05, 0.1],
    },
    "rf": {
        "n_estimators": [100, 300, 500],
        "max_depth": [None, 10, 20],
        "max_features": ["auto", "sqrt"],
        "min_samples_split": [2, 5],
        "min_samples_leaf": [1, 2],
        "bootstrap": [True, False],
    },
    "svr": {"C": [1, 10], "gamma": ["scale", "auto", 0.01], "kernel": ["linear", "rbf"], "epsilon": [0.1, 0.5]},
}
# Candidates tried, folds and seed.
SEARCH = {BINARY: (50, 5), MULTICLASS: (20, 3), REGRESSION: (50, 5)}
SEARCH_SEED = 41


def spaces(task: str) -> dict[str, dict[str, list]]:
    return NARROW_SPACES if task == MULTICLASS else WIDE_SPACES


#: Families whose trials are all fitted in one job.
TREE_FAMILIES = ("xgb", "rf", "lgbm")


def tree_setting(family: str, params: dict) -> tuple[Setting, int]:
    """How the trees of one setting grow, and how many there are."""
    p = dict(params)
    rounds = p.pop("n_estimators", 100)
    if family == "xgb":
        return Setting(p.get("learning_rate", 0.3), p.get("max_depth", 6), subsample=p.get("subsample", 1.0)), rounds
    if family == "lgbm":
        # This family grows the best leaf first, holds 20 rows in a leaf and has no penalty unless told otherwise.
        return Setting(
            p.get("learning_rate", 0.1), None, p.get("num_leaves", 31), p.get("subsample", 1.0),
            p.get("colsample_bytree", 1.0), float(p.get("min_split_gain", 0.0)), min_leaf=20, l2=0.0,
        ), rounds
    tried = p.get("max_features", "auto")
    return Setting(
        1.0, p.get("max_depth"), min_leaf=p.get("min_samples_leaf", 1), min_split=p.get("min_samples_split", 2), l2=0.0,
        forest=True, bootstrap=p.get("bootstrap", True), node_columns="all" if tried == "auto" else tried,
    ), rounds


def candidate(family: str, params: dict) -> Learner:
    """The learner for one setting."""
    p = dict(params)
    if family in TREE_FAMILIES:
        return TreeLearner(*tree_setting(family, p))
    if family == "svr":
        return SupportVectorRegressor(
            p.get("C", 1.0), p.get("epsilon", 0.1), p.get("kernel", "rbf"), p.get("gamma", "scale"), p.get("degree", 3)
        )
    if family == "knn":
        return NearestNeighbours(p.get("n_neighbors", 5), False, p.get("weights", "uniform"), p.get("p", 2))
    if family == "ada":
        return AdaBoostRegressor(p.get("n_estimators", 50), p.get("learning_rate", 1.0), p.get("loss", "linear"))
    raise ValueError(f"unsupported meta-model family {family!r}")


def draw(space: dict[str, list], n: int, seed: int = SEARCH_SEED) -> list[dict]:
    """``n`` different settings at random, or all of them if there are no more."""
    names = list(space)
    total = 1
    for values in space.values():
        total *= len(values)
    if total <= n:
        return [dict(zip(names, combo, strict=True)) for combo in itertools.product(*space.values())]
    rng = random.Random(seed)
    picked = []
    for at in rng.sample(range(total), n):
        setting = {}
        for name in names:
            at, i = divmod(at, len(space[name]))
            setting[name] = space[name][i]
        picked.append(setting)
    return picked


@dataclass
class Searched:
    model: Model | None
    params: dict | None
    cv_error: float | None  # mean over folds of the best setting's MAE
    test_error: float | None
    trials: DataFrame  # family, candidate, params, fold, mae, reason


def _mae(model: Model, rows: DataFrame) -> float:
    return model.predict(rows).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]


def search(
    train: DataFrame,
    test: DataFrame | None,
    family: str,
    space: dict[str, list],
    n_iter: int = 50,
    folds: int = 5,
    seed: int = SEARCH_SEED,
    parallelism: int = 4,
) -> Searched:
    """Randomised search by cross-validated MAE, then a fit of the winner on all rows.

    Trees of all (setting, fold) trials grow together in one job; of other
    families every trial is its own set of Spark jobs, ``parallelism`` of them
    in flight at once. A setting that cannot be fitted is a trial without a
    score. ``train`` and ``test`` have row_id, features and label.
    """
    candidate(family, {})  # an unknown family fails here
    if family in TREE_FAMILIES:
        one = lambda df: None if df is None else df.withColumn("targets", F.array(F.col("label").cast("double")))
        return search_trees(one(train), one(test), 1, family, space, n_iter, folds, seed)[0]
    settings = draw(space, n_iter, seed)
    folded = cut_lineage(
        train.select("row_id", "features", "label", fold_of(F.col("row_id"), seed, folds).alias("_fold"))
    )
    present = sorted(row[0] for row in folded.select("_fold").distinct().collect())

    def trial(job):
        at, fold = job
        try:
            model = candidate(family, settings[at]).fit(folded.filter(F.col("_fold") != fold).drop("_fold"))
            return at, fold, _mae(model, folded.filter(F.col("_fold") == fold).drop("_fold")), ""
        except Exception as err:
            return at, fold, None, f"{type(err).__name__}: {err}"

    jobs = [(at, fold) for at in range(len(settings)) for fold in present]
    with ThreadPoolExecutor(parallelism) as pool:
        done = list(pool.map(trial, jobs))
    spark = train.sparkSession
    trials = spark.createDataFrame(
        [(family, at, json.dumps(settings[at]), fold, mae, why) for at, fold, mae, why in done],
        "family string, candidate int, params string, fold int, mae double, reason string",
    )
    best = best_candidate(trials).first()
    if best is None:
        return Searched(None, None, None, None, trials)
    params = json.loads(best["params"])
    model = candidate(family, params).fit(folded.drop("_fold"))
    test_error = _mae(model, test) if test is not None else None
    return Searched(model, params, best["cv_mae"], test_error, trials)


def search_trees(
    train: DataFrame, test: DataFrame | None, n_targets: int, family: str, space: dict[str, list],
    n_iter: int = 50, folds: int = 5, seed: int = SEARCH_SEED,
) -> list[Searched]:
    """The same search of a tree family for several targets at once: one job for all trials, one for the winners.

    Rows have row_id, features and targets, an array of ``n_targets`` values,
    null where a row has none; such a row is left out of that target's trials.
    """
    settings = draw(space, n_iter, seed)
    folded = cut_lineage(train.select("row_id", "features", "targets", fold_of(F.col("row_id"), seed, folds).alias("_fold")))
    present = sorted(row[0] for row in folded.select("_fold").distinct().collect())
    grown: dict[Setting, list[tuple[int, int, str]]] = {}
    for at, params in enumerate(settings):
        setting, rounds = tree_setting(family, params)
        grown.setdefault(setting, []).append((rounds, at, json.dumps(params)))
    runs = [Run(s, tuple(t), target, fold) for target in range(n_targets) for fold in present for s, t in grown.items()]
    if runs:
        errors = cut_lineage(trial_errors(folded, runs))
    else:
        errors = train.sparkSession.createDataFrame([], "target int, candidate int, params string, fold int, mae double")
    # A fold without a row of this target has no error, and says nothing about its settings.
    named = errors.select("target", F.lit(family).alias("family"), "candidate", "params", "fold", nan_to_null(F.col("mae")).alias("mae"))
    trials = [
        named.filter((F.col("target") == target) & F.col("mae").isNotNull()).drop("target").withColumn("reason", F.lit(""))
        for target in range(n_targets)
    ]
    best = [best_candidate(t).first() for t in trials]
    winners = []
    for target, row in enumerate(best):
        if row is not None:
            setting, rounds = tree_setting(family, json.loads(row["params"]))
            winners.append(Run(setting, ((rounds, 0, ""),), target))
    models = fit_trees(folded, winners) if winners else {}
    out = []
    for target, row in enumerate(best):
        if row is None:
            out.append(Searched(None, None, None, None, trials[target]))
            continue
        error = None
        if test is not None:
            labelled = test.withColumn("label", F.get("targets", F.lit(target))).filter("label is not null")
            error = _mae(models[target], labelled)
        out.append(Searched(models[target], json.loads(row["params"]), row["cv_mae"], error, trials[target]))
    return out


def best_candidate(trials: DataFrame) -> DataFrame:
    """The setting with the lowest mean fold error, among those that fitted on every fold."""
    means = trials.groupBy("family", "candidate", "params").agg(
        F.avg("mae").alias("cv_mae"), F.count_if(F.col("mae").isNull()).alias("failed")
    )
    return (
        means.filter("failed = 0")
        .groupBy("family")
        .agg(F.min_by(F.struct("candidate", "params", "cv_mae"), F.struct("cv_mae", "candidate")).alias("best"))
        .select("family", "best.*")
    )


def fit_default(train: DataFrame, family: str = "xgb") -> Model:
    """Fit a family with its default setting, without a search."""
    return candidate(family, {}).fit(train)


def train_meta_models(
    prepared: Prepared, task: str, family: str = "xgb", n_iter: int | None = None, folds: int | None = None,
    space: dict[str, list] | None = None, parallelism: int = 4,
) -> dict[str, Searched]:
    """One searched model per metric, trained on validation rows and measured on test rows."""
    n_iter, folds = n_iter or SEARCH[task][0], folds or SEARCH[task][1]
    space = space or spaces(task)[family]
    rows = cut_lineage(prepared.rows)
    if family in TREE_FAMILIES:
        targets = rows.select("split", "row_id", "features", F.array(*[f"{m}_target" for m in METRICS[task]]).alias("targets"))
        parts = [targets.filter(F.col("split") == s).drop("split") for s in ("val", "test")]
        found = search_trees(*parts, len(METRICS[task]), family, space, n_iter, folds)
        return dict(zip(METRICS[task], found, strict=True))
    out = {}
    for metric in METRICS[task]:
        labelled = rows.filter(F.col(f"{metric}_target").isNotNull()).select(
            "split", "row_id", "features", F.col(f"{metric}_target").alias("label")
        )
        parts = [labelled.filter(F.col("split") == s).drop("split") for s in ("val", "test")]
        out[metric] = search(*parts, family, space, n_iter, folds, parallelism=parallelism)
    return out


def predict_scores(prepared: Prepared, models: dict[str, Searched | None], task: str) -> DataFrame:
    """Add ``predicted_<metric>`` to the val and test rows; 0 where there is no model.

    Predictions of standardised targets are mapped back with the stored scalers.
    """
    out = prepared.rows.filter("split in ('val', 'test')")
    stats = {row["metric"]: row for row in prepared.scalers.collect()} if task == REGRESSION else {}
    for metric in METRICS[task]:
        found = models.get(metric)
        name = f"predicted_{metric}"
        if found is None or found.model is None:
            out = out.withColumn(name, F.lit(0.0))
            continue
        out = found.model.predict(out).withColumnRenamed("prediction", name)
        if metric in stats:
            mean, std = stats[metric]["mean"], stats[metric]["std"]
            out = out.withColumn(name, restored(F.col(name), F.lit(mean), F.lit(std)))
    return out.drop("features", *[f"{m}_target" for m in METRICS[task]])


def with_scores_named_by_split(predictions: DataFrame, metrics: Sequence[str], split: str) -> DataFrame:
    """One split's rows with its metric columns renamed ``<metric>_<split>``."""
    return predictions.filter(F.col("split") == split).withColumnsRenamed({m: f"{m}_{split}" for m in metrics})
