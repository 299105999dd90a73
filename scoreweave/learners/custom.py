"""Learners MLlib does not have, built from distributed jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions.hashing import fold_of, seeded
from scoreweave.learners.base import (
    Learner,
    Model,
    load_model,
    loads,
    n_classes,
    nodes_expression,
    quantile_cuts,
    save_note,
    tree_nodes,
    with_vector,
)
from scoreweave.operators import knn
from scoreweave.session import cut_lineage

# -- nearest neighbours ----------------------------------------------------------


class NearestModel:
    def __init__(self, train: DataFrame, k: int, classes: int | None, weights: str, p: int):
        self.train, self.k, self.classes, self.weights, self.p = train, k, classes, weights, p

    def predict(self, rows: DataFrame) -> DataFrame:
        found = knn.knn_join(rows, self.train, self.k, p=self.p)
        if self.classes is None:
            voted = knn.average(found, self.weights)
        else:
            voted = knn.vote(found, self.classes, self.weights)
        return rows.join(voted, rows.row_id == voted.qid).drop("qid")

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/rows")
        save_note(path, {"kind": "nearest", "k": self.k, "classes": self.classes, "weights": self.weights, "p": self.p})


@loads("nearest")
def _load_nearest(spark, path: str, note: dict) -> NearestModel:
    return NearestModel(spark.read.parquet(f"{path}/rows"), note["k"], note["classes"], note["weights"], note["p"])


class NearestNeighbours:
    """Vote (or mean) of the k nearest training rows."""

    def __init__(self, k: int = 5, classifier: bool = True, weights: str = "uniform", p: int = 2):
        self.k, self.classifier, self.weights, self.p = k, classifier, weights, p

    def fit(self, train: DataFrame) -> NearestModel:
        kept = train.select("row_id", "features", "label")
        return NearestModel(kept, self.k, n_classes(train) if self.classifier else None, self.weights, self.p)


# -- voting and stacking ---------------------------------------------------------


class _Joined:
    """Predictions of several models on the same rows, side by side."""

    def __init__(self, models: Sequence[tuple[str, Model]], output: str):
        self.models, self.output = models, output

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows
        for name, model in self.models:
            with_all = model.predict(out)
            dropped = [c for c in ("prediction", "probability") if c in with_all.columns and c != self.output]
            out = with_all.drop(*dropped).withColumnRenamed(self.output, f"{self.output}_{name}")
        return out


class VotingModel:
    def __init__(self, models: Sequence[tuple[str, Model]], classifier: bool):
        self.models, self.classifier = models, classifier

    def predict(self, rows: DataFrame) -> DataFrame:
        output = "probability" if self.classifier else "prediction"
        out = _Joined(self.models, output).predict(rows)
        given = [F.col(f"{output}_{name}") for name, _ in self.models]
        share = F.lit(float(len(given)))
        if not self.classifier:
            total = given[0]
            for g in given[1:]:
                total = total + g
            return out.select(*rows.columns, (total / share).alias("prediction"))
        total = given[0]
        for g in given[1:]:
            total = F.zip_with(total, g, lambda a, b: a + b)
        mean = F.transform(total, lambda v: v / share)
        return out.select(*rows.columns, mean.alias("probability")).withColumn("prediction", _argmax("probability"))

    def save(self, path: str) -> None:
        save_note(path, {"kind": "voting", "parts": _save_parts(path, self.models), "classifier": self.classifier})


def _save_parts(path: str, models: Sequence[tuple[str, Model]]) -> list[str]:
    for at, (_, model) in enumerate(models):
        model.save(f"{path}/part-{at}")
    return [name for name, _ in models]


def _load_parts(spark, path: str, names: Sequence[str]) -> list[tuple[str, Model]]:
    return [(name, load_model(spark, f"{path}/part-{at}")) for at, name in enumerate(names)]


@loads("voting")
def _load_voting(spark, path: str, note: dict) -> VotingModel:
    return VotingModel(_load_parts(spark, path, note["parts"]), note["classifier"])


@loads("stacking")
def _load_stacking(spark, path: str, note: dict) -> StackingModel:
    final = load_model(spark, f"{path}/final")
    return StackingModel(_load_parts(spark, path, note["parts"]), final, note["classifier"], note["classes"])


def _argmax(array: str) -> Column:
    return (F.array_position(array, F.array_max(array)) - 1).cast("double")


class Voting:
    """Mean of class probabilities, or of predictions for regression."""

    def __init__(self, learners: Sequence[tuple[str, Learner]], classifier: bool):
        self.learners, self.classifier = learners, classifier

    def fit(self, train: DataFrame) -> VotingModel:
        return VotingModel([(name, learner.fit(train)) for name, learner in self.learners], self.classifier)


class StackingModel:
    def __init__(self, models, final: Model, classifier: bool, classes: int | None):
        self.models, self.final, self.classifier, self.classes = models, final, classifier, classes

    def predict(self, rows: DataFrame) -> DataFrame:
        inputs = _stack_inputs(self.models, rows, self.classifier, self.classes)
        scored = self.final.predict(inputs.withColumn("_own", F.col("features")).withColumn("features", F.col("_stacked")))
        extra = ["prediction", "probability"] if self.classifier else ["prediction"]
        return scored.withColumn("features", F.col("_own")).select(*rows.columns, *extra)

    def save(self, path: str) -> None:
        self.final.save(f"{path}/final")
        parts = _save_parts(path, self.models)
        save_note(path, {"kind": "stacking", "parts": parts, "classifier": self.classifier, "classes": self.classes})


def _stack_inputs(models, rows: DataFrame, classifier: bool, classes: int | None) -> DataFrame:
    """Add ``_stacked``: class probabilities (of class 1 only for two classes) or predictions."""
    output = "probability" if classifier else "prediction"
    out = _Joined(models, output).predict(rows)
    if classifier:
        first = 1 if classes == 2 else 0
        blocks = [F.slice(f"{output}_{name}", first + 1, classes - first) for name, _ in models]
        stacked = F.concat(*blocks)
    else:
        stacked = F.array(*[F.col(f"{output}_{name}") for name, _ in models])
    return out.select(*rows.columns, stacked.alias("_stacked"))


class Stacking:
    """Base learners' out-of-fold outputs feed a final linear learner; bases are refit on all rows."""

    def __init__(self, learners, final: Learner, classifier: bool, folds: int = 5, seed: int = 42):
        self.learners, self.final, self.classifier = learners, final, classifier
        self.folds, self.seed = folds, seed

    def fit(self, train: DataFrame) -> StackingModel:
        classes = n_classes(train) if self.classifier else None
        folded = train.withColumn("_fold", fold_of(F.col("row_id"), self.seed, self.folds))
        held_out = None
        for fold in range(self.folds):
            inner = folded.filter(F.col("_fold") != fold).drop("_fold")
            models = [(name, learner.fit(inner)) for name, learner in self.learners]
            part = _stack_inputs(models, folded.filter(F.col("_fold") == fold).drop("_fold"), self.classifier, classes)
            part = part.select("row_id", "label", F.col("_stacked").alias("features"))
            held_out = part if held_out is None else held_out.unionByName(part)
        final = self.final.fit(cut_lineage(held_out))
        return StackingModel([(name, learner.fit(train)) for name, learner in self.learners], final, self.classifier, classes)


# -- boosting by reweighting -------------------------------------------------------

CUT_EVERY = 10


class BoostedStumps:
    """Weighted vote of stumps (feature, cut, class at or below it, class above it, weight); all are one column expression."""

    def __init__(self, stumps: list[tuple[int, float, float, float, float]], classes: int):
        self.stumps, self.classes = stumps, classes

    def predict(self, rows: DataFrame) -> DataFrame:
        total = sum(alpha for *_, alpha in self.stumps)
        side = lambda f, cut, low, high: F.when(F.get("features", F.lit(f)) <= F.lit(cut), F.lit(low)).otherwise(F.lit(high))
        votes = F.array(*[F.struct(side(*stump).alias("c"), F.lit(alpha).alias("a")) for *stump, alpha in self.stumps])
        out = rows.withColumn("_votes", votes)
        # Centred votes: a stump gives alpha to its class and -alpha/(K-1) to the others.
        k = self.classes
        decision = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda c: F.aggregate(
                "_votes",
                F.lit(0.0),
                lambda s, v: s + F.when(v["c"] == c, v["a"]).otherwise(-v["a"] / float(k - 1)),
            ) / F.lit(total),
        )
        powered = F.transform("_decision", lambda d: F.exp(d / float(k - 1)))
        out = out.withColumn("_decision", decision).withColumn("_powered", powered)
        scale = F.aggregate("_powered", F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn("probability", F.transform("_powered", lambda v: v / scale))
        return out.withColumn("prediction", _argmax("_decision")).select(*rows.columns, "prediction", "probability")

    def save(self, path: str) -> None:
        save_note(path, {"kind": "stumps", "stumps": self.stumps, "classes": self.classes})


@loads("stumps")
def _load_stumps(spark, path: str, note: dict) -> BoostedStumps:
    return BoostedStumps([tuple(s) for s in note["stumps"]], note["classes"])


class AdaBoostClassifier:
    """Multi-class exponential boosting of depth-1 trees (SAMME, Hastie et al. 2009).

    The rows are binned and written once; a round is one job that adds up the
    rows' weights per feature, bin and class. Weights follow from the stumps so
    far, so nothing is written between rounds, and the best stump and its error
    both follow from the sums.
    """

    def __init__(self, rounds: int = 50, rate: float = 1.0, seed: int = 42):
        self.rounds, self.rate, self.seed = rounds, rate, seed

    def fit(self, train: DataFrame) -> BoostedStumps:
        k = max(2, n_classes(train))
        cuts = quantile_cuts(train)
        bins = max((len(c) for c in cuts), default=0) + 1

        def bin_(batches):
            for pdf in batches:
                x = np.vstack(pdf["features"].to_numpy())
                codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
                yield pd.DataFrame({"codes": list(codes.astype(np.int32)), "label": pdf["label"].astype(int)})

        binned = cut_lineage(train.select("features", "label").mapInPandas(bin_, "codes array<int>, label int"))
        found: list[tuple[int, int, float, float, float]] = []  # as the model's, with the bin instead of the cut
        while len(found) < self.rounds:
            sums = self._sums(binned, found, len(cuts), bins, k)
            if not sums.any():
                raise ValueError("no rows to fit on")
            feature, at, low, high, error = _best_stump(sums)
            if error <= 1e-12:
                found.append((feature, at, low, high, 1.0))
                break
            if error >= 1 - 1 / k:
                break
            found.append((feature, at, low, high, self.rate * (math.log((1 - error) / error) + math.log(k - 1))))
        if not found:
            raise ValueError("the first stump is no better than chance")
        # A stump that sends every row to one side has no threshold.
        cut = lambda f, b: float(cuts[f][b]) if b < len(cuts[f]) else float("inf")
        return BoostedStumps([(f, cut(f, b), low, high, alpha) for f, b, low, high, alpha in found], k)

    @staticmethod
    def _sums(binned: DataFrame, found: list, features: int, bins: int, k: int) -> np.ndarray:
        """Weight per feature, bin and class; a task ships its non-zero sums."""

        def add(batches):
            total = np.zeros(features * bins * k)
            for pdf in batches:
                codes, y = np.vstack(pdf["codes"].to_numpy()), pdf["label"].to_numpy()
                weight = np.ones(len(y))
                for f, b, low, high, alpha in found:
                    weight *= np.where(np.where(codes[:, f] <= b, low, high) != y, math.exp(alpha), 1.0)
                cell = (np.arange(features) * bins + codes) * k + y[:, None]
                total += np.bincount(cell.ravel(), np.repeat(weight, features), len(total))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"cell": at, "w": total[at]})

        parts = binned.mapInPandas(add, "cell bigint, w double").groupBy("cell").agg(F.sum("w").alias("w")).toPandas()
        out = np.zeros(features * bins * k)
        out[parts["cell"].to_numpy(int)] = parts["w"].to_numpy(float)
        return out.reshape(features, bins, k)


def _best_stump(sums: np.ndarray) -> tuple[int, int, float, float, float]:
    """(feature, bin, class at or below, class above, error) of the stump with the least weighted Gini impurity."""
    below = sums.cumsum(axis=1)
    whole = below[:, -1:, :]
    above = whole - below
    left, right = below.sum(axis=2), above.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = np.where(left > 0, (below**2).sum(axis=2) / left, 0.0) + np.where(right > 1e-12 * left, (above**2).sum(axis=2) / right, 0.0)
    f, b = divmod(int(pure.argmax()), sums.shape[1])
    low = int(below[f, b].argmax())
    high = int(above[f, b].argmax()) if right[f, b] > 1e-12 * left[f, b] else low
    return f, b, float(low), float(high), float(1 - (below[f, b, low] + above[f, b, high]) / whole[f].sum())


class BoostedTrees:
    """Weighted median of the predictions of trees, given as their preorder nodes."""

    def __init__(self, trees: list[tuple[list[dict], float]]):
        self.trees = trees

    def save(self, path: str) -> None:
        save_note(path, {"kind": "median", "trees": self.trees})

    def predict(self, rows: DataFrame) -> DataFrame:
        half = sum(w for _, w in self.trees) / 2
        pairs = F.array_sort(F.array(*[F.struct(nodes_expression(t).alias("y"), F.lit(w).alias("w")) for t, w in self.trees]))
        state = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("y"))
        median = F.aggregate(
            pairs,
            state,
            lambda s, z: F.struct(
                (s["seen"] + z["w"]).alias("seen"),
                F.when(s["y"].isNotNull(), s["y"]).when(s["seen"] + z["w"] >= half, z["y"]).alias("y"),
            ),
            lambda s: s["y"],
        )
        return rows.withColumn("prediction", median)


@loads("median")
def _load_median(spark, path: str, note: dict) -> BoostedTrees:
    return BoostedTrees([(nodes, weight) for nodes, weight in note["trees"]])


class AdaBoostRegressor:
    """Boosting of depth-3 trees by relative loss (AdaBoost.R2, Drucker 1997), with row weights."""

    def __init__(self, rounds: int = 50, rate: float = 1.0, loss: str = "linear", seed: int = 42):
        if loss not in ("linear", "square", "exponential"):
            raise ValueError(f"unknown loss {loss!r}")
        self.rounds, self.rate, self.loss, self.seed = rounds, rate, loss, seed

    def fit(self, train: DataFrame) -> BoostedTrees:
        n = train.count()
        data = cut_lineage(train.select("row_id", "features", "label").withColumn("weight", F.lit(1.0 / n)))
        trees: list[tuple[list[dict], float]] = []
        for step in range(self.rounds):
            tree = DecisionTreeRegressor(
                featuresCol="vector", labelCol="label", weightCol="weight", maxDepth=3, seed=self.seed + step
            ).fit(with_vector(data))
            nodes = tree_nodes(tree)
            guess = nodes_expression(nodes)
            gap = F.abs(guess - F.col("label"))
            worst = data.agg(F.max(gap).alias("m")).first()["m"]
            if worst == 0:
                trees.append((nodes, 1.0))
                break
            share = gap / F.lit(worst)
            loss = {"linear": share, "square": share * share, "exponential": 1 - F.exp(-share)}[self.loss]
            error = data.agg((F.sum(loss * F.col("weight")) / F.sum("weight")).alias("e")).first()["e"]
            if error <= 0:
                trees.append((nodes, 1.0))
                break
            if error >= 0.5:
                if not trees:
                    trees.append((nodes, 1.0))
                break
            beta = error / (1 - error)
            trees.append((nodes, self.rate * math.log(1 / beta)))
            data = data.withColumn("weight", F.col("weight") * F.pow(F.lit(beta), (1 - loss) * self.rate))
            if (step + 1) % CUT_EVERY == 0:
                data = cut_lineage(data)
        return BoostedTrees(trees)


# -- support vector regression -----------------------------------------------------


def _fourier(width: int, gamma: float, features: int, seed: int):
    """Random cosine features whose inner products approach an RBF kernel (Rahimi, Recht 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(features, width))
    b = rng.uniform(0, 2 * math.pi, size=width)
    return lambda x: math.sqrt(2.0 / width) * np.cos(x @ w + b)


def _landmark_map(kernel: str, gamma: float, degree: int, marks: list[list[float]]):
    """Features whose inner products are the kernel's, exact between the landmark rows and close to it elsewhere (Nystroem).

    The kernel between landmarks is inverted on its positive part; a sigmoid
    kernel need not be positive, and what is not has no such features.
    """
    points = np.array(marks, float)

    def value(x: np.ndarray) -> np.ndarray:
        dots = gamma * (x @ points.T)
        return np.tanh(dots) if kernel == "sigmoid" else dots**degree

    own = value(points)
    sizes, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = sizes > 1e-10 * max(float(sizes.max(initial=0.0)), 1e-300)
    root = vectors[:, kept] / np.sqrt(sizes[kept])

    return lambda x: value(x) @ root


def _landmarked(*settings):
    """The same as a column function."""
    lift = _landmark_map(*settings)

    @F.pandas_udf("array<double>")
    def lifted(x: pd.Series) -> pd.Series:
        return pd.Series(list(lift(np.vstack(x.to_numpy()))))

    return lifted


def _lifting(lifted: tuple | None):
    """The feature map of a kernel with the settings in ``lifted``, from rows to rows; the linear one keeps them."""
    if lifted is None:
        return lambda x: x
    kind, *settings = lifted
    return _fourier(*settings) if kind == "rbf" else _landmark_map(kind, *settings)


class SvrModel:
    """A linear model on the features, or on what the kernel's map with the settings in ``lifted`` makes of them."""

    def __init__(self, lifted: tuple | None, coefficients: Sequence[float], intercept: float):
        self.lifted, self.coefficients, self.intercept = lifted, np.array(coefficients, float), float(intercept)

    def save(self, path: str) -> None:
        save_note(path, {"kind": "svr", "lifted": self.lifted, "coefficients": list(self.coefficients), "intercept": self.intercept})

    def predict(self, rows: DataFrame) -> DataFrame:
        lift, coefficients, intercept = _lifting(self.lifted), self.coefficients, self.intercept

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            return pd.Series(lift(np.vstack(x.to_numpy())) @ coefficients + intercept if len(x) else [], dtype=float)

        return rows.withColumn("prediction", guess("features"))


@loads("svr")
def _load_svr(spark, path: str, note: dict) -> SvrModel:
    lifted = tuple(note["lifted"]) if note["lifted"] else None
    if "coefficients" not in note:  # saved when the linear model was one of MLlib
        model = LinearRegressionModel.load(f"{path}/model")
        return SvrModel(lifted, model.coefficients.toArray(), model.intercept)
    return SvrModel(lifted, note["coefficients"], note["intercept"])


#: Rows lifted at a time.
LIFT_BLOCK = 4096


def _penalised(sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from the weighted sums of products of (features, 1, target).

    The penalty of a fit is 1 / (sum of weights), in units of the target's
    deviation, as MLlib's normal solver takes it. A feature without spread
    gets no coefficient.
    """
    total = sums[-2, -2]
    mean = sums / total
    x, t = mean[:-2, -2], mean[-2, -1]
    spread = math.sqrt(max(mean[-1, -1] - t * t, 0.0))
    out = np.zeros(len(x))
    if spread == 0:
        return out, float(t)
    cov, with_target = mean[:-2, :-2] - np.outer(x, x), mean[:-2, -1] - x * t
    varied = np.flatnonzero(np.diag(cov) > 0)
    lifted = cov[np.ix_(varied, varied)] + np.eye(len(varied)) / (total * spread)
    out[varied] = np.linalg.solve(lifted, with_target[varied])
    return out, float(t - x @ out)


class SupportVectorRegressor:
    """Epsilon-insensitive regression; kernels through explicit features.

    The RBF kernel takes random cosine features, the polynomial and the sigmoid
    one the kernel values with ``width`` landmark rows, chosen by a hash of
    their ids. Fitted by reweighted least squares: rows outside the tube pull
    with the weight that makes the quadratic touch the absolute loss at the
    current error, rows inside do not pull. Each round is one pass over the
    rows that lifts them, finds their errors and adds up the products the next
    fit follows from; lifted rows are not kept. Rounds end once predictions
    move by less than ``tolerance`` of the label's deviation on average, or
    after ``rounds``.
    """

    def __init__(
        self, c: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf", gamma: str | float = "scale",
        degree: int = 3, width: int = 128, rounds: int = 30, tolerance: float = 1e-3, seed: int = 42,
    ):
        if kernel not in ("rbf", "linear", "poly", "sigmoid"):
            raise ValueError(f"unknown kernel {kernel!r}")
        self.c, self.epsilon, self.kernel, self.gamma, self.degree = c, epsilon, kernel, gamma, degree
        self.width, self.rounds, self.tolerance, self.seed = width, rounds, tolerance, seed

    def _gamma(self, train: DataFrame, d: int) -> float:
        if self.gamma == "auto":
            return 1.0 / d
        if self.gamma == "scale":
            spread = train.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()[0]
            return 1.0 / (d * spread) if spread else 1.0
        return float(self.gamma)

    def _lifted(self, train: DataFrame) -> tuple | None:
        if self.kernel == "linear":
            return None
        d = train.select(F.size("features")).first()[0]
        gamma = self._gamma(train, d)
        if self.kernel == "rbf":
            return ("rbf", self.width, gamma, d, self.seed)
        # At most `width` rows reach the driver.
        marks = train.select("features").orderBy(seeded(F.col("row_id"), self.seed), "row_id").limit(self.width).collect()
        return (self.kernel, gamma, self.degree, [list(r[0]) for r in marks])

    def fit(self, train: DataFrame) -> SvrModel:
        lifted = self._lifted(train)
        base = cut_lineage(train.select("features", "label"))
        spread = base.agg(F.stddev_pop("label")).first()[0] or 1.0
        model, before = None, None
        for _ in range(self.rounds):
            sums, gap = self._sums(base, lifted, model, before, 1e-3 * spread)
            if before is not None and gap < self.tolerance * spread:
                break
            if sums is None:
                break  # every row is inside the tube
            before, model = model, _penalised(sums)
        if model is None:
            raise ValueError("no rows to fit on")
        return SvrModel(lifted, *model)

    def _sums(self, base: DataFrame, lifted: tuple | None, model: tuple | None, before: tuple | None, floor: float):
        """Weighted sums of products of (features, 1, target) under ``model``, none if no row pulls; and how far it is from the one before."""
        lift, c, epsilon = _lifting(lifted), self.c, self.epsilon

        def add(batches):
            total, moved, rows = None, 0.0, 0
            for batch in batches:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float)
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                x = x.reshape(len(y), -1) if len(y) else np.zeros((0, 0))
                for start in range(0, len(y), LIFT_BLOCK):
                    z, label = lift(x[start : start + LIFT_BLOCK]), y[start : start + LIFT_BLOCK]
                    weight, target = np.full(len(label), c), label
                    if model is not None:
                        guess = z @ model[0] + model[1]
                        error = label - guess
                        excess = np.abs(error) - epsilon
                        weight = np.where(excess > 0, c / np.maximum(excess, floor), 0.0)
                        target = label - np.sign(error) * epsilon
                        if before is not None:
                            moved += float(np.abs(guess - (z @ before[0] + before[1])).sum())
                    wide = np.column_stack([z, np.ones(len(label)), target])
                    part = (wide * weight[:, None]).T @ wide
                    total = part if total is None else total + part
                    rows += len(label)
            if rows:
                cells = np.concatenate([total.ravel(), [moved, rows]])
                yield pa.RecordBatch.from_pydict({"cell": np.arange(len(cells)), "w": cells})

        parts = base.mapInArrow(add, "cell bigint, w double").groupBy("cell").agg(F.sum("w").alias("w")).toPandas()
        if parts.empty:
            return None, math.inf
        # As large as the model squared.
        cells = parts.sort_values("cell")["w"].to_numpy(float)
        if not np.isfinite(cells).all():
            raise ValueError("features and labels must be finite")
        width = math.isqrt(len(cells) - 2)
        sums = cells[:-2].reshape(width, width)
        return (sums if sums[-2, -2] > 0 else None), cells[-2] / cells[-1]


class Unfittable:
    """Stands in for a learner that cannot be trained; fitting raises."""

    def fit(self, train: DataFrame) -> Model:
        raise ValueError("not trainable")
