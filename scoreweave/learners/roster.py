"""The learners scored per task, under the names the score tables use."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)

from scoreweave.learners.base import Learner, RidgeLogistic, SparkLearner
from scoreweave.learners.custom import (
    AdaBoostClassifier,
    AdaBoostRegressor,
    NearestNeighbours,
    Stacking,
    SupportVectorRegressor,
    Voting,
)
from scoreweave.sources.registry import BINARY, MULTICLASS, REGRESSION

DEEPEST = 30  # the deepest tree MLlib grows
SEED = 42


def _logistic(rounds: int = 200, weighting: str | None = "balanced") -> Learner:
    return RidgeLogistic(LogisticRegression(maxIter=rounds), 1.0, weighting)


def _forest(trees: int, depth: int, classifier: bool, weighting: str | None = None) -> Learner:
    kind = RandomForestClassifier if classifier else RandomForestRegressor
    # Classification forests try sqrt(d) features per split, regression ones all of them.
    subset = "sqrt" if classifier else "all"
    est = kind(numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, seed=SEED)
    return SparkLearner(est, classifier, weighting)


def _tree(depth: int, classifier: bool) -> Learner:
    if classifier:
        return SparkLearner(DecisionTreeClassifier(maxDepth=depth, impurity="gini", seed=SEED), True, "balanced")
    return SparkLearner(DecisionTreeRegressor(maxDepth=depth, seed=SEED), False)


def _bagging(depth: int, classifier: bool) -> Learner:
    kind = RandomForestClassifier if classifier else RandomForestRegressor
    est = kind(
        numTrees=10, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, seed=SEED
    )
    return SparkLearner(est, classifier)


def _boosting(rounds: int, classifier: bool) -> Learner:
    kind = GBTClassifier if classifier else GBTRegressor
    est = kind(
        stepSize=0.1, maxIter=rounds, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED
    )
    return SparkLearner(est, classifier, "positive" if classifier else None)


def _naive_bayes() -> Learner:
    return SparkLearner(NaiveBayes(modelType="gaussian"), True)


def roster(task: str, depth: int = DEEPEST, trees: int = 100, rounds: int = 100, boosts: int = 50) -> dict[str, Learner]:
    """Learner name to learner. The defaults are the full-size ones.

    ``depth`` bounds the unlimited trees; ``trees``, ``rounds`` and ``boosts``
    are the forest size, gradient-boosting rounds and reweighting rounds.
    """
    if task == REGRESSION:
        nearest = lambda k: NearestNeighbours(k, classifier=False)
        line = lambda: SparkLearner(LinearRegression(regParam=0.0), False)
        return {
            "Linear Regression": line(),
            "Random Forest Regressor": _forest(trees, depth, False),
            "Decision Tree Regressor": _tree(depth, False),
            "SVR": SupportVectorRegressor(),
            "K-Nearest Neighbors Regressor": nearest(5),
            "XGBoost Regressor": _boosting(rounds, False),
            "AdaBoost Regressor": AdaBoostRegressor(boosts),
            "Bagging Regressor": _bagging(depth, False),
            "Stacking Regressor": Stacking(
                [("rf", _forest(10, depth, False)), ("knn", nearest(3))], line(), classifier=False
            ),
            "Voting Regressor": Voting(
                [("lr", line()), ("rf", _forest(trees, depth, False)), ("knn", nearest(5))], classifier=False
            ),
        }
    nearest = lambda k: NearestNeighbours(k)
    plain = lambda: _logistic(200, None)
    out = {
        "Logistic Regression": _logistic(200 if task == BINARY else 100),
        "Random Forest": _forest(trees, depth, True, "balanced"),
        "Decision Tree": _tree(depth, True),
        "K-Nearest Neighbors": nearest(5),
        "Bagging Classifier": _bagging(depth, True),
        "Stacking Classifier": Stacking(
            [("rf", _forest(10, depth, True)), ("knn", nearest(3))], plain(), classifier=True
        ),
        "Voting Classifier": Voting(
            [("lr", plain()), ("rf", _forest(trees, depth, True)), ("knn", nearest(5))], classifier=True
        ),
    }
    if task == BINARY:
        out["XGBoost"] = _boosting(rounds, True)
        out["Naive Bayes"] = _naive_bayes()
    elif task == MULTICLASS:
        out["AdaBoost Classifier"] = AdaBoostClassifier(boosts)
    else:
        raise ValueError(f"unknown task {task!r}")
    return out
