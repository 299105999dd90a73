"""Learners beat the trivial guess, failures stay isolated, and searches pick the best setting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.learners.base import load_model
from scoreweave.learners.custom import Unfittable
from scoreweave.learners.roster import roster
from scoreweave.plans import meta
from scoreweave.plans.scores import fit_and_predict, performance
from scoreweave.sources import registry
from scoreweave.sources.sinks import RunLog

SPLITS = ["train", "train", "train", "val", "test"]


def _table(matrix, task):
    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=(n, 3))
    if task == "regression":
        y = 3 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n)
    elif task == "binary":
        y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    else:
        y = np.digitize(x[:, 0], [-0.5, 0.5]).astype(float)
    return matrix(x, y, task, splits=[SPLITS[i % 5] for i in range(n)]).cache()


@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_learners_beat_the_trivial_guess(spark, matrix, task):
    learners = roster(task, depth=5, trees=10, rounds=10, boosts=5)
    learners = {k: v for k, v in learners.items() if not k.startswith("Stacking") or task == "binary"}
    learners["Broken"] = Unfittable()
    fitted = fit_and_predict(_table(matrix, task), "d", learners)
    assert [k for k in fitted.failures] == [("d", "Broken")]
    scores = performance(fitted, task).collect()
    assert len(scores) == 2 * (len(learners) - 1)
    for row in scores:
        value = row["r2"] if task == "regression" else row["accuracy"]
        assert value > (0.3 if task == "regression" else 0.6), row


def test_search_space_draw_and_unknown_family():
    space = meta.spaces("binary")["xgb"]
    drawn = meta.draw(space, 50)
    assert len({str(d) for d in drawn}) == 50 and drawn == meta.draw(space, 50)
    assert len(meta.draw({"a": [1, 2], "b": [3]}, 50)) == 2
    with pytest.raises(ValueError):
        meta.candidate("unknown", {})


def test_search_skips_settings_that_cannot_be_fitted(spark, matrix):
    rows = _table(matrix, "regression").filter("split = 'train'").select("row_id", "features", "label")
    found = meta.search(rows, rows, "ada", {"n_estimators": [3], "loss": ["linear", "unknown"]}, n_iter=4, folds=2)
    assert found.params["loss"] == "linear" and found.cv_error < 2.0 and found.test_error < 2.0
    assert found.trials.filter("reason <> ''").count() == 2


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly", "sigmoid"])
def test_kernels(spark, matrix, kernel):
    """Each kernel fits what it can express; with all rows as landmarks the features give the kernel itself."""
    from scoreweave.learners.custom import SupportVectorRegressor, _landmarked

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = {"linear": 2 * x[:, 0], "rbf": np.sin(2 * x[:, 0]), "poly": x[:, 0] ** 3 - x[:, 0] * x[:, 1] ** 2, "sigmoid": np.tanh(x[:, 0] - x[:, 1])}[kernel]
    rows = matrix(x, y, "regression")
    model = SupportVectorRegressor(100.0, 0.05, kernel, 0.5).fit(rows)
    error = model.predict(rows).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error < 0.35 * np.abs(y - np.median(y)).mean(), error
    if kernel == "poly":
        lift = _landmarked("poly", 0.5, 2, x[:20].tolist())
        z = np.array([r[0] for r in matrix(x[:20], y[:20], "regression").select(lift("features")).collect()])
        order = [int(r[0]) for r in matrix(x[:20], y[:20], "regression").select("row_id").collect()]
        assert np.allclose(z @ z.T, (0.5 * x[order] @ x[order].T) ** 2, atol=1e-6)


def test_support_vectors_take_one_pass_a_round(spark, matrix):
    """Reweighted least squares in plain numpy gives the same model, and a round starts one job that meets the rows."""
    from scoreweave.learners.custom import SupportVectorRegressor

    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(200, 2)), np.ones(200)])
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=200)
    rows = matrix(x, y, "regression").cache()
    sc = spark.sparkContext
    sc.setJobGroup("svr", "svr")
    model = SupportVectorRegressor(0.5, 0.1, "linear", rounds=6, tolerance=0.0).fit(rows)
    jobs = sc.statusTracker().getJobIdsForGroup("svr")
    sc.setLocalProperty("spark.jobGroup.id", None)
    # A round that is exchanged adaptively has a job for each of its two stages.
    assert len(jobs) <= 2 * 6 + 4, jobs
    weight, target, fit = np.full(200, 0.5), y, np.zeros(3)
    for _ in range(6):
        keep = x[:, :2]
        mean, at = np.average(keep, 0, weight), np.average(target, 0, weight)
        spread = np.sqrt(np.average((target - at) ** 2, 0, weight))
        cov = (keep - mean).T @ ((keep - mean) * weight[:, None]) / weight.sum()
        slope = np.linalg.solve(cov + np.eye(2) / (weight.sum() * spread), (keep - mean).T @ (weight * (target - at)) / weight.sum())
        fit = keep @ slope + at - mean @ slope
        excess = np.abs(y - fit) - 0.1
        weight = np.where(excess > 0, 0.5 / np.maximum(excess, 1e-3 * y.std()), 0.0)
        target = y - np.sign(y - fit) * 0.1
    got = {int(r["row_id"]): r["prediction"] for r in model.predict(rows).collect()}
    assert np.allclose([got[i] for i in range(200)], fit, atol=1e-8)


def test_model_round_trip_and_run_log(spark, matrix, tmp_path):
    table = _table(matrix, "binary")
    train, held = table.filter("split = 'train'"), table.filter("split = 'test'")
    model = roster("binary", depth=3)["Decision Tree"].fit(train)
    log = RunLog(spark, str(tmp_path / "log"))
    log.start_run()
    assert log.log_model(model, "tree", str(tmp_path))
    assert not log.log_model(object(), "odd", str(tmp_path))
    log.log_metric("m", 0.5)
    log.end_run()
    kinds = {r["kind"]: r["count"] for r in log.read().groupBy("kind").count().collect()}
    assert kinds == {"run": 2, "model": 1, "error": 1, "metric": 1}
    again = load_model(spark, str(tmp_path / "tree"))
    pick = lambda m: sorted((r["row_id"], r["prediction"]) for r in m.predict(held).collect())
    assert pick(model) == pick(again)


def test_nothing_loads(spark):
    broken = registry.Spec("x", "binary", lambda s, d: s.read.parquet(d + "/absent"), "y")
    with pytest.raises(registry.NoDatasets):
        registry.open_all(spark, "/nowhere", [broken])


def test_tree_grows_past_five_levels(spark, matrix):
    from scoreweave.learners.landmarks import tree_shape

    x = [[float(i % 24), 0.0] for i in range(240)]
    shape = tree_shape(matrix(x, [i % 24 % 2 for i in range(240)])).first()
    assert (shape["leaves"], shape["nodes"]) == (24, 23) and abs(shape["leaves_corrob_mean"] - 1 / 24) < 1e-9


def _mllib_shape(spark, rows, depth, seed=42):
    from pyspark.ml.classification import DecisionTreeClassifier

    from scoreweave.learners.base import saved_nodes, with_vector

    model = DecisionTreeClassifier(featuresCol="vector", labelCol="label", maxDepth=depth, seed=seed).fit(with_vector(rows))
    nodes = saved_nodes(spark, model)
    return sorted(zip(nodes["depth"], nodes["leaf"], nodes["prediction"], nodes["feature"], nodes["n_rows"], strict=True)), model.featureImportances.toArray()


@pytest.mark.parametrize(("codes", "depth", "classes"), [(1 << 20, 30, 3), (64, 30, 2), (64, 4, 3), (1, 30, 2), (64, 0, 2)])
def test_deep_tree_is_mllibs(spark, matrix, monkeypatch, codes, depth, classes):
    """Split over all tasks, within one, or both: the same nodes, also with ties, copies and a constant feature."""
    from scoreweave.learners import deep

    monkeypatch.setattr(deep, "TASK_CODES", codes)
    rng = np.random.default_rng(depth + classes)
    x = np.stack([np.round(rng.normal(size=260), 2), rng.integers(0, 3, 260), np.zeros(260), np.round(rng.normal(size=260), 1)], axis=1)
    rows = matrix(x.tolist(), rng.integers(0, classes, 260).tolist()).repartition(3)
    got = [tuple(r) for r in deep.tree_nodes(rows, depth)[0].select("depth", "leaf", "prediction", "feature", "n_rows", "gain").collect()]
    want, importance = _mllib_shape(spark, rows, depth)
    assert sorted(r[:5] for r in got) == want
    weights = np.zeros(4)
    for r in got:
        if not r[1]:
            weights[r[3]] += r[5] * r[4]
    assert np.allclose(weights / (weights.sum() or 1.0), importance)


@pytest.mark.parametrize("n", [12_000, 40_000])
def test_deep_tree_takes_the_same_thresholds_of_many_rows(spark, n):
    from scoreweave.learners import deep

    rows = spark.range(n).repartition(3).selectExpr(
        "array(CAST(xxhash64(id) % 9973 AS DOUBLE) / 7, CAST(id % 3 AS DOUBLE), CAST(xxhash64(id, 1) % 40 AS DOUBLE)) AS features",
        "CAST(xxhash64(id) % 9973 / 7 + xxhash64(id, 2) % 900 > 0 AS DOUBLE) AS label",
    )
    got = [tuple(r) for r in deep.tree_nodes(rows, 7)[0].select("depth", "leaf", "prediction", "feature", "n_rows").collect()]
    assert sorted(got) == _mllib_shape(spark, rows, 7)[0] and len(got) > 30


def test_deep_tree_takes_no_job_per_level(spark, matrix):
    """Levels of small nodes are grown within tasks: a tree of many levels runs no more jobs than one of a single split."""
    from scoreweave.learners.landmarks import tree_shape

    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    jobs, depth = {}, {}
    for name, y in (("flat", x[:, 0] > np.median(x[:, 0])), ("deep", noise)):
        spark.sparkContext.setJobGroup(name, name)
        depth[name] = tree_shape(matrix(x.tolist(), [int(v) for v in y])).first()["leaves_branch_mean"]
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert depth["deep"] > depth["flat"] + 4 and jobs["deep"] <= jobs["flat"] + 2


def test_deep_tree_refuses_what_it_cannot_learn_from(spark, matrix):
    from scoreweave.learners.deep import checked

    fine = matrix([[0.0], [1.0]], [0, 1])
    for label in ("CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)", "-1.0D", "0.5D", "1e9D"):
        with pytest.raises(ValueError):
            checked(fine.selectExpr("features", f"IF(row_id = '1', {label}, label) AS label"))
    for features in ("array(CAST(NULL AS DOUBLE))", "array(CAST('NaN' AS DOUBLE))", "array(0.0D, 1.0D)", "CAST(NULL AS array<double>)"):
        with pytest.raises(ValueError):
            checked(fine.selectExpr("label", f"IF(row_id = '1', {features}, features) AS features"))
    with pytest.raises(ValueError):
        checked(fine.limit(0))


def _landmark_rows(spark, seed, n, classes, name):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + y[:, None] * [1.0, 0.4, 0.0], 2)
    rows = [(name, f"{i}", [float(v) for v in z], float(t)) for i, (z, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "dataset_name string, row_id string, features array<double>, label double")


def test_landmarks_equal_plain_cross_validation(spark, monkeypatch):
    """Every fold is fitted on the other folds, whichever statistics it came from, for two tables at once."""
    from scoreweave.functions.hashing import fold_of
    from scoreweave.learners import landmarks as module
    from scoreweave.operators import knn

    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 16)  # several cells
    tables = {n: _landmark_rows(spark, s, 150, k, n) for n, s, k in (("two", 1, 2), ("three", 2, 3))}
    both = tables["two"][2].unionByName(tables["three"][2]).repartition(5)
    got = {(r["dataset_name"], r["landmark"], r["fold"]): r["accuracy"] for r in module.landmarks(both, folds=4).collect()}
    assert len(got) == 2 * len(module.LANDMARKS) * 4
    for name, (x, y, df) in tables.items():
        fold = np.array([r[0] for r in sorted(df.select(fold_of(F.col("row_id"), 42, 4), F.col("row_id").cast("int")).collect(), key=lambda r: r[1])])
        order = module.ranked_features(df)
        for f in range(4):
            a, b = fold != f, fold == f
            labels = np.unique(y[a])
            means = [x[a & (y == c)].mean(0) for c in labels]
            within = sum((x[a & (y == c)] - m).T @ (x[a & (y == c)] - m) for c, m in zip(labels, means, strict=True))
            inverse = np.linalg.pinv(within / (a.sum() - len(labels)))
            line = np.array([x[b] @ inverse @ m - 0.5 * m @ inverse @ m + np.log((y[a] == c).mean()) for c, m in zip(labels, means, strict=True)])
            assert np.isclose(got[name, "linear_discr", f], (labels[line.argmax(0)] == y[b]).mean())
            spread = [x[a & (y == c)].var(0) + 1e-9 * x[a].var(0).max() for c in labels]
            bell = np.array([np.log((y[a] == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (x[b] - m) ** 2 / v).sum(1) for c, m, v in zip(labels, means, spread, strict=True)])
            assert np.isclose(got[name, "naive_bayes", f], (labels[bell.argmax(0)] == y[b]).mean())
            for landmark, z in (("one_nn", x), ("elite_nn", x[:, [order[0]]])):
                d = np.round(((z[b][:, None] - z[a][None]) ** 2).sum(2), 10)
                ids = np.flatnonzero(a).astype(str)
                near = [min(range(a.sum()), key=lambda k, row=row: (row[k], ids[k])) for row in d]
                assert np.isclose(got[name, landmark, f], (y[a][near] == y[b]).mean()), (name, landmark, f)
            best = [_plain_stump(x[a][:, k], y[a], len(x)) for k in range(3)]
            top = max(range(3), key=lambda k: (best[k][0], -k))
            for landmark, k in (("best_node", top), ("worst_node", order[-1]), ("random_node", order[42 % 3])):
                assert abs(got[name, landmark, f] - (best[k][1](x[b][:, k]) == y[b]).mean()) <= 0.2, (name, landmark)


def _plain_stump(v, y, n):
    """Gini gain and prediction of the best threshold among all values; the operator tries quantiles only."""
    found = (-np.inf, None)
    whole = np.bincount(y)
    for cut in np.unique(v)[:-1]:
        low, high = np.bincount(y[v <= cut], minlength=len(whole)), np.bincount(y[v > cut], minlength=len(whole))
        gain = (low**2).sum() / low.sum() + (high**2).sum() / high.sum()
        if gain > found[0]:
            found = (gain, lambda z, cut=cut, low=low, high=high: np.where(z <= cut, low.argmax(), high.argmax()))
    return found


def test_stumps_by_subtraction(spark):
    """On few values the thresholds are all of them, so gain, threshold and classes are those of a plain search."""
    from scoreweave.learners.landmarks import fold_stumps

    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(120, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(120) < 0.2)).astype(int)
    rows = [("t", i % 3, [float(v) for v in z], float(t)) for i, (z, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "dataset_name string, _fold int, features array<double>, label double").repartition(3)
    fold = np.arange(120) % 3
    found = {(r["_fold"], r["feature"]): r for r in fold_stumps(df).collect()}
    assert len(found) == 6
    for (f, k), r in found.items():
        a = fold != f
        gain, predict = _plain_stump(x[a, k], y[a], 120)
        assert np.isclose(r["gain"], (gain - (np.bincount(y[a]) ** 2).sum() / a.sum()) / a.sum())
        z = np.arange(6.0)
        assert (np.where(z <= r["cut"], r["low"], r["high"]) == predict(z)).all()


def test_registered_landmarks_and_searches_are_the_whole_job(spark):
    """Real rows: ten folds of every classification dataset; the search with its own budget and the full record."""
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["px_landmarks"](spark, folder).collect()
    assert {r["dataset_name"] for r in rows} == {s.name for s in registry.ALL if s.task != "regression"}
    assert len(rows) == 5 * 7 and all(0 <= r["accuracy_mean"] <= 1 for r in rows)
    trials = __spark_entry__.queries()["meta_search"](spark, folder).collect()
    assert {t["candidate"] for t in trials} == set(range(50)) and len(trials) == 50 * len({t["fold"] for t in trials})


@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_every_model_survives_saving(spark, matrix, tmp_path, task):
    table = _table(matrix, task)
    train, held = table.filter("split = 'train'"), table.filter("split = 'test'")
    for at, (name, learner) in enumerate(roster(task, depth=3, trees=3, rounds=3, boosts=3).items()):
        model = learner.fit(train)
        model.save(f"{tmp_path}/{at}")
        again = load_model(spark, f"{tmp_path}/{at}")
        pick = lambda m: sorted((r["row_id"], r["prediction"]) for r in m.predict(held).collect())
        assert pick(model) == pick(again), name


def test_adaboost_equals_plain_rounds(spark, matrix):
    from scoreweave.learners.custom import AdaBoostClassifier

    rng = np.random.default_rng(8)
    x = rng.integers(0, 8, size=(200, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 7).astype(int) + (x[:, 2] > 5).astype(int)
    model = AdaBoostClassifier(12).fit(matrix(x, y, "multiclass"))
    w, total = np.ones(200), np.zeros((200, 3))
    for feature, cut, low, high, alpha in model.stumps:
        best = np.inf
        for f in range(3):
            for c in np.unique(x[:, f])[:-1]:
                sides = [np.bincount(y[m], w[m], 3) for m in (x[:, f] <= c, x[:, f] > c)]
                best = min(best, w.sum() - sum((s**2).sum() / s.sum() for s in sides))
        guess = np.where(x[:, feature] <= cut, low, high)
        own = [np.bincount(y[m], w[m], 3) for m in (x[:, feature] <= cut, x[:, feature] > cut)]
        assert np.isclose(w.sum() - sum((s**2).sum() / s.sum() for s in own if s.sum()), best)
        error = w[guess != y].sum() / w.sum()
        assert np.isclose(alpha, np.log((1 - error) / error) + np.log(2))
        w = w * np.where(guess != y, np.exp(alpha), 1.0)
        total += np.where(np.arange(3) == guess[:, None], alpha, -alpha / 2)
    got = {r["row_id"]: r["prediction"] for r in model.predict(matrix(x, y, "multiclass")).collect()}
    assert all(got[str(i)] == total[i].argmax() for i in range(200))


def test_meta_dataset_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    names = [(f"d{i}", split, model) for i in range(3) for split in ("val", "test") for model in ("A", "B")]
    columns = "dataset_name string, split string, model_name string, accuracy double, f1_score double, auc_roc double, n_samples double"
    rows = spark.createDataFrame([(*n, 0.5, 0.1 * i, None if i == 3 else 0.7, float(i)) for i, n in enumerate(names)], columns)
    ready = meta.meta_prepare(rows.mapInArrow(each, columns), "binary")
    got = {tuple(r["row_id"].split("|")): r for r in ready.rows.collect()}
    assert sorted(got) == sorted(names) and seen.value == len(names)
    assert {len(r["features"]) for r in got.values()} == {3} and {r["auc_roc_target"] for r in got.values()} == {0.7}
