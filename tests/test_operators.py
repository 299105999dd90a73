"""Invariants and brute-force checks on small fixtures."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreweave.functions.scalar import edge_bin
from scoreweave.operators import bundle, encoding, knn, metrics, mutual_info, profile, sampling, scaling
from scoreweave.operators.cleaning import fill_mode, impute_mean
from scoreweave.operators.order_stats import Point, exact_counted_points, exact_quantiles


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "constant", "one"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=5001),
        "ties": rng.integers(0, 4, 4000).astype(float),
        "heavy": np.concatenate([np.zeros(3000), rng.pareto(0.5, 2000)]),
        "constant": np.full(50, 7.0),
        "one": np.array([4.5]),
    }[kind]
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    ps = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["k"], "v", ps).collect()}
    assert got == pytest.approx(dict(zip(ps, np.quantile(values, ps), strict=True)), rel=1e-12)


@pytest.mark.parametrize("kind", ["spread", "hot", "constant", "one"])
def test_exact_points_of_counted_values(spark, kind):
    """Values with counts give the ranks of the rows they stand for."""
    rng = np.random.default_rng(4)
    values, counts = {
        "spread": (np.unique(rng.normal(size=4000)), rng.integers(1, 5, 4000)),
        "hot": (np.arange(-50.0, 50.0), np.where(np.arange(100) == 50, 9000, 1)),
        "constant": (np.array([7.0]), np.array([40])),
        "one": (np.array([4.5]), np.array([1])),
    }[kind]
    rows = [("a", float(v), int(c)) for v, c in zip(values, counts)] + [("a", None, 3)]
    ps = [0.0, 0.2, 0.25, 0.5, 0.75, 1.0]
    points = [Point(p, p, p * (F.col("_n") - 1)) for p in ps]
    got = {r["point"]: r["value"] for r in exact_counted_points(spark.createDataFrame(rows, "k string, v double, c bigint"), ["k"], "v", "c", points).collect()}
    assert got == pytest.approx(dict(zip(ps, np.quantile(np.repeat(values, counts[: len(values)]), ps), strict=True)), rel=1e-12)


def test_column_measures_read_rows_once(spark):
    rng = np.random.default_rng(6)
    x = np.stack([rng.lognormal(size=900), rng.integers(0, 3, 900).astype(float), np.full(900, 0.1)], axis=1)
    plain = spark.createDataFrame([("d", "train", [float(v) for v in row]) for row in x], "dataset_name string, split string, features array<double>").repartition(5)
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    got = {r["feature"]: r.asDict() for r in bundle.column_measures(plain.mapInPandas(noted, plain.schema)).collect()}
    assert read.value == len(x)
    for f in range(3):
        v, row = x[:, f], got[f]
        assert row["n"] == 900 and row["mean"] == pytest.approx(v.mean()) and row["median"] == pytest.approx(np.median(v))
        assert row["mad"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) and row["t_mean"] == pytest.approx(np.sort(v)[180:720].mean())
    assert got[0]["sd"] == pytest.approx(x[:, 0].std(ddof=1)) and got[0]["g_mean"] == pytest.approx(np.exp(np.log(x[:, 0]).mean()))
    off = x[:, 0] - x[:, 0].mean()
    assert got[0]["skewness"] == pytest.approx((off**3).mean() / off.std() ** 3 * (899 / 900) ** 1.5)
    assert got[0]["kurtosis"] == pytest.approx((off**4).mean() / off.std() ** 4 * (899 / 900) ** 2 - 3)
    assert got[2]["sd"] == 0 and got[2]["mean"] == 0.1 and got[2]["skewness"] is None and got[2]["kurtosis"] is None


def test_record_profiles_a_table_once(spark, monkeypatch):
    """Column profiles, co-moments and binned counts are made once for all parts of the record (co-moments also by class)."""
    from scoreweave.plans.record import full_record

    rng = np.random.default_rng(9)
    rows = [(t, t, s, float(rng.integers(0, 2)) if t == "binary" else float(rng.normal()), [float(v) for v in rng.normal(size=3)]) for t in ("binary", "regression") for s in ("val", "test") for _ in range(40)]
    table = spark.createDataFrame(rows, "dataset_name string, task string, split string, label double, features array<double>")
    made = []
    for name in ("column_profile", "comoments", "binned_counts"):
        monkeypatch.setattr(profile, name, lambda *a, name=name, make=getattr(profile, name), **b: (made.append(name), make(*a, **b))[1])
    out = {(r["dataset_name"], r["split"]): r.asDict() for r in full_record(table).collect()}
    assert sorted(made) == ["binned_counts", "column_profile", "comoments", "comoments"]
    assert len(out) == 4 and all(r["n_samples"] == 40 and r["nr_inst"] == 40 for r in out.values())
    x = np.array([r[4] for r in rows if r[0] == "binary" and r[2] == "val"])
    assert out["binary", "val"]["mad_mean"] == pytest.approx(np.mean(1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)))


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("c"))
    out = sampling.assign_split(df, "row_id", "c")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n_test = math.ceil(0.2 * n)
    n_val = math.ceil(0.25 * (n - n_test))
    assert counts.get("test", 0) == n_test and counts.get("val", 0) == n_val and sum(counts.values()) == n
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sampling.assign_split(df, "row_id", "c").collect()))
    for r in out.filter("split = 'test'").groupBy("c").count().collect():
        assert abs(r["count"] - 0.2 * df.filter(F.col("c") == r["c"]).count()) <= 1 + 1e-9 or n < 5


def test_plain_split_sizes(spark):
    out = sampling.assign_split(spark.range(101).select(F.col("id").cast("string").alias("row_id")), "row_id")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 21, "val": 20, "train": 60}


@pytest.mark.parametrize("p", [1, 2, math.inf])
def test_knn_equals_brute_force(spark, matrix, p):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(900, 4)), np.zeros((500, 4)), rng.integers(0, 3, (800, 4))])
    rows = matrix(x, np.arange(len(x)))
    q, ref = rows.filter("cast(row_id as int) % 5 = 0"), rows.filter("cast(row_id as int) % 5 <> 0")
    got = {}
    for r in knn.knn_join(q, ref, 4, p=p).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    ids = sorted(str(i) for i in range(len(x)) if i % 5)
    at = np.array([int(i) for i in ids])
    for i in range(0, len(x), 5):
        gap = np.abs(x[at] - x[i])
        d = {1: gap.sum(1), 2: (gap**2).sum(1), math.inf: gap.max(1)}[p]
        want = [ids[j] for j in np.argsort(np.round(d, 10), kind="stable")[:4]]
        assert [rid for _, rid in sorted(got[str(i)])] == want


def test_knn_with_fewer_references_than_k(spark, matrix):
    rows = matrix(np.eye(3), [0, 1, 0])
    found = knn.knn_join(rows, rows, 5)
    assert found.count() == 9
    assert {r["prediction"] for r in knn.vote(found, 2).collect()} == {0.0}


def _psi(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def _ross(x, y, k=3):
    terms, kept = [], np.array([(y == c).sum() > 1 for c in y])
    for i in np.flatnonzero(kept):
        same = np.delete(np.abs(x[y == y[i]] - x[i]), np.flatnonzero(np.flatnonzero(y == y[i]) == i))
        kk = min(k, len(same))
        r = np.sort(same)[kk - 1]
        d = np.abs(x[kept] - x[i])
        m = (d < r).sum() if r > 0 else (d == 0).sum()
        terms.append(_psi(kk) - _psi(len(same) + 1) - _psi(m))
    return max(0.0, _psi(kept.sum()) + np.mean(terms))


def test_discrete_mutual_information(spark, matrix):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400).astype(float)
    y[0] = 9
    x = np.stack([rng.integers(0, 500, 400) / 8 + y * 20, rng.integers(0, 4, 400), np.round(rng.normal(size=400) * 64) / 64], 1)
    got = {r["feature"]: r["mi"] for r in mutual_info.discrete_terms(matrix(x, y, "multiclass")).collect()}
    for f in range(3):
        assert got[f] == pytest.approx(_ross(x[:, f], y), abs=1e-8)


def _kraskov(x, y, k=3):
    x, y = (v / (v.std() or 1.0) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    r = np.sort(np.round(np.maximum(dx, dy), 10), axis=1)[:, k]
    inside = lambda d, i: max(1, (d[i] < r[i]).sum() if r[i] > 0 else (d[i] == 0).sum())
    psi = np.mean([_psi(inside(dx, i)) + _psi(inside(dy, i)) for i in range(len(x))])
    return max(0.0, _psi(len(x)) + _psi(k) - psi)


@pytest.mark.parametrize("cell", [16, 8192])
def test_continuous_mutual_information(spark, matrix, monkeypatch, cell):
    """Planes with ties, copies, lines and far points, in many cells and in one."""
    monkeypatch.setattr(mutual_info, "CELL", cell)
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4000, 500) / 64
    y[:40] = 7.25
    y[-1] = 900
    x = np.stack([y + rng.integers(0, 640, 500) / 64, rng.integers(0, 2, 500), np.where(y == 7.25, 1.0, rng.integers(0, 9, 500)), np.ones(500)], 1)
    x[-2, 0] = -700
    got = {r["feature"]: r["mi"] for r in mutual_info.continuous_terms(matrix(x, y, "regression")).collect()}
    for f in range(4):
        assert got[f] == pytest.approx(_kraskov(x[:, f], y), abs=1e-8)


def test_neighbours_in_a_cell_are_met_from_near_to_far():
    rng = np.random.default_rng(1)
    x, y = rng.random(8000), rng.random(8000)
    near, taken = mutual_info._kth_in_cell(x, y, x, y, np.full(8000, np.inf), 4)
    some = rng.integers(0, 8000, 50)
    d = np.sort(np.maximum(np.abs(x - x[some, None]), np.abs(y - y[some, None])), axis=1)[:, :4]
    assert np.array_equal(near[:, some].T, d)
    # All pairs would be 8000 a point.
    assert taken < 400 * 8000


def test_auc_ties_and_single_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.3, 0), ("a", 0.1, 0), ("b", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r["g"]: r["auc_roc"] for r in metrics.binary_auc(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(11 / 12) and got["b"] is None
    turned = metrics.binary_auc(df.withColumn("score", -F.col("score")), ["g"]).filter("g = 'a'").first()
    assert turned["auc_roc"] == pytest.approx(1 - 11 / 12)


def test_f1_without_positives_and_macro_union(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0)], "g string, label int, prediction int")
    row = metrics.accuracy_f1(metrics.confusion(df, ["g"]), ["g"]).first()
    assert (row["accuracy"], row["f1_score"]) == (1.0, 0.0)
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 2)], "g string, label int, prediction int")
    row = metrics.macro_scores(metrics.confusion(df, ["g"]), ["g"]).first()
    assert (row["precision"], row["recall"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_constant_and_single_feature(spark, matrix):
    x = np.array([[1.0, 5.0, 2.0], [2.0, 5.0, 1.0], [4.0, 5.0, 0.0]])
    m = matrix(x, [0, 1, 0])
    prof = profile.column_profile(m)
    row = profile.summarise(prof).first()
    assert (row["avg_skewness"], row["avg_kurtosis"], row["n_zero_variance_features"]) == (0.0, 0.0, 1)
    assert profile.mean_abs_correlation(profile.correlations(profile.comoments(m), prof), prof).first()[2] == 0.0
    single = matrix(x[:, :1], [0, 1, 0])
    prof = profile.column_profile(single)
    found = profile.correlations(profile.comoments(single), prof)
    assert profile.mean_abs_correlation(found, prof).first()[2] == 0.0


def test_comoments_and_pca_far_from_zero(spark, matrix):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 7)) * np.arange(1, 8) + 1e6
    m = matrix(x, np.zeros(500)).repartition(7)
    co = profile.comoments(m)
    c = np.cov(x.T, ddof=0) * 500
    for r in co.collect():
        assert r["c"] == pytest.approx(c[r["i"], r["j"]], rel=1e-3, abs=50)
    values = np.linalg.eigvalsh(c)[::-1]
    assert profile.pca_explained(co).first()[2] == pytest.approx(values[:5].sum() / values.sum(), rel=1e-4)


def test_class_stats_of_two_clouds(spark, matrix):
    rng = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 200)
    x = rng.normal(size=(400, 2)) + np.stack([y * 3, y * 0], 1)
    row = bundle.class_stats(profile.comoments(matrix(x, y), (*profile.KEYS, "label"))).first()
    assert row["gravity"] == pytest.approx(np.linalg.norm(x[y == 0].mean(0) - x[y == 1].mean(0)))
    assert row["w_lambda"] == pytest.approx(1 / (1 + row["lh_trace"])) and row["nr_disc"] == 1


def test_array_scaling_counts_missing_values(spark, matrix):
    m = matrix([[1.0, None], [None, None], [5.0, None]], [0, 1, 0])
    out = sorted(r["features"] for r in scaling.apply_arrays(m, scaling.fit_arrays(m)).collect())
    filled = np.array([1.0, 3.0, 5.0])
    assert np.allclose([v[0] for v in out], (filled - 3) / filled.std()) and all(len(v) == 1 for v in out)


def test_mode_tie_and_all_null_column(spark):
    df = spark.createDataFrame([(1, "b", 1.0, None), (2, "a", None, None), (3, None, 3.0, None)], "i int, s string, v double, z double")
    assert [r["s"] for r in fill_mode(df, ["s"]).orderBy("i").collect()] == ["b", "a", "a"]
    out = impute_mean(df, ["v", "z"])
    assert "z" not in out.columns and out.filter("i = 2").first()["v"] == 2.0


def test_one_hot_null_alignment_and_level_limit(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    right = spark.createDataFrame([(1, "b"), (2, "c")], "i int, s string")
    assert sorted(map(tuple, encoding.one_hot(left, ["s"]).collect())) == [(1, 0), (2, 1), (3, 0)]
    aligned = encoding.one_hot_align(left, right, "s", "m")[1]
    assert aligned.columns == ["i", "m_a", "m_b"] and sorted(map(tuple, aligned.collect())) == [(1, 0, 1), (2, 0, 0)]
    with pytest.raises(encoding.TooManyLevels):
        encoding.column_levels(left, ["s"], limit=1)
    assert encoding.levels({"t": (left, ["s"]), "u": (left.limit(1), ["s"])}, limit=1) == ({"u": {"s": ["a"]}}, {"t": 2})


def test_concentration_counts_rows_where_they_lie(spark, matrix, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (3000, 3)).astype(float)
    x[:, 1] = (x[:, 0] + (rng.random(3000) < 0.2)) % 6
    rows = matrix(x, np.zeros(3000))
    of = profile.column_profile(rows)
    plans = []
    written = bundle.cut_lineage
    monkeypatch.setattr(bundle, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    monkeypatch.setattr(bundle, "measured", lambda df: written(df))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = bundle.feature_concentration(rows, of).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
    taus = []
    for i, j in [(i, j) for i in range(3) for j in range(3) if i != j]:
        table = np.zeros((6, 6))
        np.add.at(table, (x[:, i].astype(int), x[:, j].astype(int)), 1 / 3000)
        base = (table.sum(0) ** 2).sum()
        taus.append(((table**2 / table.sum(1, keepdims=True)).sum() - base) / (1 - base))
    assert np.isclose(got["attr_conc_mean"], np.mean(taus)) and np.isclose(got["attr_conc_sd"], np.std(taus, ddof=1))


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_pairs_are_counted_over_batches(monkeypatch, most):
    monkeypatch.setattr(bundle, "PAIR_BLOCK", 2)
    monkeypatch.setattr(bundle, "PAIR_BYTES", most)
    rng = np.random.default_rng(6)
    bins = {"a": rng.integers(0, 10, (40, 5)), "b": rng.integers(0, 10, (40, 3))}
    batches = [
        pa.RecordBatch.from_pydict({
                "k": ["a", "b"] * 10,
                "features": [list(map(float, bins[k][at + i])) for i in range(10) for k in "ab"],
                **{c: [[v] * bins[k].shape[1] for _ in range(10) for k in "ab"] for c, v in (("low", 0.0), ("high", 10.0))},
            })
        for at in range(0, 40, 10)
    ]
    got = [tuple(r.values()) for out in bundle._pair_counts(["k"])(iter(batches)) for r in out.to_pylist()]
    want = {}
    for k, rows in bins.items():
        for i, j in [(i, j) for i in range(rows.shape[1]) for j in range(rows.shape[1]) if i != j]:
            for x, y in rows[:, [i, j]].tolist():
                want[k, i, j, x, y] = want.get((k, i, j, x, y), 0) + 1
    sums = {}
    for *key, n in got:
        sums[tuple(key)] = sums.get(tuple(key), 0) + n
    assert sums == want and (most == 1 or len(got) == len(want))
    with pytest.raises(ValueError):
        list(bundle._pair_counts(["k"])(iter([pa.RecordBatch.from_pydict({"k": ["a"], "features": [[1.0, None]], "low": [[0.0, 0.0]], "high": [[1.0, 1.0]]})])))


def test_edge_bins_of_columns_are_those_of_rows(spark):
    rng = np.random.default_rng(7)
    low, high = np.array([0.1, -3.0, 5.0, 0.0]), np.array([0.7, 1e9, 5.0, 1.0])
    at = rng.integers(0, 11, (400, 4)) / 10
    x = np.clip(low + at * (high - low) + rng.choice([0.0, 1e-16, -1e-16], (400, 4)), low, high)
    x[0, 3] = np.nan
    got = bundle._edge_bins(x, low, high)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double")
    cut = [edge_bin(F.col(c), F.lit(float(m)), F.lit(float(n))) for c, m, n in zip("abcd", low, high, strict=True)]
    assert [list(r) for r in got] == [list(r) for r in df.orderBy("i").select(*cut).collect()]
