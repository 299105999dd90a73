"""Helpers that keep groups, levels and neighbours out of single tasks, against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreweave.operators import encoding, knn, metrics
from scoreweave.operators.numbering import consecutive
from scoreweave.plans.prepare import Matrices
from scoreweave.session import cut_lineage, dealt
from scoreweave.sources import registry


def test_consecutive_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{rng.integers(0, 9)}" if i % 11 else None, int(rng.integers(0, 50))) for i in range(500)]
    got = consecutive(spark.createDataFrame(rows, "a string, b int").repartition(7), ["a", "b"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(500))
    in_order = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])]
    assert in_order == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert consecutive(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_ranges_split_until_they_are_small(spark):
    # One group far larger than the others, its values piled up near zero.
    rows = [("big", float(np.exp(-i / 400))) for i in range(4000)] + [("small", float(i)) for i in range(40)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = metrics.ranges(df, ["g"], "x", most=7).collect()
    assert sorted((r["g"], r["x"]) for r in got) == sorted(rows)
    parts = {}
    for r in got:
        parts.setdefault((r["g"], r["_range"]), []).append(r["x"])
    assert max(map(len, parts.values())) <= 7 and len(parts) > 4000 / 7
    for (g, low), own in parts.items():
        above = [other for (h, other) in parts if h == g and other > low]
        assert min(own) > low and (not above or max(own) <= min(above))


@pytest.mark.parametrize("most", [5, 100_000])
def test_auc_over_many_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(metrics, "RANGE_ROWS", most)
    rng = np.random.default_rng(3)
    score, y = np.round(rng.normal(size=600), 2), rng.integers(0, 2, 600)
    rows = [("d", "m", "val", float(s), int(t)) for s, t in zip(score, y, strict=True)] + [("d", "n", "val", 1.0, 1)]
    df = spark.createDataFrame(rows, "dataset_name string, model_name string, split string, score double, positive int")
    got = {r["model_name"]: r["auc_roc"] for r in metrics.auc(df).collect()}
    p, q = score[y == 1][:, None], score[y == 0][None]
    assert np.isclose(got["m"], ((p > q) + 0.5 * (p == q)).mean()) and got["n"] is None


def test_sparse_levels(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id", "CAST(id % 3 AS STRING) AS small", "concat('v', lpad(CAST(id AS STRING), 6, '0')) AS wide", "IF(id % 5 = 0, NULL, 'x') AS gap")
    df = df.unionByName(df.limit(1))
    got = encoding.one_hot_sparse(df, ["small", "wide", "gap"]).orderBy("id").collect()
    # small has places 0 and 1, wide 2 to n, and the only level of gap is its first.
    want = sorted([[v for v in (i % 3 - 1, i + 1) if (v >= 0 if v == i % 3 - 1 else i > 0)] for i in [0, *range(n)]])
    assert sorted(list(r["indices"]) for r in got) == want
    other = spark.createDataFrame([(1, "2", "unknown", None)], "id int, small string, wide string, gap string")
    known = encoding.level_dictionary(df, ["small", "wide", "gap"], drop_first=False)
    assert encoding.one_hot_sparse(other, ["small", "wide", "gap"], dictionary=known).first()["indices"] == [2]
    with pytest.raises(encoding.TooManyLevels):
        encoding.column_levels(df, ["wide"])


def test_a_table_with_too_many_levels_does_not_stop_the_others(spark):
    wide = spark.range(12_000).selectExpr("CAST(id AS STRING) AS row_id", "CAST(id AS STRING) AS c", "CAST(id % 2 AS DOUBLE) AS y")
    fine = spark.range(50).selectExpr("CAST(id AS STRING) AS row_id", "CAST(id % 4 AS STRING) AS c", "CAST(id % 2 AS DOUBLE) AS y")
    specs = {n: registry.Spec(n, "binary", lambda s, d: None, "y", categorical=("c",)) for n in ("wide", "fine")}
    loaded = registry.Loaded({n: (specs[n], df) for n, df in (("wide", wide), ("fine", fine))}, {})
    made = Matrices(loaded)
    assert set(made.frames) == {"fine"} and loaded.failures == {"wide": "12000 levels"}
    assert len(made.union().first()["features"]) == 3


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_of_other_groups(spark, monkeypatch, p):
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(p)
    x = np.round(rng.normal(size=(300, 2)), 1)
    x[:100] = x[0]  # a crowd of equal points, all of one group
    g = np.where(np.arange(300) < 100, 0, rng.integers(0, 3, 300))
    rows = [(f"{i:03d}", [float(v) for v in z], int(h)) for i, (z, h) in enumerate(zip(x, g, strict=True))]
    df = spark.createDataFrame(rows, "row_id string, features array<double>, g0 int").repartition(4)
    got = {}
    for r in knn.knn_join(df, df, 2, carry=(), p=p, apart="g0").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    gap = np.abs(x[:, None] - x[None])
    d = np.round(gap.sum(2) if p == 1 else (gap**2).sum(2), 10)
    for i in range(300):
        want = sorted((d[i, j], f"{j:03d}") for j in range(300) if g[j] != g[i])[:2]
        assert [rid for _, rid in sorted(got[f"{i:03d}"])] == [rid for _, rid in want]
    alone = knn.knn_join(df.filter("g0 = 1"), df.filter("g0 = 1"), 1, carry=(), apart="g0")
    assert alone.count() == 0


@pytest.mark.parametrize(("visits", "d"), [(64, 2), (0, 2), (3, 6)])
def test_leaves_of_large_cells(spark, monkeypatch, visits, d):
    """Few pivots, many leaves: equal to brute force whether leaves or whole cells are visited."""
    for name, value in (("ROWS_PER_PIVOT", 200), ("ROWS_PER_LEAF", 12), ("VISITS", visits), ("TILE", 40)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(700, d)), 2)
    x[:60] = x[0]
    rows = [(f"{i:03d}", [float(v) for v in z]) for i, z in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id string, features array<double>").repartition(4)
    got = {}
    for r in knn.knn_join(df, df, 3, carry=()).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    square = np.round(((x[:, None] - x[None]) ** 2).sum(2), 10)
    for i in range(700):
        want = sorted((square[i, j], f"{j:03d}") for j in range(700))[:3]
        assert [rid for _, rid in sorted(got[f"{i:03d}"])] == [rid for _, rid in want]


def test_copies_of_a_query_stay_flat(spark, monkeypatch):
    """In the plane a query visits a few leaves, however many rows there are."""
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 64)
    monkeypatch.setattr(knn, "ROWS_PER_LEAF", 16)
    seen = []
    real = knn._tile_join
    monkeypatch.setattr(knn, "_tile_join", lambda q, *a, **k: (seen.append(q.count()), real(q, *a, **k))[1])
    for n in (2000, 8000):
        df = spark.range(n).selectExpr("CAST(id AS STRING) AS row_id", f"array(double(id * 7919 % {n}) / {n}, double(xxhash64(id) % 1000003) / 1000003) AS features")
        seen.clear()
        knn.knn_join(df, df, 1, carry=()).count()
        assert seen[1] / n < 12, seen


def test_measured_tables_are_broadcast_only_while_small(spark):
    from scoreweave.session import measured

    big = spark.range(1000).withColumnRenamed("id", "k")
    joined = big.join(measured(spark.range(10).withColumnRenamed("id", "k")), "k")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        joined = big.join(measured(spark.range(10).withColumn("pad", F.repeat(F.lit("x"), 500)).withColumnRenamed("id", "k")), "k")
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_datasets_are_prepared_apart(spark, tmp_path):
    """A query that works on one dataset reads and writes that dataset only; splits are those of all datasets together."""
    from scoreweave.catalogue.common import shared_prepared
    from scoreweave.plans.prepare import split_each, split_matrix

    events = spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") * 1.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 7).alias("props"),
        F.when(F.col("id") % 3 == 0, "view").otherwise("error").alias("event_type"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")  # there is no other table in the folder
    rows = shared_prepared(spark, str(tmp_path), "event_value")
    assert rows.filter("dataset_name = 'event_value' and task = 'regression'").count() == 200
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 120, "val": 40, "test": 40}

    both = {
        name: spark.range(90).select(
            F.lit(name).alias("dataset_name"), F.lit(task).alias("task"), F.concat(F.lit(name), "id").alias("row_id"),
            (F.col("id") % 3).cast("double").alias("label"), F.array(F.col("id").cast("double")).alias("features"),
        )
        for name, task in (("a", "multiclass"), ("b", "regression"))
    }
    apart = split_each(both)
    together = split_matrix(both["a"].unionByName(both["b"]))
    assert sorted(apart["a"].unionByName(apart["b"]).collect()) == sorted(together.collect())


def test_rows_are_written_once(spark, tmp_path, monkeypatch):
    """One table a dataset, without ids where none are asked for, is all the preparation writes of its rows; scaling on reading is that of `apply_arrays`."""
    from scoreweave.catalogue import common
    from scoreweave.operators.scaling import apply_arrays, fit_arrays
    from scoreweave.plans import prepare

    value = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 > 0, F.col("id") * 1.5)
    props = F.when(F.col("id") % 5 > 0, F.format_string('{"k": %d}', F.col("id") % 7))
    kind = F.when(F.col("id") % 4 > 0, F.element_at(F.array(F.lit("view"), F.lit("error"), F.lit("signup")), (F.col("id") % 3 + 1).cast("int")))
    events = spark.range(300).select((F.col("id") % 250).alias("event_id"), value.alias("value"), props.alias("props"), kind.alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    written = []

    def noted(df, *more, **how):
        out = cut_lineage(df, *more, **how)
        written.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(prepare, "cut_lineage", noted)
    bare = common.shared_prepared(spark, str(tmp_path), "event_value", ids=False)
    assert [(n, c) for n, c in written if n >= 300] == [(300, ["label", "_f0", "_f1", "split"])]
    assert "row_id" not in bare.columns
    rows = common.shared_split(spark, str(tmp_path), "event_value")
    want = apply_arrays(rows, fit_arrays(rows))
    got = common.shared_prepared(spark, str(tmp_path), "event_value")
    # The order in which tasks' sums are merged may move the last digit.
    near = lambda df: sorted(str([*[r[c] for c in ("split", "label")], [round(v, 9) for v in r["features"]]]) for r in df.collect())
    assert near(bare) == near(got) == near(want)
    assert got.columns == want.columns


def test_rows_of_one_task_are_read_by_several(spark):
    """A learner works on as many cores as there are tasks that read rows, also where a source was a single row group."""
    from scoreweave.plans.prepare import write_each

    rows = spark.range(300_000).coalesce(1).select(
        F.lit("a").alias("dataset_name"), F.lit("binary").alias("task"), F.md5(F.col("id").cast("string")).alias("row_id"), F.rand(3).alias("label"),
    )
    written = write_each({"a": rows}, {"a": "binary"})["a"]
    sizes = written.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 300_000 and max(r["count"] for r in sizes) < 200_000


def test_dealt_rows_stay_in_several_tasks(spark):
    """Adaptive execution merges small shuffles by their bytes; a step that takes long keeps its tasks, and a window needs no other shuffle."""
    rows = spark.range(4000).select((F.col("id") % 200).alias("k"), "id")
    numbered = dealt(rows, "k").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    tasks = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == 4000
    assert numbered.agg(F.max("n")).first()[0] == 20


def test_shuffles_of_a_written_table_are_removed(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {f for f in map(str, files.getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f}
    before = left()
    out = cut_lineage(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    deadline = time.time() + 20
    while left() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not left() - before
    assert out.count() == 1000 and not spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "true"


@pytest.mark.parametrize("apart", [None, "g"])
@pytest.mark.parametrize("p", [1, 2, float("inf")])
def test_equal_vectors_are_searched_once(spark, monkeypatch, apart, p):
    """Few different vectors: tiles see k copies of each, and the result is that of the plain search."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (600, 2)).astype(float)
    rows = spark.createDataFrame(
        [(f"r{i:03d}", [float(v) for v in x[i]], float(i % 5), i % 3) for i in range(600)],
        "row_id string, features array<double>, label double, g int",
    )
    picked = rows.filter("label < 2")
    sizes = []
    inner = knn._search
    monkeypatch.setattr(knn, "_search", lambda q, r, n, *a: sizes.append((q.count(), n)) or inner(q, r, n, *a))
    got = knn.knn_join(picked, rows, 4, p=p, apart=apart).orderBy("qid", "rank").collect()
    at_most = 16 * 4 * (3 if apart else 1)
    assert sizes[0][0] <= at_most / 4 and sizes[0][1] <= at_most
    monkeypatch.setattr(knn, "COPIES", 601)
    plain = knn.knn_join(picked, rows, 4, p=p, apart=apart).orderBy("qid", "rank").collect()
    assert sizes[1] == (240, 600) and got == plain
