"""Dataset registry: named tables with a label, ready for profiling and learning.

A :class:`Spec` says how to build one dataset from source tables; loading
checks it and reports one status row per dataset, so one broken source never
stops the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.sources.readers import table

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


@dataclass(frozen=True)
class Spec:
    name: str
    task: str
    build: Callable[[SparkSession, str], DataFrame]
    label: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    vector: str | None = None
    text_label: bool = False
    joined: bool = False  # several sources: written once, instead of joined anew by every pass
    required: tuple[str, ...] = field(default=())

    def needs(self) -> tuple[str, ...]:
        cols = ("row_id", self.label, *self.numeric, *self.categorical, *self.required)
        return cols + ((self.vector,) if self.vector else ())


class MissingColumns(ValueError):
    pass


class NoDatasets(RuntimeError):
    pass


def check_columns(df: DataFrame, needed: Iterable[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise MissingColumns("missing columns: " + ", ".join(missing))


@dataclass
class Loaded:
    """Datasets whose sources opened, and the reasons for those that did not."""

    frames: dict[str, tuple[Spec, DataFrame]]
    failures: dict[str, str]


def open_all(spark: SparkSession, folder: str, specs: Iterable[Spec]) -> Loaded:
    """Build every dataset lazily; a failing source is recorded, not raised."""
    frames: dict[str, tuple[Spec, DataFrame]] = {}
    failures: dict[str, str] = {}
    for spec in specs:
        try:
            df = spec.build(spark, folder)
            check_columns(df, spec.needs())
            frames[spec.name] = (spec, df)
        except MissingColumns as err:
            failures[spec.name] = str(err)
        except Exception as err:  # any source error isolates to its dataset
            failures[spec.name] = "source failed: " + type(err).__name__
    if not frames:
        raise NoDatasets("no dataset could be loaded: " + "; ".join(failures.values()))
    return Loaded(frames, failures)


def label_counts(frames: dict[str, tuple[Spec, DataFrame]], targets: bool = True) -> DataFrame:
    """Rows per (dataset, label), in one job.

    Without ``targets`` the values of a regression target count as one label,
    so that they are not shuffled merely to count rows.
    """
    parts = [
        df.select(
            F.lit(spec.name).alias("dataset_name"),
            F.lit(spec.task).alias("task"),
            (
                F.when(F.col(spec.label).isNotNull(), F.lit("value"))
                if spec.task == REGRESSION and not targets
                else F.col(spec.label).cast("string")
            ).alias("label"),
        )
        for spec, df in frames.values()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("dataset_name", "task", "label").agg(F.count("*").alias("n"))


def cardinality_ok(task, n_labels):
    """The label guard: exactly two classes, or at least three, by task."""
    return (
        F.when(task == BINARY, n_labels == 2).when(task == MULTICLASS, n_labels >= 3).otherwise(n_labels >= 1)
    )


def status(spark: SparkSession, loaded: Loaded) -> DataFrame:
    """One row per dataset: ``ok``, ``rejected`` by a guard, or ``failed`` to open."""
    counts = (
        label_counts(loaded.frames, targets=False)
        .groupBy("dataset_name", "task")
        .agg(F.sum("n").alias("n_rows"), F.count("label").alias("n_labels"))
    )
    ok = cardinality_ok(F.col("task"), F.col("n_labels"))
    checked = counts.select(
        "dataset_name",
        "task",
        F.when(ok, "ok").otherwise("rejected").alias("status"),
        F.when(ok, "").otherwise("label cardinality").alias("reason"),
        "n_rows",
    )
    failed = spark.createDataFrame(
        [(name, None, "failed", reason, None) for name, reason in loaded.failures.items()],
        "dataset_name string, task string, status string, reason string, n_rows bigint",
    )
    return checked.unionByName(failed)


def load_all(spark: SparkSession, folder: str, specs: Iterable[Spec]) -> Loaded:
    """Open every dataset and drop those the label guard rejects; raise if none is left."""
    loaded = open_all(spark, folder, specs)
    # One row per dataset: its size is the number of registered datasets.
    rejected = [
        (r["dataset_name"], r["reason"])
        for r in status(spark, loaded).filter("status = 'rejected'").collect()
    ]
    for name, reason in rejected:
        loaded.failures[name] = reason
        del loaded.frames[name]
    if not loaded.frames:
        raise NoDatasets("every dataset was rejected")
    return loaded


def summary(frames: dict[str, tuple[Spec, DataFrame]]) -> DataFrame:
    """Shape and label distribution: (dataset, label, n, n_rows, n_columns)."""
    width = F.create_map(
        *[
            F.lit(v)
            for spec, _ in frames.values()
            for v in (spec.name, len(spec.numeric) + len(spec.categorical) + (1 if spec.vector else 0))
        ]
    )
    counts = label_counts({k: v for k, v in frames.items() if v[0].task != REGRESSION})
    totals = counts.groupBy("dataset_name").agg(F.sum("n").alias("n_rows"))
    return counts.join(totals, "dataset_name").select(
        "dataset_name", "label", "n", "n_rows", width[F.col("dataset_name")].alias("n_columns")
    )


# -- the datasets built from the star-schema tables --------------------------


def _line_key():
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return F.concat_ws(
        "|",
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        cents("l_quantity"),
        cents("l_extendedprice"),
        F.unix_date(F.to_date("l_shipdate")),
    )


def _line_status(spark, folder):
    return table(spark, folder, "lineitem").select(
        _line_key().alias("row_id"),
        (F.col("l_linestatus") == "F").cast("int").alias("is_final"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


def _return_flag(spark, folder):
    return table(spark, folder, "lineitem").select(
        _line_key().alias("row_id"),
        "l_returnflag",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_linestatus",
    )


def _doc_quality(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("row_id"),
        "quality",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        "lang",
    )


def _order_status(spark, folder):
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        "o_orderstatus",
        "o_totalprice",
        "c_acctbal",
        "o_orderpriority",
        "c_mktsegment",
    )


def _emb_class(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"), "label", "embedding"
    )


def _line_price(spark, folder):
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        _line_key().alias("row_id"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "p_retailprice",
        F.col("p_size").cast("double").alias("p_size"),
    )


def _order_total(spark, folder):
    orders = table(spark, folder, "orders")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"))
    )
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        "o_totalprice",
        F.coalesce("n_lines", F.lit(0.0)).alias("n_lines"),
        F.coalesce("sum_qty", F.lit(0.0)).alias("sum_qty"),
        "o_orderstatus",
        "o_orderpriority",
    )


def _event_value(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("row_id"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
    )


LINE_STATUS = Spec(
    "line_status", BINARY, _line_status, "is_final",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag",),
)
RETURN_FLAG = Spec(
    "return_flag", MULTICLASS, _return_flag, "l_returnflag",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_linestatus",), text_label=True,
)
DOC_QUALITY = Spec("doc_quality", BINARY, _doc_quality, "quality", ("n_chars", "n_words"), ("lang",), joined=True)
ORDER_STATUS = Spec(
    "order_status", MULTICLASS, _order_status, "o_orderstatus",
    ("o_totalprice", "c_acctbal"), ("o_orderpriority", "c_mktsegment"), text_label=True, joined=True,
)
EMB_CLASS = Spec("emb_class", MULTICLASS, _emb_class, "label", vector="embedding")
LINE_PRICE = Spec(
    "line_price", REGRESSION, _line_price, "l_extendedprice",
    ("l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"), joined=True,
)
ORDER_TOTAL = Spec(
    "order_total", REGRESSION, _order_total, "o_totalprice",
    ("n_lines", "sum_qty"), ("o_orderstatus", "o_orderpriority"), joined=True,
)
EVENT_VALUE = Spec("event_value", REGRESSION, _event_value, "value", ("k",), ("event_type",))

ALL = (
    LINE_STATUS, RETURN_FLAG, DOC_QUALITY, ORDER_STATUS, EMB_CLASS, LINE_PRICE, ORDER_TOTAL, EVENT_VALUE,
)


def track(task: str) -> tuple[Spec, ...]:
    return tuple(s for s in ALL if s.task == task)
