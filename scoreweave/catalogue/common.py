"""Rounding on both sides, the shared prepared table, and the SQL that rebuilds it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.plans.prepare import Encoded, load_matrices, scaled_each, split_rows
from scoreweave.sources.registry import ALL, NoDatasets


def rounded(df: DataFrame, digits: int, *columns: str, **special: int) -> DataFrame:
    """Round the named double columns (all doubles if none is named); -0.0 becomes 0.0."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    out = []
    for c in df.columns:
        if c in names or c in special:
            v = F.round(F.col(c), special.get(c, digits))
            out.append(F.when(v == 0, F.lit(0.0)).otherwise(v).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def r(expression: str, digits: int) -> str:
    v = f"round({expression}, {digits})"
    return f"CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END"


_WRITTEN: dict[tuple, Encoded] = {}
_SCALED: dict[tuple, DataFrame] = {}
TASKS = {s.name: s.task for s in ALL}


def _key(spark: SparkSession, folder: str, ids: bool, name: str) -> tuple:
    return spark.sparkContext.applicationId, folder, ids, name


def _each(kept: dict, spark: SparkSession, folder: str, ids: bool, names: Sequence[str], make) -> dict:
    """The named datasets (all if none is named) after a step that is taken once per session, folder and dataset.

    ``make`` gives those not yet there; one that cannot be read or encoded is
    left out. Rows with ids do where none are asked for.
    """
    at = lambda name: next((k for has in {True, ids} if (k := _key(spark, folder, has, name)) in kept), None)
    wanted = list(names or TASKS)
    missing = [n for n in wanted if not at(n)]
    if missing:
        kept.update({_key(spark, folder, ids, n): part for n, part in make(missing).items()})
    found = {n: kept[at(n)] for n in wanted if at(n)}
    if not found:
        raise NoDatasets("none could be loaded of " + ", ".join(wanted))
    return found


def _rows(spark: SparkSession, folder: str, ids: bool, names: Sequence[str]) -> dict[str, Encoded]:
    make = lambda missing: split_rows(load_matrices(spark, folder, [s for s in ALL if s.name in missing]), ids=ids)
    return _each(_WRITTEN, spark, folder, ids, names, make)


def shared_split(spark: SparkSession, folder: str, *names: str, ids: bool = True) -> DataFrame:
    """The named datasets (all if none is named), split, written and encoded; row_id only with ``ids``."""
    return reduce(DataFrame.unionByName, [_frame(e, ids) for e in _rows(spark, folder, ids, names).values()])


def _frame(part: Encoded | DataFrame, ids: bool) -> DataFrame:
    frame = part.frame() if isinstance(part, Encoded) else part
    return frame if ids else frame.drop("row_id")


def shared_prepared(spark: SparkSession, folder: str, *names: str, ids: bool = True) -> DataFrame:
    """The same rows imputed and standardised on all rows."""

    def make(missing):
        return scaled_each(_rows(spark, folder, ids, missing), TASKS)

    return reduce(DataFrame.unionByName, [_frame(f, ids) for f in _each(_SCALED, spark, folder, ids, names, make).values()])


LINE_KEY = (
    "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), "
    "CAST(round(l_extendedprice * 100) AS BIGINT), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))"
)


def is_level(column: str, *levels: str) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS DOUBLE)" for v in levels)


PRIORITIES = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

RAW = {
    "line_status": (
        "binary",
        f"SELECT {LINE_KEY} AS row_id, CAST(l_linestatus = 'F' AS DOUBLE) AS label, "
        f"[l_quantity, l_extendedprice, l_discount, l_tax, {is_level('l_returnflag', 'N', 'R')}] AS features FROM lineitem",
    ),
    "return_flag": (
        "multiclass",
        f"SELECT {LINE_KEY} AS row_id, CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 1 ELSE 2 END AS label, "
        f"[l_quantity, l_extendedprice, l_discount, l_tax, {is_level('l_linestatus', 'O')}] AS features FROM lineitem",
    ),
    "doc_quality": (
        "binary",
        "SELECT CAST(doc_id AS VARCHAR) AS row_id, CAST(quality AS DOUBLE) AS label, "
        "[CAST(n_chars AS DOUBLE), CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE), "
        f"{is_level('lang', 'en', 'es', 'fr')}] AS features FROM documents JOIN labels USING (doc_id)",
    ),
    "order_status": (
        "multiclass",
        "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, "
        "CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1 ELSE 2 END AS label, "
        f"[o_totalprice, c_acctbal, {is_level('o_orderpriority', *PRIORITIES)}, "
        f"{is_level('c_mktsegment', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')}] AS features "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "emb_class": (
        "multiclass",
        "SELECT CAST(vec_id AS VARCHAR) AS row_id, CAST(label AS DOUBLE) AS label, "
        "CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
    ),
    "line_price": (
        "regression",
        f"SELECT {LINE_KEY} AS row_id, l_extendedprice AS label, "
        "[l_quantity, l_discount, l_tax, p_retailprice, CAST(p_size AS DOUBLE)] AS features "
        "FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
    "order_total": (
        "regression",
        "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice AS label, "
        "[coalesce(CAST(n_lines AS DOUBLE), 0.0), coalesce(sum_qty, 0.0), "
        f"{is_level('o_orderstatus', 'O', 'P')}, {is_level('o_orderpriority', *PRIORITIES)}] AS features "
        "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty "
        "FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    ),
    "event_value": (
        "regression",
        "SELECT CAST(event_id AS VARCHAR) AS row_id, value AS label, "
        "[CAST(props->>'$.k' AS DOUBLE), "
        f"{is_level('event_type', 'error', 'purchase', 'signup', 'view')}] AS features FROM events",
    ),
}


def raw_sql(*names: str) -> str:
    """CTE ``raw(dataset_name, task, row_id, label, features)``."""
    picked = names or tuple(RAW)
    parts = [
        f"SELECT '{n}' AS dataset_name, '{RAW[n][0]}' AS task, row_id, label, features FROM ({RAW[n][1]})"
        for n in picked
    ]
    return "raw AS (" + " UNION ALL ".join(parts) + ")"


SPLIT_SQL = """
keyed AS (SELECT dataset_name, row_id, label,
    CASE WHEN task = 'regression' THEN '' ELSE CAST(CAST(label AS INTEGER) AS VARCHAR) END AS stratum,
    md5('42:' || row_id) AS h FROM raw),
strata AS (SELECT dataset_name, stratum, count(*) AS n FROM keyed GROUP BY ALL),
sized AS (SELECT *, sum(n) OVER (PARTITION BY dataset_name) AS total,
    ceil(0.4::DOUBLE * sum(n) OVER (PARTITION BY dataset_name)) AS aside FROM strata),
tested AS (SELECT *, CASE WHEN stratum <> '' THEN ceil(0.2::DOUBLE * total) ELSE ceil(0.5::DOUBLE * aside) END AS n_test FROM sized),
validated AS (SELECT *, CASE WHEN stratum <> '' THEN ceil(0.25::DOUBLE * (total - n_test)) ELSE aside - n_test END AS n_val FROM tested),
test_share AS (SELECT *, n_test * n::DOUBLE / total AS x FROM validated),
test_quota AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (PARTITION BY dataset_name
    ORDER BY round(x - floor(x), 9) DESC, stratum) <= n_test - sum(floor(x)) OVER (PARTITION BY dataset_name)
    THEN 1 ELSE 0 END AS q_test FROM test_share),
val_share AS (SELECT *, n_val * (n - q_test) / sum(n - q_test) OVER (PARTITION BY dataset_name) AS y FROM test_quota),
quota AS (SELECT dataset_name, stratum, q_test, floor(y) + CASE WHEN row_number() OVER (PARTITION BY dataset_name
    ORDER BY round(y - floor(y), 9) DESC, stratum) <= n_val - sum(floor(y)) OVER (PARTITION BY dataset_name)
    THEN 1 ELSE 0 END AS q_val FROM val_share),
ranked AS (SELECT dataset_name, row_id, stratum,
    row_number() OVER (PARTITION BY dataset_name, stratum ORDER BY h, row_id) AS rk FROM keyed),
parted AS (SELECT dataset_name, row_id, CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_val THEN 'val'
    ELSE 'train' END AS split FROM ranked JOIN quota USING (dataset_name, stratum))"""


def cells_sql(*names: str) -> str:
    """CTEs up to ``cells(dataset_name, task, split, row_id, label, feature, value)``, standardised on all rows."""
    return f"""{raw_sql(*names)}, {SPLIT_SQL},
flat AS (SELECT dataset_name, task, row_id, label, unnest(range(len(features))) AS feature, unnest(features) AS v FROM raw),
fitted AS (SELECT dataset_name, feature, avg(v) AS m, stddev_pop(v) AS s FROM flat GROUP BY ALL),
cells AS (SELECT dataset_name, task, split, row_id, label, CAST(feature AS INTEGER) AS feature,
    CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END AS value
    FROM flat JOIN fitted USING (dataset_name, feature) JOIN parted USING (dataset_name, row_id))"""


def raw_cells_sql(*names: str) -> str:
    """CTEs up to ``cells`` as above, but with the values unscaled."""
    return f"""{raw_sql(*names)}, {SPLIT_SQL},
flat AS (SELECT dataset_name, task, row_id, label, unnest(range(len(features))) AS feature, unnest(features) AS value FROM raw),
cells AS (SELECT dataset_name, task, split, row_id, label, CAST(feature AS INTEGER) AS feature, value
    FROM flat JOIN parted USING (dataset_name, row_id))"""
