"""Sources, guards, projections, samples and splits."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import RAW, SPLIT_SQL, r, raw_sql, rounded, shared_split
from scoreweave.functions.scalar import flatten_image
from scoreweave.operators import cleaning, sampling
from scoreweave.plans.prepare import load_matrices, split_matrix
from scoreweave.sources import registry
from scoreweave.sources.readers import concat_parts, table, vector_columns

_LABELS = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset_name, '{task}' AS task, CAST({label} AS VARCHAR) AS label FROM {source}"
    for name, task, label, source in (
        ("line_status", "binary", "CAST(l_linestatus = 'F' AS INTEGER)", "lineitem"),
        ("return_flag", "multiclass", "l_returnflag", "lineitem"),
        ("doc_quality", "binary", "quality", "documents JOIN labels USING (doc_id)"),
        ("order_status", "multiclass", "o_orderstatus", "orders JOIN customer ON o_custkey = c_custkey"),
        ("emb_class", "multiclass", "label", "embeddings"),
    )
)
_REGRESSION_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS dataset_name, 'regression' AS task, 'ok' AS status, '' AS reason, count(*) AS n_rows FROM ({RAW[n][1]})"
    for n in ("line_price", "order_total", "event_value")
)

# Specs that must not load: no such table, no such column, and three classes where two are due.
_NO_TABLE = registry.Spec(
    "no_table", registry.BINARY, lambda s, d: table(s, d, "absent").withColumn("row_id", F.lit("")), "target"
)
_NO_COLUMN = dataclasses.replace(registry.ORDER_STATUS, name="no_column", required=("o_absent",))
_NOT_BINARY = dataclasses.replace(registry.ORDER_STATUS, name="not_binary", task=registry.BINARY)


@register(f"""
    WITH l AS ({_LABELS}), c AS (SELECT dataset_name, label, count(*) AS n FROM l GROUP BY ALL)
    SELECT dataset_name, label, n, CAST(sum(n) OVER (PARTITION BY dataset_name) AS BIGINT) AS n_rows,
      CAST(CASE dataset_name WHEN 'line_status' THEN 5 WHEN 'return_flag' THEN 5 WHEN 'doc_quality' THEN 3
           WHEN 'order_status' THEN 4 ELSE 1 END AS INTEGER) AS n_columns FROM c""")
def scan_summary(spark, folder):
    return registry.summary(registry.open_all(spark, folder, registry.ALL).frames)


@register(f"""
    WITH l AS ({_LABELS} UNION ALL SELECT 'not_binary', 'binary', o_orderstatus
               FROM orders JOIN customer ON o_custkey = c_custkey),
    c AS (SELECT dataset_name, task, count(DISTINCT label) AS k, count(*) AS n_rows FROM l GROUP BY ALL),
    ok AS (SELECT *, CASE WHEN task = 'binary' THEN k = 2 ELSE k >= 3 END AS fine FROM c)
    SELECT dataset_name, task, CASE WHEN fine THEN 'ok' ELSE 'rejected' END AS status,
      CASE WHEN fine THEN '' ELSE 'label cardinality' END AS reason, n_rows FROM ok
    UNION ALL {_REGRESSION_COUNTS}
    UNION ALL SELECT 'no_table', NULL, 'failed', 'source failed: AnalysisException', NULL
    UNION ALL SELECT 'no_column', NULL, 'failed', 'missing columns: o_absent', NULL""")
def registry_status(spark, folder):
    specs = (*registry.ALL, _NO_TABLE, _NO_COLUMN, _NOT_BINARY)
    return registry.status(spark, registry.open_all(spark, folder, specs))


@register("""
    SELECT 'order_status' AS dataset_name, 'ok' AS status, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'no_column', 'failed', NULL""")
def guard_required(spark, folder):
    loaded = registry.open_all(spark, folder, (registry.ORDER_STATUS, _NO_COLUMN))
    return registry.status(spark, loaded).select("dataset_name", "status", "n_rows")


@register(f"""
    WITH l AS ({_LABELS} UNION ALL SELECT 'not_binary', 'binary', o_orderstatus
               FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT dataset_name, task, count(DISTINCT label) AS n_labels,
      CASE WHEN task = 'binary' THEN count(DISTINCT label) = 2 ELSE count(DISTINCT label) >= 3 END AS accepted
    FROM l GROUP BY dataset_name, task""")
def guard_label_cardinality(spark, folder):
    specs = [s for s in (*registry.ALL, _NOT_BINARY) if s.task != registry.REGRESSION]
    counts = registry.label_counts(registry.open_all(spark, folder, specs).frames)
    found = counts.groupBy("dataset_name", "task").agg(F.count("label").alias("n_labels"))
    return found.withColumn("accepted", registry.cardinality_ok(F.col("task"), F.col("n_labels")))


_DIMS = ", ".join(f"{{p}}CAST(embedding[{i + 1}] AS DOUBLE) AS pixel_{i}" for i in range(64)).replace("{p}", "")


@register(f"SELECT vec_id, label, {_DIMS} FROM embeddings")
def vector_to_columns(spark, folder):
    emb = table(spark, folder, "embeddings")
    parts = [emb.filter("label < 5"), emb.filter("NOT label < 5 OR label IS NULL")]
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    return vector_columns(concat_parts(parts), "embedding", width)


@register(f"""
    SELECT vec_id, CAST(i AS INTEGER) AS pixel, {r('v', 6)} AS value FROM (
      SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""")
def image_flatten(spark, folder):
    emb = table(spark, folder, "embeddings")
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    flat = emb.select("vec_id", flatten_image(image).alias("flat"))
    return rounded(flat.select("vec_id", F.posexplode("flat").alias("pixel", "value")).withColumn(
        "value", F.col("value").cast("double")), 6, "value")


@register("SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_select(spark, folder):
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return cleaning.features_only(line, "l_returnflag")


@register("SELECT o_orderkey, o_orderstatus FROM orders")
def label_select(spark, folder):
    return cleaning.label_only(table(spark, folder, "orders"), "o_orderkey", "o_orderstatus")


@register("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def drop_if_present(spark, folder):
    return cleaning.drop_columns(table(spark, folder, "customer"), ["c_name", "c_nationkey", "c_absent"])


@register("""
    SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def label_lookup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    return docs.join(table(spark, folder, "labels"), "doc_id")


@register("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 10000")
def sample_fixed(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sampling.sample_fixed(orders, 10_000, "o_orderkey")


def _split(spark, folder, *specs):
    matrix = load_matrices(spark, folder, specs).union()
    return split_matrix(matrix).select("dataset_name", "row_id", "split")


@register(f"WITH {raw_sql('doc_quality', 'order_status', 'emb_class')}, {SPLIT_SQL} SELECT dataset_name, row_id, split FROM parted")
def split_stratified(spark, folder):
    return _split(spark, folder, registry.DOC_QUALITY, registry.ORDER_STATUS, registry.EMB_CLASS)


@register(f"WITH {raw_sql('line_price')}, {SPLIT_SQL} SELECT dataset_name, row_id, split FROM parted")
def split_plain(spark, folder):
    return _split(spark, folder, registry.LINE_PRICE)


@register("""
    SELECT o_orderkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'val' ELSE 'train' END AS split FROM (
      SELECT o_orderkey, CAST(('0x' || substr(md5('42:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders)""")
def split_by_threshold(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return sampling.assign_split_threshold(orders, "o_orderkey")


@register(f"""
    WITH {raw_sql()}, {SPLIT_SQL}
    SELECT dataset_name, split, count(*) AS n FROM parted GROUP BY ALL""")
def split_sizes(spark, folder):
    parts = shared_split(spark, folder, ids=False)
    return parts.groupBy("dataset_name", "split").agg(F.count("*").alias("n"))
