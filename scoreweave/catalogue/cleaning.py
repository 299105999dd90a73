"""Missing values, encodings and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import LINE_KEY, r, rounded
from scoreweave.functions.scalar import equals_trimmed, nan_to_zero
from scoreweave.operators import cleaning, encoding, scaling
from scoreweave.sources.readers import table
from scoreweave.sources.registry import LINE_PRICE

# Gaps: an order of unspecified priority has neither a priority nor a trusted total.
_GAPS = """gaps AS (SELECT o_orderkey, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS o_totalprice, o_orderstatus FROM orders)"""


def _gaps(spark, folder):
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(known, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(known, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderstatus",
    )


@register(f"WITH {_GAPS} SELECT * FROM gaps WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL")
def drop_null_rows(spark, folder):
    return cleaning.drop_null_rows(_gaps(spark, folder))


@register(f"""
    WITH {_GAPS} SELECT o_orderkey, {r('coalesce(o_totalprice, (SELECT median(o_totalprice) FROM gaps))', 4)} AS o_totalprice FROM gaps""")
def fill_median(spark, folder):
    gaps = _gaps(spark, folder).select("o_orderkey", "o_totalprice")
    return rounded(cleaning.fill_median(gaps, ["o_totalprice"]), 4)


@register(f"""
    WITH {_GAPS}, best AS (SELECT o_orderpriority AS p FROM gaps WHERE o_orderpriority IS NOT NULL
      GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)
    SELECT o_orderkey, coalesce(o_orderpriority, (SELECT p FROM best)) AS o_orderpriority FROM gaps""")
def fill_mode(spark, folder):
    return cleaning.fill_mode(_gaps(spark, folder).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register(f"""
    WITH {_GAPS} SELECT o_orderkey, {r('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps))', 4)} AS o_totalprice FROM gaps""")
def impute_mean(spark, folder):
    gaps = _gaps(spark, folder).select("o_orderkey", "o_totalprice")
    empty = gaps.withColumn("nothing", F.lit(None).cast("double"))
    return rounded(cleaning.impute_mean(empty, ["o_totalprice", "nothing"]), 4, "o_totalprice")


def _hot(column, levels, prefix):
    return ", ".join(f"CAST(coalesce({column} = '{v}', false) AS INTEGER) AS \"{prefix}_{v}\"" for v in levels)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_KNOWN = ("2-HIGH", "3-MEDIUM", "5-LOW")


@register(f"WITH {_GAPS} SELECT o_orderkey, {_hot('o_orderpriority', _KNOWN, 'o_orderpriority')} FROM gaps")
def onehot_drop_first(spark, folder):
    return encoding.one_hot(_gaps(spark, folder).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register(f"""
    SELECT o_orderkey, o_totalprice, {_hot('o_orderstatus', ('O', 'P'), 'o_orderstatus')},
      {_hot('o_orderpriority', ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), 'o_orderpriority')} FROM orders""")
def onehot_auto(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return encoding.one_hot_auto(orders)


@register(f"SELECT c_custkey, {_hot('c_mktsegment', _SEGMENTS, 'model')} FROM customer")
def onehot_all_prefixed(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return encoding.one_hot(customers, ["c_mktsegment"], drop_first=False, prefix="model")


@register(f"""
    SELECT o_orderkey, {_hot('o_orderstatus', ('F', 'O'), 'status')} FROM orders WHERE o_orderstatus <> 'F'""")
def onehot_align(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    left, right = orders.filter("o_orderstatus <> 'P'"), orders.filter("o_orderstatus <> 'F'")
    return encoding.one_hot_align(left, right, "o_orderstatus", "status")[1]


@register("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_final FROM orders")
def label_binarize(spark, folder):
    padded = F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))
    return table(spark, folder, "orders").select("o_orderkey", equals_trimmed(padded, "F").alias("is_final"))


_NUMBERS = ("l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size")
_PRICE = f"""base AS (SELECT {LINE_KEY} AS row_id, l_extendedprice, l_quantity, l_discount, l_tax, p_retailprice,
    CAST(p_size AS DOUBLE) AS p_size, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _price(spark, folder):
    return LINE_PRICE.build(spark, folder)


def _scaled_sql(column, over="base", where=""):
    return f"({column} - (SELECT avg({column}) FROM {over} {where})) / (SELECT stddev_pop({column}) FROM {over} {where})"


@register(f"WITH {_PRICE} SELECT row_id, " + ", ".join(f"{r(_scaled_sql(c), 6)} AS {c}" for c in _NUMBERS) + " FROM base")
def scale_population(spark, folder):
    base = _price(spark, folder).drop("l_extendedprice")
    return rounded(scaling.apply(base, scaling.fit(base, _NUMBERS), _NUMBERS), 6)


_HALVES = """halves AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment < 'FURNITURE' THEN 'val' ELSE 'test' END AS split FROM customer)"""


def _halves(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") < "FURNITURE", "val").otherwise("test").alias("split")
    )


@register(f"WITH {_HALVES} SELECT c_custkey, split, " + r(_scaled_sql("c_acctbal", "halves", "WHERE split = 'val'"), 6) + " AS c_acctbal FROM halves")
def scale_fit_val_apply_test(spark, folder):
    rows = _halves(spark, folder)
    stats = scaling.fit(rows.filter("split = 'val'"), ["c_acctbal"])
    return rounded(scaling.apply(rows, stats, ["c_acctbal"]), 6)


@register(f"""
    WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders)
    SELECT o_orderkey, {r('(o_totalprice - mean) / std', 6)} AS scaled, {r('(o_totalprice - mean) / std * std + mean', 4)} AS restored
    FROM orders, m""")
def scale_target_roundtrip(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("scaled"))
    stats = scaling.fit(orders, ["scaled"])
    forward = scaling.apply(orders, stats, ["scaled"]).withColumn("restored", F.col("scaled"))
    back_stats = stats.select(F.col("scaled_mean").alias("restored_mean"), F.col("scaled_std").alias("restored_std"))
    return rounded(scaling.invert(forward, back_stats, ["restored"]), 6, "scaled", restored=4)


@register(f"""
    SELECT 'l_quantity' AS metric, {r('avg(l_quantity)', 6)} AS mean, {r('stddev_pop(l_quantity)', 6)} AS std FROM lineitem
    UNION ALL SELECT 'l_discount', {r('avg(l_discount)', 6)}, {r('stddev_pop(l_discount)', 6)} FROM lineitem
    UNION ALL SELECT 'l_tax', {r('avg(l_tax)', 6)}, {r('stddev_pop(l_tax)', 6)} FROM lineitem""")
def scaler_stats(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(scaling.fit_long(line, ["l_quantity", "l_discount", "l_tax"]), 6)


@register(f"""
    WITH {_GAPS} SELECT o_orderkey, {r("coalesce(" + _scaled_sql("o_totalprice", "gaps") + ", 0.0)", 6)} AS o_totalprice FROM gaps""")
def nan_to_zero_after_scale(spark, folder):
    gaps = _gaps(spark, folder).select("o_orderkey", F.coalesce("o_totalprice", F.lit(float("nan"))).alias("o_totalprice"))
    scaled = scaling.apply(gaps, scaling.fit(gaps, ["o_totalprice"]), ["o_totalprice"])
    return rounded(scaled.withColumn("o_totalprice", nan_to_zero(F.col("o_totalprice"))), 6)


@register(f"""
    WITH {_GAPS} SELECT o_orderkey, o_orderstatus,
      {r('coalesce(o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderstatus))', 4)} AS o_totalprice FROM gaps""")
def fill_target_mean(spark, folder):
    gaps = _gaps(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(cleaning.fill_column_mean(gaps, "o_totalprice", ["o_orderstatus"]), 4)


@register("""
    WITH found AS (SELECT DISTINCT 0 AS c, c_mktsegment AS v FROM customer UNION ALL SELECT DISTINCT 1, c_name FROM customer),
    later AS (SELECT c, v FROM found QUALIFY row_number() OVER (PARTITION BY c ORDER BY v) > 1),
    numbered AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS position FROM later)
    SELECT c_custkey, position FROM customer JOIN numbered ON (c = 0 AND v = c_mktsegment) OR (c = 1 AND v = c_name)""")
def onehot_sparse(spark, folder):
    """A column with a level per row, which no table could hold as columns."""
    encoded = encoding.one_hot_sparse(table(spark, folder, "customer"), ["c_mktsegment", "c_name"])
    return encoded.select("c_custkey", F.explode("indices").alias("position"))
