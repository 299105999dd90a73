"""Deterministic samples, splits and folds.

Rows are ordered by the md5 text of ``seed:key``. A split is cut at exact
counts, but no row is ranked or moved for it: buckets of the digest are
counted, the bucket a cut falls into is counted again in finer buckets, the few
rows of the one that holds the cut are ranked, and the digest found there
becomes a threshold every row is compared with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions.hashing import prefix, seeded
from scoreweave.session import cut_lineage, measured

DIGITS = 2  # 256 digest buckets per stratum, twice over: rank 1 row in 65,536


def sample_fixed(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, or all rows if there are fewer."""
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).limit(n)


def _counts(keyed: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Rows per digest bucket, written out: the quotas and the search for the cuts both read it."""
    return cut_lineage(keyed.groupBy(*tables, "_stratum", "_bucket").agg(F.count("*").alias("_c")))


def _allot(strata: DataFrame, tables: Sequence[str], size: str, total: str, out: str) -> DataFrame:
    """Share ``total`` out over strata of ``size`` by largest remainder.

    ``strata`` has one row per (table, class), so the windows are small.
    """
    table = Window.partitionBy(*tables)
    # Nothing is left to share out when a tiny table went to test whole.
    share = F.try_divide((F.col(total) * F.col(size)).cast("double"), F.sum(size).over(table).cast("double"))
    exact = F.coalesce(share, F.lit(0.0))
    with_floor = strata.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = table.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), F.col("_stratum"))
    return with_floor.select(
        *strata.columns,
        (
            F.col("_floor")
            + (F.row_number().over(order) <= F.col(total) - F.sum("_floor").over(table)).cast("bigint")
        ).alias(out),
    )


def quotas(strata: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Test and validation counts per stratum of a 60/20/20 split.

    Stratified tables take a fifth for test, rounded up, then a quarter of the
    rest, rounded up. Unstratified ones take two fifths, rounded up, and halve
    them, rounding test up.
    """
    table = Window.partitionBy(*tables)
    n = F.sum("_n").over(table)
    sized = (
        strata.withColumn("_total", n)
        .withColumn("_aside", F.ceil(F.lit(0.4) * F.col("_total")))
        .withColumn(
            "_n_test",
            F.when(F.col("_stratified"), F.ceil(F.lit(0.2) * F.col("_total"))).otherwise(F.ceil(F.lit(0.5) * F.col("_aside"))),
        )
        .withColumn(
            "_n_val",
            F.when(F.col("_stratified"), F.ceil(F.lit(0.25) * (F.col("_total") - F.col("_n_test")))).otherwise(
                F.col("_aside") - F.col("_n_test")
            ),
        )
    )
    test = _allot(sized, tables, "_n", "_n_test", "_q_test").withColumn("_left", F.col("_n") - F.col("_q_test"))
    return _allot(test, tables, "_left", "_n_val", "_q_val").select(
        *tables, "_stratum", "_n", "_q_test", (F.col("_q_test") + F.col("_q_val")).alias("_q_both")
    )


def _holding(counts: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """The buckets that hold a cut, with the rows before them."""
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    holds = lambda q: (F.col(q) > F.col("_before")) & (F.col(q) <= F.col("_before") + F.col("_c"))
    return (
        counts.withColumn("_before", before)
        .filter(holds("_q_test") | holds("_q_both"))
        .select(*group, bucket, "_before", "_q_test", "_q_both")
    )


def assign_split(
    df: DataFrame,
    key: str,
    stratum: str | None = None,
    tables: Sequence[str] = (),
    seed: int = 42,
    digits: int = DIGITS,
) -> DataFrame:
    """Add ``split`` in {train, val, test}: 60/20/20 at exact, reproducible counts.

    ``stratum`` holds the class to stratify by; null means the table is not
    stratified. Several tables can be split in one job by naming their key
    columns in ``tables``.
    """
    return with_split(df, split_thresholds(df, key, stratum, tables, seed, digits), key, stratum, tables, seed)


def _keyed(df: DataFrame, key: str, stratum: str | None, seed: int) -> DataFrame:
    return df.withColumn("_h", seeded(F.col(key), seed)).withColumn(
        "_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    )


def split_thresholds(
    df: DataFrame,
    key: str,
    stratum: str | None = None,
    tables: Sequence[str] = (),
    seed: int = 42,
    digits: int = DIGITS,
) -> DataFrame:
    """The digests that cut each stratum at the counts of :func:`assign_split`, one written row per stratum."""
    tables = list(tables)
    group = [*tables, "_stratum"]
    keyed = _keyed(df, key, stratum, seed)
    coarse, fine = prefix(F.col("_h"), digits), prefix(F.col("_h"), 2 * digits)
    slim = keyed.select(*group, F.col(key).alias("_key"), "_h", coarse.alias("_bucket"), fine.alias("_fine"))
    counts = _counts(slim, tables)
    strata = counts.groupBy(*group).agg(F.sum("_c").alias("_n")).withColumn("_stratified", F.col("_stratum") != "")
    located = counts.join(quotas(strata, tables), group).withColumn("_base", F.lit(0))
    # At most two buckets per stratum hold a cut.
    edges = _holding(located, group, "_bucket")
    # The rows of these buckets, some two in 256, are set aside for both steps that follow.
    near = cut_lineage(slim.join(measured(edges), [*group, "_bucket"]))
    finer = (
        near.groupBy(*group, "_bucket", "_fine", "_before", "_q_test", "_q_both")
        .agg(F.count("*").alias("_c"))
        .withColumnRenamed("_before", "_base")
    )
    rank = Window.partitionBy(*group, "_fine").orderBy("_h", "_key")
    ranked = (
        near.select(*group, "_key", "_h", "_fine")
        .join(measured(_holding(finer, [*group, "_bucket"], "_fine").drop("_bucket")), [*group, "_fine"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(rank))
        .filter("_rank = _q_test or _rank = _q_both")
    )
    at = F.struct("_h", "_key")
    # One row per stratum, so that every later reader of the split only compares digests.
    return cut_lineage(
        ranked.groupBy(*group).agg(
            F.max(F.when(F.col("_rank") == F.col("_q_test"), at)).alias("_test"),
            F.max(F.when(F.col("_rank") == F.col("_q_both"), at)).alias("_both"),
        )
    )


def with_split(
    df: DataFrame, thresholds: DataFrame, key: str, stratum: str | None = None, tables: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Add ``split`` by comparing digests with the thresholds; ``df`` may hold some of the tables they were found for."""
    here = F.struct(F.col("_h"), F.col(key).alias("_key"))
    return _keyed(df, key, stratum, seed).join(thresholds, [*tables, "_stratum"], "left").select(
        *df.columns,
        F.when(here <= F.col("_test"), "test").when(here <= F.col("_both"), "val").otherwise("train").alias("split"),
    )


def assign_split_threshold(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """60/20/20 in expectation by digest alone: no counting, no join."""
    u = F.conv(prefix(seeded(F.col(key), seed), 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(u < 0.2, "test").when(u < 0.4, "val").otherwise("train"))
