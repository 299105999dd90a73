"""One-hot encoding, alignment and label encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.operators.numbering import consecutive
from scoreweave.session import cut_lineage, measured

MAX_LEVELS = 10_000


class TooManyLevels(ValueError):
    pass


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def levels(
    frames: dict[str, tuple[DataFrame, Sequence[str]]], limit: int = MAX_LEVELS
) -> tuple[dict[str, dict[str, list[str]]], dict[str, int]]:
    """Sorted distinct values of the text columns of many tables, in one job, and the tables with too many of them.

    Levels become columns, so they are counted per table first; a table with
    more than ``limit`` of them is named with their number instead, and the
    others go on. `one_hot_sparse` encodes any number of levels.
    """
    parts = [
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                        for c in columns
                    ]
                )
            ).alias("x")
        ).select("x.*")
        for name, (df, columns) in frames.items()
        if columns
    ]
    out: dict[str, dict[str, list[str]]] = {name: {c: [] for c in columns} for name, (_, columns) in frames.items()}
    if not parts:
        return out, {}
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    found = cut_lineage(pairs.filter("v is not null").distinct())
    # A row per table.
    wide = {r["t"]: r["count"] for r in found.groupBy("t").count().collect() if r["count"] > limit}
    for row in found.filter(~F.col("t").isin(*wide)).collect() if wide else found.collect():
        out[row["t"]][row["c"]].append(row["v"])
    for per_table in out.values():
        for values in per_table.values():
            values.sort()
    return {name: known for name, known in out.items() if name not in wide}, wide


def column_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list[str]]:
    known, wide = levels({"t": (df, columns)}, limit)
    if wide:
        raise TooManyLevels(f"{wide['t']} levels in {sorted(columns)}; more than {limit} do not become columns")
    return known["t"]


def level_dictionary(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """(column, level, position): every level's place in a sparse vector, as a table that may have any number of rows.

    Positions follow the order of ``columns``, then of the levels; with
    ``drop_first`` the first level of each column has none.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)])
    found = df.select(F.explode(cells).alias("x")).select("x.*").filter("level is not null").distinct()
    if drop_first:
        found = cut_lineage(found)
        first = measured(found.groupBy("_c").agg(F.min("level").alias("_first")))
        found = found.join(first, "_c").filter("level <> _first").drop("_first")
    return consecutive(found, ["_c", "level"], "position").select("column", "level", "position")


def one_hot_sparse(df: DataFrame, columns: Sequence[str], drop_first: bool = True, dictionary: DataFrame | None = None) -> DataFrame:
    """Replace text columns by ``indices``, the ascending positions that are 1.

    The dictionary stays a table and is joined column by column: broadcast
    while its files are small, else by a shuffle in which a frequent level is
    split. Nulls, first levels and levels that ``dictionary`` does not know have
    no position. Other columns and repeated rows stay as they are.
    """
    known = cut_lineage(dictionary if dictionary is not None else level_dictionary(df, columns, drop_first))
    out, places = df, []
    for i, c in enumerate(columns):
        place = f"_place{i}"
        own = known.filter(F.col("column") == c).select(F.col("level").alias(f"_level{i}"), F.col("position").alias(place))
        out = out.join(own, F.col(c).cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
        places.append(place)
    kept = [c for c in df.columns if c not in columns]
    return out.select(*kept, F.array_sort(F.array_compact(F.array(*places))).alias("indices"))


def indicator(column: str, level: str):
    """1 for the level, 0 for any other value and for null."""
    return F.coalesce((F.col(column) == F.lit(level)).cast("int"), F.lit(0))


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = True,
    prefix: str | None = None,
    known: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Replace text columns by 0/1 columns ``<column or prefix>_<level>``.

    ``known`` fixes the levels (for instance those of another table).
    """
    known = known or column_levels(df, columns)
    kept = [F.col(c) for c in df.columns if c not in columns]
    dummies = [
        indicator(c, level).alias(f"{prefix or c}_{level}")
        for c in columns
        for level in known[c][1 if drop_first else 0 :]
    ]
    return df.select(*kept, *dummies)


def one_hot_auto(df: DataFrame, exclude: Sequence[str] = (), drop_first: bool = True) -> DataFrame:
    """One-hot every text column found in the schema."""
    return one_hot(df, [c for c in text_columns(df) if c not in exclude], drop_first)


def one_hot_align(left: DataFrame, right: DataFrame, column: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Encode both sides with the left side's levels: unseen ones vanish, missing ones are 0."""
    known = column_levels(left, [column])
    return (
        one_hot(left, [column], drop_first=False, prefix=prefix, known=known),
        one_hot(right, [column], drop_first=False, prefix=prefix, known=known),
    )
