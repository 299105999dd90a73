"""From registered datasets to one prepared table: encode, impute, scale, split."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scoreweave.functions.scalar import nan_to_null
from scoreweave.operators.encoding import indicator, levels
from scoreweave.operators.sampling import assign_split, split_thresholds, with_split
from scoreweave.operators.scaling import apply_arrays, centred, fit_arrays
from scoreweave.session import ROW_GROUP, cut_lineage, measured
from scoreweave.sources.registry import ALL, REGRESSION, Loaded, NoDatasets, Spec, open_all


COLUMNS = 64  # features; a table with more of them keeps them in one array


@dataclass(frozen=True)
class Encoded:
    """Rows of a dataset with the source's columns, which files hold in little space, and the features as expressions over them.

    Without expressions (a vector, or many features) the rows have the array itself.
    """

    rows: DataFrame
    values: tuple[Column, ...] | None

    def _with(self, features: Column) -> DataFrame:
        before = [c for c in ("dataset_name", "task", "row_id", "label") if c in self.rows.columns]
        return self.rows.select(*before, features.alias("features"), *[c for c in ("split",) if c in self.rows.columns])

    def frame(self) -> DataFrame:
        return self._with(F.col("features") if self.values is None else F.array(*self.values))

    def fitted(self, only: Column) -> DataFrame:
        """One row of what `fit_arrays` measures on the rows ``only`` lets through, column by column."""
        std = lambda v: F.stddev_pop(v) * F.sqrt(F.try_divide(F.count(v), F.count("*")))
        stats = [F.struct(F.avg(v).alias("mean"), std(v).alias("std")) for v in self.values]
        return self.rows.filter(only).agg(F.array(*stats).alias("stats"))

    def scaled(self, stats: Sequence[Row]) -> DataFrame:
        """The same as `apply_arrays` gives, its numbers standing in the expressions."""
        fitted = [(v, F.lit(s["mean"]), F.lit(s["std"])) for v, s in zip(self.values, stats, strict=True) if s["mean"] is not None]
        return self._with(F.array(*[centred(F.coalesce(v, mean), mean, std) for v, mean, std in fitted]).cast("array<double>"))


class Matrices:
    """Feature arrays of the loaded datasets, with the names behind the positions."""

    def __init__(self, loaded: Loaded):
        sources = _stored(loaded)
        texts = {
            name: (df, [*spec.categorical, *((spec.label,) if spec.text_label else ())])
            for name, (spec, df) in sources.items()
        }
        self._levels, wide = levels(texts)
        # A table with too many levels for columns is left out by name; the others go on.
        for name, n in wide.items():
            loaded.failures[name] = f"{n} levels"
        kept = {name: pair for name, pair in sources.items() if name not in wide}
        if not kept:
            raise NoDatasets("no dataset could be encoded: " + "; ".join(loaded.failures.values()))
        self.specs: dict[str, Spec] = {name: spec for name, (spec, _) in kept.items()}
        self.encoded = {name: self._encoded(spec, df) for name, (spec, df) in kept.items()}
        self.frames = {name: e.frame() for name, e in self.encoded.items()}

    def classes(self, name: str) -> list[str]:
        return self._levels[name].get(self.specs[name].label, [])

    def feature_names(self, name: str) -> list[str]:
        spec = self.specs[name]
        return [*spec.numeric, *[f"{c}_{v}" for c in spec.categorical for v in self._levels[name][c][1:]]]

    def _encoded(self, spec: Spec, df: DataFrame) -> Encoded:
        known = self._levels[spec.name]
        if spec.text_label:
            classes = F.array(*[F.lit(v) for v in known[spec.label]])
            label = (F.array_position(classes, F.col(spec.label)) - 1).cast("double")
        else:
            label = F.col(spec.label).cast("double")
        named = [F.lit(spec.name).alias("dataset_name"), F.lit(spec.task).alias("task"), "row_id", label.alias("label")]
        source = {c: f"_f{i}" for i, c in enumerate([*spec.numeric, *spec.categorical])}
        narrow = not spec.vector and len(spec.numeric) + sum(len(known[c]) - 1 for c in spec.categorical) <= COLUMNS
        at = lambda c: source[c] if narrow else c
        values = (
            *[nan_to_null(F.col(at(c)).cast("double")) for c in spec.numeric],
            *[indicator(at(c), v).cast("double") for c in spec.categorical for v in known[c][1:]],
        )
        if narrow:
            return Encoded(df.select(*named, *[F.col(c).alias(f) for c, f in source.items()]), values)
        features = F.transform(spec.vector, lambda v: nan_to_null(v.cast("double"))) if spec.vector else F.array(*values)
        return Encoded(df.select(*named, features.alias("features")), None)

    def union(self) -> DataFrame:
        frames = list(self.frames.values())
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


def _stored(loaded: Loaded) -> dict[str, tuple[Spec, DataFrame]]:
    """The loaded datasets; the rows of those joined from several sources are written, as several passes read them."""

    def store(pair: tuple[Spec, DataFrame]) -> tuple[Spec, DataFrame]:
        spec, df = pair
        return spec, cut_lineage(df.select(*dict.fromkeys(spec.needs())), row_group=ROW_GROUP) if spec.joined else df

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(loaded.frames, pool.map(store, loaded.frames.values()), strict=True))


def load_matrices(spark: SparkSession, folder: str, specs: Iterable[Spec] = ALL) -> Matrices:
    return Matrices(open_all(spark, folder, specs))


def _classed(matrix: DataFrame) -> DataFrame:
    """With the class to stratify by: classification tables have one, regression ones do not."""
    return matrix.withColumn("_class", F.when(F.col("task") != REGRESSION, F.col("label").cast("int").cast("string")))


def split_matrix(matrix: DataFrame, seed: int = 42) -> DataFrame:
    """Stratified split for classification tables, plain for regression ones."""
    return assign_split(_classed(matrix), "row_id", "_class", ["dataset_name"], seed).drop("_class")


def split_each(frames: Mapping[str, DataFrame], seed: int = 42) -> dict[str, DataFrame]:
    """The same for datasets that are kept apart: their cuts are found together, which split a row is in follows on reading."""
    keyed = [f.select("dataset_name", "task", "row_id", "label") for f in frames.values()]
    thresholds = split_thresholds(_classed(reduce(DataFrame.unionByName, keyed)), "row_id", "_class", ["dataset_name"], seed)
    return {
        n: with_split(_classed(f), thresholds.filter(F.col("dataset_name") == n), "row_id", "_class", ["dataset_name"], seed).drop("_class")
        for n, f in frames.items()
    }


def write_each(frames: Mapping[str, DataFrame], tasks: Mapping[str, str]) -> dict[str, DataFrame]:
    """Write the rows of each dataset as a table of its own; its name and task are put back as constants.

    A table of several datasets, partitioned by them, sorts all rows before they
    are written. Here nothing is sorted, and a filter by name leaves the other
    tables out of the plan.
    """

    def write(name: str) -> DataFrame:
        frame = frames[name]
        named = {"dataset_name": F.lit(name), "task": F.lit(tasks[name])}
        return cut_lineage(frame.drop(*named), row_group=ROW_GROUP).withColumns(named).select(*frame.columns)

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(frames, pool.map(write, frames), strict=True))


def prepared(matrix: DataFrame, seed: int = 42, fit_on: str = "train") -> DataFrame:
    """Columns dataset_name, task, row_id, label, features, split; features imputed and scaled.

    ``fit_on="train"`` measures means and deviations on training rows;
    ``fit_on="all"`` measures them on every row, before the split.
    """
    if fit_on == "all":
        return split_matrix(apply_arrays(matrix, fit_arrays(matrix)), seed)
    if fit_on != "train":
        raise ValueError("fit_on must be 'train' or 'all'")
    parted = split_matrix(matrix, seed)
    return apply_arrays(parted, fit_arrays(parted.filter("split = 'train'")))


def split_rows(matrices: Matrices, seed: int = 42, ids: bool = True) -> dict[str, Encoded]:
    """Each dataset split and written once, in the columns of its source.

    Without ``ids`` row_id is left out: it takes more space than all features,
    and a description of the rows does not need it.
    """
    parted = split_each({n: e.rows for n, e in matrices.encoded.items()}, seed)
    tasks = {name: spec.task for name, spec in matrices.specs.items()}
    written = write_each({n: f if ids else f.drop("row_id") for n, f in parted.items()}, tasks)
    return {n: Encoded(f, matrices.encoded[n].values) for n, f in written.items()}


def scaled_each(parts: Mapping[str, Encoded], tasks: Mapping[str, str], fit_on: str = "all") -> dict[str, DataFrame]:
    """Imputed and standardised rows of each dataset: by expressions on reading, or written where the features are an array."""
    only = F.lit(True) if fit_on == "all" else F.col("split") == fit_on
    wide = {n: e.frame() for n, e in parts.items() if e.values is None}
    narrow = {n: e for n, e in parts.items() if n not in wide}
    # Two numbers per feature, at most COLUMNS features a table.
    rows = [e.fitted(only).select(F.lit(n).alias("name"), "stats") for n, e in narrow.items()]
    found = {r["name"]: r["stats"] for r in reduce(DataFrame.unionByName, rows).collect()} if rows else {}
    if wide:
        stats = measured(fit_arrays(reduce(DataFrame.unionByName, wide.values()).filter(only)))
        wide = write_each({n: apply_arrays(f, stats) for n, f in wide.items()}, tasks)
    return {n: narrow[n].scaled(found[n]) if n in narrow else wide[n] for n in parts}


def prepared_table(matrices: Matrices, seed: int = 42, fit_on: str = "train") -> DataFrame:
    """:func:`prepared` of all datasets, whose rows are written once; encoding and scaling are expressions on reading."""
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    parts = split_rows(matrices, seed)
    tasks = {name: spec.task for name, spec in matrices.specs.items()}
    return reduce(DataFrame.unionByName, scaled_each(parts, tasks, fit_on).values())
