"""One classification tree of any size, grown where its rows lie.

The tree is MLlib's: Gini impurity, up to BINS bins a feature, the first best
split wins, sibling leaves of one class are one leaf. Only the way there differs.
Rows are replaced by their bins and counted, so rows alike in all bins and the
label are one cell. Nodes of many cells are split by histograms that are added up
over all tasks, a level a pass; a node whose cells fit into a task is grown to its
leaves there. The driver holds the nodes above those subtrees, whose number is
that of the cells by TASK_CODES, and none of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.session import cut_lineage

#: Bins of a feature, at most; rows, about, that its thresholds are taken from, as by MLlib (the tree itself grows on all rows).
BINS, THRESHOLD_ROWS = 32, 10_000
#: Classes that may be inferred from labels.
CLASSES = 100
#: Bin codes (cells times features) of a subtree that one task grows; counters of histograms made at a time.
TASK_CODES, COUNTERS = 1 << 20, 1 << 22
#: An impurity below this is none.
PURE = float(np.finfo(float).eps)

NODES = "depth int, leaf boolean, prediction double, feature int, n_rows long, gain double"


@dataclass(frozen=True)
class Size:
    rows: int
    features: int
    classes: int


def checked(rows: DataFrame) -> Size:
    """The size of a table to learn from; a label or value that no tree can be grown on is an error."""
    label = F.col("label").cast("double")
    bad_label = label.isNull() | F.isnan(label) | (label < 0) | (label != F.floor(label))
    bad_value = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    seen = rows.agg(
        F.count("*").alias("n"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"), F.max(label).alias("top"),
        F.count_if(bad_label).alias("labels"), F.count_if(F.col("features").isNull() | bad_value).alias("values"),
    ).first()
    if not seen["n"]:
        raise ValueError("no rows to grow a tree on")
    if seen["labels"] or seen["top"] >= CLASSES:
        raise ValueError(f"labels must be whole numbers from 0 to {CLASSES - 1}, not null or NaN")
    if seen["values"] or seen["least"] != seen["most"] or not seen["most"]:
        raise ValueError("features must be equally many finite numbers in every row")
    return Size(seen["n"], seen["most"], int(seen["top"]) + 1)


def cut_points(values: np.ndarray, counts: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Up to `most` thresholds between ascending distinct values, all of them or those nearest to even shares of the counts.

    Values are other than 0; what lacks from the expected count is that of 0.
    """
    rest = expected - counts.sum()
    if rest > PURE * counts.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts.astype(float), at, rest)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    sums = np.cumsum(counts, dtype=float)
    step = expected / (most + 1)
    out, target = [], step
    for i in range(len(middle)):
        if abs(sums[i] - target) < abs(sums[i + 1] - target):
            out.append(middle[i])
            target += step
    return np.array(out)


def _drawn(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that MLlib's trees take thresholds from; a data frame's own sample would be other rows."""
    spark = rows.sparkSession
    number = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    frame = rows._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(frame.javaRDD().sample(False, share, number), frame.schema()), spark)


def thresholds(rows: DataFrame, size: Size, seed: int) -> list[np.ndarray]:
    """Ascending thresholds per feature: a row a feature, so it fits the driver."""
    most, share = min(BINS, size.rows) - 1, min(1.0, THRESHOLD_ROWS / size.rows)
    own = rows.select("features")
    cells = (_drawn(own, share, seed) if share < 1 else own).select(F.posexplode("features").alias("feature", "value"))
    values = cells.where("value != 0").groupBy("feature", "value").agg(F.count("*").alias("n"))
    expected = share * size.rows

    def cut(key: tuple[int, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        return pd.DataFrame({"feature": [key[0]], "cuts": [cut_points(pdf["value"].to_numpy(), pdf["n"].to_numpy(), expected, most)]})

    out = [np.zeros(0)] * size.features
    for row in values.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect():
        out[row["feature"]] = np.array(row["cuts"])
    return out


def _coded(cuts: Sequence[np.ndarray]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)
            ends = np.arange(len(codes) + 1, dtype=np.int32) * len(cuts)
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([packed, batch["label"].cast(pa.int32())], ["codes", "label"])

    return each


def _codes(column: pa.Array, features: int) -> np.ndarray:
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32, 1, column.offset * 4)[0] if len(column) else 0
    return np.frombuffer(data, np.uint8, len(column) * features, first).reshape(-1, features) if len(column) else np.zeros((0, features), np.uint8)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity of counts by class, the last axis; subtracted class by class, so that equal gains stay equal."""
    total = counts.sum(axis=-1)
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / np.maximum(total, 1)
        out -= share * share
    return np.where(total > 0, out, 0.0)


def best_splits(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, feature, bin, class): the gain of each node's first best split, its feature and its last bin to the left."""
    total = table[:, 0].sum(axis=1)
    left = table.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    n_left, n_right, n = left.sum(axis=-1), right.sum(axis=-1), np.maximum(total.sum(axis=-1), 1)[:, None, None]
    gain = _impurity(total)[:, None, None] - n_left / n * _impurity(left) - n_right / n * _impurity(right)
    gain = np.where((n_left > 0) & (n_right > 0), gain, -np.inf).reshape(len(table), -1)
    if not gain.shape[1]:
        none = np.zeros(len(table), np.int64)
        return np.full(len(table), -np.inf), none, none
    which = gain.argmax(axis=1)
    return gain[np.arange(len(table)), which], which // left.shape[2], which % left.shape[2]


@dataclass
class Tree:
    """Nodes in order of their making, children after their parent; a node without children is a leaf."""

    depth: list[int] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)

    def add(self, depth: int, counts: np.ndarray) -> int:
        for column, value in ((self.depth, depth), (self.counts, counts), (self.gain, 0.0), (self.feature, -1), (self.bin, -1), (self.left, -1)):
            column.append(value)
        return len(self.depth) - 1

    def split(self, at: int, gain: float, feature: int, bin_: int, left: np.ndarray, right: np.ndarray) -> int:
        """The first of two new children; the other follows it."""
        self.gain[at], self.feature[at], self.bin[at] = float(gain), int(feature), int(bin_)
        self.left[at] = self.add(self.depth[at] + 1, left)
        self.add(self.depth[at] + 1, right)
        return self.left[at]

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The node without children that each row of codes comes to."""
        feature, bin_, left = (np.array(v) for v in (self.feature, self.bin, self.left))
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows):
            rows = rows[left[at[rows]] >= 0]
            old = at[rows]
            at[rows] = left[old] + (codes[rows, feature[old]] > bin_[old])
        return at

    def pruned(self, grown: dict[int, float | None] | None = None) -> pd.DataFrame:
        """The NODES that are left when sibling leaves of one class are merged, with their numbers.

        `grown` has the nodes whose subtrees were grown elsewhere: the class of those that ended as a leaf, else None.
        """
        counts = np.array(self.counts)
        leaf, kept, prediction = np.array(self.left) < 0, np.ones(len(counts), bool), counts.argmax(axis=1).astype(float)
        for at, value in (grown or {}).items():
            leaf[at] = value is not None
            kept[at] = value is not None
            prediction[at] = 0.0 if value is None else value
        for at in range(len(counts) - 1, -1, -1):
            l, r = self.left[at], self.left[at] + 1
            if l >= 0 and leaf[l] and leaf[r] and prediction[l] == prediction[r]:
                leaf[at], prediction[at] = True, prediction[l]
                kept[l] = kept[r] = False
        gone = np.where(leaf, -1, self.feature)
        table = pd.DataFrame(
            {"node": np.arange(len(counts)), "depth": self.depth, "leaf": leaf, "prediction": prediction, "feature": gone, "n_rows": counts.sum(axis=1).astype(np.int64), "gain": np.where(leaf, 0.0, self.gain)}
        )
        return table[kept]


def grow(codes: np.ndarray, label: np.ndarray, n: np.ndarray, size: Size, start: int, depth: int) -> Tree:
    """The tree of cells that fit into a task; its root is at depth `start`."""
    d, classes = size.features, size.classes
    bins = int(codes.max(initial=0)) + 1
    tree = Tree()
    open_ = [tree.add(start, np.bincount(label, n, classes))]
    rows, of = np.arange(len(codes)), np.zeros(len(codes), np.int64)  # rows of open nodes and their nodes' places among these, ascending
    if start >= depth or _impurity(tree.counts[0]) < PURE:
        return tree
    most = max(1, COUNTERS // (d * bins * classes))
    while open_:
        ends = np.searchsorted(of, np.arange(len(open_) + 1))
        fresh, parts = [], []
        for first in range(0, len(open_), most):
            nodes = open_[first : first + most]
            own = slice(ends[first], ends[first + len(nodes)])
            mine, at = rows[own], of[own] - first
            cell = ((at[:, None] * d + np.arange(d)) * bins + codes[mine]) * classes + label[mine][:, None]
            table = np.bincount(cell.ravel(), np.repeat(n[mine], d), len(nodes) * d * bins * classes).reshape(len(nodes), d, bins, classes)
            gain, feature, bin_ = best_splits(table)
            child = np.full((len(nodes), 2), -1)
            for k in np.flatnonzero(gain > 0):
                total = table[k, 0].sum(axis=0)
                left = table[k, feature[k], : bin_[k] + 1].sum(axis=0)
                made = tree.split(nodes[k], gain[k], feature[k], bin_[k], left, total - left)
                for side, counts in enumerate((left, total - left)):
                    if tree.depth[made] < depth and _impurity(counts) >= PURE:
                        child[k, side] = len(fresh)
                        fresh.append(made + side)
            to = child[at, (codes[mine, feature[at]] > bin_[at]).astype(np.int64)]
            parts.append((mine[to >= 0], to[to >= 0]))
        rows, of = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.argsort(of, kind="stable")
        rows, of, open_ = rows[order], of[order], fresh
    return tree


def _counted(tree: Tree, nodes: Sequence[int], size: Size, bins: int):
    """Histograms of `nodes` over a task's cells, a row per node and feature; behind the classes, how many cells there are."""
    d, width = size.features, size.classes + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.depth), -1)
        slot[list(nodes)] = np.arange(len(nodes))
        table = np.zeros((len(nodes), d, bins, width), np.int64)
        for batch in batches:
            codes = _codes(batch["codes"], d)
            at = slot[tree.places(codes)]
            here = at >= 0
            cell = (((at[here][:, None] * d + np.arange(d)) * bins) + codes[here]) * width
            np.add.at(table.ravel(), cell + batch["label"].to_numpy()[here][:, None], batch["n"].to_numpy()[here][:, None])
            np.add.at(table.ravel(), cell + size.classes, 1)
        some = np.flatnonzero(table.any(axis=(1, 2, 3)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(nodes)[some], d), pa.int64()),
                pa.array(np.tile(np.arange(d), len(some)), pa.int32()),
                pa.array([h.tobytes() for k in some for h in table[k]], pa.binary()),
            ],
            ["node", "feature", "counts"],
        )

    return each


def _judged(size: Size, bins: int):
    """The best split of a node by one feature, from its histograms of all tasks; counts are by class, with the cells behind."""
    shape = (bins, size.classes + 1)

    def each(table: pa.Table) -> pa.Table:
        total = np.zeros(shape, np.int64)
        for counts in table["counts"]:
            total += np.frombuffer(counts.as_py(), np.int64).reshape(shape)
        gain, _, bin_ = best_splits(total[None, None, :, :-1].astype(float))
        left = total[: bin_[0] + 1].sum(axis=0)
        return pa.table(
            {
                "node": table["node"][:1], "feature": table["feature"][:1], "gain": pa.array(gain, pa.float64()), "bin": pa.array(bin_, pa.int32()),
                "left_counts": pa.array([left.tolist()], pa.list_(pa.int64())), "counts": pa.array([total.sum(axis=0).tolist()], pa.list_(pa.int64())),
            }
        )

    return each


_SPLIT = "node long, feature int, gain double, bin int, left_counts array<long>, counts array<long>"


def _top(cells: DataFrame, size: Size, bins: int, depth: int, most: int) -> tuple[Tree, list[int]]:
    """The tree down to nodes of `most` cells at most, and those of them that are still to be grown."""
    seen = cells.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()  # a row per class
    counts = np.zeros(size.classes)
    for row in seen:
        counts[row["label"]] = row["n"]
    tree, ready = Tree(), []
    open_ = [tree.add(0, counts)]
    if sum(row["cells"] for row in seen) <= most or depth < 1 or _impurity(counts) < PURE:
        return tree, open_
    together = max(1, COUNTERS // (size.features * bins * (size.classes + 1)))
    while open_:
        fresh = []
        for first in range(0, len(open_), together):
            counted = cells.mapInArrow(_counted(tree, open_[first : first + together], size, bins), "node long, feature int, counts binary")
            judged = counted.groupBy("node", "feature").applyInArrow(_judged(size, bins), _SPLIT)
            # The first feature wins among equal gains. A row per node that is too large for a task.
            best = judged.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("last"), "bin", "left_counts", "counts")).alias("s"))
            for row in best.select("node", "s.*").orderBy("node").collect():
                if not row["gain"] > 0:
                    continue
                left, total = np.array(row["left_counts"], float), np.array(row["counts"], float)
                made = tree.split(row["node"], row["gain"], -row["last"], row["bin"], left[:-1], total[:-1] - left[:-1])
                for side, part in enumerate((left, total - left)):
                    if tree.depth[made] < depth and _impurity(part[:-1]) >= PURE:
                        (ready if part[-1] <= most else fresh).append(made + side)
        open_ = fresh
    return tree, ready


def _routed(tree: Tree, ready: Sequence[int], features: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(len(tree.depth), bool)
        wanted[list(ready)] = True
        for batch in batches:
            at = tree.places(_codes(batch["codes"], features))
            rows = pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["root", *batch.schema.names])
            yield rows.filter(pa.array(wanted[at]))

    return each


def tree_nodes(rows: DataFrame, depth: int, seed: int = 42) -> tuple[DataFrame, Size]:
    """NODES of a classification tree on `rows` (features, label), written as a table, and the size of `rows`.

    Inner nodes have their split's feature and gain, leaves -1 and 0.
    """
    spark, size = rows.sparkSession, checked(rows)
    cuts = thresholds(rows, size, seed)
    bins = max(len(c) for c in cuts) + 1
    coded = rows.select("features", "label").mapInArrow(_coded(cuts), "codes binary, label int")
    cells = cut_lineage(coded.groupBy("codes", "label").agg(F.count("*").alias("n")))
    tree, ready = _top(cells, size, bins, depth, max(1, TASK_CODES // size.features))
    starts = {at: tree.depth[at] for at in ready}

    def subtree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        root = key[0].as_py()
        grown = grow(_codes(batch["codes"], size.features), batch["label"].to_numpy(), batch["n"].to_numpy().astype(float), size, starts[root], depth)
        out = grown.pruned().assign(root=root)
        return pa.Table.from_pandas(out[["root", "node", *(f.split()[0] for f in NODES.split(", "))]], schema=_subtree, preserve_index=False)

    grouped = cells.mapInArrow(_routed(tree, ready, size.features), "root long, codes binary, label int, n long").groupBy("root")
    below = cut_lineage(grouped.applyInArrow(subtree, f"root long, node long, {NODES}"))
    # Subtrees that ended as a leaf may merge with a sibling: a row per subtree.
    alone = (F.col("node") == 0) & F.col("leaf")
    ends = {row["root"]: row["prediction"] for row in below.where(alone).select("root", "prediction").collect()}
    above = tree.pruned({at: ends.get(at) for at in ready}).drop(columns="node")
    nodes = below.where(~alone).drop("root", "node")
    if len(above):
        nodes = nodes.unionByName(spark.createDataFrame(above, NODES))
    return cut_lineage(nodes), size


_subtree = pa.schema(
    [
        ("root", pa.int64()), ("node", pa.int64()), ("depth", pa.int32()), ("leaf", pa.bool_()), ("prediction", pa.float64()),
        ("feature", pa.int32()), ("n_rows", pa.int64()), ("gain", pa.float64()),
    ]
)
