"""Exact k-nearest-neighbour join.

Reference rows are split into Voronoi cells around a few pivots, and large cells
into leaves around pivots of their own, so that leaves keep their size as the
rows grow. A query first searches its own leaf, which bounds how far its k-th
neighbour can be; the triangle inequality then names the other leaves it must
still visit. A query that would have to visit very many, as in spaces of high
dimension, visits whole cells instead, so its copies stay bounded. Work is cut
into tiles of bounded size (a piece of a leaf's queries against a piece of its
references), so neither a crowded leaf nor a crowded query set lands in one
task, and a tile emits k rows per query, never its pairs. No candidate is left
out: the result equals brute force, ties going to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions.hashing import seeded
from scoreweave.session import cut_lineage

MAX_PIVOTS = 64
ROWS_PER_PIVOT = 512
#: References of a leaf, about, and the bytes that the pivots of all leaves may take; leaves a query visits one by one.
ROWS_PER_LEAF = 2048
LEAF_BYTES = 32 << 20
VISITS = 64
TILE = 4096
QUERY_BLOCK = 512
#: Rows per different vector from which equal ones are put together.
COPIES = 2
SLACK = 1e-9
TIE_DIGITS = 10  # distances equal to this many decimals are ties


def _stack(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy())


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Powered distances: squared for p=2, plain for p=1 and for the largest coordinate (inf)."""
    if p != 2:
        fold = np.add if p == 1 else np.maximum
        out = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            fold(out, np.abs(a[:, i, None] - b[None, :, i]), out=out)
        return out
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        out += gap * gap
    return out


def _candidates(a: np.ndarray, b: np.ndarray, k: int, barred: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of all pairs that can be among the k nearest, infinity for the others and for barred ones.

    A matrix product around the references' centre finds them with a bound on
    its error; those within the bound are computed from the differences.
    """
    centre = b.mean(axis=0)
    u, v = a - centre, b - centre
    nu, nv = (u * u).sum(1), (v * v).sum(1)
    rough = nu[:, None] + nv[None, :] - 2.0 * (u @ v.T)
    error = 8 * a.shape[1] * np.finfo(float).eps * (nu + nv.max())[:, None]
    # Coordinates far from zero are themselves rounded when the centre is taken off.
    shift = np.finfo(float).eps * max(np.abs(a).max(), np.abs(b).max()) * np.sqrt(a.shape[1])
    error = error + 4 * shift * (np.sqrt(nu)[:, None] + np.sqrt(nv.max()) + shift)
    if barred is not None:
        rough[barred] = np.inf
    kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1 : min(k, rough.shape[1])]
    row, col = np.nonzero((rough <= kth + 2 * error) & np.isfinite(rough))
    out = np.full(rough.shape, np.inf)
    for start in range(0, len(row), 1 << 16):
        r, c = row[start : start + (1 << 16)], col[start : start + (1 << 16)]
        gap = a[r] - b[c]
        out[r, c] = (gap * gap).sum(axis=1)
    return out


def _root(powered: np.ndarray, p: float) -> np.ndarray:
    return np.sqrt(powered) if p == 2 else powered


def _nearest(block: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k smallest entries per row, earlier columns winning ties."""
    if block.shape[1] <= k:
        return np.ones(block.shape, dtype=bool)
    kth = np.partition(block, k - 1, axis=1)[:, k - 1 : k]
    closer = block < kth
    tied = block == kth
    room = k - closer.sum(axis=1, keepdims=True)
    return closer | (tied & (np.cumsum(tied, axis=1) <= room))


class _Pivots:
    """Pivot coordinates and what they say about cells; small and shipped with the tasks."""

    def __init__(self, points: np.ndarray, p: float):
        self.points, self.p = points, p
        self.between = _root(_distances(points, points, p), p)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return _root(_distances(x, self.points, self.p), self.p)

    def lower_bounds(self, to_pivots: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Nothing in cell j can be closer to the query than entry j."""
        bound = np.maximum(to_pivots - radius[None, :], 0.0)
        if self.p == 2:
            mine = to_pivots[np.arange(len(own)), own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (to_pivots**2 - mine[:, None] ** 2) / (2.0 * self.between[own])
            bound = np.maximum(bound, np.where(np.isfinite(plane), plane, 0.0))
        return bound

    def reach_of_k(self, to_pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
        """A distance within which at least k references are certain to lie."""
        upper = to_pivots + radius[None, :]
        order = np.argsort(upper, axis=1)
        enough = np.cumsum(np.take_along_axis(counts, order, axis=1), axis=1) >= k
        first = enough.argmax(axis=1)
        rows = np.arange(len(upper))
        return np.where(enough.any(axis=1), upper[rows, order[rows, first]], np.inf)


class _Leaves:
    """Pivots of all leaves, those of a cell side by side; ships with the tasks, LEAF_BYTES at most."""

    def __init__(self, pivots: _Pivots, own: dict[int, np.ndarray]):
        # A cell without pivots of its own is one leaf around the cell's pivot.
        self.pivots = pivots
        parts = [own.get(c, pivots.points[c : c + 1]) for c in range(len(pivots.points))]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.points = np.concatenate(parts)

    def of_cell(self, cell: int) -> slice:
        return slice(self.first[cell], self.first[cell + 1])

    def distances(self, x: np.ndarray, cell: int) -> np.ndarray:
        return _root(_distances(x, self.points[self.of_cell(cell)], self.pivots.p), self.pivots.p)

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell and leaf of each row, and its distances to both pivots."""
        d = self.pivots.to_pivots(x)
        cell = d.argmin(axis=1)
        leaf, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            own = self.distances(x[at], c)
            best = own.argmin(axis=1)
            leaf[at], near[at] = self.first[c] + best, own[np.arange(len(at)), best]
        return cell, leaf, d[np.arange(len(x)), cell], near


def _pieces(sizes: dict[int, int], cell):
    """How many tile-sized pieces the rows of a cell need; only those that need several are listed."""
    large = [F.lit(v) for c, n in sizes.items() if n > TILE for v in (int(c), -(-int(n) // TILE))]
    return F.coalesce(F.try_element_at(F.create_map(*large), cell), F.lit(1)) if large else F.lit(1)


def _tile_join(
    queries: DataFrame, q_sizes: dict[int, int], refs: DataFrame, r_sizes: dict[int, int], k: int, p: float, carry: dict[str, str],
    apart: bool = False,
) -> DataFrame:
    """Up to k nearest per query and tile, for queries and references of the same cell, and of different `g` if they are kept apart."""
    q_pieces, r_pieces = _pieces(q_sizes, F.col("cell")), _pieces(r_sizes, F.col("cell"))
    piece = lambda key, n: F.pmod(F.xxhash64(key), n.cast("bigint")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # A few cells are named; of many, those that only one side has are found empty by their task.
    listed = lambda df, sizes: df.filter(F.col("cell").isin(*sizes)) if len(sizes) <= MAX_PIVOTS else df
    q = listed(queries, r_sizes).select(
        "cell", "qid", F.col("x"), *["g"] * apart, piece("qid", q_pieces).alias("qp"), each(r_pieces).alias("rp")
    )
    ref = listed(refs, q_sizes).select(
        "cell", "rid", F.col("x"), *["g"] * apart, *carry, piece("rid", r_pieces).alias("rp"), each(q_pieces).alias("qp")
    )
    carried = list(carry)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: np.array([], dtype=object) for c in ("qid", "rid", "powered", *carried)})
        right = right.sort_values("rid", kind="stable")
        a, b = _stack(left["x"]), _stack(right["x"])
        found = []
        for start in range(0, len(a), QUERY_BLOCK):
            part = a[start : start + QUERY_BLOCK]
            barred = left["g"].to_numpy()[start : start + QUERY_BLOCK, None] == right["g"].to_numpy()[None, :] if apart else None
            block = _candidates(part, b, k, barred) if p == 2 else _distances(part, b, p)
            if barred is not None:
                block[barred] = np.inf
            block = np.round(block, TIE_DIGITS)
            row, col = np.nonzero(_nearest(block, k) & np.isfinite(block))
            found.append((row + start, col, block[row, col]))
        row, col, powered = (np.concatenate(part) for part in zip(*found, strict=True))
        picked = right.iloc[col]
        return pd.DataFrame(
            {
                "qid": left["qid"].to_numpy()[row],
                "rid": picked["rid"].to_numpy(),
                "powered": powered,
                **{c: picked[c].to_numpy() for c in carried},
            }
        )

    schema = "qid string, rid string, powered double" + "".join(f", {c} {t}" for c, t in carry.items())
    keys = ["cell", "qp", "rp"]
    return q.groupBy(*keys).cogroup(ref.groupBy(*keys)).applyInPandas(search, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Top k per query; Spark trims each partition to k per query before the shuffle."""
    order = Window.partitionBy("qid").orderBy("powered", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _repeated(rows: DataFrame, group: Sequence[str]) -> tuple[int, bool]:
    """Number of rows, and whether they hold far fewer different vectors; either way the result is the same."""
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("features", *group))).first()
    return n, kinds * COPIES <= n


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, carry: Sequence[str] = ("label",), p: float = 2,
    max_pivots: int = MAX_PIVOTS, apart: str | None = None,
) -> DataFrame:
    """Rows (qid, rid, rank, distance, *carry): the k nearest references of every query.

    ``apart`` names a column of both inputs, such as a fold; a query then sees
    only references with another value of it.

    Both inputs have ``row_id`` and ``features``; ``carry`` names reference
    columns to bring along. ``p`` is 1
    (city block), 2 (Euclidean) or infinity (largest coordinate).

    Equal vectors are worked on once. References at the same place are equally
    far from everything, so only the k smallest ids of a place (and value of
    ``apart``) can be among k nearest; equal queries have equal neighbours.
    """
    group = [apart] if apart else []
    n_refs, crowded = _repeated(refs, group)
    if crowded:
        place = Window.partitionBy("features", *group).orderBy(F.col("row_id").cast("string").asc_nulls_last())
        refs = cut_lineage(refs.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= k).drop("_at"))
        n_refs = refs.count()
    if not _repeated(queries, group)[1]:
        return _search(queries, refs, n_refs, k, carry, p, max_pivots, apart)
    places = queries.select("features", *group).distinct().withColumn("row_id", F.monotonically_increasing_id().cast("string"))
    places = cut_lineage(places)
    found = cut_lineage(_search(places, refs, n_refs, k, carry, p, max_pivots, apart).withColumnRenamed("qid", "_place"))
    named = places.withColumnRenamed("row_id", "_place")
    own = queries.select(F.col("row_id").cast("string").alias("qid"), "features", *group).join(named, ["features", *group]).select("qid", "_place")
    # An id that queries share still has k neighbours in all.
    order = Window.partitionBy("qid").orderBy("distance", "rank", "rid")
    ranked = own.join(found, "_place").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("qid", "rid", "rank", "distance", *carry)


def _search(
    queries: DataFrame, refs: DataFrame, n_refs: int, k: int, carry: Sequence[str], p: float, max_pivots: int, apart: str | None
) -> DataFrame:
    """The join itself, of queries and of references whose number is known."""
    typed = {c: refs.schema[c].dataType.simpleString() for c in carry}
    group = [F.col(apart).cast("string").alias("g")] if apart else []
    grouped = ["g"] if apart else []
    wanted = int(min(max_pivots, max(1, n_refs // ROWS_PER_PIVOT)))
    # At most max_pivots vectors reach the driver.
    points = np.array(
        [row[0] for row in refs.orderBy(seeded(F.col("row_id"), 7), "row_id").limit(wanted).select("features").collect()],
        dtype=float,
    )
    points = np.unique(points, axis=0)
    pivots = _Pivots(points, p)

    leaves = _Leaves(pivots, _leaf_points(refs, pivots, n_refs))

    @F.pandas_udf("cell int, leaf int, reach double, near double")
    def locate(x: pd.Series) -> pd.DataFrame:
        cell, leaf, reach, near = leaves.locate(_stack(x))
        return pd.DataFrame({"cell": cell.astype("int32"), "leaf": leaf.astype("int32"), "reach": reach, "near": near})

    def placed(df: DataFrame, id_name: str, keep: Sequence[str]) -> DataFrame:
        out = df.select(F.col("row_id").cast("string").alias(id_name), F.col("features").alias("x"), *group, *keep)
        return cut_lineage(out.withColumn("at", locate("x")).select(*out.columns, "at.cell", "at.leaf", "at.reach", "at.near"))

    ref_rows, query_rows = placed(refs, "rid", list(carry)), placed(queries, "qid", [])
    by_leaf = lambda df: df.withColumn("cell", F.col("leaf")).drop("leaf", "reach", "near")
    # One row per leaf.
    stats = ref_rows.groupBy("cell", "leaf").agg(F.count("*").alias("n"), F.max("reach").alias("radius"), F.max("near").alias("near")).collect()
    r_sizes = {row["leaf"]: row["n"] for row in stats}
    q_sizes = {row["leaf"]: row["count"] for row in query_rows.groupBy("leaf").count().collect()}
    counts, radius = np.zeros(len(points)), np.full(len(points), -np.inf)
    leaf_radius = np.full(len(leaves.points), -np.inf)
    for row in stats:
        counts[row["cell"]] += row["n"]
        radius[row["cell"]] = max(radius[row["cell"]], row["radius"])
        leaf_radius[row["leaf"]] = row["near"]
    # Of each value of `apart`, the references it may see per cell.
    seen: dict[str, np.ndarray] = {}
    if apart:
        for row in ref_rows.groupBy("g", "cell").count().collect():
            seen.setdefault(row["g"], counts.copy())[row["cell"]] -= row["count"]

    near = _best(_tile_join(by_leaf(query_rows), q_sizes, by_leaf(ref_rows), r_sizes, k, p, typed, bool(apart)), k).drop("rank")
    if len(leaves.points) == 1:
        return _finish(near, k, p, list(carry))
    near = cut_lineage(near)
    so_far = near.groupBy("qid").agg(F.count("*").alias("n"), F.max("powered").alias("powered"))
    known = F.when(F.col("n") >= k, F.sqrt("powered") if p == 2 else F.col("powered")).otherwise(F.lit(float("inf")))
    bounded = query_rows.join(so_far, "qid", "left").select(
        "qid", "x", "cell", "leaf", F.coalesce(known, F.lit(float("inf"))).alias("theta"), (F.col("g") if apart else F.lit(None).cast("string")).alias("g")
    )

    @F.pandas_udf("array<int>")
    def still_to_visit(x: pd.Series, cell: pd.Series, leaf: pd.Series, theta: pd.Series, g: pd.Series) -> pd.Series:
        """Leaves, or as -1, -2, ... whole cells, that can hold one of the k nearest."""
        points_in, cells_in, leaves_in, known_in = _stack(x), cell.to_numpy(), leaf.to_numpy(), theta.to_numpy()
        groups = g.to_numpy()
        out = []
        for start in range(0, len(points_in), QUERY_BLOCK):
            block = slice(start, start + QUERY_BLOCK)
            d, own = pivots.to_pivots(points_in[block]), cells_in[block]
            there = np.array([seen.get(own_group, counts) for own_group in groups[block]]) if seen else np.broadcast_to(counts, d.shape)
            reach = np.minimum(known_in[block], pivots.reach_of_k(d, there, radius, k)) * (1 + SLACK) + SLACK
            open_cells = (pivots.lower_bounds(d, own, radius) <= reach[:, None]) & (counts[None, :] > 0)
            visits = [[] for _ in own]
            for c in np.flatnonzero(open_cells.any(axis=0)):
                rows = np.flatnonzero(open_cells[:, c])
                within = leaves.of_cell(c)
                open_leaves = leaves.distances(points_in[block][rows], c) - leaf_radius[within][None, :] <= reach[rows, None]
                at, which = np.nonzero(open_leaves)
                for i, found in zip(rows[at], which + within.start, strict=True):
                    if found != leaves_in[start + i]:
                        visits[i].append((found, -1 - c))
            for own_visits in visits:
                several = len(own_visits) > VISITS and len(leaves.points) > len(pivots.points)
                ids = {cell for _, cell in own_visits} if several else [found for found, _ in own_visits]
                out.append(np.array(sorted(ids), "int32"))
        return pd.Series(out)

    visits = cut_lineage(
        bounded.select("qid", "x", *grouped, F.explode(still_to_visit("x", "cell", "leaf", "theta", "g")).alias("cell"))
    )
    v_sizes = {row["cell"]: row["count"] for row in visits.groupBy("cell").count().collect()}
    targets, coarse = by_leaf(ref_rows), min(v_sizes, default=0) < 0
    if coarse:
        targets = targets.unionByName(ref_rows.withColumn("cell", -1 - F.col("cell")).drop("leaf", "reach", "near"))
        r_sizes = r_sizes | {-1 - c: int(n) for c, n in enumerate(counts) if n}
    found = near.unionByName(_tile_join(visits, v_sizes, targets, r_sizes, k, p, typed, bool(apart)))
    # A whole cell holds the query's own leaf again.
    return _finish(found.dropDuplicates(["qid", "rid"]) if coarse else found, k, p, list(carry))


def _leaf_points(refs: DataFrame, pivots: _Pivots, n_refs: int) -> dict[int, np.ndarray]:
    """Pivots of the leaves of each cell that is large enough to have several: rows taken by a hash of their ids."""
    width = pivots.points.shape[1] if len(pivots.points) else 1
    wanted = min(n_refs // ROWS_PER_LEAF, LEAF_BYTES // (8 * max(1, width)))
    if wanted <= len(pivots.points):
        return {}
    share = F.conv(F.substring(seeded(F.col("row_id"), 11), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # About `wanted` rows, LEAF_BYTES together.
    taken = refs.filter(share < wanted / n_refs).select("features").collect()
    if not taken:
        return {}
    points = np.unique(np.array([r[0] for r in taken], float), axis=0)
    cell = pivots.to_pivots(points).argmin(axis=1)
    return {int(c): points[cell == c] for c in np.unique(cell) if (cell == c).sum() > 1}


def _finish(found: DataFrame, k: int, p: float, carry: list[str]) -> DataFrame:
    distance = F.sqrt("powered") if p == 2 else F.col("powered")
    return _best(found, k).select("qid", "rid", "rank", distance.alias("distance"), *carry)


def vote(neighbours: DataFrame, n_classes: int, weights: str = "uniform") -> DataFrame:
    """Class shares among the neighbours; the smallest class wins a tie."""
    shares = neighbours.groupBy("qid").agg(
        # k entries per query
        F.collect_list(F.struct("label", _weight(weights).alias("w"))).alias("near")
    )
    total = F.aggregate("near", F.lit(0.0), lambda s, z: s + z["w"])
    probability = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda c: F.aggregate(
            "near", F.lit(0.0), lambda s, z: s + F.when(z["label"] == c, z["w"]).otherwise(0.0)
        ) / total,
    )
    return shares.select("qid", probability.alias("probability")).withColumn(
        "prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    )


def average(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    w = _weight(weights)
    return neighbours.groupBy("qid").agg((F.sum(F.col("label") * w) / F.sum(w)).alias("prediction"))


def _weight(weights: str):
    if weights == "uniform":
        return F.lit(1.0)
    if weights == "distance":
        # An exact match outweighs everything else.
        return 1.0 / F.greatest(F.col("distance"), F.lit(1e-150))
    raise ValueError(f"unknown weights {weights!r}")
