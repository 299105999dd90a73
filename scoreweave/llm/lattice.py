"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, several tables, probed neighbours."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.components import components
from scoreweave.llm.words import mix, signed
from scoreweave.session import cut_lineage

#: Tables; E8 blocks of a cell (8 projections each); neighbours probed; lattice steps per unit of length.
TABLES, BLOCKS, PROBES, STEPS = 6, 2, 10, 4.0
#: Bits of the sign signature that candidates are compared by before vectors are fetched, and its slack in deviations.
SIGN_BITS, SLACK = 128, 4.5
SEED = 20


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are whole and sum to an even number."""
    out = np.rint(x)
    rest = x - out
    odd = np.flatnonzero(out.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    out[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: E8 is D8 and D8 shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    near = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(near[:, None], whole, half)


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@functools.cache
def _projections(size: int, tables: int, blocks: int, steps: float) -> tuple[np.ndarray, np.ndarray]:
    """One (size, 8 * blocks) matrix per table with orthogonal columns where they fit, and directions for signs."""
    rng = np.random.default_rng(SEED + size)
    made = [rng.normal(size=(size, 8 * blocks)) for _ in range(tables)]
    made = [np.linalg.qr(m)[0] if size >= 8 * blocks else m / math.sqrt(size) for m in made]
    return np.stack(made) * steps * math.sqrt(size / 64), rng.normal(size=(size, SIGN_BITS))


def _cell(points: np.ndarray, table: int, size: int) -> np.ndarray:
    """Cell numbers of lattice points (rows of 8 * blocks coordinates)."""
    twice = (points * 2).astype(np.int64).astype(np.uint64)
    out = np.full(len(points), np.uint64(table * 65_537 + size), np.uint64)
    for column in twice.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by dimension, with the rows they are of."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[(at[rows][:, None] + np.arange(size))]
        x = x / np.abs(x).max(axis=1)[:, None]
        yield rows, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _codes(tables: int, blocks: int, probes: int, steps: float):
    """Rows (cell, id, g1, g2): the own cell of each vector, and `probes` cells next to it, in every table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = neighbours()
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                ids = part["_id"].to_numpy(zero_copy_only=False)
                for rows, x in _matrix(part["vector"]):
                    matrices, directions = _projections(x.shape[1], tables, blocks, steps)
                    signs = np.packbits(x @ directions > 0, axis=1).view(np.int64)
                    for table, matrix in enumerate(matrices):
                        y = x @ matrix
                        centre = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
                        cells, who = [_cell(centre, table, x.shape[1])], [np.arange(len(x))]
                        if probes:
                            rest = y - centre
                            gain = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ roots.T for b in range(blocks)], axis=1)
                            best = np.argpartition(-gain, probes, axis=1)[:, :probes]
                            for k in best.T:
                                moved = centre.copy()
                                block, root = k // len(roots), roots[k % len(roots)]
                                moved[np.arange(len(x))[:, None], 8 * block[:, None] + np.arange(8)] += root
                                cells.append(_cell(moved, table, x.shape[1]))
                                who.append(np.arange(len(x)))
                        of = np.concatenate(who)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(np.concatenate(cells))), pa.array(ids[rows][of]), pa.array(signs[of, 0].copy()), pa.array(signs[of, 1].copy())],
                            ["cell", "id", "g1", "g2"],
                        )

    return each


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 4000):
            part = batch.slice(first, 4000)
            x, y = part["vx"], part["vy"]
            cos = np.full(part.num_rows, np.nan)
            sides = [list(_matrix(v)) for v in (x, y)]
            for rows, u in sides[0]:
                for others, w in sides[1]:
                    if u.shape[1] == w.shape[1]:
                        both, i, j = np.intersect1d(rows, others, return_indices=True)
                        cos[both] = (u[i] * w[j]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], part["na"], part["nb"], pa.array(cos)], ["a", "b", "na", "nb", "cosine"])


def vector_links(
    vectors: DataFrame,
    least: float = 0.9,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    probes: int = PROBES,
    steps: float = STEPS,
) -> DataFrame:
    """(a, b, na, nb, cosine) of the pairs found, from distinct (_id, na, vector); every pair once, a < b.

    A vector is filed in its own cell of every table and looks into that cell
    and the nearest others, so a pair meets if either looks into the other's
    cell. Cells are joined as a skew-aware join of ids and 128-bit sign
    signatures; pairs whose signatures are further apart than `least` allows
    (SLACK deviations) are passed over, the others' cosines are computed in
    double precision.
    """
    kind = "cell long, id long, g1 long, g2 long"
    slim = vectors.select("_id", "vector")
    filed = slim.mapInArrow(_codes(tables, blocks, 0, steps), kind)
    looks = slim.mapInArrow(_codes(tables, blocks, probes, steps), kind)
    share = math.acos(least) / math.pi
    most = int(SIGN_BITS * share + SLACK * math.sqrt(SIGN_BITS * share * (1 - share)))
    near = (
        filed.alias("f")
        .join(looks.alias("l"), "cell")
        .where("f.id <> l.id")
        .where(f"bit_count(f.g1 ^ l.g1) + bit_count(f.g2 ^ l.g2) <= {most}")
        .select(F.least("f.id", "l.id").alias("a"), F.greatest("f.id", "l.id").alias("b"))
        .distinct()
    )
    near = cut_lineage(near)
    full = near.join(vectors.select(F.col("_id").alias("a"), F.col("size").alias("na"), F.col("vector").alias("vx")), "a").join(
        vectors.select(F.col("_id").alias("b"), F.col("size").alias("nb"), F.col("vector").alias("vy")), "b"
    )
    return full.mapInArrow(_cosines, "a long, b long, na long, nb long, cosine double").where(F.col("cosine") >= least)


def embedding_components(
    table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **options
) -> DataFrame:
    """Per row: the id, n_links, component_id and kept (id = component_id).

    Rows link when their cosine is at least `least`; links are found by
    `vector_links`, and equal vectors always link, as one class. Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths never link. Rows that repeat an
    id and vector count as rows of their own; a null id has a null component.
    Other columns are not used.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False)
    )
    rows = table.select(F.col(id_col).cast("long").alias("_id"), F.when(sound & F.col(id_col).isNotNull(), vector).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.hash("vector"), "sound": F.col("vector").isNotNull()})
    usable = rows.where("sound")
    classes = cut_lineage(usable.groupBy("h1", "h2").agg(F.min("_id").alias("_id"), F.count("*").alias("size")))
    heads = cut_lineage(usable.join(classes, ["h1", "h2", "_id"]).select("_id", "size", "vector").dropDuplicates(["_id", "vector"]))
    links = cut_lineage(vector_links(heads, least, **options))
    ends = links.select(F.col("a").alias("id"), F.col("nb").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.col("na").alias("n")))
    counts = ends.groupBy("id").agg(F.sum("n").alias("linked"))
    labels = classes.join(counts, F.col("_id") == F.col("id"), "left").drop("id")
    labels = labels.join(components(links), F.col("_id") == F.col("id"), "left").select(
        "h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "_id").alias("component")
    )
    labels = cut_lineage(labels)
    # Rows that link with nothing are spread by their ids instead of sharing the hash of null.
    keyed = rows.select("_id", "sound", F.when(F.col("sound"), F.col("h1")).otherwise(F.xxhash64("_id")).alias("h1"), "h2")
    out = keyed.join(labels.withColumn("sound", F.lit(True)), ["h1", "h2", "sound"], "left")
    component = F.coalesce("component", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


@query()
def op7_lattice_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """Components of vectors with cosine 0.9 and more."""
    return embedding_components(spark.read.parquet(f"{folder}/embeddings.parquet"))
