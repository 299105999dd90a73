"""Connected components of a link table, without the driver or one task holding any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreweave.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighbourhood to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its smaller neighbours to itself and the others."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `links`; component is the smallest reachable id.

    Alternates the two star operations until the table stays the same, which
    takes logarithmically many rounds. Minima combine before the shuffle and
    the joins keep one row per node on one side, so a node with very many
    links is split by adaptive execution. Self links and links with a null end
    are ignored; an empty table gives an empty one. Each round is cut into the
    shared checkpoint folder.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = cut_lineage(edges)
    known = _fingerprint(edges)
    for _ in range(rounds):
        if known[0] == 0:
            break
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = _fingerprint(edges)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)
