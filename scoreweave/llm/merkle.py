"""Merkle manifest of a dataset: hash trees per group and over the groups, with a proof for every row.

Levels are worked out by lag and lead windows. The nodes of a group are numbered
from 0; the window partitions are aligned blocks of 3**HEIGHT nodes, so HEIGHT
levels take one shuffle, no window holds more than one block, and a group with
very many rows spreads over all executors. Block roots are the nodes of the next
tier, until one block holds every group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.storage import bounded
from scoreweave.session import cut_lineage

#: Children of a node.
FANOUT = 3
#: Levels worked out within one window partition of FANOUT**HEIGHT nodes.
HEIGHT = 5
BLOCK = FANOUT**HEIGHT
#: Columns that make a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of values, each written as its byte count, `:` and itself, or as `-` if it is null."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `_pos`, their number within the group, and `_n`, the group's size.

    Rows are spread by ranges of (group, order), so a large group lies on many
    partitions; what is counted is one row per partition and group.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(
        group,
        "_part",
        (F.col("_first") - F.sum("_rows").over(before) + F.col("_rows")).alias("_zero"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    numbered = ranged.join(bounded(starts), [group, "_part"])
    return numbered.withColumn("_pos", F.col("_at") - F.col("_zero")).drop("_at", "_part", "_zero")


def _tier(nodes: DataFrame) -> DataFrame:
    """Up to HEIGHT levels over nodes (_g, _pos, _n, _digest, ...).

    Adds `_block`, `_path`, the steps from the node up to its block's root, and
    `_top`, that root. A row whose number is divisible by 3**k stands for the
    node of level k that begins there.
    """
    window = Window.partitionBy("_g", "_block").orderBy("_pos")
    rows = nodes.withColumns({"_block": F.floor(F.col("_pos") / BLOCK).cast("long"), "_d0": F.col("_digest")})
    for k in range(HEIGHT):
        size = FANOUT**k
        own = f"_d{k}"
        slot = F.floor(F.col("_pos") / size) % FANOUT
        rows = rows.withColumns(
            {
                "_back2": F.lag(own, 2 * size).over(window),
                "_back1": F.lag(own, size).over(window),
                "_next1": F.lead(own, size).over(window),
                "_next2": F.lead(own, 2 * size).over(window),
            }
        )
        # What lies outside the run of three belongs to another parent; the last run may be shorter.
        left = F.concat(F.when(slot == 2, F.col("_back2")).otherwise(""), F.when(slot >= 1, F.col("_back1")).otherwise(""))
        right = F.concat(
            F.when(slot <= 1, F.coalesce("_next1", F.lit(""))).otherwise(""),
            F.when(slot == 0, F.coalesce("_next2", F.lit(""))).otherwise(""),
        )
        several = F.col("_n") > size
        rows = rows.withColumns(
            {
                f"_step{k}": F.when((F.col("_pos") % size == 0) & several, F.struct(left.alias("left"), right.alias("right"))),
                f"_d{k + 1}": F.when(
                    F.col("_pos") % (size * FANOUT) == 0, F.when(several, digest(F.col(own), right)).otherwise(F.col(own))
                ),
            }
        ).drop("_back2", "_back1", "_next1", "_next2", own)
    none = F.array().cast(f"array<{_STEP}>")
    rows = rows.withColumns({"_top": F.first(f"_d{HEIGHT}").over(window), "_path": none})
    for k in reversed(range(HEIGHT)):
        size = FANOUT**k
        slot = F.floor(F.col("_pos") / size) % FANOUT
        rows = rows.withColumns({"_up1": F.lag("_path", size).over(window), "_up2": F.lag("_path", 2 * size).over(window)})
        above = F.when(slot == 0, F.col("_path")).when(slot == 1, F.col("_up1")).otherwise(F.col("_up2"))
        step = F.when(F.col(f"_step{k}").isNotNull(), F.array(f"_step{k}")).otherwise(none)
        rows = rows.withColumn("_path", F.when(F.col("_pos") % size == 0, F.concat(step, above))).drop("_up1", "_up2", f"_step{k}")
    return rows.drop(f"_d{HEIGHT}")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Written tiers from the nodes up; in the last one every group is one block."""
    made = []
    while True:
        tier = cut_lineage(_tier(nodes))
        made.append(tier)
        largest = tier.agg(F.max("_n")).first()[0] or 0
        if largest <= BLOCK:
            return made
        nodes = tier.where(F.col("_pos") % BLOCK == 0).select(
            "_g", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / BLOCK).cast("long").alias("_n"), F.col("_top").alias("_digest")
        )


def _lengthened(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Rows of the lowest tier with the whole `_path`; `top` is the last tier with the path and other columns complete."""
    for tier in reversed(tiers[:-1]):
        own = [c for c in tier.columns if c not in ("_path", "_top")]
        above = top.select("_g", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), "_top", "_root")
        top = tier.drop("_top").join(above, ["_g", "_block"]).select(*own, F.concat("_path", "_above").alias("_path"), "_top", "_root")
    return top


def merkle_manifest(leaves: DataFrame, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """The columns of `leaves` with `subroot`, `root` and `path`, an array of (left, right) siblings from the leaf to the root.

    Within a group leaves ascend by `order_col`, nulls first, and among equal
    ones by the leaf, so repeated rows give the same tree however they lie.
    Every three consecutive nodes become the digest of their hex digests, also
    where the last run has fewer, while a group has several; the groups'
    subroots, ordered by the group's UTF-8 bytes with null first, likewise give
    the root. A null group is a group; a single leaf is its own subroot. Null
    leaves count as empty strings. An empty table gives an empty one. Columns
    named `subroot`, `root` or `path` are replaced.
    """
    names = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "path")]
    plain = leaves.select(F.struct(*names).alias("_row"))
    keyed = plain.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"_row.{group_col}").cast("string")), F.lit("")).alias("_g"),
        F.coalesce(f"_row.{leaf_col}", F.lit("")).alias("_digest"),
        F.col(f"_row.{order_col}").alias("_order"),
        "_row",
    )
    tiers = _tiers(_numbered(keyed, "_g", ["_order", "_digest"]).drop("_order"))
    groups = tiers[-1].where("_pos = 0").select(F.lit("").alias("_g"), F.col("_g").alias("_group"), F.col("_top").alias("_digest"))
    over = _tiers(_numbered(groups, "_g", ["_group"]))
    # All groups: their paths to the root, and the root beside each.
    path_of = cut_lineage(
        _lengthened(over, over[-1].withColumn("_root", F.col("_top"))).select(F.col("_group").alias("_g"), F.col("_path").alias("_above"), "_root")
    )
    last = tiers[-1].join(path_of, "_g").withColumn("_path", F.concat("_path", "_above")).drop("_above")
    return _lengthened(tiers, last).select(
        *(F.col("_row")[c].alias(c) for c in names), F.col("_top").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path")
    )


#: CRC-32 (reversed polynomial 0xEDB88320) of a string of ASCII characters, in SQL.
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
    "lambda x, zero: xor(x >> 1, 3988292384 * (x & 1))))))"
)


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _sql_tree(nodes: str, group: str, source: str) -> str:
    """Recursive table of all nodes of all levels of each group, and each node's siblings beside it."""
    return f"""
{nodes}(g, lvl, idx, digest) AS (
  SELECT {group}
  UNION ALL
  SELECT g, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS several FROM {nodes}) WHERE several > 1 GROUP BY g, lvl, idx // 3
),
{source}_sides AS (
  SELECT *, count(*) OVER (PARTITION BY g, lvl) AS several,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {nodes} WINDOW run AS (PARTITION BY g, lvl, idx // 3 ORDER BY idx)
)"""


_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_sql_tree("nodes", "g, 0, pos, leaf FROM numbered", "node")},
tops AS (SELECT g, max_by(digest, lvl) AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM nodes GROUP BY g),
{_sql_tree("roots", "'', 0, pos, subroot FROM tops", "root")},
folded(g, pos, part, lvl, idx, digest, proof) AS (
  SELECT g, pos, 0, 0, pos, coalesce(tampered, leaf), '' FROM numbered
  UNION ALL
  SELECT f.g, f.pos, coalesce(t.part, f.part), CASE WHEN t.part = 1 THEN 0 ELSE f.lvl + 1 END, coalesce(t.pos, f.idx // 3),
    CASE WHEN t.part = 1 THEN f.digest ELSE sha256(s.before || f.digest || s.after) END,
    CASE WHEN t.part = 1 THEN f.proof ELSE f.proof || s.before || s.after END
  FROM folded f
  JOIN (SELECT 0 AS part, * FROM node_sides UNION ALL SELECT 1, * FROM root_sides) s
    ON s.part = f.part AND s.g = CASE WHEN f.part = 0 THEN f.g ELSE '' END AND s.lvl = f.lvl AND s.idx = f.idx
  LEFT JOIN (SELECT 1 AS part, g, pos FROM tops) t ON f.part = 0 AND s.several = 1 AND t.g = f.g
  WHERE s.several > 1 OR f.part = 0
)
SELECT n.doc_id, n.leaf, t.subroot, r.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = r.root AS verified
FROM numbered n
JOIN tops t ON t.g = n.g
JOIN (SELECT max_by(digest, lvl) AS root, max(lvl) AS height FROM roots) r ON true
JOIN folded f ON f.g = n.g AND f.pos = n.pos AND f.part = 1 AND f.lvl = r.height
"""


@query(_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' manifest, and every row checked against it after line feeds were deleted from some of the texts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fields = {c: F.col(c) for c in COLUMNS}
    leaf = leaf_digest(*fields.values())
    cut = leaf_digest(*(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut)
    made = merkle_manifest(docs.select("doc_id", "source", leaf.alias("leaf"), tampered.alias("tampered")))
    checked = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
