"""The manifest against a plain tree: lone leaves, short last runs, null and clashing columns, repeated rows, several tiers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scoreweave.llm import merkle
from scoreweave.llm.merkle import BLOCK, fold, leaf_digest, merkle_manifest, op13_merkle_manifest, proof_digest

SMALL = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """The root of a list of digests, and each one's siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            k = at[i] // 3 * 3
            path.append(("".join(nodes[k : at[i]]), "".join(nodes[at[i] + 1 : k + 3])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """(group, id, leaf) rows with subroot, root and path."""
    groups = {}
    for g, i, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf or "", leaf))
    order = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    made = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, over = climb([made[g][0] for g in order])
    out = []
    for g, above in zip(order, over, strict=True):
        for (known, i, _, leaf), path in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1], strict=True):
            out.append((g, i if known else None, leaf, made[g][0], root, tuple(path + above)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in df.collect()), key=str)


@pytest.mark.parametrize("height", [2, 5])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3**height)
    sizes = {"a": 1, "b": 2, "c": 3, "é": 4, "": 10, None: 28, "z": 3 * 3**height + 1 if height < 5 else 2}
    rows = [(g, i * 7 % n, h(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    rows += [("a", None, h("x")), ("a", None, None), ("b", 1, h("tie")), ("b", 1, h("tie")), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").selectExpr("*", "1 AS _pos", "2 AS Root", "3 AS path", "4 AS _g")
    got = merkle_manifest(df.repartition(5))
    assert rows_of(got) == plain(rows)
    assert {"_pos", "_g"} < set(got.columns)
    kept = got.select(fold(F.coalesce("leaf", F.lit("")), F.col("path")).alias("folded"), "root", proof_digest(F.col("path")).alias("p"), "path")
    for r in kept.collect():
        assert r["folded"] == r["root"] and r["p"] == h(*(x for step in r["path"] for x in step))


def test_a_group_over_several_blocks(spark):
    n = 2 * BLOCK + 5
    df = spark.range(n).selectExpr("CAST(NULL AS STRING) AS source", "id AS doc_id", "sha2(CAST(id AS STRING), 256) AS leaf").repartition(7)
    assert rows_of(merkle_manifest(df)) == plain([(None, i, h(str(i))) for i in range(n)])


def test_empty_table_and_leaf(spark):
    none = spark.createDataFrame([], "source string, doc_id long, leaf string")
    assert merkle_manifest(none).count() == 0
    row = spark.createDataFrame([(1, None, "é\n")], "a long, b string, c string")
    assert row.select(leaf_digest(F.col("a"), F.col("b"), F.col("c"))).first()[0] == h("1:1", "-", "3:é\n")


def test_query(spark):
    rows = op13_merkle_manifest(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(rows) == docs.count() and len({r["root"] for r in rows}) == 1
    broken = {r["doc_id"] for r in docs.where("crc32(CAST(doc_id AS STRING)) % 2 = 0 AND contains(text, '\n')").collect()}
    assert broken and {r["doc_id"] for r in rows if not r["verified"]} == broken
