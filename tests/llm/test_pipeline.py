"""The pipeline's rows against plain versions of its stages."""

import pytest

import corpus_pipeline
from scoreweave.llm.quality import THRESHOLD, fit, score
from scoreweave.llm.surrogates import find_entities
from tests.llm import brute
from tests.llm.test_text_operators import check_packing

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, made[-1], SMALL))
    read = [{r["doc_id"]: r for r in d.collect()} for d in made[:5]]
    assert all(d.columns == docs.columns for d in made[1:5])
    model = fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(read[1]) == {r["doc_id"] for r in score(docs, model).collect() if r["score"] >= THRESHOLD}
    groups = brute.jaccard([(d, r["text"]) for d, r in read[1].items()])
    assert set(read[2]) == {d for d, _, c in groups if d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.contained([(d, r["text"]) for d, r in read[2].items()], items, 10)
    assert set(read[3]) == {x[0] for x in hit if not x[5]}
    assert set(read[4]) == set(read[3])
    for d, r in read[4].items():
        before = read[3][d]
        assert r["n_chars"] == (len(r["text"]) if find_entities(before["text"]) else before["n_chars"])
        assert not {m.canonical for m in find_entities(r["text"])} & {m.canonical for m in find_entities(before["text"])}
    assert check_packing(made[5].collect(), [(d, r["text"]) for d, r in read[4].items()]) == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", range(5))
def test_empty_and_null(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    function = corpus_pipeline.STAGES[stage][1]
    function(spark, docs.limit(0), SMALL).collect()
    odd = docs.limit(3).unionByName(docs.selectExpr("doc_id + 5000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars").limit(2))
    odd = odd.selectExpr("*", "1 AS score", "2 AS hits", "3 AS n_entities", "4 AS component_id")
    function(spark, odd, SMALL).collect()
