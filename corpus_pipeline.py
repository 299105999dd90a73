"""Documents to training sequences, stage by stage; every stage is one of the operators in scoreweave.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm.decontaminate import decontaminate
from scoreweave.llm.jaccard_join import jaccard_components
from scoreweave.llm.packing import pack_sequences
from scoreweave.llm.quality import THRESHOLD, fit, score
from scoreweave.llm.surrogates import replace_personal_data
from scoreweave.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on labelled documents outside the held-out quarter."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*COLUMNS), model).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id; a row that repeats it goes too. Rows without id stay."""
    groups = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    # Written first: the ids are then joined without the operator's plan below them.
    kept = docs.select(*COLUMNS).join(cut_lineage(groups), "doc_id", "left_semi")
    one_each = kept.dropDuplicates(["doc_id"])
    return one_each.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs.select(*COLUMNS), items).where("not contaminated").select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew where the text changed."""
    replaced = replace_personal_data(docs.select(*COLUMNS))
    length = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_private),
    ("packing", pack),
]

#: The classifier and the packing cannot be said in SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
