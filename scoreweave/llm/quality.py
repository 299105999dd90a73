"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.words import _BYTE_VALUES, LOWER, mix, pieces, span_hashes, text_buffer
from scoreweave.session import cut_lineage

#: Weights of the model: 2**BITS, whatever the corpus.
BITS = 18
#: Labelled documents the model is fitted on, at most; taken by a hash of their ids.
SAMPLE = 8192
EPOCHS = 3
THRESHOLD = 0.7
HELD_OUT = 2  # crc32(id as text) mod 4

#: 0 blank, 1 letter or digit or any byte of a longer character, 2 sign.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words and word pairs of all texts, the texts they are in, and how many each text has.

    A word is a run of letters and digits, lower-cased in ASCII, or a run of
    signs. A pair of equal words, next to each other or with one between,
    also counts as the n-gram "x x" or "x _ x", whatever the word.
    """
    data, at = text_buffer(column)
    kinds = _KINDS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kinds[1:] != kinds[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = kinds[starts] != 0
    starts, ends = starts[solid], ends[solid]
    hashes = span_hashes(_BYTE_VALUES[LOWER[data]], starts, ends)
    docs = np.searchsorted(at, starts, side="right") - 1
    near = docs[1:] == docs[:-1]
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[near]
    twice = [docs[gap:][(docs[gap:] == docs[:-gap]) & (hashes[gap:] == hashes[:-gap])] for gap in (1, 2)]
    shapes = [np.full(len(x), mix(np.array([gap], np.uint64))[0]) for gap, x in enumerate(twice, 1)]
    slots = np.concatenate([hashes, pairs, *shapes]) >> np.uint64(64 - bits)
    of = np.concatenate([docs, docs[1:][near], *twice])
    return slots.astype(np.int64), of, np.bincount(of, minlength=len(column))


@dataclass
class Model:
    """z and n of every slot, the bias in the last place; weights follow from them."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3

    @classmethod
    def empty(cls, bits: int) -> Model:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        small = np.abs(z) <= self.l1
        return np.where(small, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _scale(counts: np.ndarray) -> np.ndarray:
    """A text's n-grams weigh SCALE together, however long it is."""
    return 16.0 / np.maximum(counts, 1)


def _vectors(bits: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            slots, of, _ = features(batch["text"], bits)
            key, n = np.unique(of << bits | slots, return_counts=True)
            at = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1))
            packed = [_pack(key[a:b] & ((1 << bits) - 1), n[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_order"], batch["label"], pa.array(packed, pa.binary())], ["_order", "label", "grams"])

    return each


def _pack(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """A text's slots and how often each occurs, compressed: the task of an epoch gets the whole sample in few batches."""
    return zlib.compress(np.stack([np.diff(slots, prepend=0), counts]).astype(np.int32).tobytes(), 1)


def _unpack(grams: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The slots, and the weight of each."""
    steps, counts = np.frombuffer(zlib.decompress(grams), np.int32).astype(np.int64).reshape(2, -1)
    return np.cumsum(steps), counts * _scale(counts.sum())


def _epoch(state: Model, bits: int):
    """One pass over the sample in a fixed order; memory is the model and one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state
        for batch in batches:
            for label, grams in zip(batch["label"].to_pylist(), batch["grams"], strict=True):
                at, x = _unpack(grams.as_buffer())
                model.learn(np.append(at, 1 << bits), np.append(x, 1.0), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.z.tobytes()]), pa.array([model.n.tobytes()])], ["z", "n"])

    return each


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on at most `sample` labelled documents whose crc32(id) mod 4 is not 2.

    Which ones depends on a hash of the ids alone. Several label rows of one
    document count as their mean; null labels and ids are passed over, and of
    rows that repeat an id one is used. Feature vectors are made on all
    executors; an epoch is one bounded task that streams them through the
    model, whose 2**bits weights are all that reaches the driver. Without a
    usable label the model is empty and scores 0.5.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != HELD_OUT))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.avg(label_col).alias("label"))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(sample)
    )
    known = cut_lineage(known)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most `sample` rows of three numbers, so the broadcast is bounded.
    chosen = texts.join(F.broadcast(known), "_id").select("_order", "label", "text")
    one_each = chosen.groupBy("_order").agg(F.min(F.struct("text", "label")).alias("v")).select("_order", "v.label", "v.text")
    vectors = cut_lineage(one_each.mapInArrow(_vectors(bits), "_order long, label double, grams binary"))
    model = Model.empty(bits)
    ordered = vectors.repartition(1).sortWithinPartitions("_order")
    for _ in range(epochs):
        row = ordered.mapInArrow(_epoch(model, bits), "z binary, n binary").first()
        if row is None:
            break
        model.z, model.n = np.frombuffer(row["z"]).copy(), np.frombuffer(row["n"]).copy()
    return model


def score(docs: DataFrame, model: Model, bits: int = BITS, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """`columns` of `docs` (all, if not given) and `score` in 0..1, the sigmoid of a sparse dot product over the whole text.

    Null and empty texts get the score of the bias. A column already named `score` is replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights())
    keep = [c for c in columns or docs.columns if c.lower() != "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in pieces(batches, "_text"):
            slots, of, counts = features(batch["_text"], bits)
            sums = np.bincount(of, weights=w[slots], minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(sums * _scale(counts) + w[-1], -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p)], [*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(each, schema)


@query()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labelled ones that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model, columns=["doc_id"]).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
