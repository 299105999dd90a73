"""Toxicity by multiple-instance learning: sentences carry scores, a noisy-or makes the document's, only documents are labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from scoreweave.llm import query
from scoreweave.llm.words import _BYTE_VALUES, LOWER, mix, pieces, span_hashes, text_buffer
from scoreweave.session import cut_lineage

#: Weights of the model: 2**BITS, whatever the corpus.
BITS = 18
#: Labelled documents the model is fitted on, at most; taken by a hash of their ids.
SAMPLE = 8192
EPOCHS = 5
THRESHOLD = 0.5
#: A sentence ends at one of `.!?` or a line's end, and after so many words.
SENTENCE_WORDS = 64
#: Bytes of the word beginnings that count as features beside the words.
BEGINNINGS = (4, 5, 6)
HELD_OUT = 0  # crc32(id as text) mod 5

_SPANS = ArrayType(StructType().add("start", "long").add("end", "long").add("score", "double"))

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Sentences:
    """Features of the sentences of some documents."""

    slots: np.ndarray  # of each feature
    of: np.ndarray  # the sentence it is in
    first: np.ndarray  # first sentence of each document, one more than documents
    starts: np.ndarray  # byte offset of each sentence's first word in its document
    ends: np.ndarray  # byte offset after its last word


def sentences(column: pa.Array, bits: int = BITS) -> Sentences:
    """Words and word beginnings of every sentence, lower-cased in ASCII and hashed to slots.

    A word is a run of letters, digits and bytes of longer characters.
    """
    data, at = text_buffer(column)
    letters = np.append(_LETTERS[data], False)
    change = np.ones(len(data) + 1, bool)
    change[1:] = letters[1:] != letters[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = letters[starts]
    starts, ends = starts[solid], ends[solid]
    docs = np.searchsorted(at, starts, side="right") - 1
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS[data], out=stops[1:])
    new = np.ones(len(starts), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    heads = np.flatnonzero(new)
    inside = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    new |= inside % SENTENCE_WORDS == 0
    of = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1
    values = _BYTE_VALUES[LOWER[data]]
    words = span_hashes(values, starts, ends)
    found, where = [words], [of]
    for n in BEGINNINGS:
        long = ends - starts >= n
        found.append(mix(span_hashes(values, starts[long], starts[long] + n) + np.uint64(n)))
        where.append(of[long])
    base = at[docs[heads]]
    return Sentences(
        (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64),
        np.concatenate(where),
        np.searchsorted(docs[heads], np.arange(len(at))),
        starts[heads] - base,
        ends[tails] - base,
    )


def noisy_or(z: np.ndarray) -> float:
    """The chance that at least one sentence is toxic, from the sentences' log-odds."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


@dataclass
class Model:
    """Follow-the-regularised-leader state of every slot, the bias in the last place."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 1e-3
    prior: float = -4.0  # log-odds of a sentence without any weight

    @classmethod
    def empty(cls, bits: int = BITS) -> Model:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, which: np.ndarray, of: np.ndarray, label: float) -> None:
        """One step on the noisy-or likelihood of a document: features at[which] in sentences `of`.

        With p the sentences' chances and P the document's, the log-likelihood
        has the slope p (1 - P) / P in a toxic document's log-odds, else -p: a
        toxic document pulls up the sentences that are likeliest already.
        """
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        odds = np.clip(np.bincount(of, weights=w[which], minlength=1) + w[-1] + self.prior, -35, 35)
        p = 1 / (1 + np.exp(-odds))
        total = np.logaddexp(0, odds).sum()
        slope = p * (1 - label) - label * p / np.expm1(min(total, 700.0))
        g = np.append(np.bincount(which, weights=slope[of], minlength=len(at) - 1), slope.sum())
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _vectors(bits: int):
    """Per text its distinct slots, and for each feature the place of its slot and its sentence."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = sentences(batch["text"], bits)
            docs = np.searchsorted(s.first, s.of, side="right") - 1
            order = np.argsort(docs, kind="stable")
            bounds = np.searchsorted(docs[order], np.arange(batch.num_rows + 1))
            rows = []
            for i in range(batch.num_rows):
                own = order[bounds[i] : bounds[i + 1]]
                at, which = np.unique(s.slots[own], return_inverse=True)
                rows.append((at, which.astype(np.int32), (s.of[own] - s.first[i]).astype(np.int32)))
            lists = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["_order"], batch["label"], *lists], ["_order", "label", "at", "which", "sentence"])

    return each


def _epoch(state: Model):
    """One pass over the sample in a fixed order; memory is the model and one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state
        for batch in batches:
            columns = (batch["at"], batch["which"], batch["sentence"])
            for label, at, which, of in zip(batch["label"].to_pylist(), *columns, strict=True):
                if len(at):
                    model.learn(*(x.values.to_numpy() for x in (at, which, of)), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.z.tobytes()]), pa.array([model.n.tobytes()])], ["z", "n"])

    return each


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id must not be learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == HELD_OUT


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on at most `sample` labelled documents whose crc32(id) mod 5 is not 0.

    Which ones depends on a hash of the ids alone. Several label rows of one
    document count as their mean; null labels and ids are passed over, and of
    rows that repeat an id one is used. Texts without a word teach nothing.
    Features are made on all executors; an epoch is one bounded task that
    streams them through the model, whose 2**bits weights are all that reaches
    the driver. Without a usable label the model has no weights.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
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
    vectors = cut_lineage(one_each.mapInArrow(_vectors(bits), "_order long, label double, at array<long>, which array<int>, sentence array<int>"))
    model = Model.empty(bits)
    ordered = vectors.repartition(1).sortWithinPartitions("_order")
    for _ in range(epochs):
        row = ordered.mapInArrow(_epoch(model), "z binary, n binary").first()
        if row is None:
            break
        model.z, model.n = np.frombuffer(row["z"]).copy(), np.frombuffer(row["n"]).copy()
    return model


def score(
    docs: DataFrame,
    model: Model,
    bits: int = BITS,
    text_col: str = "text",
    columns: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`columns` of `docs` (all, if not given), `score` in 0..1 and `offending`.

    `offending` lists the sentences whose own score reaches the threshold, as
    (start, end, score) with byte offsets in the UTF-8 text; where the document
    reaches it and no sentence alone does, its highest sentence. The score is
    the noisy-or over all sentences of the whole text. Null texts and texts
    without a word have no sentence and score as one sentence without features.
    Columns already named `score` or `offending` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights())
    prior = model.prior
    keep = [c for c in columns or docs.columns if c.lower() not in ("score", "offending")]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        alone = float(np.clip(w[-1] + prior, -35, 35))
        for batch in pieces(batches, "_text"):
            s = sentences(batch["_text"], bits)
            odds = np.clip(np.bincount(s.of, weights=w[s.slots], minlength=len(s.starts)) + w[-1] + prior, -35, 35)
            sums = np.zeros(len(odds) + 1)
            np.cumsum(np.logaddexp(0, odds), out=sums[1:])
            none = s.first[1:] == s.first[:-1]
            whole = np.where(none, np.logaddexp(0, alone), sums[s.first[1:]] - sums[s.first[:-1]])
            p, own = -np.expm1(-whole), 1 / (1 + np.exp(-odds))
            bad = own >= threshold
            docs_of = np.repeat(np.arange(batch.num_rows), np.diff(s.first))
            quiet = (p >= threshold) & ~none & (np.bincount(docs_of, weights=bad, minlength=batch.num_rows) == 0)
            for i in np.flatnonzero(quiet):
                bad[s.first[i] + np.argmax(own[s.first[i] : s.first[i + 1]])] = True
            at = np.searchsorted(docs_of[bad], np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(s.starts[bad]), pa.array(s.ends[bad]), pa.array(own[bad])], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(at), spans)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p), lists], [*keep, "score", "offending"])

    schema = docs.select(*keep).schema.add("score", "double").add("offending", _SPANS)
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(each, schema)


@query()
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out, with its offending sentences."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model, columns=["doc_id"]).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )
