"""Exact removal of long repeated passages: seed on winnowed anchors, extend, keep maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.words import runs, signed, span_hashes, windows
from scoreweave.session import cut_lineage

#: Words of an anchor. A window of `min_words` has min_words - ANCHOR + 1 of them; the least hash is its seed.
ANCHOR = 8
_ANCHOR_BASE, _WINDOW_BASE, _RUN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _seeded(run, min_words: int) -> tuple[np.ndarray, ...]:
    """Window starts, their documents and their seeds, and where a new stretch of one seed begins."""
    hashes = run.hashes()
    starts, docs = windows(run.word_at, min_words)
    if not len(starts):
        return hashes, starts, docs, np.zeros(0, np.uint64), np.zeros(0, bool)
    anchor = min(ANCHOR, min_words)
    at = np.arange(len(hashes) - anchor + 1)
    least = _rolling_min(span_hashes(hashes, at, at + anchor, _ANCHOR_BASE), min_words - anchor + 1)
    seeds = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (docs[1:] != docs[:-1])
    return hashes, starts, docs, seeds, new


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _anchors(min_words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            _, _, docs, seeds, new = _seeded(run, min_words)
            yield pa.RecordBatch.from_arrays(
                [run.table["_doc"], run.table["_h1"], run.table["_h2"], _lists(signed(seeds[new]), np.bincount(docs[new], minlength=run.docs))],
                ["_doc", "_h1", "_h2", "seeds"],
            )

    return each


def _stretches(min_words: int):
    """Of every document, the stretches of windows whose seed other documents have too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            hashes, starts, docs, seeds, new = _seeded(run, min_words)
            if not len(starts):
                continue
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(starts)))
            wanted, of = run.table["shared"].flatten().to_numpy(zero_copy_only=False), run.table["shared"].value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(run.docs), of)
            # A stretch is wanted if its (document, seed) is among the pairs asked for.
            ask = np.unique(np.rec.fromarrays([of, wanted], names="d,s"))
            have = np.rec.fromarrays([docs[first], signed(seeds[first])], names="d,s")
            spot = np.minimum(np.searchsorted(ask, have), max(len(ask) - 1, 0))
            take = ask[spot] == have if len(ask) else np.zeros(len(have), bool)
            first, count = first[take], count[take]
            if not len(first):
                continue
            every = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            window = span_hashes(hashes, starts[every], starts[every] + min_words, _WINDOW_BASE)
            whole = span_hashes(hashes, starts[first], starts[first] + count - 1 + min_words, _RUN_BASE)
            doc = docs[first]
            yield pa.RecordBatch.from_arrays(
                [
                    run.table["_doc"].take(pa.array(doc)),
                    run.table["_h1"].take(pa.array(doc)),
                    pa.array(signed(seeds[first])),
                    pa.array(signed(whole)),
                    pa.array((starts[first] - run.word_at[doc]).astype(np.int64)),
                    pa.array(count.astype(np.int64)),
                    _lists(signed(window), count),
                ],
                ["_doc", "_h1", "seed", "whole", "start", "n", "windows"],
            )

    return each


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, start, n): n windows of `min_words` words from word `start` on occur in a document with a smaller id.

    `start` -1 stands for a whole text of which a copy has a smaller id.

    1. Every window is seeded by its least anchor hash, so equal windows have
       equal seeds. Whole copies are left to one of them.
    2. Seeds that several documents have are joined back; only their windows
       are looked at further.
    3. A seed extends both ways as far as the windows that share it. Stretches
       equal in whole are settled by one row; where stretches differ, their
       windows are matched one by one. No pairs are built: every step keeps
       the smallest document of a key, combined before the shuffle, and joins
       it back, so a passage in a third of all documents is split like any
       skewed join.

    Hashes are 64 bits for seeds and 64 for windows, compared together. Rows
    without id are left out; a repeated row gives its spans once or more.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns({"_h1": F.xxhash64("text"), "_h2": F.hash("text")})
    seeded = cut_lineage(texts.mapInArrow(_anchors(min_words), "_doc long, _h1 long, _h2 int, seeds array<long>"))
    firsts = seeded.groupBy("_h1", "_h2").agg(F.min("_doc").alias("first"))
    judged = seeded.join(firsts, ["_h1", "_h2"])
    copies = judged.where("_doc > first and size(seeds) > 0").select("_doc", "_h1").distinct()
    alone = judged.where("_doc = first").select("_doc", "_h1", F.explode("seeds").alias("seed"))
    # Written before it is joined, so that the join has an exchange of its own that adaptive execution can split.
    shared = cut_lineage(alone.groupBy("seed").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi")).where("lo < hi").select("seed"))
    wanted = alone.join(shared, "seed").groupBy("_doc", "_h1").agg(F.collect_set("seed").alias("shared"))
    found = texts.select("_doc", "_h1", "text").join(wanted, ["_doc", "_h1"])
    stretches = cut_lineage(
        found.mapInArrow(_stretches(min_words), "_doc long, _h1 long, seed long, whole long, start long, n long, windows array<long>")
    )
    wholes = cut_lineage(stretches.groupBy("seed", "whole").agg(F.min("_doc").alias("first")))
    unsettled = cut_lineage(wholes.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed"))
    known = stretches.drop("windows").join(wholes, ["seed", "whole"])
    repeats = known.where("_doc > first").select("_doc", "_h1", "start", "n")
    heads = stretches.join(wholes.join(unsettled, "seed"), ["seed", "whole"]).where("_doc = first")
    single = heads.select("_doc", "_h1", "seed", "start", F.posexplode("windows").alias("i", "window")).select(
        "_doc", "_h1", "seed", "window", (F.col("start") + F.col("i")).alias("start")
    )
    bounds = single.groupBy("seed", "window").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
    earliest = cut_lineage(bounds.where("first < last").drop("last"))
    matched = single.join(earliest, ["seed", "window"]).where("_doc > first").select("_doc", "_h1", "start", F.lit(1).cast("long").alias("n"))
    whole = copies.select("_doc", "_h1", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))
    return repeats.unionByName(matched).unionByName(whole).select(F.col("_doc").alias("doc"), F.col("_h1").alias("text_hash"), "start", "n")


def _cut(min_words: int, with_text: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            n_words = np.diff(run.word_at)
            spans = run.table["spans"].flatten()
            of = np.repeat(np.arange(run.docs), run.table["spans"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = np.asarray(spans.field("start"), np.int64)
            windows_n = np.asarray(spans.field("n"), np.int64)
            begin = np.where(start < 0, run.word_at[of], run.word_at[of] + start)
            end = np.where(start < 0, run.word_at[of + 1], begin + windows_n + min_words - 1)
            depth = np.zeros(len(run.starts) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
            kept = np.cumsum(depth[:-1]) == 0
            keep_at = np.zeros(len(kept) + 1, np.int64)
            np.cumsum(kept, out=keep_at[1:])
            n_kept = np.diff(keep_at[run.word_at])
            starts, ends = run.starts[kept], run.ends[kept]
            last = np.zeros(len(starts), bool)
            tails = np.cumsum(n_kept) - 1
            last[tails[n_kept > 0]] = True
            data = run.data.copy()
            data[ends[~last]] = 0x20
            change = np.zeros(len(data) + 1, np.int32)
            change[starts] += 1
            np.add.at(change, ends + ~last, -1)
            out = data[np.cumsum(change[:-1]) > 0]
            sizes = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(ends + ~last - starts, out=sizes[1:])
            at = sizes[np.concatenate([[0], np.cumsum(n_kept)])]
            view = memoryview(out)
            arrays = [
                pa.array(n_words.astype(np.int64)),
                pa.array((n_words - n_kept).astype(np.int64)),
                pa.array([hashlib.sha256(view[at[i] : at[i + 1]]).hexdigest() for i in range(run.docs)]),
            ]
            names = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([bytes(view[at[i] : at[i + 1]]).decode() for i in range(run.docs)], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([run.table["_key"], *arrays], ["_key", *names])

    return each


def substring_dedup(
    docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Remove every word inside a window of `min_words` words that a document with a smaller id has too.

    Words are runs of other than ASCII blanks. Windows are judged on the input.
    Returns per row: the id, n_words, n_removed, kept_sha256 and, `with_text`,
    the kept words joined by one space. Null and empty texts have no words. A
    row with a null id is never judged and loses nothing. Repeated rows stay,
    each with the same result; rows of one id do not count against each other.
    Other columns of `docs` are not used and may have any names.
    """
    spans = repeated_spans(docs, min_words, id_col, text_col)
    marks = spans.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    texts = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = texts.join(
        marks, (F.col("_key").cast("long") == F.col("doc")) & (F.xxhash64("text") == F.col("text_hash")), "left"
    ).select("_key", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_key {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return marked.mapInArrow(_cut(min_words, with_text), schema).withColumnRenamed("_key", id_col)


@query()
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words that an earlier document has, removed from all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return substring_dedup(docs, min_words=50, with_text=False)
