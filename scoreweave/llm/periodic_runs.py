"""Periodic runs of words: Lyndon arrays under both orders from a suffix sorter's grouping phase, roots extended into runs.

A run of period p holds a Lyndon word of length p, under one of the two orders
of the alphabet, that is the longest Lyndon word at its place. The first phase
of a grouping suffix sorter leaves every suffix in the group of its longest
Lyndon prefix, so the groups' lengths are the Lyndon array; no suffix is ever
sorted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from scoreweave.llm import query
from scoreweave.llm.words import Run, joined, mix, runs, span_hashes, windows

_RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping; symbols are 0, 1, ..., all of them used.

    Suffixes lie in groups that share a prefix, and groups are taken from the
    greatest down. The suffixes before which a group's members stand (the
    nearest to the left in a lower group) get its prefix appended, once for each
    member that names them: they move to the upper end of their group and form a
    new one there. A group's number is the place where it begins in the order.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group = [0] * n, [0] * n
    size, width = [0] * n, [1] * n  # of the group that begins at a place: members, prefix length
    begin = 0
    for at, i in enumerate(order):
        if symbols[i] != symbols[order[begin]]:
            begin = at
        place[i], group[i] = at, begin
        size[begin] += 1
    before, length = [-1] * n, [1] * n
    end = n
    while end:
        begin = group[order[end - 1]]
        own = width[begin]
        named: dict[int, int] = {}
        members = order[begin:end]
        if len(members) > 1:
            members.sort()
        for i in members:
            length[i] = own
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                named[j] = named.get(j, 0) + 1
        end = begin
        if not named:
            continue
        levels: dict[int, list[int]] = {}
        for j, times in named.items():
            levels.setdefault(times, []).append(j)
        for times in sorted(levels, reverse=True):
            old: dict[int, int] = {}
            for j in levels[times]:
                g = group[j]
                moved = old.get(g, 0) + 1
                old[g] = moved
                to, was = g + size[g] - moved, place[j]
                other = order[to]
                order[was], place[other] = other, was
                order[to], place[j] = j, to
            for j in levels[times]:
                g = group[j]
                # A group that moved whole keeps its place.
                group[j] = g + size[g] - old[g]
            for g, moved in old.items():
                left = size[g] - moved
                size[g] = left
                size[g + left] = moved
                width[g + left] = width[g] + times * own
    return length


def _extension(left: np.ndarray, right: np.ndarray) -> int:
    """Number of leading places at which both agree, compared in growing pieces."""
    n, at, step = min(len(left), len(right)), 0, 64
    while at < n:
        differ = left[at : min(at + step, n)] != right[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def find_runs(symbols: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal runs with length >= max(min_length, min_exponent * period); min_exponent is 2 at least."""
    n = len(symbols)
    known, ranks = np.unique(symbols, return_inverse=True)
    values = mix(ranks.astype(np.uint64) + np.uint64(1))
    found = set()
    for order in (ranks, len(known) - 1 - ranks):
        roots = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.arange(n)
        # A run of three periods has a root that is followed by itself; equal hashes are checked by the extension.
        fits = (roots <= n // min_exponent) & (at + roots * min(2, min_exponent - 1) <= n)
        at, roots = at[fits], roots[fits]
        twice = np.ones(len(at), bool)
        if min_exponent > 2:
            twice = span_hashes(values, at, at + roots) == span_hashes(values, at + roots, at + 2 * roots)
        ends: dict[int, int] = {}
        for i, p in zip(at[twice].tolist(), roots[twice].tolist(), strict=True):
            if i + p <= ends.get(p, -1):
                continue  # a root of the run found before
            right = i + p + _extension(ranks[i:], ranks[i + p :])
            start = i - _extension(ranks[:i][::-1], ranks[: i + p][::-1])
            ends[p] = right
            if right - start >= max(min_length, min_exponent * p):
                found.add((start, right - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(run: Run, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the stretches that can hold runs.

    In a run of L words the first L - p are repeated p words later, at least
    `size` of them in a row, so each of its words lies in a window of `size`
    words that its document holds twice. What lies in none is in no run, and a
    run never crosses it; equal hashes of different windows only add stretches.
    """
    size = min_length - min_length // min_exponent
    at, docs = windows(run.word_at, size)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = mix(span_hashes(run.hashes(), at, at + size) + docs.astype(np.uint64))
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    heads = at[twice[near] == keys]
    depth = np.zeros(len(run.starts) + 1, np.int64)
    depth[: len(run.starts)] += np.bincount(heads, minlength=len(run.starts))
    depth -= np.bincount(heads + size, minlength=len(depth))
    inside = np.cumsum(depth[:-1]) > 0
    edge = np.ones(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[run.word_at[(run.word_at > 0)]] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]] & (np.diff(cuts) >= min_length)
    return cuts[:-1][keep], cuts[1:][keep]


def _runs(min_length: int, min_exponent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            found: list[list[dict]] = [[] for _ in range(run.docs)]
            kept = np.ones(len(run.starts), bool)
            firsts, lasts = _stretches(run, min_length, min_exponent)
            text = run.data.tobytes() if len(firsts) else b""
            of = np.searchsorted(run.word_at, firsts, side="right") - 1
            for first, last, doc in zip(firsts.tolist(), lasts.tolist(), of.tolist(), strict=True):
                ids: dict[bytes, int] = {}
                spans = zip(run.starts[first:last].tolist(), run.ends[first:last].tolist(), strict=True)
                symbols = np.array([ids.setdefault(text[a:b], len(ids)) for a, b in spans], np.int64)
                base = first - int(run.word_at[doc])
                for start, length, period in find_runs(symbols, min_length, min_exponent):
                    found[doc].append({"start": base + start, "length": length, "period": period})
                    kept[first + start + period : first + start + length] = False
            texts = joined(run, kept)
            yield pa.RecordBatch.from_arrays(
                [
                    run.table["_key"],
                    pa.array(np.diff(run.word_at).astype(np.int64)),
                    pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    pa.array([x.decode() for x in texts], pa.string()),
                ],
                ["_key", "n_words", "runs", "collapsed"],
            )

    return each


def periodic_runs(
    docs: DataFrame, min_length: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row the id, `n_words`, `runs` (start, length, period; by start, then period) and `collapsed`.

    A run is a stretch of consecutive words with smallest period p and length
    >= max(min_length, min_exponent * p) that no neighbouring word extends
    keeping the period. `collapsed` is the text without the words that any run
    holds after its first p words, joined by one space. Words are runs of other
    than ASCII blanks, numbered from 0. Null and empty texts have no words, no
    run and an empty `collapsed`. Rows with a null id and repeated rows are kept,
    each judged alone; other columns are not used and may have any names.
    There is no shuffle: a task holds a piece of its rows, or one long text.
    """
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run repeats its root twice at least")
    texts = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType().add("_key", docs.schema[id_col].dataType).add("n_words", "long").add("runs", _RUNS).add("collapsed", "string")
    return texts.mapInArrow(_runs(min_length, min_exponent), schema).withColumnRenamed("_key", id_col)


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text; where crc32(id) ends in 0, the words from some place on repeat the period that begins there."""
    text, h = F.col(text_col), F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n, g = F.size(words).cast("long"), F.expr(f"crc32(CAST({id_col} AS STRING)) div 10")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    as_int = lambda x: x.cast("int")
    cycles = F.flatten(F.array_repeat(F.slice(words, as_int(a) + 1, as_int(p)), as_int(F.ceil((n - a) / p))))
    changed = F.concat_ws(" ", F.slice(words, F.lit(1), as_int(a)), F.slice(cycles, F.lit(1), as_int(n - a)))
    return docs.select(id_col, F.when(h % 10 == 0, F.when(n > 0, changed).otherwise(text)).otherwise(text).alias(text_col))


def strongest(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones that of smallest start, then period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least 24 words and three periods in every document, some of which are made periodic first."""
    docs = with_planted_periods(spark.read.parquet(f"{folder}/documents.parquet"))
    made = periodic_runs(docs, min_length=24, min_exponent=3).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
