"""Exact Jaccard join of word n-gram sets by rare-first prefix filtering, as components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from scoreweave.llm import query
from scoreweave.llm.components import components
from scoreweave.llm.storage import bounded
from scoreweave.llm.words import Run, mix, runs, signed, span_hashes
from scoreweave.session import cut_lineage

#: Words of a shingle, and the similarity in hundredths from which documents link.
SHINGLE, PERCENT = 5, 75
#: The frequency order reads a table of 2**SKETCH_BITS counters, whatever the corpus.
SKETCH_BITS, BLOCK = 20, 1 << 14
#: Postings of a join task, about; documents of one n-gram in a task; texts verified together; documents and bytes of
#: a block of bitmaps, at most; partial tables summed together.
BUCKET, HOT, TOGETHER, BLOCK_DOCS, BLOCK_BYTES, FAN_IN = 200_000, 100_000, 64, 1024, 1 << 23, 256
_BASE = 0xA0761D6478BD642F


def shingle_sets(run: Run, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a run: hashes, their documents, both sorted, and set sizes.

    A document with fewer words than `size`, but some, has its whole sequence as one.
    """
    hashes, count = run.hashes(), np.diff(run.word_at)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    docs = np.repeat(np.arange(run.docs), n)
    starts = np.arange(len(docs)) - np.repeat(np.cumsum(n) - n - run.word_at[:-1], n)
    shingles = span_hashes(hashes, starts, np.minimum(starts + size, run.word_at[docs + 1]), _BASE)
    order = np.lexsort((shingles, docs))
    shingles, docs = shingles[order], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (docs[1:] != docs[:-1])
    shingles, docs = shingles[new], docs[new]
    return shingles, docs, np.bincount(docs, minlength=run.docs)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return sums[at[1:]] - sums[at[:-1]]


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's two counters, one in each half of the table."""
    half = 1 << (SKETCH_BITS - 1)
    return (shingles >> np.uint64(65 - SKETCH_BITS)).astype(np.int64), half + (shingles & np.uint64(half - 1)).astype(np.int64)


def _frequency(counters: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """At least how often each shingle was counted: the lesser of its counters."""
    return np.minimum(*(counters[place] for place in _places(shingles)))


def _survey(size: int):
    """Per document its set's size and 128-bit signature; per task how often each counter's shingles occur."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.int64)
        for run in runs(batches, lower=True):
            shingles, _, n = shingle_sets(run, size)
            for place in _places(shingles):
                counters += np.bincount(place, minlength=len(counters))
            yield pa.RecordBatch.from_arrays(
                [
                    run.table["_doc"],
                    pa.array(n),
                    pa.array(signed(_sums(mix(shingles + np.uint64(1)), n))),
                    pa.array(signed(_sums(mix(shingles ^ np.uint64(_BASE)), n))),
                    pa.nulls(run.docs, pa.int32()),
                    pa.nulls(run.docs, pa.int64()),
                    pa.nulls(run.docs, pa.binary()),
                ],
                ["_doc", "n", "s1", "s2", "block", "part", "counts"],
            )
        blocks = np.flatnonzero(counters.reshape(-1, BLOCK).any(axis=1))
        if len(blocks):
            part = pa.array(np.full(len(blocks), TaskContext.get().partitionId(), np.int64))
            none = pa.nulls(len(blocks), pa.int64())
            rows = [counters[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(blocks.astype(np.int32)), part, pa.array(rows, pa.binary())],
                ["_doc", "n", "s1", "s2", "block", "part", "counts"],
            )

    return each


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for row in table["counts"].to_pylist():
        total += np.frombuffer(row, np.int64)
    return pa.table({"block": table["block"][:1], "part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(survey: DataFrame, parts: int) -> np.ndarray:
    """Counters summed over all tasks in a tree, so that no task adds more than FAN_IN tables."""
    tables = survey.where("block is not null").select("block", "part", "counts")
    while parts > 1:
        tables = tables.withColumn("part", F.expr(f"part div {FAN_IN}"))
        tables = tables.groupBy("block", "part").applyInArrow(_added, "block int, part long, counts binary")
        parts = -(-parts // FAN_IN)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in tables.select("block", "counts").toLocalIterator():  # at most 2**SKETCH_BITS / BLOCK rows
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return out


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its rarest shingles a set must show: any partner shares one of them."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _prefixes(sketch, size: int, percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = sketch.value
        for run in runs(batches, lower=True):
            shingles, docs, n = shingle_sets(run, size)
            s1, s2 = _sums(mix(shingles + np.uint64(1)), n), _sums(mix(shingles ^ np.uint64(_BASE)), n)
            seen = _frequency(counters, shingles)
            order = np.lexsort((shingles, seen, docs))
            first = np.cumsum(n) - n
            kept = prefix_sizes(n, percent)
            take = order[np.repeat(first - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())]
            at = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    run.table["_doc"],
                    pa.array(n),
                    pa.array(signed(s1)),
                    pa.array(signed(s2)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(signed(shingles[take]))),
                ],
                ["_doc", "n", "s1", "s2", "prefix"],
            )

    return each


def _postings(sketch, buckets: int, hot: int):
    """Postings of a batch, one row per bucket. N-grams that may be in more than `hot` documents are dealt over several.

    An n-gram travels as half its hash. Two that are taken for one make a larger group, whose pairs are verified as all are.
    Ids travel in halves too, as the upper ones are mostly alike and compress to nothing.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = sketch.value
        # What other shingles add to a counter grows with the corpus; only what stands out of it can be one frequent shingle.
        usual = int(2 * counters.sum() // len(counters))
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch["prefix"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = batch["prefix"].value_lengths().to_numpy(zero_copy_only=False)
            ids, n = batch["_doc"].to_numpy(zero_copy_only=False), batch["n"].to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shares = 1 + np.maximum(0, _frequency(counters, token) - usual) // hot
            salt = (mix(ids.astype(np.uint64) + np.uint64(7))[of] % shares.astype(np.uint64)).astype(np.int64)
            bucket = (mix(token ^ mix(salt.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            bounds = pa.array(np.append(at, len(order)).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(bounds, pa.array(x[order]))
                for x in (
                    (token >> np.uint64(32)).astype(np.uint32).view(np.int32), (ids >> 32).astype(np.int32)[of], ids.astype(np.int32)[of],
                    n[of].astype(np.int32), pos.astype(np.int32), salt.astype(np.int32), shares.astype(np.int32),
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][at]), *lists], ["bucket", "token", "upper", "lower", "n", "pos", "salt", "shares"]
            )

    return each


_FOUND = "kind string, token long, salt int, shares int, a long, an int, b long, bn int, members array<long>, same long"


def _similar_size(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(x, y) * 100 >= percent * np.maximum(x, y)


def _may_match(n1, p1, n2, p2, percent: int) -> np.ndarray:
    """Length filter, and positional filter for two sets whose first common n-gram is at these places."""
    most = 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
    return _similar_size(n1, n2, percent) & (most * (100 + percent) >= percent * (n1 + n2))


def _bucket_join(percent: int):
    """Of a bucket's n-grams: pairs with the smallest document; groups of three and more; leaders of dealt n-grams."""

    def each(table: pa.Table) -> pa.Table:
        column = lambda name, kind=np.int64: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]).astype(kind)
        token, upper, lower, n, pos, salt, shares = (column(x) for x in ("token", "upper", "lower", "n", "pos", "salt", "shares"))
        doc = (upper << 32) + (lower & 0xFFFFFFFF)
        order = np.lexsort((doc, salt, token))
        token, doc, n, pos, salt, shares = (x[order] for x in (token, doc, n, pos, salt, shares))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(token)))
        head = np.repeat(first, size)
        out = {k: [] for k in ("kind", "token", "salt", "shares", "a", "an", "b", "bn", "members", "same")}

        def add(kind, count, **values):
            out["kind"].append(pa.array([kind] * count, pa.string()))
            for name, type_ in (("token", pa.int64()), ("salt", pa.int32()), ("shares", pa.int32()), ("a", pa.int64()), ("an", pa.int32()), ("b", pa.int64()), ("bn", pa.int32()), ("members", pa.list_(pa.int64())), ("same", pa.int64())):
                v = values.get(name)
                out[name].append(pa.nulls(count, type_) if v is None else v.cast(type_) if isinstance(v, pa.Array) else pa.array(v, type_))

        pair = ~new & (doc[head] != doc) & _may_match(n[head], pos[head], n, pos, percent)
        pairs = np.unique(np.stack([doc[head][pair], n[head][pair], doc[pair], n[pair]], axis=1), axis=0)
        if len(pairs):
            add("pair", len(pairs), a=pairs[:, 0], an=pairs[:, 1], b=pairs[:, 2], bn=pairs[:, 3])
        dealt = new & (shares > 1)
        if dealt.any():
            add("leader", int(dealt.sum()), token=token[dealt], salt=salt[dealt], a=doc[dealt], an=n[dealt])
        # Groups with the same members are one; those of dealt n-grams keep their n-gram.
        sums = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(mix(doc.astype(np.uint64) + np.uint64(3)) * np.uint64(2) + n.astype(np.uint64), out=sums[1:])
        same = sums[first + size] - sums[first]
        wide = shares[first] > 1
        same = np.where(wide, mix(same ^ token[first].astype(np.uint64)), same)
        group = np.flatnonzero((size > 2) | wide)
        group = group[np.unique(same[group], return_index=True)[1]]
        if len(group):
            take = np.repeat(first[group] - (np.cumsum(size[group]) - size[group]), size[group]) + np.arange(size[group].sum())
            at = pa.array(np.concatenate([[0], np.cumsum(size[group])]).astype(np.int32))
            add(
                "group", len(group), token=token[first[group]], salt=salt[first[group]], shares=shares[first[group]], same=signed(same[group]),
                members=pa.ListArray.from_arrays(at, pa.array(doc[take])),
            )
        if not out["kind"]:
            add("pair", 0)
        return pa.table({k: pa.concat_arrays(v) for k, v in out.items()})

    return each


def _verified(size: int, percent: int):
    """Of one leader's candidates in a group, those that are similar enough; every text's set is made once."""

    def each(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets: dict[int, list[np.ndarray]] = {}
        row = 0
        for run in runs(iter([batch]), lower=True):
            shingles, _, n = shingle_sets(run, size)
            at = np.concatenate([[0], np.cumsum(n)])
            for i, doc in enumerate(run.table["doc"].to_pylist()):
                sets.setdefault(doc, []).append(shingles[at[i] : at[i + 1]])
            row += run.docs
        leader = batch["a"][0].as_py()
        a, b = [], []
        for doc, own in sets.items():
            if doc != leader and any(_similar(x, y, percent) for x in sets.get(leader, []) for y in own):
                a.append(leader)
                b.append(doc)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return each


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    # Suffix filter: the sets share at most the lesser count of every hash range.
    ranges = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) for s in (x, y)]
    most = int(np.minimum(*ranges).sum())
    if 100 * most < percent * (len(x) + len(y) - most):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` with their documents' texts; others' texts stay where they are while the list of ids is small."""
    named = texts.withColumnRenamed("_doc", "doc")
    return named.join(bounded(wanted.select("doc").distinct()), "doc", "left_semi").join(wanted, "doc")


def _verify(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among distinct pairs. A text travels once by its id and once per pair; a leader's once per TOGETHER partners."""
    counts = cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("k")))
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / TOGETHER)))
    dealt = cut_lineage(dealt.select("a", "b", "part"))
    roles = dealt.select(F.col("b").alias("doc"), "a", "part").unionByName(dealt.select(F.col("a").alias("doc"), "a", "part").distinct())
    return _texts_of(texts, roles).select("a", "part", "doc", "text").groupBy("a", "part").applyInArrow(_verified(size, percent), "a long, b long")


def _bitmaps(size: int, percent: int):
    """Of each document its set's size, and its set as a bitmap of 2**tier bits for every size class it can find partners in.

    Its own class has two to four bits a shingle; a set of class t has more than 2**(t - 2) shingles.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, lower=True):
            shingles, docs, n = shingle_sets(run, size)
            first = np.concatenate([[0], np.cumsum(n)])
            level = np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)
            spread = mix(shingles ^ np.uint64(_BASE))
            rows = []
            for i, doc in enumerate(run.table["_doc"].to_pylist()):
                own = spread[first[i] : first[i + 1]]
                tier = int(level[i])
                while tier == level[i] or n[i] * 100 >= percent << (tier - 2):
                    bits = np.zeros(1 << tier, np.uint8)
                    bits[(own >> np.uint64(64 - tier)).astype(np.int64)] = 1
                    rows.append((doc, int(n[i]), tier, tier == level[i], np.packbits(bits).tobytes()))
                    tier += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "tier", "native", "bits"])

    return each


def _met(percent: int):
    """Of a tile the pairs of different components that can be similar: a shingle's bit that the other lacks is a shingle it lacks."""

    def each(table: pa.Table) -> pa.Table:
        lo, hi = (table[c][0].as_py() for c in ("lo", "hi"))
        table = table.sort_by([("doc", "ascending")])
        doc, comp, n, native, block = (table[c].to_numpy() for c in ("doc", "component", "n", "native", "block"))
        bits = np.stack([np.frombuffer(b.as_py(), np.uint64) for b in table["bits"]])
        size = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        a, b = [], []
        other = np.flatnonzero(block == hi)
        for x in np.flatnonzero(block == lo):
            # Two documents of a lower class meet in their own tile.
            y = other[(comp[other] != comp[x]) & _similar_size(n[other], n[x], percent) & (native[other] | native[x])]
            if lo == hi:
                y = y[y > x]
            if not len(y):
                continue
            least = -(-percent * (n[x] + n[y]) // (100 + percent))
            both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1).astype(np.int64)
            # Every bit that the other's map lacks is at least one shingle that is not common.
            y = y[np.minimum(n[x] - size[x], n[y] - size[y]) + both >= least]
            a.append(np.minimum(doc[x], doc[y]))
            b.append(np.maximum(doc[x], doc[y]))
        out = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return each


def _unsettled_links(texts: DataFrame, groups: DataFrame, comps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links across components within n-gram groups that still lie in several.

    Open groups are gathered by the component most of their documents are in.
    Such a family splits into that component and the others, both dealt into
    blocks; a block of others meets every block of the family in a tile. Tiles
    hold bitmaps of sets, not texts, and one size class each: a document meets
    those of its own class, and of higher ones if it is large enough to link
    with them. Pairs that the bitmaps cannot rule out are verified as all are.
    """
    one = groups.groupBy("same").agg(F.first(F.struct("token", "shares", "members")).alias("g")).select("same", "g.*")
    # Groups of one dealt n-gram are one.
    wide = F.col("shares") > 1
    members = one.select(F.when(wide, F.col("token")).otherwise(F.col("same")).alias("key"), wide.alias("dealt"), F.explode("members").alias("id"))
    labelled = cut_lineage(members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = labelled.groupBy("key", "dealt", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("key", "dealt").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("top")).where("kinds > 1")
    homes = cut_lineage(open_.select("key", "dealt", F.col("top.component").alias("home")))
    placed = labelled.join(homes, ["key", "dealt"]).groupBy("home", "id").agg(F.first("component").alias("component"))
    placed = cut_lineage(placed.withColumn("outside", F.col("component") != F.col("home")))
    named = texts.join(bounded(placed.select(F.col("id").alias("_doc")).distinct()), "_doc", "left_semi")
    maps = cut_lineage(named.mapInArrow(_bitmaps(size, percent), "id long, n long, tier int, native boolean, bits binary").where("n > 0"))
    sized = cut_lineage(placed.join(maps.select("id", "tier", "native"), "id").distinct())
    bytes_each = F.expr("shiftleft(1L, tier - 3)")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_DOCS), F.floor(F.lit(BLOCK_BYTES) / bytes_each)))
    counts = cut_lineage(
        sized.groupBy("home", "tier")
        .agg(F.count_if("outside").alias("out"), F.count_if(~F.col("outside")).alias("in"), F.max("native").alias("any"))
        .where(F.col("any") & (F.col("out") > 0))
        .select("home", "tier", F.ceil(F.col("out") / room).cast("int").alias("outer"), F.ceil(F.col("in") / room).cast("int").alias("inner"))
    )
    # Blocks of others are 0, 1, ..; blocks of the home component follow them.
    block = F.when(F.col("outside"), F.expr("pmod(xxhash64(id), outer)")).otherwise(F.expr("outer + pmod(xxhash64(id), greatest(inner, 1))")).cast("int")
    dealt = sized.join(counts, ["home", "tier"]).withColumn("block", block)
    partners = F.when(F.col("outside"), F.expr("sequence(0, outer + inner - 1)")).otherwise(F.expr("sequence(0, outer - 1)"))
    tiles = dealt.withColumn("other", F.explode(partners)).select(
        "id", "home", "tier", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    full = cut_lineage(tiles.distinct()).join(maps, ["id", "tier"]).withColumnRenamed("id", "doc")
    pairs = cut_lineage(full.groupBy("home", "tier", "lo", "hi").applyInArrow(_met(percent), "a long, b long").distinct())
    return _verify(texts, pairs, size, percent)


def jaccard_components(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
    hot: int = HOT,
) -> DataFrame:
    """Per row: the id, n_shingles and component_id, the smallest id reachable by links.

    Documents link when 100 * intersection >= percent * union of their sets of
    `size`-word shingles (words: runs of other than ASCII blanks, lower-cased
    in ASCII; a shorter document is one shingle). Null and empty texts have
    empty sets and link with nothing; a null id gets a null component. Texts
    of a repeated id count as one document that has each of its rows' links.
    Other columns are not used.

    1. One scan surveys set sizes, 128-bit set signatures and a counter table
       of fixed size; equal sets are one class from here on.
    2. Each class posts its rarest shingles, as many as any partner must meet.
    3. Per n-gram every class is paired with the smallest one, under length
       and positional filters, and each distinct pair is verified once.
    4. Where a group of an n-gram still lies in several components, its
       documents' bitmaps are compared across components, block by block
       inside tasks; what they cannot rule out is verified. Pairs inside a
       component would not change the result.

    N-grams that may be in over `hot` documents are dealt over several groups,
    whose leaders are paired; step 4 takes them together again, in blocks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = texts.rdd.getNumPartitions()
    survey = cut_lineage(texts.mapInArrow(_survey(size), "_doc long, n long, s1 long, s2 long, block int, part long, counts binary"))
    rows = survey.where("block is null").select("_doc", "n", "s1", "s2")
    sketch = spark.sparkContext.broadcast(_sketch(survey, parts))
    named = texts.where("_doc is not null")
    posted = named.mapInArrow(_prefixes(sketch, size, percent), "_doc long, n long, s1 long, s2 long, prefix array<long>").where("n > 0")
    classes = posted.groupBy("s1", "s2").agg(F.min(F.struct("_doc", "n", "prefix")).alias("c")).select("s1", "s2", "c.*")
    total = rows.agg(F.sum(F.expr(f"n - ceil(n * {percent} / 100) + 1"))).first()[0] or 0
    buckets = max(1, int(total) // bucket)
    spread = classes.mapInArrow(
        _postings(sketch, buckets, hot),
        "bucket long, token array<int>, upper array<int>, lower array<int>, n array<int>, pos array<int>, salt array<int>, shares array<int>",
    )
    found = cut_lineage(spread.groupBy("bucket").applyInArrow(_bucket_join(percent), _FOUND))
    pairs = found.where("kind = 'pair'").select("a", "b")
    leaders = found.where("kind = 'leader'").select("token", "a")
    heads = leaders.groupBy("token").agg(F.min("a").alias("head"))
    led = leaders.join(heads, "token").where("a > head").select(F.col("head").alias("a"), F.col("a").alias("b"))
    pairs = cut_lineage(pairs.unionByName(led).distinct())
    links = cut_lineage(_verify(named, pairs, size, percent))
    comps = cut_lineage(components(links))
    open_groups = found.where("kind = 'group'").select("same", "token", "shares", "members")
    more = cut_lineage(_unsettled_links(named, open_groups, comps, size, percent))
    if more.limit(1).count():
        comps = cut_lineage(components(links.unionByName(more)))
    firsts = rows.where("_doc is not null and n > 0").groupBy("s1", "s2").agg(F.min("_doc").alias("id"))
    labels = firsts.join(comps, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    labels = cut_lineage(labels)  # written first: copies of one set are then split by adaptive execution
    return rows.join(labels, ["s1", "s2"], "left").select(
        F.col("_doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("_doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("_doc")).otherwise(F.col("component")).cast("long").alias("component_id"),
    )


@query()
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents by shingle similarity of 0.75 and more."""
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"))
