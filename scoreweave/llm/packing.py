"""Cost-balanced packing of whole tokenised documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from scoreweave.llm import query
from scoreweave.llm.pretokens import Memo, Splitter
from scoreweave.llm.words import mix, pieces

#: Documents packed together. More would save nothing: a group leaves no padding.
GROUP_DOCS = 4096
#: A token costs 1 by itself, and QUADRATIC / capacity more for every token of its own piece.
QUADRATIC = 1.0


class Encoder:
    """Token ids of texts; distinct pre-tokens go through the tokenizer once and are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter = Splitter(path)
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.memo = Memo(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            said = self.library.encode("\n".join(part), add_special_tokens=False)
            size = np.bincount(np.array(said.word_ids, np.int64), minlength=len(part))
            if len(size) != len(part):
                raise ValueError("the tokenizer splits a pre-token")
            ids.append(np.array(said.ids, np.uint16))
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the first of each text."""
        split = self.splitter.split(texts)
        at, size = self.memo.look_up(split)
        sums = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        ids = self.memo.ids[np.repeat(at - sums[:-1], size) + np.arange(sums[-1])]
        bounds = sums[split.at]
        if split.special:
            ids = np.insert(ids, [sums[p] for _, p, _ in split.special], [t for _, _, t in split.special])
            more = np.bincount([i for i, _, _ in split.special], minlength=len(texts))
            bounds = bounds + np.concatenate([[0], np.cumsum(more)])
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, end_id: int, capacity: int, groups: int):
    """Per row: its group, token count, checksums of its full pieces, and the ids that are left."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, task, row = _encoders[path], TaskContext.get().partitionId(), 0
        for batch in pieces(batches, limit=1 << 20):
            ids, at = encode(batch["text"].to_pylist())
            sizes, full, rest = [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint16(end_id))
                whole = len(own) // capacity * capacity
                sizes.append(len(own))
                full.append([_crc(own[j : j + capacity]) for j in range(0, whole, capacity)])
                rest.append(own[whole:].tobytes())
            # Rows are dealt by their place in the input, so no key or copy can crowd a group.
            place = mix((np.uint64(task) << np.uint64(40)) + np.arange(row, row + batch.num_rows, dtype=np.uint64) + np.uint64(1))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array((place % np.uint64(groups)).astype(np.int64)), pa.array(sizes, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                ["_id", "_group", "n", "full", "rest"],
            )

    return each


def place(lengths: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; all sequences are filled exactly.

    Sequences hold `capacity`, but for the last few, which hold the powers of
    two that the rest of the tokens sums to. Items go by descending length to
    the cheapest sequence with room for them; one that fits nowhere fills the
    roomiest sequence and goes on with what is left of it.
    """
    total = int(lengths.sum())
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1], np.int64)
    used, cost, out = np.zeros(len(room), np.int64), np.zeros(len(room)), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[item])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            best = int(fits.argmin())
            if fits[best] == np.inf:
                best = int(room.argmax())
            size = min(left, int(room[best]))
            out.append((item, start, size, best, int(used[best])))
            used[best] += size
            room[best] -= size
            cost[best] += size * (1 + quadratic * size / capacity)
            start, left = start + size, left - size
    return out


def _packed(capacity: int, quadratic: float):
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def each(table: pa.Table) -> pa.Table:
        # One order whatever order the shuffle delivers.
        table = table.sort_by([("_row", "ascending")])
        base = table["_group"][0].as_py() << 32
        rest = [np.frombuffer(x, np.uint16) for x in table["rest"].to_pylist()]
        sizes = table["n"].to_numpy()
        lengths = np.array([len(x) for x in rest], np.int64)
        rows, sequence = [], base
        for i, sums in enumerate(table["full"].to_pylist()):
            for k, crc in enumerate(sums):
                rows.append((i, k * capacity, capacity, crc, sequence, 0))
                sequence += 1
        for i, start, size, own, offset in place(lengths, capacity, quadratic):
            rows.append((i, int(sizes[i] - lengths[i]) + start, size, _crc(rest[i][start : start + size]), sequence + own, offset))
        item, *columns = map(np.array, zip(*rows, strict=True))
        start, length, crc, seq, offset = columns
        ids = table["_id"].combine_chunks().take(pa.array(item))
        return pa.Table.from_arrays([ids, *map(pa.array, (start, length, crc, sizes[item], seq, offset))], names)

    return each


def pack_sequences(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = 4096,
    quadratic: float = QUADRATIC,
    group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by `end_id`; null and empty texts are that
    one id. Full multiples of `capacity` become sequences of their own where
    the ids are made; what is left is packed in groups of about `group_docs`
    rows by `place`, so a task holds at most group_docs * capacity ids however
    large the table is. Repeated rows and null ids are packed like others. An
    empty table gives no rows. Other columns are not used.
    """
    groups = max(1, -(-docs.count() // group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = slim.mapInArrow(
        _tokenised(path, end_id, capacity, groups), f"_id {kind}, _group long, n long, full array<long>, rest binary"
    ).withColumn("_row", F.xxhash64("_id", "rest", "full"))
    packed = tokens.groupBy("_group").applyInArrow(
        _packed(capacity, quadratic),
        f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("_id", id_col)


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_sequences(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
