"""Exact token counts by a compiled transducer, without running a tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import query
from scoreweave.llm.pretokens import Memo, Splitter
from scoreweave.llm.words import pieces, text_buffer

END = "</w>"
#: Bytes of the longest pre-token whose prefixes are kept as states.
SHORT = 128


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Transducer:
    """Byte-pair merges as a deterministic transducer, built state by state as inputs ask for it.

    A state stands for the bytes of a pre-token read so far and knows the last
    token of their segmentation. Segmentations are incremental: the last token
    of a longer input is the longest token ending there that can stand after
    the segmentation before it, which one adjacent pair decides. So a
    transition's emission, the change of the token count, is a constant of the
    transition. A pre-token's last byte takes a closing transition, as its
    symbol carries the word end.
    """

    def __init__(self, model: dict, states: int = 400_000):
        self.vocab, self.limit = model["vocab"], states
        merges = [m if isinstance(m, list | tuple) else m.split(" ") for m in model["merges"]]
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.ends = {t.removesuffix(END) for t in self.vocab if t.endswith(END)}
        self.plain = {t for t in self.vocab if not t.endswith(END)}
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.moves: dict[str, tuple[str, int]] = {"": ("", 0)}  # prefix: last token, tokens so far

    def merged(self, symbols: list[str]) -> list[str]:
        ranks = self.ranks
        while len(symbols) > 1:
            best = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            a, b = symbols[best[1]], symbols[best[1] + 1]
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _fits(self, left: str, right: str, end: bool) -> bool:
        """Whether the two tokens side by side are their bytes' own segmentation."""
        key = (left, right + END if end else right)
        known = self.pairs.get(key)
        if known is None:
            symbols = list(left + right)
            if end:
                symbols[-1] += END
            known = self.pairs[key] = self.merged(symbols) == list(key)
            if len(self.pairs) > self.limit:
                self.pairs = {key: known}
        return known

    def _move(self, word: str, n: int, end: bool, state: Callable[[int], tuple[str, int]]) -> tuple[str, int]:
        """Last token and token count of the first n symbols, from the states of shorter prefixes."""
        known = self.ends if end else self.plain
        for size in range(min(n, self.longest), 0, -1):
            last = word[n - size : n]
            if last in known:
                before, count = state(n - size)
                if not before or self._fits(before, last, end):
                    return last, count + 1
        raise ValueError(f"no token for {word[max(0, n - self.longest) : n]!r}")

    def _count_long(self, word: str) -> int:
        """Tokens of a pre-token of any length, with the states of its last positions alone."""
        width = self.longest + 1
        ring = [("", 0)] * width
        state = lambda i: ring[i % width]
        for i in range(1, len(word)):
            ring[i % width] = self._move(word, i, False, state)
        return self._move(word, len(word), True, state)[1]

    def count(self, word: str) -> int:
        """Tokens of one pre-token given as byte symbols."""
        n = len(word)
        if n > SHORT:
            return self._count_long(word)
        moves = self.moves
        if len(moves) > self.limit:
            self._clear()
            moves = self.moves
        state = lambda i: moves[word[:i]]
        known = n - 1
        while word[:known] not in moves:
            known -= 1
        for i in range(known + 1, n):
            moves[word[:i]] = self._move(word, i, False, state)
        return self._move(word, n, True, state)[1]

    def counts(self, words: list[str]) -> np.ndarray:
        table = self.symbols
        return np.array([self.count("".join([table[b] for b in w.encode("utf-8")])) for w in words], np.int32)


class Counter:
    """Token counts of texts with one tokenizer file."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.machine = Transducer(self.splitter.model)
        self.memo = Memo(lambda words: (np.zeros(0, np.uint16), self.machine.counts(words)), bits=20)

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = self.splitter.split(texts)
        _, sizes = self.memo.look_up(split)
        sums = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=sums[1:])
        out = np.diff(sums[split.at])
        for i, _, _ in split.special:
            out[i] += 1
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process, kept between tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts equal those of the tokenizer in `path` without added special
    tokens; special strings inside a text count one each. Null texts count as
    empty, with no tokens. Repeated rows and null ids stay as they are; other
    columns are not used. `path` must be readable on every executor.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in pieces(batches, limit=1 << 20):
            _, at = text_buffer(batch["text"])
            n = count(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(each, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)


@query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the 49k word vocabulary."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
