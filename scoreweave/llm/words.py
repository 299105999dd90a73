"""Vectorised words, word hashes and window hashes over Arrow text columns.

All functions work on one run of documents at a time (`runs`), so memory
follows `RUN_BYTES` or the longest single text, never the partition. Null
texts count as empty. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once. Several arrays of as many 64-bit numbers lie beside them, in every Python worker.
RUN_BYTES = 1 << 19

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (murmur's 64-bit finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _STEP) | _U(1)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; base is odd."""
    had = _powers.get(base)
    if had is None or len(had[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, _U)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), _U)
        down[0] = 1
        had = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= RUN_BYTES * 4:
            _powers[base] = had
    return had


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A hash of values[start:end] for each span, the same wherever the span lies."""
    n = len(values)
    up, down = _power(base, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * down[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(_U) * _STEP)


@dataclass
class Run:
    """Some documents: their bytes, and the words in them."""

    table: pa.RecordBatch
    data: np.ndarray  # bytes of all texts
    doc_at: np.ndarray  # byte offset of each document, one more than documents
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    word_at: np.ndarray  # first word of each document, one more than documents

    @property
    def docs(self) -> int:
        return len(self.doc_at) - 1

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.word_at))

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUES[self.data], self.starts, self.ends)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset; nulls have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def runs(
    batches: Iterator[pa.RecordBatch], text: str = "text", *, blanks: np.ndarray = BLANKS, lower: bool = False, limit: int = RUN_BYTES
) -> Iterator[Run]:
    """Words of every document: maximal runs of bytes that are not blanks."""
    for table in pieces(batches, text, limit):
        data, at = text_buffer(table.column(text))
        if lower:
            data = LOWER[data]
        yield find_words(table, data, at, blanks)


def find_words(table, data: np.ndarray, at: np.ndarray, blanks: np.ndarray = BLANKS) -> Run:
    solid = ~blanks[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Run(table, data, at, starts, ends, np.searchsorted(starts, at))


def windows(word_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of `size` words that lie in one document, and their documents."""
    counts = np.maximum(np.diff(word_at) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(skip - word_at[:-1], counts), docs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def joined(run: Run, kept: np.ndarray) -> list[bytes]:
    """Each document's kept words joined by one space; `kept` marks words of the run."""
    counts = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=counts[1:])
    doc_at = counts[run.word_at]
    starts, ends = run.starts[kept], run.ends[kept]
    last = np.zeros(len(starts), bool)
    last[doc_at[1:][doc_at[1:] > doc_at[:-1]] - 1] = True
    # Every word but a document's last takes the byte after it along, overwritten by a space.
    data = np.append(run.data, np.uint8(0))
    data[ends[~last]] = 0x20
    change = np.zeros(len(data) + 1, np.int32)
    change[starts] += 1
    np.add.at(change, ends + ~last, -1)
    out = data[np.cumsum(change[:-1]) > 0]
    sizes = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends + ~last - starts, out=sizes[1:])
    at = sizes[doc_at]
    view = memoryview(out)
    return [bytes(view[at[i] : at[i + 1]]) for i in range(run.docs)]
