"""A compiled splitter: normalised text to pre-tokens by a deterministic transducer over character classes.

The splitter's pattern is `'s|'t|'re|'ve|'m|'ll|'d|letters+|one number|others+`.
As a machine it has five states, and each transition says how many pre-tokens
it begins (0 or 1). A run of texts is cut into chunks of equal length; every
chunk is walked from all five states at once, which gives its state map, the
maps are composed by a parallel prefix scan, and a second walk from the now
known entry states marks where pre-tokens begin. Chunk bounds may fall
anywhere, also inside a pre-token or a contraction.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex

from scoreweave.llm.words import mix, span_hashes

BLANK, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)
#: States: nothing open, inside letters, inside others, one and two letters of a contraction to come.
_NONE, _LETTERS, _OTHERS, _ONE, _TWO = range(5)
_FRESH = [_NONE, _LETTERS, _NONE, _OTHERS, _ONE, _TWO]
NEXT = np.array([_FRESH, _FRESH, [_NONE, _LETTERS, _NONE, _OTHERS, _OTHERS, _OTHERS], [_NONE] * 6, [_ONE] * 6], np.uint8)
BEGINS = np.array([[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6], bool)
CHUNK = 256


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            for part in (m.span(),):
                lo, hi = (x if x < 0xD800 else x + 0x800 for x in part)
                if part[0] < 0xD800 < part[1]:
                    out[lo:0xD800], out[0xE000:hi] = kind, kind
                else:
                    out[lo:hi] = kind
    return out


def _with_contractions(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Apostrophes that begin 's 't 'm 'd become SHORT, those of 're 've 'll LONG."""
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[at[pair]] = LONG
    return kinds


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Row i of the result is the composition of the maps 0..i, in logarithmically many steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def begin_marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a pre-token begins."""
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.zeros((chunk, rows), np.uint8)
    padded = np.zeros(rows * chunk, np.uint8)
    padded[:n] = kinds
    grid[:] = padded.reshape(rows, chunk).T
    flat = NEXT.ravel()
    state = np.repeat(np.arange(5, dtype=np.uint8)[:, None], rows, axis=1)
    for column in grid:
        state = flat[state * np.uint8(6) + column]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = compose_scan(np.ascontiguousarray(state.T))[:-1, _NONE]
    marks, begins = np.empty((chunk, rows), bool), BEGINS.ravel()
    for i, column in enumerate(grid):
        key = entry * np.uint8(6) + column
        marks[i] = begins[key]
        entry = flat[key]
    return marks.T.ravel()[:n]


@dataclass
class Split:
    """Pre-tokens of a run of texts."""

    text: str  # all texts, normalised, one blank between any two
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray  # first pre-token of each text, one more than texts
    special: list[tuple[int, int, int]]  # text, pre-tokens of the run before it, id of a special string


class Splitter:
    """Built from a tokenizer file; refuses files of another make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: only lower-cased byte-pair files with word ends are compiled")
        self.model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def split(self, texts: list[str]) -> Split:
        parts, of, specials = [], [], []
        for i, text in enumerate(texts):
            if any(x in text for x in self.special):
                for j, piece in enumerate(self._special.split(text)):
                    if j % 2:
                        specials.append((i, len(parts), self.special[piece]))
                    else:
                        parts.append(piece)
                        of.append(i)
            else:
                parts.append(text)
                of.append(i)
        parts = [_normal(x) for x in parts]
        joined = "\n".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _with_contractions(points, _classes()[points])
        marks = begin_marks(kinds) if len(kinds) else np.zeros(0, bool)
        starts = np.flatnonzero(marks)
        stops = np.append(np.flatnonzero(marks | (kinds == BLANK)), len(points))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        hashes = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends, 0xD6E8FEB86659FD93)
        sizes = np.array([len(x) + 1 for x in parts], np.int64)
        part_at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        first = np.searchsorted(np.array(of), np.arange(len(texts) + 1))
        special = [(i, int(part_at[p]), t) for i, p, t in specials]
        return Split(joined, hashes, starts, ends, part_at[first], special)


def _normal(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # one character at a time: no final sigma


class Memo:
    """What is known of pre-tokens, in a table of fixed size; a newer entry takes an older one's place.

    `learn` gives rows of ids for a list of distinct pre-tokens. Ids lie in
    one array that starts anew when it is full, so memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str]], list], bits: int = 19, room: int = 1 << 22):
        self.learn, self.mask, self.room = learn, np.uint64((1 << bits) - 1), room
        self.keys = np.zeros(1 << bits, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys[:] = 0
        self.at = np.zeros(len(self.keys), np.int32)
        self.size = np.zeros(len(self.keys), np.int32)
        self.ids, self.used = np.zeros(self.room, np.uint16), 0

    def _learned(self, split: Split, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes among `which`, their ids in one array, and their sizes."""
        keys, first = np.unique(split.hashes[which], return_index=True)
        spots = which[first]
        words = [split.text[a:b] for a, b in zip(split.starts[spots].tolist(), split.ends[spots].tolist(), strict=True)]
        ids, sizes = self.learn(words)
        return keys, ids, sizes

    def look_up(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """Offset into `ids` and number of ids of every pre-token of the run."""
        hashes = split.hashes
        slot = (hashes & self.mask).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if not len(missing):
            return self.at[slot], self.size[slot]
        keys, ids, sizes = self._learned(split, missing)
        if self.used + len(ids) > self.room:
            self.room = max(self.room, 2 * len(ids))
            self._clear()
            missing = np.arange(len(hashes))
            keys, ids, sizes = self._learned(split, missing)
            if len(ids) > self.room:
                self.room = 2 * len(ids)
                self._clear()
        places = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at, size = self.at[slot], self.size[slot]
        spot = np.searchsorted(keys, hashes[missing])
        at[missing], size[missing] = places[spot], sizes[spot]
        own = (keys & self.mask).astype(np.int64)
        self.keys[own], self.at[own], self.size[own] = keys, places, sizes
        # Of two new keys in one slot the last stays; its key, place and size were set in the same order.
        return at, size
