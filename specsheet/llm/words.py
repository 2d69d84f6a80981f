"""Array helpers for words of UTF-8 texts inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = 1 << 20

#: Bytes between words: ``[^\x20\x09-\x0D]+`` is a word.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, ``n`` of each at least."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    power, inverse = _powers(size)
    return power[:n], inverse[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its rows' bounds; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def word_bounds(data: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of one text."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A quick 64-bit hash of each byte run, for feature buckets; different runs can be made to collide."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        base, piece = starts[at], data[starts[at] : ends[to - 1]]
        power, inverse = powers(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def _coded_runs(data: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return values.dictionary_encode()


def distinct_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte runs among ``data[bounds[i]:bounds[i + 1]]``, compared as bytes, and which one each is."""
    coded = _coded_runs(data, bounds)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def joint_codes(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``n`` words of each text (of all its words, if fewer) as numbers that are equal
    where the words are, compared as bytes; lower-cased A-Z."""
    found = [np.frombuffer(t.lower(), np.uint8) for t in texts]
    bounds = [word_bounds(d) for d in found]
    sizes = [len(starts) for starts, _ in bounds]
    data = np.concatenate([d[~WHITE[d]] for d in found])
    ids = _coded_runs(data, np.append(0, np.cumsum(np.concatenate([e - s for s, e in bounds])))).indices.to_numpy().astype(np.int64)
    codes = ids
    most = int(ids.max(initial=0)) + 1
    radix = most
    for k in range(1, n):
        if radix * most >= 1 << 62:  # ranks instead: as few numbers as there are runs
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            radix = int(codes.max(initial=0)) + 1
        codes = codes[: max(0, len(ids) - k)] * most + ids[k:]
        radix *= most
    at, out = 0, []
    for size in sizes:
        whole = np.unique(codes[at : at + size - n + 1]) if size >= n else None
        out.append(whole if whole is not None else tuple(ids[at : at + size].tolist()))
        at += size
    return out


_KEYS = ("corpus word key1", "corpus word key2")  # sixteen signs each


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, SipHash under two keys: no two words collide in both but by a chance of
    one in 2^128, and none can be built to by rule, as with a polynomial."""
    values = np.empty(len(words), dtype=object)
    values[:] = words
    one, two = (pd.util.hash_array(values, hash_key=k, categorize=False) for k in _KEYS)
    return one, two


class HashedText:
    """A text's bytes, the bounds of its words, and two 64-bit hashes of each word."""

    __slots__ = ("data", "ends", "one", "starts", "two")

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray):
        self.data, self.starts, self.ends, self.one, self.two = data, starts, ends, one, two


def hashed_texts(column: pa.Array, lower: bool = False, block: int = 1 << 20) -> Iterator[HashedText]:
    """The rows of an Arrow string column (a null is empty), taken in blocks of about ``block`` bytes; ``lower``
    turns A-Z to lower case."""
    data, bounds = text_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + block, side="right")) - 1)
        piece, cuts = data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        if lower:
            piece = np.frombuffer(piece.tobytes().lower(), np.uint8)
        inside = ~WHITE[piece]
        first = np.append(True, ~inside[:-1])[: len(piece)]
        first[cuts[:-1][cuts[:-1] < len(piece)]] = True  # a word ends where its text does
        starts = np.flatnonzero(first & inside)
        last = np.append(~inside[1:], True)[: len(piece)]
        last[cuts[1:][cuts[1:] > 0] - 1] = True
        ends = np.flatnonzero(last & inside) + 1
        words, which = distinct_runs(piece[inside], np.append(0, np.cumsum(ends - starts)))
        one, two = (h[which] for h in word_hashes(words))
        at = np.searchsorted(starts, cuts).tolist()
        for i in range(to - row):
            a, b, begin = at[i], at[i + 1], cuts[i]
            yield HashedText(piece[begin : cuts[i + 1]], starts[a:b] - begin, ends[a:b] - begin, one[a:b], two[a:b])
        row = to


class Runs:
    """Hashes of runs of words. Level ``j`` has a hash of every ``2^j`` words in a row, joined from two of the
    level before by a mixing that is not linear; a run is covered by two of one level."""

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a) + b)

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            below, span = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self._join(below[: max(0, len(below) - span)], below[span:]))
        return self.levels[j]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run ``[starts, ends)`` of one word or more."""
        size = ends - starts
        out = np.empty(len(starts), np.uint64)
        level = np.frexp(size.astype(np.float64))[1] - 1  # of a positive integer: its highest bit
        for j in np.unique(level).tolist():
            at, below = np.flatnonzero(level == j), self.level(j)
            out[at] = self._join(below[starts[at]], below[ends[at] - (1 << j)])
        return mix(out + size.astype(np.uint64))
