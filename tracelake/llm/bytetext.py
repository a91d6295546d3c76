"""Vectorised text hashing over Arrow string buffers: words, word windows and byte windows.

Hashes are polynomials modulo 2**64 over a table of random byte values, taken from prefix sums, so any word or window
costs O(1); a final mixer spreads them. Where a decision rests on equality alone, two hashes with different constants are
compared, or the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken together.
PIECE = 4 << 20
#: Bytes that are hashed at a time, ended by a word's end.
SEGMENT = 1 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Poly:
    """Polynomial window sums with one multiplier."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = int(mix(np.array([seed + 77], dtype=U64))[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=U64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) < n:
            k = len(self._up)
            self._up = np.concatenate([self._up, self._up * U64(pow(self.base, k, 1 << 64))])
            self._down = np.concatenate([self._down, self._down * U64(pow(self.inverse, k, 1 << 64))])
        return self._up[:n], self._down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values weighed by the powers of the base; one more than values."""
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        np.multiply(values, up[:-1], out=out[1:])
        np.cumsum(out[1:], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span of the values, the same wherever it stands."""
        _, down = self._powers(len(sums))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of width values."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        sums = self.sums(values)
        _, down = self._powers(len(sums))
        return mix((sums[width:] - sums[:-width]) * down[:n] + U64(width))


_separator = np.zeros(256, dtype=bool)
_separator[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[ord("A") : ord("Z") + 1] += 32

FIRST, SECOND = Poly(11), Poly(23)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if column.null_count:  # a null may stand over bytes of its own
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, np.diff(at), 0)
        if (sizes != np.diff(at)).any():
            raw = np.concatenate([raw[at[i] : at[i + 1]] for i in np.flatnonzero(valid)] or [raw[:0]])
            return raw, np.concatenate([[0], np.cumsum(sizes)])
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses texts."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~_separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, poly: Poly = FIRST) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hash of every word, the n + 1 offsets of the texts' words, and the words' byte spans."""
    starts, ends = word_spans(data, offsets)
    table = poly.table[LOWER_AZ] if lower else poly.table
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):  # by segments that end with a word
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        a, b = starts[i], ends[j - 1]
        out[i:j] = poly.spans(poly.sums(table[data[a:b]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out, np.searchsorted(starts, offsets), (starts, ends)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start, start + 1, ... of each length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return starts[at], reach[np.concatenate([at[1:] - 1, [len(starts) - 1]])]
