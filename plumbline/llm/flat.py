"""String columns as one flat array of bytes: the vectorised inner loops of the text operators work on these."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and where each row starts (one more entry than rows). Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype="<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype="<i8")
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A to Z to a to z; everything else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The white space of the contracts.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: Bytes hashed at a time, and of text in a slice of a column: what the loops hold is some tens of times as much.
CHUNK = 1 << 18


def slices(column: pa.Array, rows: int = 500) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column in slices of at most so many rows and about CHUNK bytes, a row at least: first row, bytes and starts."""
    data, starts = flat_bytes(column)
    k, n = 0, len(starts) - 1
    while k < n:
        end = min(n, k + rows, max(k + 1, int(np.searchsorted(starts, starts[k] + CHUNK, "right")) - 1))
        yield k, data[starts[k] : starts[end]], starts[k : end + 1] - starts[k]
        k = end


def _made_powers(n: int, base: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    size = 1
    while size < n:
        take = min(size, n - size)
        out[size : size + take] = out[:take] * np.uint64(pow(base, size, 1 << 64))
        size += take
    return out


_kept_powers = lru_cache(maxsize=2)(_made_powers)


def _powers(n: int, base: int) -> np.ndarray:
    """A table for chunks is kept; a longer one, for a word of more bytes than that, is not."""
    return _kept_powers(2 * CHUNK, base)[:n] if n <= 2 * CHUNK else _made_powers(n, base)


def words(data: np.ndarray, starts: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, the row's first word (one more entry than rows), and each word's first byte.

    Words are runs of bytes other than spaces, A to Z in lower case; equal words have equal hashes everywhere. Words are
    found in all of the bytes, and hashed by chunks of whole words.
    """
    n = len(data)
    if not n:
        zero = np.zeros(0, dtype=np.uint64)
        return zero, np.zeros(len(starts), dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~is_space[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = starts[:-1][(starts[:-1] < n) & (np.diff(starts) > 0)]
    opens[first] |= inside[first]
    begin = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    end = np.flatnonzero(closes) + 1
    inverse = pow(_BASE, -1, 1 << 64)
    value = np.empty(len(begin), dtype=np.uint64)
    k = 0
    while k < len(begin):
        upto = max(k + 1, int(np.searchsorted(end, begin[k] + CHUNK, "right")))
        a, b = begin[k], end[upto - 1]
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[LOWER[data[a:b]]] * _powers(b - a, _BASE), out=sums[1:])
        value[k:upto] = (sums[end[k:upto] - a] - sums[begin[k:upto] - a]) * _powers(b - a, inverse)[begin[k:upto] - a]
        k = upto
    value = mixed(value + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return value, np.searchsorted(begin, starts), begin


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within rows, and where each row's runs start. A row with fewer words, but
    one at least, has one run: all its words."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    starts = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(runs, out=starts[1:])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), starts
    at = np.arange(total) - np.repeat(starts[:-1], runs) + np.repeat(first[:-1], runs)
    padded = np.concatenate([word, np.zeros(width, dtype=np.uint64)])
    length = np.repeat(np.minimum(count, width), runs)
    value = length.astype(np.uint64)
    for k in range(width):
        part = padded[at + k]
        if (length <= k).any():
            part = np.where(length > k, part, np.uint64(0))
        value = mixed(value * np.uint64(0xE7037ED1A0B428DB) + part)
    return value, starts


def runs(mask: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of set bytes within rows, of `least` bytes or more: row, first byte and the byte after the last."""
    n = len(mask)
    if n < least:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inner = starts[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    inner = inner[mask[inner] & mask[inner - 1]]  # rows that touch within a run
    step = np.diff(mask.view(np.int8))
    begin, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    begin = np.concatenate([[0] if mask[0] else [], begin, inner]).astype(np.int64)
    end = np.concatenate([end, [n] if mask[-1] else [], inner]).astype(np.int64)
    begin.sort()
    end.sort()
    keep = end - begin >= least
    begin, end = begin[keep], end[keep]
    return np.searchsorted(starts, begin, "right") - 1, begin, end


def points(data: np.ndarray, start: int, at: int) -> int:
    """Code points between two bytes of UTF-8."""
    return int(np.count_nonzero((data[start:at] & 0xC0) != 0x80))
