"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (runs of letters, digits and non-ASCII characters, A to Z in lower case). A
document is contaminated by an item of n words if a window of its words is within k = floor(n * EDITS) word edits, or
is the item itself where n is under LEAST_WORDS: k is 0 then. Such a window has n - k to n + k words. find_leaks() takes windows of exactly n words unless it is called with wide.

* The random walk embedding of Chakraborty, Goldenberg and Koucky reads a sequence with steps of 0 or 1 that a hash of
  the step and the symbol decides, for 3n steps. Sequences at small edit distance fall into step again and so are at
  small Hamming distance.
* Bit sampling: a table takes SAMPLED coordinates of a walk. Windows and items that agree in one of WALKS * TABLES
  tables are candidates. A window that equals the item agrees in all. The tests hold recall over all distances, up to
  the largest, to 0.95.
* Candidates are verified by the bit-parallel edit distance over words, so no clean window is reported. Wide windows are
  sought in the candidate and k words on either side of it, with free ends.

Windows that cannot be within the distance are passed over before, without loss: a window within k edits of an item of n
words shares at least n - q + 1 - k * q of the item's q-word runs. Only where a document has that many of one item's
runs within the longest window are windows of the item's size embedded, one at each word.

The items are the query set. They go to all executors in blocks of BLOCK_ITEMS and BLOCK_CHARS at most, each a pass over
the documents, which is a map: nothing is shuffled. Defined results: null and empty texts match nothing, nor do items
without a word; an item of a few words matches wherever these stand together; a document with fewer words than an item is one window; of windows at the same distance the first is
reported, and of wide ones with the same start the shortest; repeated rows and items are reported each; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, trimmed
from .flat import flat_bytes, mixed, shingles, slices, words

EDITS, LEAST_WORDS, BLOCK_ITEMS, BLOCK_CHARS = 0.2, 8, 50_000, 20_000_000
WALKS, TABLES, SAMPLED = 8, 4, 2

#: Bytes between words: all ASCII but letters and digits.
BREAKS = np.ones(256, dtype=bool)
BREAKS[128:] = BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = False

#: Windows compared at a time.
_WINDOWS = 20_000
#: Windows whose walks are held at a time.
_ROWS = 2048

_PAD = np.uint64(0x5851F42D4C957F2D)


def edit_distance(pattern: dict, n: int, text: np.ndarray) -> int:
    """Levenshtein distance of an item, given by masks() and its length, to a sequence: Myers' bit vectors."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = mask, 0, n
    for symbol in text.tolist():
        eq = pattern.get(symbol, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & mask
        up, down = minus | (mask & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = ((up << 1) | 1) & mask, (down << 1) & mask
        plus, minus = down | (mask & ~(d | up)), up & d
    return score


def edit_distances(pattern: dict, n: int, text: list[int], free: bool) -> list[int]:
    """Distance of an item to each prefix of a sequence, or, with a free start, to the best suffix of each prefix."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = mask, 0, n, []
    for symbol in text:
        eq = pattern.get(symbol, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & mask
        up, down = minus | (mask & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        out.append(score)
        up, down = ((up << 1) | (not free)) & mask, (down << 1) & mask
        plus, minus = down | (mask & ~(d | up)), up & d
    return out


def best_window(item: np.ndarray, pattern: dict, most: int, text: list[int]) -> tuple[int, int, int] | None:
    """Distance, start and length of the closest window, the first and then shortest of equals; None if over `most`."""
    n = len(item)
    score = edit_distances(pattern, n, text, True)
    least = min(score, default=n)
    if least > most:
        return None
    back, found = masks(item[::-1]), []
    for stop in (j + 1 for j, d in enumerate(score) if d == least):
        tail = edit_distances(back, n, text[max(0, stop - n - least) : stop][::-1], False)
        length = max(j + 1 for j, d in enumerate(tail) if d == least)
        found.append((stop - length, length))
    return (least, *min(found))


def masks(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, symbol in enumerate(item.tolist()):
        out[symbol] = out.get(symbol, 0) | (1 << k)
    return out


def signatures(sequences: np.ndarray, length: np.ndarray, size: int, seed: int = 3) -> np.ndarray:
    """LSH keys of rows of symbols (padded to a common width): one column per table. `size` is the item's length. All walks
    go on together, over _ROWS rows at a time."""
    rows, width = sequences.shape
    rng = np.random.default_rng([seed, size])
    picks: dict[int, list[tuple[int, int]]] = {}
    for walk in range(WALKS):
        for t in range(TABLES):
            for step in rng.choice(3 * size, min(SAMPLED, 3 * size), replace=False).tolist():
                picks.setdefault(step, []).append((walk, t))
    out = np.repeat(np.arange(WALKS, dtype=np.uint64) + np.uint64(size * 64), TABLES)[:, None] * np.ones(rows, dtype=np.uint64)
    salt = (np.arange(WALKS, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(seed))[:, None]
    for k in range(0, rows, _ROWS):
        some = sequences[k : k + _ROWS]
        # A column of pads behind the longest row, where walks beyond the end stay.
        padded = np.full((len(some), width + 1), _PAD, dtype=np.uint64)
        np.copyto(padded[:, :width], some, where=np.arange(width) < length[k : k + _ROWS, None])
        flat, stop = padded.ravel(), np.arange(1, len(some) + 1) * (width + 1) - 1
        at = np.tile(stop - width, (WALKS, 1))
        for step in range(max(picks) + 1):
            symbol = flat.take(at)
            for walk, t in picks.get(step, ()):
                key = out[walk * TABLES + t, k : k + _ROWS]
                key[:] = mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbol[walk] + np.uint64(t + 1))
            symbol += salt + np.uint64(step * 7919)
            at += _top_bit(symbol).view(np.int64)
            np.minimum(at, stop, out=at)
    return out.T


def _top_bit(x: np.ndarray) -> np.ndarray:
    """The highest bit of mixed(), made in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x >>= np.uint64(63)
    return x


def allowed(n: int, edits: float) -> int:
    return int(n * edits) if n >= LEAST_WORDS else 0


@dataclass
class Index:
    """LSH tables and q-word runs of a block of items."""

    ids: list
    items: list[np.ndarray]
    edits: float
    wide: bool = False
    tables: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    grams: dict[int, tuple] = field(default_factory=dict)  # by q: sorted runs, offsets, items, small filter
    need: np.ndarray | None = None

    def __post_init__(self):
        need, width = np.zeros(len(self.items), dtype=np.int64), np.zeros(len(self.items), dtype=np.int64)
        for k, item in enumerate(self.items):
            n, e = len(item), allowed(len(item), self.edits)
            width[k] = next((q for q in (3, 2) if n - q + 1 - e * q >= 2), 1)
            need[k] = max(1, n - width[k] + 1 - e * width[k])
        self.need = need
        size = np.asarray([len(x) for x in self.items])
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            keys = signatures(np.stack([self.items[k] for k in mine]), np.full(len(mine), n), n)
            for k, row in zip(mine.tolist(), keys.tolist()):
                for t, key in enumerate(row):
                    self.tables.setdefault((t, key), []).append(k)
        self.masks = [masks(item) for item in self.items]
        for q in sorted(set(width.tolist())):
            mine = [k for k in range(len(self.items)) if width[k] == q]
            first = np.concatenate([[0], np.cumsum([len(self.items[k]) for k in mine])])
            run, starts = shingles(np.concatenate([self.items[k] for k in mine]), first, q)
            owner = np.repeat(np.asarray(mine), np.diff(starts))
            pairs = np.unique(np.stack([run, owner.astype(np.uint64)], axis=1), axis=0)
            value, at = np.unique(pairs[:, 0], return_index=True)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[value >> np.uint64(44)] = True
            self.grams[q] = (value, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64), seen)

    def windows(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Row, item and starts of the windows that share enough runs with the item."""
        size = np.asarray([len(x) for x in self.items])
        longest = size + np.asarray([allowed(n, self.edits) if self.wide else 0 for n in size.tolist()], dtype=np.int64)
        for q, (value, at, items, seen) in self.grams.items():
            run, starts = shingles(word, first, q)
            place = np.flatnonzero(seen[run >> np.uint64(44)])
            rank = np.minimum(np.searchsorted(value, run[place]), len(value) - 1)
            real = value[rank] == run[place]
            place, rank = place[real], rank[real]
            if not len(place):
                continue
            row = np.searchsorted(starts, place, "right") - 1
            many = at[rank + 1] - at[rank]
            spread = np.repeat(np.arange(len(place)), many)
            item = items[np.repeat(at[rank], many) + np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)]
            row, place = row[spread], (place - starts[row])[spread]
            order = np.lexsort((place, item, row))
            row, item, place = row[order], item[order], place[order]
            # The need-th next hit of the same row and item must lie within the window.
            ahead = np.arange(len(row)) + self.need[item] - 1
            ok = ahead < len(row)
            far = np.minimum(ahead, len(row) - 1)
            ok &= (row[far] == row) & (item[far] == item) & (place[far] - place + q <= longest[item])
            hit = np.flatnonzero(ok)
            if not len(hit):
                continue
            group = np.flatnonzero(np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (item[hit][1:] != item[hit][:-1])]))
            for a, b in zip(group, np.append(group[1:], len(hit))):
                some = hit[a:b]
                r, i = int(row[some[0]]), int(item[some[0]])
                n, most = size[i], first[r + 1] - first[r]
                last = max(0, most - 1 if self.wide else most - n)
                low, high = np.maximum(0, place[far[some]] + q - longest[i]), np.minimum(place[some], last)
                mark = np.zeros(last + 2, dtype=np.int64)
                np.add.at(mark, np.minimum(low, len(mark) - 1), 1)
                np.add.at(mark, np.minimum(np.maximum(high, low) + 1, len(mark) - 1), -1)
                yield r, i, np.flatnonzero(np.cumsum(mark[:-1]) > 0)

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """Row, item, first word, words and distance of each match of a column of texts."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held: dict[int, list[tuple]] = {}
        for k, data, starts in slices(column):
            word, first, _ = words(data, starts, BREAKS)
            todo: dict[int, set[tuple[int, int]]] = {}
            for r, i, at in self.windows(word, first):
                todo.setdefault(len(self.items[i]), set()).update((r, s) for s in at.tolist())
            for n, found in todo.items():
                place = np.asarray(sorted(found))
                for j in range(0, len(place), _WINDOWS):
                    row, start = place[j : j + _WINDOWS].T
                    begin = first[row] + start
                    length = np.minimum(n, first[row + 1] - begin)
                    room = allowed(n, self.edits) if self.wide else 0
                    left = np.minimum(start, room)
                    width = left + np.minimum(n + room, first[row + 1] - begin)
                    grid = word[np.clip(begin[:, None] + np.arange(-room, n + room), 0, len(word) - 1)]
                    held.setdefault(n, []).append((row + k, start, length, left, width, grid))
                    if sum(len(x[0]) for x in held[n]) >= _WINDOWS:
                        self._compare(n, held.pop(n), best)
        for n, parts in held.items():
            self._compare(n, parts, best)
        return [(r, i, s, m, d) for (r, i), (d, s, m) in sorted(best.items())]

    def _compare(self, n: int, parts: list[tuple], best: dict) -> None:
        row, start, length, left, width, grid = (np.concatenate(x) for x in zip(*parts))
        room = (grid.shape[1] - n) // 2
        keys = signatures(grid[:, room : room + n], length, n)
        near: dict[tuple[int, int], dict[int, int]] = {}
        for t in range(keys.shape[1]):
            for w, key in enumerate(keys[:, t].tolist()):
                for i in self.tables.get((t, key), ()):
                    seen = near.setdefault((int(row[w]), i), {})
                    seen[w] = seen.get(w, 0) + 1
        for (r, i), seen in near.items():
            if self.wide:
                seen = {w: seen[w] for w in self._possible(i, sorted(seen, key=lambda w: start[w]), start, left, width, grid)}
            # Windows that agree in most tables first: an exact copy agrees in all and ends the search.
            for w in sorted(seen, key=lambda w: (-seen[w], start[w])):
                known = best.get((r, i))
                if known and known[0] == 0:
                    break
                if self.wide:
                    a = room - left[w]
                    if found := best_window(self.items[i], self.masks[i], allowed(n, self.edits), grid[w, a : a + width[w]].tolist()):
                        d, s, m = found[0], int(start[w] - left[w]) + found[1], found[2]
                        best[r, i] = min((d, s, m), known or (n, 0, 0))
                    continue
                d = edit_distance(self.masks[i], n, grid[w, : length[w]])
                if d <= allowed(n, self.edits) and (known is None or (d, start[w]) < known[:2]):
                    best[r, i] = (d, int(start[w]), int(length[w]))


    def _possible(self, i: int, every: list[int], start: np.ndarray, left: np.ndarray, width: np.ndarray, grid: np.ndarray) -> list[int]:
        """Of wide windows of one row, by start, those in which the item can be. Windows that overlap are gone through as one
        text: where it holds no close end, no window in it does."""
        n, most, room, out = len(self.items[i]), allowed(len(self.items[i]), self.edits), (grid.shape[1] - len(self.items[i])) // 2, []
        at = [int(x) for x in start[every] - left[every]]
        k = 0
        while k < len(every):
            begin, upto, text, first = at[k], at[k], [], k
            while k < len(every) and at[k] <= upto:
                w, stop = every[k], at[k] + int(width[every[k]])
                if stop > upto:
                    a = room - int(left[w])
                    text += grid[w, a + upto - at[k] : a + stop - at[k]].tolist()
                    upto = stop
                k += 1
            ends = [begin + j for j, d in enumerate(edit_distances(self.masks[i], n, text, True)) if d <= most]
            if ends:
                out += [every[j] for j in range(first, k) if (e := bisect_left(ends, at[j])) < len(ends) and ends[e] < at[j] + width[every[j]]]
        return out


def index_of(items: list[tuple[int, str]], edits: float = EDITS, wide: bool = False) -> Index:
    data, starts = flat_bytes(pa.array([t for _, t in items], pa.string()))
    word, first, _ = words(data, starts, BREAKS)
    some = [k for k in range(len(items)) if first[k + 1] > first[k]]
    return Index([items[k][0] for k in some], [word[first[k] : first[k + 1]] for k in some], edits, wide)


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block: one block at a time is on the driver."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text or "")
        if len(block) == block_items or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


_MATCH = "doc_id long, item_id long, word_start long, word_end long, distance long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_items: int = BLOCK_ITEMS, wide: bool = False) -> DataFrame:
    """doc_id, item_id, word_start, word_end (exclusive) and distance of the best window of each document and item."""
    found = None
    for block in _blocks(benchmark, block_items):
        index = index_of(block, edits, wide=wide)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = batch.column(0).to_pylist()
                rows = [(doc[r], index.ids[i], s, s + m, d) for r, i, s, m, d in index.matches(batch.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], [x.split()[0] for x in _MATCH.split(", ")])

        one = columns(docs, "doc_id", "text").mapInArrow(lambda b, run=run: trimmed(run(b)), _MATCH)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], _MATCH) if found is None else found


def keep_clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_items: int = BLOCK_ITEMS, wide: bool = True) -> DataFrame:
    """The documents that no item contaminates, in the columns of the input."""
    place = docs.columns.index("text")
    for block in _blocks(benchmark, block_items):
        index = index_of(block, edits, wide=wide)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {m[0] for m in index.matches(batch.column(place))}
                yield batch.filter(pa.array([r not in leaks for r in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(lambda b, run=run: trimmed(run(b)), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), wide=True)
