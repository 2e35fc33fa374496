"""N-gram Jaccard self-join with a prefix tree, up to connected components.

A document is its set of 5-word shingles, each a 64-bit hash (a pair of sets would need equal hashes of different
shingles to be judged wrongly). Documents with equal sets are one node, known by a 128-bit hash of the set, so groups of
copies cost one node however large they are. Shingles have one global order: by rising frequency, then by their hash.
Frequencies are logarithms of counts in a sketch of fixed size, one counter for many shingles, that adds up the nodes of
all documents. Any common order gives the same links; this one keeps what is frequent out of prefixes.

1. Sets of size n link at J >= 80/100 only if they share a shingle among the first n - ceil(0.8 n) + 1 in order. A map
   over the texts sends these prefixes, packed by ranges of shingles, to tasks that keep the shingles of two or more
   nodes; very frequent shingles need no such task. Shingles with the same nodes stand for the same pairs: the first stays.
2. Such a shingle is the root of a trie. It holds each node's ordered shared shingles from the root on, to a bounded
   depth. A query walks the trie: nodes with a common beginning share the overlap found on it, and a subtree is left when
   the overlap so far plus the shorter remaining length cannot reach what its smallest set requires. What is left at the
   ends of paths are the candidate pairs. A pair that can link is met at the first shingle it shares.
3. In the first pass the nodes of each trie meet one of them only, that with the fewest shingles before the root, which is
   the centre of what shares the root: the lengths that remain decide. Links found so join groups of near copies, however
   large, at a cost in proportion to their rows. In the second pass the tries are walked. The queries are all nodes
   outside the largest component of their trie, and meet the nodes of other components only: no link is lost that would
   join two components, and no pairs are made within a group that is joined already. Tries of very many nodes are dealt
   to a grid of tasks, queries by nodes.
4. Candidates are judged by parity bits of both sets, a 16th to an 8th of their size, which bound their difference from
   below: most unlinked ones end there, without their sets. The others are decided exactly: whole sets go to a task per
   query, as a trie again, walked once with the same bounds.

Defined results: null or empty text, or text of white space, has an empty set and is linked with nothing; with fewer
than 5 words the whole sequence is the one shingle; repeated rows and equal texts are linked by their equal sets; a null
doc_id gets the smallest doc_id of its component, or null where there is none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, durable, mark, marked, one_each, release, small, trimmed, written
from .flat import mixed, shingles, slices, words
from .graph import components

WIDTH, PERCENT = 5, 80
#: Counters of the sketch, and the slices it is added up in. Logarithms have _STEPS steps for each doubling.
_COUNTERS, _SLICES, _STEPS = 1 << 20, 64, 4
#: A counter of so many, and eight times the mean, is that of very frequent shingles: their rows are dealt by node.
FREQUENT_FROM = 1024
#: Rows in an Arrow batch of texts or sets, at most (4 MB of them), and shingles or nodes that are held to be counted.
_BATCH, _COUNTED = 2000, 200_000
_BUCKET_TOKENS, _HELD_BYTES = 250_000, 32_000_000
#: A candidate trie is so deep, and holds at most so many nodes and queries in one task.
_DEPTH, _TRIE_NODES = 16, 1024
#: A trie of whole sets holds at most so many sets, and shingles on average.
_TRIE_SETS, _TRIE_TOKENS = 512, 500_000


def required(n: int, percent: int = PERCENT) -> int:
    """Least overlap with any partner, for a set of n."""
    return -(-percent * n // 100)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each row."""
    for k, data, starts in slices(column):
        word, first, _ = words(data, starts)
        run, at = shingles(word, first, width)
        for row in range(len(at) - 1):
            yield k + row, np.unique(run[at[row] : at[row + 1]])


def _key(values: np.ndarray) -> bytes:
    """A node: 128 bits of three independent sums over the set's members and its size; equal sets have equal ones."""
    if not len(values):
        return bytes(16)
    one, two, three = (mixed(values ^ np.uint64(x)).sum(dtype=np.uint64) for x in (0, 0xA5A5A5A5DEADBEEF, 0x3C6EF372FE94F82B))
    n = np.uint64(len(values))
    return mixed(np.asarray([one ^ mixed(np.asarray([three + n]))[0], two ^ mixed(np.asarray([three ^ ~n]))[0]])).tobytes()


def _binaries(nodes: np.ndarray) -> pa.Array:
    """Rows of two 64-bit halves as 16-byte values."""
    ends = np.arange(0, 16 * len(nodes) + 1, 16, dtype="<i4")
    return pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(nodes).tobytes())])


def _halves(column: pa.Array) -> np.ndarray:
    """16-byte values as rows of two 64-bit halves."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 2)


def _counter(values: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (mixed(values ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(44)).astype(np.int64)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """A written table: id, doc_id, mark, node and n per document, and rows of slices of each task's sketch."""

    names = ["id", "doc_id", "mark", "node", "n", "slice", "counts"]
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, known, total = np.zeros(_COUNTERS, dtype="<u4"), [], set(), 0
        for batch in batches:
            node, size = [], []
            for _, values in _sets(batch.column(3), width):
                node.append(_key(values))
                size.append(len(values))
                if node[-1] not in known:  # copies count once, as far as they are near
                    known.add(node[-1])
                    held.append(_counter(values))
                    total += len(values)
                if total >= _COUNTED:
                    sketch += np.bincount(np.concatenate(held), minlength=_COUNTERS).astype("<u4")
                    held, total = [], 0
                if len(known) >= _COUNTED:
                    known = set()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.binary()), pa.array(size, pa.int64()), *(pa.nulls(batch.num_rows, t) for t in kinds[5:])], names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=_COUNTERS).astype("<u4")
        parts = sketch.reshape(_SLICES, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), t) for t in kinds[:5]), pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names)

    with batches_of(docs.sparkSession, _BATCH):
        schema = "id long, doc_id long, mark long, node binary, n long, slice int, counts binary"
        return written(_identified(docs).mapInArrow(lambda b: trimmed(run(b)), schema), "shingles")


def _identified(docs: DataFrame) -> DataFrame:
    """id finds a document's text again: its doc_id, or a hash of its text where that is null."""
    return docs.select(F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("id"), "doc_id", mark().alias("mark"), "text")


def _order(table: DataFrame) -> tuple[np.ndarray, int]:
    """The place of each counter's shingles in the global order, a byte each, and the first place of very frequent ones."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns)):
                mine = sums.setdefault(k, np.zeros(_COUNTERS // _SLICES, dtype="<u8"))
                mine += np.frombuffer(counts, dtype="<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    counts = np.zeros((_SLICES, _COUNTERS // _SLICES), dtype=np.uint64)
    with batches_of(table.sparkSession, 64):
        parts = table.where("slice IS NOT NULL").select("slice", "counts").repartition(_SLICES, "slice").mapInArrow(add, "slice int, counts binary")
        for r in parts.collect():  # the sketch, whatever the size of the corpus
            counts[r.slice] = np.frombuffer(r.counts, dtype="<u8")
    place = lambda x: np.floor(_STEPS * np.log2(np.maximum(x, 1))).astype(np.uint8)
    often = max(float(FREQUENT_FROM), 8.0 * float(counts.mean()))
    return place(counts.ravel()), int(np.ceil(_STEPS * np.log2(often)))


def _ordered(values: np.ndarray, places: np.ndarray, often: int) -> tuple[np.ndarray, int]:
    """A sorted set in the global order, and how many of it are not very frequent."""
    place = places[_counter(values)]
    order = np.argsort(place, kind="stable")
    return values[order], int((place < often).sum())


def _shared_tokens(docs: DataFrame, places, buckets: int, width: int, percent: int) -> DataFrame:
    """A written table of token, node, n and pos, the place in the node's order: prefix shingles that several nodes have.

    One row of each shingle, its pivot's, has what its nodes add up to: many, least, one and two (see _roots). Rows of very
    frequent shingles are not together and have -1 in many.
    """
    packed = "bucket int, tokens binary, nodes binary, sizes binary, places binary"
    schema = "token long, node binary, n long, pos long, many long, least long, one long, two long"

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, sizes, at, late, known = [], [], [], [], [], set()
            for _, values in _sets(batch.column(3), width):
                n = len(values)
                node = _key(values)
                if not n or node in known:
                    continue
                known.add(node)
                values, rare = _ordered(values, *places.value)
                head = n - required(n, percent) + 1
                tokens.append(values[: min(head, rare)])
                nodes.append(np.tile(np.frombuffer(node, dtype="<u8"), (len(tokens[-1]), 1)))
                sizes.append(np.full(len(tokens[-1]), n, dtype=np.int32))
                at.append(np.arange(len(tokens[-1]), dtype=np.int32))
                if head > rare:
                    late.append((values[rare:head], node, n, rare))
            rows = []
            if tokens:
                token, node, size, place = (np.concatenate(x) for x in (tokens, nodes, sizes, at))
                bucket = (token >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:]):
                    some = order[a:b]
                    if len(some):
                        rows.append((int(bucket[a]), token[some].tobytes(), node[some].tobytes(), size[some].tobytes(), place[some].tobytes()))
            # Very frequent shingles are as good as certain to be shared: their rows are dealt by node.
            for values, node, n, rare in late:
                k, bucket = len(values), -1 - int.from_bytes(node[:8], "little") % buckets
                rows.append((bucket, values.tobytes(), node * k, np.full(k, n, dtype=np.int32).tobytes(), np.arange(rare, rare + k, dtype=np.int32).tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["bucket", "tokens", "nodes", "sizes", "places"])

    def out(token, node, size, place, sums) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(token.view(np.int64)), _binaries(node), pa.array(size.astype(np.int64)), pa.array(place.astype(np.int64)), *sums]
        whole = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])
        for k in range(0, len(token), 50_000):
            yield whole.slice(k, 50_000)

    def added_up(token, node, size, place) -> list[pa.Array]:
        """many, least, one and two in the row of the pivot of each run of rows with one shingle."""
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        head = np.lexsort((node[:, 0], node[:, 1], size, place, token))[begin]
        marks = [np.bitwise_xor.reduceat(mixed(node[:, k] ^ mixed(node[:, 1 - k])), begin).view(np.int64) for k in (0, 1)]
        sums = [np.diff(begin, append=len(token)), np.minimum.reduceat(size, begin), *marks]
        out, none = [], np.ones(len(token), dtype=bool)
        none[head] = False
        for x in sums:
            column = np.zeros(len(token), dtype=np.int64)
            column[head] = x
            out.append(pa.array(column, pa.int64(), mask=none))
        return out

    def unpack(rows) -> tuple[np.ndarray, ...]:
        token, node, size, place = (np.frombuffer(b"".join(c), dtype=t) for c, t in zip(rows, ("<u8", "<u8", "<i4", "<i4")))
        return token, node.reshape(-1, 2), size, place

    def distinct(held: list) -> tuple[np.ndarray, ...]:
        """The rows, sorted by shingle and node, each once."""
        columns = unpack(list(zip(*held)))
        order = np.lexsort((columns[1][:, 0], columns[1][:, 1], columns[0]))
        token, node, size, place = (c[order] for c in columns)
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1]).any(axis=1)])
        return token[fresh], node[fresh], size[fresh], place[fresh]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket is held at a time, and copies in it are dropped as they gather."""
        bucket, held, size, least = None, [], 0, _HELD_BYTES

        def flush() -> Iterator[pa.RecordBatch]:
            token, *rest = distinct(held)
            if bucket < 0:
                yield from out(token, *rest, [pa.array(np.full(len(token), -1), pa.int64()), *[pa.nulls(len(token), pa.int64())] * 3])
                return
            with_next = np.concatenate([token[1:] == token[:-1], [False]])
            several = with_next | np.concatenate([[False], with_next[:-1]])
            rows = [c[several] for c in (token, *rest)]
            if len(rows[0]):
                yield from out(*rows, added_up(*rows))

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != bucket and held:
                    yield from flush()
                    held, size, least = [], 0, _HELD_BYTES
                bucket = k
                held.append(row)
                size += sum(map(len, row))
                if size >= least:
                    held = [[c.tobytes() for c in distinct(held)]]
                    size = sum(map(len, held[0]))
                    least = _HELD_BYTES + 2 * size
        if held:
            yield from flush()

    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    with batches_of(spark, _BATCH):
        made = _identified(docs).mapInArrow(lambda b: trimmed(prefixes(b)), packed)
        tokens = written(made.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: trimmed(shared(b)), schema), "tokens")
    release(spark)
    return tokens


def _roots(tokens: DataFrame) -> DataFrame:
    """The roots of tries: token, pivot (the node with the fewest shingles before it, with pn and ppos, its size and the
    root's place) and the size of the least node.

    Of shingles that the same nodes have, the first in the global order comes first in each node, and its least place is
    the least. Nodes are told to be the same by their number and two sums of hashes.
    """
    marks = [F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), F.col("node"))).alias("two")]
    often = tokens.where("many = -1").groupBy("token").agg(F.min(F.struct("pos", "n", "node")).alias("p"), F.count(F.lit(1)).alias("many"), F.min("n").alias("least"), *marks)
    pivot = F.struct("pos", "n", "node").alias("p")
    each = tokens.where("many > 0").select("token", pivot, "many", "least", "one", "two").unionByName(often.where("many > 1"))
    same = each.groupBy("one", "two", "many").agg(F.min_by(F.struct("token", "p", "least"), F.col("p.pos")).alias("root"))
    return same.select("root.token", F.col("root.p.node").alias("pivot"), F.col("root.p.n").alias("pn"), F.col("root.p.pos").alias("ppos"), F.col("root.least").alias("least"))


def _paths(tokens: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """A written table of the rows of the tries: token (the root), node, n, pos and path, the node's shared shingles from
    the root on with their places. Rows that no partner in their trie can suit, by size and place, are left out."""
    ahead = tokens.select("token", "node", "n", "pos").join(small(roots.select("token", "least")), "token", "left")
    # With a partner of `least` shingles, no more than the rest from the root on is common.
    ahead = ahead.withColumn("root", F.expr(f"coalesce({100 + percent} * (n - pos) >= {percent} * (n + least), false)"))
    lists = ahead.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "token", "root"))).alias("all"))
    path = f"transform(slice(all, k + 1, {_DEPTH}), y -> struct(y.token AS token, y.pos AS pos))"
    rows = f"filter(transform(all, (x, k) -> if(x.root, struct(x.token AS token, cast(x.pos AS long) AS pos, {path} AS path), null)), x -> x IS NOT NULL)"
    return written(lists.select("node", "n", F.inline(F.expr(rows))), "paths")


def walk(queries: tuple, members: tuple, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs in the trie of `members`: the members' row and the queries' rows, for each member with any.

    Either is (n, group, path, place) with lists of arrays for the last two: sizes, and for each row its shared shingles
    from the root on with their places in its whole ordered set. Rows of one group are not paired.

    On a path, the overlap counted up to a shingle that both have is exact; what lies beyond is at most the shorter rest.
    """
    size, group, path, place = queries
    n, own, paths, places = members
    order = sorted(range(len(n)), key=lambda k: paths[k].tobytes())
    # Where in the queries a shingle occurs.
    token = np.concatenate(path)
    whose = np.repeat(np.arange(len(path)), [len(p) for p in path])
    rest = size[whose] - np.concatenate(place) - 1
    by_token = np.argsort(token, kind="stable")
    token, whose, rest = token[by_token], whose[by_token], rest[by_token]
    # Shingles that neighbours in the order of the trie have in common, from the root on.
    common = [0] * (len(order) + 1)
    for k in range(1, len(order)):
        a, b = paths[order[k - 1]], paths[order[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[k] = int(differ[0]) if len(differ) else m
    need = lambda least: -(-percent * (size + least) // (100 + percent))
    #: By depth: overlap, the query's rest and the depth at the last common shingle, the bound of the subtree, the live.
    zero = np.zeros(len(size), dtype=np.int64)
    stack = [(zero, size, zero, zero, np.ones(len(size), dtype=bool))]
    k = 0
    while k < len(order):
        row = order[k]
        del stack[common[k] + 1 :]
        for depth in range(len(stack) - 1, len(paths[row])):
            overlap, left, last, reach, live = stack[-1]
            end = k + 1
            while end < len(order) and common[end] > depth:
                end += 1
            below = order[k:end]
            x = paths[row][depth]
            a, b = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
            if b > a:
                hit = whose[a:b]
                overlap, left, last, reach = overlap.copy(), left.copy(), last.copy(), reach.copy()
                overlap[hit] += 1
                left[hit] = rest[a:b]
                last[hit] = depth
                reach[hit] = overlap[hit] + np.minimum(left[hit], max(n[j] - places[j][depth] - 1 for j in below))
            live = live & (reach >= need(min(n[j] for j in below)))
            stack.append((overlap, left, last, reach, live))
            if not live.any():
                break
        overlap, left, last, reach, live = stack[-1]
        if len(stack) <= len(paths[row]) or not live.any():
            # The subtree is left: its other paths go on from the same shingle.
            k += 1
            while k < len(order) and common[k] >= len(stack) - 1:
                k += 1
            continue
        can = live & (group != own[row])
        can &= overlap + np.minimum(left, n[row] - places[row][last] - 1) >= need(n[row])
        if can.any():
            yield row, np.flatnonzero(can)
        k += 1


def _central(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a trie's pivot with the others (pivot, node, with sizes pn and n; the pivot is the smaller one): those for
    which the shorter rest from the root on is long enough. A pair that this rules out at one shingle is met at the first
    it shares, if it can link at all."""
    near = F.expr(f"node <> pivot AND {100 + percent} * least(n - pos, pn - ppos) >= {percent} * (n + pn)")
    both = rows.join(roots.drop("least"), "token").where(near).select(F.struct("n", "node").alias("x"), F.struct(F.col("pn").alias("n"), F.col("pivot").alias("node")).alias("y"))
    both = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return both.select(F.col("x.node").alias("pivot"), F.col("y.node").alias("node"), F.col("y.n").alias("n"), F.col("x.n").alias("pn")).distinct()


def _hopeful(n: np.ndarray, group: np.ndarray, rest: np.ndarray, asks: np.ndarray, holds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries and members of a trie that have a partner at all for which the shorter rest is long enough."""
    some, any_of = np.zeros(len(asks), dtype=bool), np.zeros(len(holds), dtype=bool)
    step = max(1, 1_000_000 // len(holds))
    for k in range(0, len(asks), step):
        a, b = asks[k : k + step, None], holds[None]
        ok = ((100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (n[a] + n[b])) & (group[a] != group[b])
        some[k : k + step] = ok.any(axis=1)
        any_of |= ok.any(axis=0)
    return asks[some], holds[any_of]


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (pivot, node, with sizes pn and n; the pivot is the smaller one) that the tries leave. Rows are
    those of _paths with `many`, the rows of their trie, `query`, and `component`; nodes of one component are not paired.
    A pair may be met in each trie that holds both."""
    names = ["pivot", "node", "n", "pn"]

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        role, node, n, component, path, place = zip(*held)
        role, n = np.asarray(role), np.asarray(n)
        group = np.unique(np.asarray(component, dtype=object), return_inverse=True)[1]
        asks, holds = np.flatnonzero(role <= 1), np.flatnonzero(role != 1)
        if len(asks) and len(holds):
            asks, holds = _hopeful(n, group, n - np.asarray([p[0] for p in place]), asks, holds, percent)
        if not len(asks) or not len(holds):
            return
        some = lambda at: (n[at], group[at], [path[k] for k in at], [place[k] for k in at])
        first, second = [], []
        for member, found in walk(some(asks), some(holds), percent):
            a, b = holds[member], asks[found]
            if role[a] != 2:
                b = b[[node[a] < node[k] for k in b]]  # two queries meet twice
            first.append(np.full(len(b), a))
            second.append(b)
        if not first:
            return
        a, b = np.concatenate(first), np.concatenate(second)
        low = np.asarray([(n[x], node[x]) <= (n[y], node[y]) for x, y in zip(a, b)], dtype=bool)
        a, b = np.where(low, a, b), np.where(low, b, a)
        for k in range(0, len(a), 10_000):
            x, y = a[k : k + 10_000], b[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in x], pa.binary()), pa.array([node[i] for i in y], pa.binary()), pa.array(n[y]), pa.array(n[x])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            lists = batch.column(7)
            ends, flat = lists.offsets.to_numpy(), lists.values
            token, place = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy().astype(np.int64)
            values = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())
            for k, (key, value) in enumerate(zip(keys, values)):
                if key != now and held:
                    yield from pairs(held)
                    held = []
                now = key
                held.append((*value, token[ends[k] : ends[k + 1]].copy(), place[ends[k] : ends[k + 1]].copy()))
        if held:
            yield from pairs(held)

    parts = F.ceil(F.col("many") / _TRIE_NODES)
    mine = F.pmod(F.xxhash64("node"), parts)
    # In a grid of parts, queries are dealt by rows and meet all columns, members the other way round. Roles: 0 query and
    # member, 1 query, 2 member alone, 3 member that is a query elsewhere in its row of the grid.
    role = lambda x, a, b: F.struct(F.lit(x).alias("role"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    grid = lambda f: F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), f)
    dealt = F.when(parts <= 1, F.array(role(0, F.lit(0), F.lit(0)))).otherwise(F.concat(grid(lambda j: role(2, j, mine)), grid(lambda j: role(1, mine, j))))
    dealt = F.filter(dealt, lambda x: F.col("query") | (x["role"] != 1))
    flat = rows.select("token", "node", "n", "component", "path", "query", F.inline(dealt))
    flat = flat.withColumn("role", F.when((F.col("role") == 0) & ~F.col("query"), 2).when((F.col("role") == 2) & F.col("query"), 3).otherwise(F.col("role")))
    flat = flat.select("token", "a", "b", "role", "node", "n", "component", "path")
    dealt_rows = flat.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b")
    return dealt_rows.mapInArrow(lambda b: trimmed(run(b)), "pivot binary, node binary, n long, pn long")


def trie_links(pivot: np.ndarray, members: list[tuple[bytes, np.ndarray]], percent: int = PERCENT) -> list[bytes]:
    """The members linked with the pivot. All sets are in the global order.

    Members are walked in the order of their sets, as a depth-first walk of their trie would: `depth` of the path and the
    overlap on it are kept from one to the next, as far as the two agree.
    """
    place = np.argsort(pivot, kind="stable")
    sorted_pivot, size, links = pivot[place], len(pivot), []
    path, depth, hits, reach = np.zeros(0, np.uint64), 0, np.zeros(1, np.int64), np.zeros(1, np.int64)
    for _, node, values in sorted((v.tobytes(), node, v) for node, v in members):
        n = len(values)
        need = -(-percent * (size + n) // (100 + percent))
        upto = min(depth, n, len(path))
        differ = np.flatnonzero(values[:upto] != path[:upto])
        depth = int(differ[0]) if len(differ) else upto
        hits, reach = hits[: depth + 1], reach[: depth + 1]
        while hits[-1] + min(n - depth, size - reach[-1]) >= need and depth < n:
            step = values[depth : depth + 128]
            rank = np.minimum(np.searchsorted(sorted_pivot, step), size - 1)
            found = sorted_pivot[rank] == step
            hits = np.concatenate([hits, hits[-1] + np.cumsum(found)])
            reach = np.concatenate([reach, np.maximum.accumulate(np.maximum(reach[-1], np.where(found, place[rank] + 1, 0)))])
            depth += len(step)
        if depth == n:
            both = int(hits[-1])
            if 100 * both >= percent * (size + n - both):
                links.append(node)
        path = values
    return links


def parity(values: np.ndarray) -> bytes:
    """A bit for each residue of the set's shingles, modulo a power of two at least four times its size: odd counts set it.

    The bits in which two sets differ are no more than the shingles in which they differ, and are seldom far fewer.
    """
    m = 1 << max(8, (len(values) - 1).bit_length() + 2)
    count = np.bincount((values & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two parity strings differ, the longer one folded to the size of the other."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n != m:
        half = max(n, m) // 2
        if n > m:
            x, n = (x >> 8 * half) ^ (x & ((1 << 8 * half) - 1)), half
        else:
            y, m = (y >> 8 * half) ^ (y & ((1 << 8 * half) - 1)), half
    return (x ^ y).bit_count()


def _of_nodes(docs: DataFrame, table: DataFrame, nodes: DataFrame, make, width: int) -> DataFrame:
    """A written table of node and value, what `make` makes of its set, for the nodes that are asked for (and maybe others
    whose documents share an id with theirs)."""
    wanted = table.where("n > 0").groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node").select("id").distinct()
    wanted = small(durable(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_key(values), make(values)) for _, values in _sets(batch.column(3), width) if len(values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows) if rows else [[]] * 2)], ["node", "value"])

    with batches_of(docs.sparkSession, _BATCH):
        return written(_identified(docs).join(wanted, "id", "left_semi").mapInArrow(lambda b: trimmed(run(b)), "node binary, value binary"), "sets", "none")


def _possible(docs: DataFrame, table: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose parity bits leave room for a link: most unlinked pairs end here, without their sets."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, pn, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                keep.append(_differ(a, b) <= n + pn - 2 * -(-percent * (n + pn) // (100 + percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["pivot", "node", "n"]).filter(pa.array(keep, pa.bool_()))

    bits = _of_nodes(docs, table, _ends(pairs), parity, width)
    light = durable(bits.dropDuplicates(["node"]))
    discard(bits)
    both = pairs.join(light.withColumnRenamed("value", "bits"), "node").join(light.select(F.col("node").alias("pivot"), F.col("value").alias("pivot_bits")), "pivot")
    with batches_of(docs.sparkSession, _BATCH):
        return durable(both.select("pivot", "node", "n", "pn", "bits", "pivot_bits").mapInArrow(lambda b: trimmed(judge(b)), "pivot binary, node binary, n long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()


def _verified(docs: DataFrame, table: DataFrame, pairs: DataFrame, places, width: int, percent: int) -> DataFrame:
    """The linked ones of pairs (pivot, node, n and the pivot's pn); a written table of a and b."""
    pairs = _possible(docs, table, pairs, width, percent)
    sets = _of_nodes(docs, table, _ends(pairs), lambda values: _ordered(values, *places.value)[0].tobytes(), width)
    size = pairs.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / _TRIE_SETS, F.sum("n") / _TRIE_TOKENS)).alias("parts"))
    dealt = durable(pairs.join(size, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node"))
    heads = dealt.select("pivot", "part", F.lit(0).alias("role"), F.col("pivot").alias("node")).distinct()
    places = durable(dealt.select("pivot", "part", F.lit(1).alias("role"), "node").unionByName(heads))
    rows = sets.withColumnRenamed("value", "tokens").join(small(places), "node").select("pivot", "part", "role", "node", "tokens")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, members = None, None, {}

        def flush() -> list[tuple[bytes, bytes]]:
            return [(now[0], node) for node in trie_links(pivot, list(members.items()), percent)] if pivot is not None and members else []

        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for group, part, role, node, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, part) != now:
                    links += flush()
                    now, pivot, members = (group, part), None, {}
                values = np.frombuffer(tokens, dtype="<u8")
                if role == 0:
                    pivot = values
                else:
                    members[node] = values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*links) if links else [[], []])], ["a", "b"])
        links = flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*links) if links else [[], []])], ["a", "b"])

    sorted_rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")
    with batches_of(docs.sparkSession, _BATCH):
        links = written(sorted_rows.mapInArrow(lambda b: trimmed(walk(b)), "a binary, b binary"), "links")
    discard(sets)
    release(docs.sparkSession)
    return links


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles and node of every row, and the component of its node: null for an empty set."""
    spark = docs.sparkSession
    table = _described(docs, width)
    places = spark.sparkContext.broadcast(_order(table))
    total = table.agg(F.sum((100 - percent) * F.col("n") / 100 + 1)).first()[0] or 0
    tokens = _shared_tokens(docs, places, max(12, int(total / _BUCKET_TOKENS)), width, percent)
    roots = durable(_roots(tokens))
    rows = _paths(tokens, roots, percent)
    discard(tokens)
    # First pass: every node against the centre of its trie.
    stars = durable(_central(rows, roots, percent))
    links = _verified(docs, table, stars, places, width, percent)
    found = durable(components(links))
    # Second pass: nodes outside the largest component of their trie.
    mine = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kinds = mine.groupBy("token", "component").agg(F.count(F.lit(1)).alias("many"))
    main = kinds.groupBy("token").agg(F.max(F.struct("many", "component"))["component"].alias("main"), F.sum("many").alias("many"), F.count(F.lit(1)).alias("kinds"))
    mine = mine.join(durable(main.where("kinds > 1").drop("kinds")), "token").withColumn("query", F.col("component") != F.col("main"))
    with batches_of(spark, _BATCH):
        pairs = durable(_candidates(mine, percent).distinct().join(stars, ["pivot", "node"], "left_anti"))
    if not pairs.isEmpty():
        links = links.unionByName(_verified(docs, table, pairs, places, width, percent))
        found = durable(components(links))
    discard(rows)
    each = table.where("node IS NOT NULL").select("doc_id", "mark", "node", F.col("n").alias("n_shingles"))
    named = small(found.select(F.col("node").alias("_node"), "component"))
    each = each.join(named, (F.col("n_shingles") > 0) & (F.col("node") == F.col("_node")), "left")
    return each.select("doc_id", "mark", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and node (equal for equal sets) of every row."""
    rows = durable(_grouped(docs, width, percent))
    # A document that is alone in its component needs no join: only components of several rows are looked up.
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    least = small(durable(least.where("rows > 1").select(F.col("component").alias("_component"), "least")))
    rows = rows.join(least, F.col("component") == F.col("_component"), "left")
    component = F.when(F.col("_component").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), "node")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each component, and all rows that are linked with nothing.

    The row with the smallest doc_id stays, then the one with the smallest hash of its text; of rows that agree in both
    any one. Rows are told apart by both, so that a row of another text keeps its place beside a row of the same doc_id
    that goes. Rows with a null doc_id stay, all of them.
    """
    rows = durable(_grouped(docs, width, percent).where("component IS NOT NULL AND doc_id IS NOT NULL"))
    order = F.struct("doc_id", "mark")
    groups = rows.groupBy("component").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("rows"))
    groups = small(durable(groups.where("rows > 1").drop("rows")))
    several = rows.join(groups, "component").withColumn("goes", order != F.col("stays"))
    several = durable(several.groupBy("doc_id", "mark", "goes").agg(F.count(F.lit(1)).alias("rows")))
    docs, name = marked(docs)
    return one_each(docs, name, durable(several.where("goes").select("doc_id", "mark")), durable(several.where("NOT goes AND rows > 1").select("doc_id", "mark")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node")
