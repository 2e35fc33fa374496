import random

import numpy as np
import pyarrow as pa

from plumbline.llm import decontamination as D
from plumbline.llm.flat import words, flat_bytes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def as_words(text):
    return words(*flat_bytes(pa.array([text], pa.string())), D.BREAKS)[0]


def made(seed, n_items=12, n_docs=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(8, 40))) for k in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = text(rng.randint(0, 120)).split()
        if d % 2:
            i = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, len(i) // 5)):
                k = rng.randrange(len(i))
                i[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [i[k], rng.choice(vocabulary)]])
            at = rng.randint(0, len(w))
            w[at:at] = i
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    return items, docs


def brute(items, docs):
    out = {}
    for d, t in docs:
        w = as_words(t)
        for i, u in items:
            v = as_words(u)
            n = len(v)
            if n < D.LEAST_WORDS or not len(w):
                continue
            best = min((distance(v, w[s : s + n]), s) for s in range(max(1, len(w) - n + 1)))
            if best[0] <= int(n * D.EDITS):
                out[d, i] = best
    return out


def test_recall_and_exactness_against_brute_force(spark):
    hit = total = 0
    for seed in range(3):
        items, docs = made(seed)
        want = brute(items, docs)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r.doc_id, r.item_id): r.distance for r in D.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), block_items=5).collect()}
        assert set(got) <= set(want)
        assert all(got[k] >= want[k][0] for k in got)
        hit, total = hit + len(got), total + len(want)
    assert total > 40 and hit / total >= 0.95


def wide_brute(items, docs):
    """Distance, start and length of the best window of n - k to n + k words."""
    out = {}
    for d, t in docs:
        w = as_words(t).tolist()
        for i, u in items:
            v = as_words(u).tolist()
            n, k = len(v), int(len(v) * D.EDITS)
            if n < D.LEAST_WORDS:
                continue
            # By start: the last row of the table has the distance to each prefix.
            best = (n, 0, 0)
            for s in range(len(w)):
                part = w[s : s + n + k]
                row = list(range(len(part) + 1))
                for a, x in enumerate(v, 1):
                    last, row[0] = row[0], a
                    for b, y in enumerate(part, 1):
                        last, row[b] = row[b], min(row[b] + 1, row[b - 1] + 1, last + (x != y))
                best = min(best, min((e, s, m) for m, e in enumerate(row) if m))
            if best[0] <= k:
                out[d, i] = best
    return out


def test_passages_with_insertions(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 6))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (10, 15, 20, 25, 30, 40)]
    docs = []
    for j in range(60):
        i = list(items[j % 6])
        for c in range(len(i) // 5, 0, -1):
            at = len(i) * c // (len(i) // 5 + 1)
            i[at : at + (j // 6 % 3 == 1)] = [] if j // 6 % 3 == 1 else text(1)
        docs.append((j, " ".join(text(rng.randint(0, 20)) + i + text(rng.randint(0, 20)))))
    items = [(k, " ".join(i)) for k, i in enumerate(items)]
    want = wide_brute(items, docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.word_start, r.word_end - r.word_start) for r in D.find_leaks(frame, bench, wide=True).collect()}
    assert len(want) == 60 and set(got) <= set(want) and len(got) >= 57
    assert all(got[k] == want[k] for k in got)
    fixed = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect()}
    assert len(fixed) < len(got)
    assert {r.doc_id for r in D.keep_clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 90))] for _ in range(2))
        x, y = as_words(" ".join(a)), as_words(" ".join(b))
        assert D.edit_distance(D.masks(x), len(x), y) == distance(a, b)


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, f"x {item}, y"), (5, "one two three " + "z " * 30_000 + item), (6, "one two three four five six seven eight")]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, item_id int, distance string")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (None, item)], "item_id long, text string")
    got = D.find_leaks(frame, items).collect()
    assert sorted((str(r.doc_id), r.word_start) for r in got) == sorted([("3", 0)] * 6 + [("None", 1)] * 3 + [("5", 30_003)] * 3 + [("6", 0)] * 3)
    kept = D.keep_clean(frame, items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2"] and kept.columns == frame.columns
    assert D.find_leaks(frame, items.limit(0)).count() == 0 == D.find_leaks(frame.limit(0), items).count()


def test_short_items_are_sought_word_for_word(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four five six seven"), (4, " ,; "), (5, "é f g")]
    docs = [(1, "x Alpha, y"), (2, "beta, GAMMA"), (3, "beta x gamma"), (4, "one two three four five six seven"), (5, "one two three four five six eight"), (6, "alphabet"), (7, "d é f g alpha"), (8, " ,; ")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 1, 2), (2, 2, 0, 2), (4, 3, 0, 7), (7, 1, 4, 5), (7, 5, 1, 4)}
    for wide in (False, True):
        assert {(r.doc_id, r.item_id, r.word_start, r.word_end) for r in D.find_leaks(frame, bench, wide=wide).collect()} == want
    assert {r.doc_id for r in D.keep_clean(frame, bench).collect()} == {3, 5, 6, 8}


def test_blocks_are_bounded_by_text(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 30)
    items, docs = made(9)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D._blocks(bench, 1000))) == len(items)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect()}
    assert got <= set(brute(items, docs)) and len(got) >= 0.9 * len(brute(items, docs))


def test_walks_agree_with_a_plain_version():
    rng = np.random.default_rng(5)
    for rows, width, size in ((1, 1, 1), (40, 9, 9), (D._ROWS + 3, 12, 14)):
        sequences, length = rng.integers(0, 2**63, (rows, width), dtype=np.uint64), rng.integers(0, width + 1, rows)
        got, picker = D.signatures(sequences, length, size), np.random.default_rng([3, size])
        picks = [[picker.choice(3 * size, min(D.SAMPLED, 3 * size), replace=False).tolist() for _ in range(D.TABLES)] for _ in range(D.WALKS)]
        whole = (1 << 64) - 1
        for r in sorted({0, rows // 2, rows - 1}):
            for walk in range(D.WALKS):
                at, keys = 0, [size * 64 + walk] * D.TABLES
                for step in range(3 * size):
                    symbol = int(sequences[r, at]) if at < length[r] else int(D._PAD)
                    for t in range(D.TABLES):
                        if step in picks[walk][t]:
                            keys[t] = int(D.mixed(np.uint64((keys[t] * 0x9E3779B97F4A7C15 + symbol + t + 1) & whole)[None])[0])
                    at += int(D.mixed(np.uint64((symbol + 3 + walk * 1_000_003 + step * 7919) & whole)[None])[0]) >> 63
                assert got[r, walk * D.TABLES : (walk + 1) * D.TABLES].tolist() == keys


def test_a_near_miss_is_gone_through_once(monkeypatch):
    item = [f"w{k}" for k in range(40)]
    miss = [w if k % 5 else f"x{k}" for k, w in enumerate(item)]  # 8 edits are within, so two more are added
    miss[7:7], miss[22:22] = ["y"], ["z"]
    texts = [" ".join(miss), " ".join(["a", "b", *item, "c"]), " ".join(miss + ["f"] * 90 + item[:20] + ["g"] + item[20:])]
    index = D.index_of([(1, " ".join(item))], wide=True)
    calls, plain = [], D.best_window
    monkeypatch.setattr(D, "best_window", lambda *a: calls.append(1) or plain(*a))
    found = index.matches(pa.array(texts))
    assert [(r, s, m, d) for r, _, s, m, d in found] == [(1, 2, 40, 0), (2, 132, 41, 1)]
    calls.clear()
    assert index.matches(pa.array(texts[:1] * 20)) == [] and not calls
