import random
import re

import numpy as np
import pytest

from plumbline.llm import ngram_join as J


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted((str(d), len(sets[k]), str(least.get(root(k)) if sets[k] else d)) for k, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdÉx") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, docs = [text(rng.randint(5, 60)) for _ in range(6)], []
    for family in range(25):
        base = text(rng.randint(0, 120))
        if rng.random() < 0.6:
            base += rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(rng.choice([" ", "\t\n", "  "]).join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "often"), [(1, 64), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, often):
    monkeypatch.setattr(J, "FREQUENT_FROM", often)
    rows = corpus(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One TWO"), (None, "one two"), (9004, "One TWO"), (9005, "solo"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, component_id string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_trie_links_equal_set_arithmetic():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.sort(rng.choice(10_000, 400, replace=False).astype(np.uint64))
        order = rng.permutation(pool)
        rank = {v: k for k, v in enumerate(order.tolist())}
        some = lambda: np.asarray(sorted(rng.choice(pool, rng.integers(1, 300), replace=False).tolist(), key=rank.get), dtype=np.uint64)
        pivot = some()
        members = []
        for k in range(12):
            m = some() if k % 3 == 0 else np.asarray(sorted(set(pivot[rng.random(len(pivot)) > rng.random() * 0.3].tolist()) | {int(pool[0])}, key=rank.get), dtype=np.uint64)
            members.append((k, m))
        want = [k for k, m in members if 100 * len(set(m.tolist()) & set(pivot.tolist())) >= 80 * len(set(m.tolist()) | set(pivot.tolist()))]
        assert sorted(J.trie_links(pivot, members)) == want


def test_keep_one_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "z"), (None, "a b c d e f g"), (5, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in J.keep_one(docs).collect()) == ["1", "2", "5", "None"]
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_goes_by_rows(spark):
    same, other = "a b c d e f g", "quite another text of some words"
    rows = [(3, same), (7, same), (7, other), (7, other), (9, other + " more"), (9, None), (None, same), (11, "alone here"), (11, "alone here")]
    docs = spark.createDataFrame([(*r, k, {"k": k}) for k, r in enumerate(rows)], "doc_id long, text string, _gone int, _MARK map<string, int>")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert got == sorted([("3", same), ("7", other), ("9", other + " more"), ("9", "None"), ("None", same), ("11", "alone here")])


def candidates(rows, percent=80):
    """All pairs of one trie that the walk leaves, from (n, group, tokens, places)."""
    n, group = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows])
    side = (n, group, [r[2] for r in rows], [r[3] for r in rows])
    return {(min(a, b), max(a, b)) for a, found in J.walk(side, side, percent) for b in found.tolist()}


@pytest.mark.parametrize("seed", range(4))
def test_walk_meets_every_linked_pair_and_few_others(seed):
    rng = np.random.default_rng(seed)
    root, rows, sets = 5, [], []
    for family in range(12):
        base = rng.choice(np.arange(6, 5000), rng.integers(3, 60), replace=False)
        for _ in range(6):
            keep = base[rng.random(len(base)) > rng.random() * 0.25]
            own = np.sort(rng.choice(5, rng.integers(0, 5), replace=False))
            sets.append(np.concatenate([own, [root], np.sort(keep)]))
    seen = {}
    for s in sets:
        for x in s[: len(s) - J.required(len(s)) + 1].tolist():
            seen[x] = seen.get(x, 0) + 1
    for k, s in enumerate(sets):
        head = len(s) - J.required(len(s)) + 1
        if root not in s[:head]:
            continue
        at = [j for j in range(head) if s[j] >= root and seen[s[j]] > 1][:16]
        rows.append((len(s), k, s[at].astype(np.uint64), np.asarray(at), k))
    linked = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (lambda a, b: not (a & b & set(range(5))) and 100 * len(a & b) >= 80 * len(a | b))(set(sets[rows[i][4]].tolist()), set(sets[rows[j][4]].tolist()))}
    found = candidates([r[:4] for r in rows])
    assert linked <= found and len(found) <= len(rows) * (len(rows) - 1) // 4


def test_tries_dealt_to_a_grid(spark, monkeypatch):
    monkeypatch.setattr(J, "_TRIE_NODES", 3)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(docs).collect()) == brute(rows)


def test_very_long_text_and_word(spark):
    words = " ".join(f"w{k % 977}x{k % 1013}" for k in range(150_000))
    rows = [(1, words), (2, words + " end"), (3, "x" * 2_000_000), (4, "y" + "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.component_id) for r in J.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
