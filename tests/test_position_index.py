import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import position_index as P
from plumbline.options import IndexOptions


def made(spark, keys, **options):
    return P.build(spark.createDataFrame([(int(k),) for k in keys], "key long"), options=IndexOptions(**options))


def asked(spark, keys):
    return spark.createDataFrame([(int(k),) for k in keys], "key long")


CASES = {
    "dense": (range(3000), 32),
    "gaps": (range(0, 1000, 2), 16),
    "single": ([42], 1),
    "duplicates": ([1, 1, 1, 2, 2, 3, 3, 3, 3], 1),
    "sparse": ([1, 100, 10**4, 10**6, 10**8], 4),
    "negative": (range(-1000, 1000), 32),
    "all_same": ([42] * 100, 1),
    "near_max": (range(2**63 - 1002, 2**63 - 2), 16),
    "quadratic": ([i * i for i in range(1000)], 16),
    "random": (sorted({random.Random(12345).randrange(10**6) for _ in range(4000)}), 32),
    "long_runs": ([7] * 300 + [8] * 5 + [9] * 700, 8),
}


@pytest.mark.parametrize("name", CASES)
def test_lookup_and_lower_bound(spark, name):
    keys, epsilon = CASES[name]
    keys = list(keys)
    index = made(spark, keys, epsilon=epsilon)
    rng = random.Random(1)
    probes = rng.sample(keys, min(60, len(keys))) + [keys[0] - 1, keys[-1] + 1, keys[0], keys[-1]] + [rng.randint(keys[0], keys[-1]) for _ in range(40)]
    first = {}
    for k, v in enumerate(keys):
        first.setdefault(v, k)
    got = index.lookup(asked(spark, probes)).collect()
    assert sorted((r.key, r.pos) for r in got if r.pos is not None) == sorted((p, first[p]) for p in probes if p in first)
    assert len(got) == len(probes)
    lower = {(r.key, r.lower) for r in index.lower_bound(asked(spark, probes)).collect()}
    assert lower == {(p, int(np.searchsorted(np.asarray(keys, dtype=np.int64), p))) for p in probes}
    audit = index.audit().first()
    assert audit.violations == 0 and audit.max_error <= epsilon
    assert index.count_hits(asked(spark, probes + probes)).first().hits == 2 * sum(p in first for p in probes)


def test_audit_counts_repeated_keys_each(spark):
    keys = sorted([*range(0, 900, 3), *[30] * 70, *[33] * 2, 900])
    index = made(spark, keys, epsilon=4)
    audit = index.audit().first()
    assert (audit.keys, audit.violations) == (len(keys), 0)
    # Lines that are 100 positions off: each row of a key is a violation.
    moved = P.PositionIndex(index.data.withColumn("pos", F.col("pos") + 100), index.segments, IndexOptions(4)).audit().first()
    assert (moved.keys, moved.violations) == (len(keys), len(keys)) and moved.max_error >= 96


def test_empty(spark):
    index = made(spark, [], epsilon=8)
    assert index.stats().first().asDict() == {"len": 0, "segments": 0, "avg_segment_size": 0.0, "index_bytes": 4, "total_bytes": 4}
    assert index.predict(asked(spark, [1])).first().pred is None
    assert index.lookup(asked(spark, [1])).first().pos is None
    assert index.audit().first().asDict() == {"keys": 0, "violations": 0, "max_error": 0, "avg_error": 0.0}


def test_more_tolerance_needs_no_more_segments(spark):
    rng = np.random.default_rng(3)
    keys = np.cumsum(rng.integers(1, 100, 20_000))
    assert made(spark, keys, epsilon=8, exact=True).segments.count() >= made(spark, keys, epsilon=128, exact=True).segments.count()


def test_epsilon_is_one_at_least():
    assert IndexOptions(0).epsilon == IndexOptions(-3).epsilon == 1


def test_save_and_load(spark, tmp_path):
    index = made(spark, range(100), epsilon=4)
    index.save(str(tmp_path))
    again = P.PositionIndex.load(spark, str(tmp_path), IndexOptions(4))
    assert again.lookup(asked(spark, [5])).first().pos == 5


@pytest.mark.parametrize("rows", [97, 1000, 10**6])
def test_an_exact_fit_in_blocks_is_that_of_one_pass(spark, monkeypatch, rows):
    rng = np.random.default_rng(8)
    keys = np.concatenate([np.arange(700), 700 + np.cumsum(rng.integers(0, 60, 1500)), np.full(200, 10**6), [2**62, 2**63 - 1]])
    low = np.concatenate([[-(2**63)], keys])
    monkeypatch.setattr(P, "EXACT_ROWS", rows)
    for epsilon in (1, 32):
        got = made(spark, rng.permutation(low), epsilon=epsilon, exact=True).segments.orderBy("start_idx").collect()
        # A plain version: from each start as far as one slope reaches.
        want, a = [], 0
        while a < len(low):
            lo, hi, b = -np.inf, np.inf, a + 1
            while b < len(low):
                dk, di = float(int(low[b]) - int(low[a])), b - a
                if dk == 0 and di > epsilon:
                    break
                x, y = (max(lo, (di - epsilon) / dk), min(hi, (di + epsilon) / dk)) if dk else (lo, hi)
                if x > y:
                    break
                lo, hi, b = x, y, b + 1
            want.append((int(low[a]), int(low[b - 1]), a, b))
            a = b
        assert [(r.min_key, r.max_key, r.start_idx, r.end_idx) for r in got] == want and len(want) > 5


def test_an_exact_fit_sorts_blocks_alone(spark, monkeypatch):
    taken, plain = [], P._pass
    monkeypatch.setattr(P, "EXACT_ROWS", 100)
    monkeypatch.setattr(P, "_pass", lambda dealt, *a: taken.append(dealt.count()) or plain(dealt, *a))
    assert made(spark, range(1050), exact=True).stats().first().segments == 1
    assert taken == [100] * 10 + [50]
