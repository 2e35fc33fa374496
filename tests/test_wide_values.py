"""Values and keys over the whole 64-bit domain, and tables on either side of the limits of one task."""

import bisect
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import catalogue
from plumbline.operators import address_map as M
from plumbline.operators import position_index as P
from plumbline.operators import sequence_codec as C
from plumbline.operators import trace_analytics as A
from plumbline.options import IndexOptions, MapOptions, SequenceOptions
from plumbline.plans import ordering

TOP, ALL = (1 << 63) - 1, 1 << 64


def _wide(n):
    rng = random.Random(n)
    return [rng.getrandbits(64) for _ in range(n)]


@pytest.mark.parametrize("limit", [10**9, 100, 7])
def test_orders_keep_every_row_on_both_sides_of_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "RANGE_ROWS", limit)
    rng = random.Random(3)
    # A hot value, ties told apart by the second column, and nulls in the first.
    rows = [(rng.choice([None, 5, 5, 5, rng.randint(-50, 50)]), k, rng.randint(-9, 9)) for k in range(300)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(5)
    got = sorted(tuple(r) for r in ordering.positions(df, ["a", "b"]).select("pos", "b").collect())
    assert got == [(k, r[1]) for k, r in enumerate(rows)]
    total, want = 0, []
    for r in rows:
        total += r[2]
        want.append((r[1], total))
    got = [tuple(r) for r in ordering.running_sum(df, F.col("v"), ["a", "b"], "s").select("b", "s").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [10**9, 60, 7])
def test_as_of(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "RANGE_ROWS", limit)
    rng = random.Random(4)
    starts = [(rng.randint(0, 2000), k) for k in range(80)]
    keys = sorted({rng.randint(-100, 2500) for _ in range(200)})
    right = spark.createDataFrame(starts, "at long, nr long").repartition(3)
    got = {r.key: r.seg and tuple(r.seg) for r in ordering.as_of(spark.createDataFrame([(k,) for k in keys], "key long"), right, "key", "at", "nr", "seg").collect()}
    for k in keys:
        below = [s for s in starts if s[0] <= k]
        assert got[k] == (max(below) if below else None)


KEYS = {
    "near_max": [ALL - 1001 + k for k in range(1000)],
    "whole": sorted(_wide(700)) + [ALL - 1] * 5,
    "jumps": [0, 1, 2, TOP, TOP + 1, TOP + 2, ALL - 2, ALL - 1],
    "same": [TOP + 7] * 100,
}


@pytest.mark.parametrize("name", KEYS)
def test_unsigned_keys(spark, name):
    keys = KEYS[name]
    rng = random.Random(2)
    probes = sorted({*rng.sample(keys, min(60, len(keys))), *(rng.randrange(ALL) for _ in range(40)), keys[0] - 1 if keys[0] else 0, keys[-1], 0, ALL - 1})
    frame = lambda x: spark.createDataFrame([(Decimal(k),) for k in x], "key decimal(20,0)")
    index = P.build(frame(keys).repartition(3), options=IndexOptions(16))
    got = {int(r.key): r.lower for r in index.lower_bound(frame(probes)).collect()}
    assert got == {k: bisect.bisect_left(keys, k) for k in probes}
    first = {int(r.key): r.pos for r in index.lookup(frame(probes)).collect()}
    assert first == {k: bisect.bisect_left(keys, k) if k in set(keys) else None for k in probes}
    assert {int(r.key) for r in index.misses(frame(probes)).collect()} == set(probes) - set(keys)
    assert index.count_hits(frame(probes)).first().hits == len(set(probes) & set(keys))
    assert index.audit().first().violations == 0
    assert index.lookup_table().count() >= index.segments.count()


def test_signed_keys_of_both_ends(spark):
    keys = sorted([-TOP - 1, -TOP, -5, 0, 7, TOP - 1, TOP] + [x - TOP - 1 for x in _wide(200)])
    probes = [-TOP - 1, -TOP, -6, -5, 1, TOP, keys[50], keys[50] + 1]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key long")
    index = P.build(frame(keys), options=IndexOptions(4))
    assert {r.key: r.lower for r in index.lower_bound(frame(probes)).collect()} == {k: bisect.bisect_left(keys, k) for k in probes}
    assert index.predict(frame([None])).first().pred is None


def test_skewed_probes_and_null_keys(spark):
    keys = spark.range(500).select((F.col("id") * 3).alias("key"))
    probes = spark.createDataFrame([(30,)] * 400 + [(31,), (None,)], "key long")
    got = P.build(keys).lower_bound(probes).groupBy("key", "lower").count().collect()
    assert sorted((str(r.key), str(r.lower), r["count"]) for r in got) == sorted([("30", "10", 400), ("31", "11", 1), ("None", "None", 1)])


def test_byte_keys(spark):
    words = sorted({"".join(random.Random(k).choices("abcé\x00z", k=k % 12)) for k in range(200)}, key=lambda w: w.encode())
    cut = sorted(w.encode()[:8].ljust(8, b"\0") for w in words)
    frame = spark.createDataFrame([(w,) for w in words], "name string")
    index = P.build(frame.select(P.byte_key(F.col("name")).alias("key")))
    got = {r.name: r.lower for r in index.lower_bound_bytes(frame, "name").collect()}
    assert got == {w: bisect.bisect_left(cut, w.encode()[:8].ljust(8, b"\0")) for w in words}


@pytest.mark.parametrize("values", [
    [0, 1 << 62, TOP], [-(1 << 62), 1 << 62, 5], [0, 1 << 50], [0, 5, 1 << 47], [-TOP - 1, TOP], [TOP, -TOP - 1, 0, TOP], [7],
    [random.Random(1).randint(-TOP, TOP) for _ in range(300)], sorted(random.Random(2).randint(-TOP, TOP) for _ in range(300)),
])
def test_wide_sequences(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "pos long, value long")
    blocks = C.encode(df)
    rows = {r.block_id: r for r in blocks.collect()}
    assert [r.value for r in C.decode(blocks).orderBy("pos").collect()] == values == C.load(C.dump(blocks))
    # The column expressions and the kernel agree, and the line is the exact one, cut at the largest number.
    lines = {r.block_id: (r.n, r.first, r.slope) for r in C.block_lines(df).collect()}
    assert lines == {k: (r.n, r.first, r.slope) for k, r in rows.items()}
    for k, (n, first, slope) in lines.items():
        part = values[k * 128 : k * 128 + n]
        assert slope == min(TOP, (max(0, part[-1] - part[0]) << C.FRACTION) // max(1, n - 1))
    codes = C.residuals(df)
    assert {r.block_id: r.width for r in C.width_choice(codes).collect()} == {k: r.width for k, r in rows.items()}
    for r in codes.collect():
        _, first, slope = lines[r.block_id]
        rest = (values[r.pos] - first - ((r.pos % 128) * slope >> C.FRACTION) + (1 << 63)) % ALL - (1 << 63)
        assert r.code % ALL == (2 * rest if rest >= 0 else -2 * rest - 1)


def test_large_blocks(spark):
    options = SequenceOptions(block=1000)
    values = [k * k * 977 - (k % 7) * 10**12 for k in range(2500)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, value long")
    assert [r.value for r in C.decode(C.encode(df, options), options).orderBy("pos").collect()] == values


def states():
    rng = random.Random(6)
    return {
        "max bits": {0: 1, 1: ALL - 2},
        "near max": {k: ALL - 101 + k % 2 for k in range(100)},
        "incompressible": {k: (1234567 * k) ^ 0x5555555555555555 for k in range(512)},
        "steep": {k: k * ((1 << 64) // 400) for k in range(400)},
        "lines": {k: 10**18 + 12345 * k + rng.randint(0, 9) + (10**6 if k % 97 == 5 else 0) for k in range(3000) if k % 11},
        "few": {5: 9, 4000: 7, 70_000: ALL - 1},
    }


@pytest.mark.parametrize("name", states())
@pytest.mark.parametrize("group", [64, 4096])
def test_unsigned_maps_and_point_decoding(spark, name, group):
    state, options = states()[name], MapOptions(group=group, unsigned=True)
    df = spark.createDataFrame([(k, Decimal(v), k // group) for k, v in state.items()], "lba long, pba decimal(20,0), grp long").repartition(3)
    groups = M.encode(df, options).persist()
    assert {r.lba: int(r.pba) for r in M.decode(groups, options).collect()} == state
    asked = [*range(0, 80_000, 37), *state][:3000]
    got = {r.lba: r.pba for r in M.get(groups, spark.createDataFrame([(k,) for k in asked + asked[:5]] + [(None,)], "lba long"), options).collect()}
    assert got == {k: Decimal(state[k]) if k in state else None for k in asked}


def test_values_below_zero_are_refused(spark):
    df = spark.createDataFrame([(0, -1, 0), (1, 5, 0)], "lba long, pba long, grp long")
    with pytest.raises(Exception, match="InvalidData"):
        M.encode(df).collect()


@pytest.mark.parametrize("group", [64, 4096])
def test_maps_of_more_than_64_bits_and_either_sign(spark, group):
    state = {k: v for name, some in enumerate(states().values()) for k, v in ((k + name * 100_000, v) for k, v in some.items())}
    state |= {10**6: -1, 10**6 + 1: -(10**37), 10**6 + 2: 10**37, 10**6 + 3: 1 << 64, 10**6 + 4: -(1 << 64), 10**6 + 5: 0}
    state |= {2 * 10**6 + k: ALL - (6_000_000 + k) ** 2 * 1000003 for k in range(200)}
    df = spark.createDataFrame([(k, Decimal(v), k // group) for k, v in state.items()], "lba long, pba decimal(38,0), grp long").repartition(3)
    options = MapOptions(group=group)
    assert {r.lba: int(r.pba) for r in M.decode_wide(M.encode_wide(df, options), options).collect()} == state


def test_the_u64_query_over_a_long_log(spark, tmp_path):
    rows = [(n, "signup", n % 700, '{"k": 3}') for n in (*range(5), 2_999_999, 4_294_967, 6_000_000, 40_000_000, 10**12)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = [tuple(r) for r in catalogue.queries()["group_roundtrip_u64"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.oracle_sql()["group_roundtrip_u64"]).fetchall())


def test_reports_over_segments(spark, tmp_path):
    state = states()["lines"]
    options = MapOptions(group=1024, epsilon=64)
    df = spark.createDataFrame([(k, v, k // 1024) for k, v in state.items()] + [(5000, 3, 4)], "lba long, pba long, grp long")
    groups = M.encode(df, options).persist()
    plain = [r for r in groups.collect()]
    segments = [s for r in plain for s in r.segs]
    assert len(segments) > 3 and any(r.out_at for r in plain)
    stats = {r.mode: r for r in M.group_stats(groups, 10_000, options).collect()}
    assert stats["empty"].groups == 10 - len(plain) and stats["direct"].entries == 1
    assert sum(r.groups for r in stats.values()) == 10 and sum(r.physical_bytes for r in stats.values()) == sum(r.bytes for r in plain)
    lengths = sorted(s["len"] for s in segments)
    q = A.length_quantiles(M.segments(groups)).first()
    assert (q.n, q.p50, q.max) == (len(lengths), lengths[(len(lengths) - 1) // 2], lengths[-1])
    widths = {r.bin: r.n for r in A.histogram(M.segments(groups), "width").collect()}
    assert widths == {w: sum(s["width"] == w for s in segments) for w in {s["width"] for s in segments}}
    # Patched widths, segment by segment.
    codes = {}
    for r in M.segment_codes(groups).collect():
        codes.setdefault((r.grp, r.start), []).append(r.code)
    assert {k: len(v) for k, v in codes.items()} == {(r.grp, s["start"]): s["len"] for r in plain for s in r.segs}
    for r in A.patched_width(M.segment_codes(groups), ("grp", "start")).collect():
        bits = [c.bit_length() for c in codes[r.grp, r.start]]
        cost = {w: len(bits) * w + 72 * sum(b > w for b in bits) for w in range(max(bits) + 1)}
        assert (r.bits, r.width) == min((c, w) for w, c in cost.items())
    report = M.report(groups, 10_000, options)
    row = report.first()
    assert row.entries == len(state) + 1 and row.segments == len(segments) and row.groups == 10
    assert row.compression_factor == round(8 * row.entries / row.physical_bytes, 6)
    assert row.memory_bytes == 8 * 10 + row.physical_bytes + 16 * len(plain)
    M.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().entries == row.entries


def test_slopes_of_greedy_segments_are_whole_numbers():
    rng = random.Random(8)
    lba, pba = [], []
    for _ in range(400):
        lba.append((lba[-1] if lba else 0) + rng.randint(1, 9))
        pba.append((pba[-1] if pba else 0) + rng.choice([1, -1, 1]) * rng.randint(1 << 30, 1 << 39))

    def plain(epsilon):
        at = count = 0
        while at < len(lba):
            slope = 0
            if at + 1 < len(lba):
                rise, run = (pba[at + 1] - pba[at]) << 24, lba[at + 1] - lba[at]
                slope = rise // run if rise >= 0 else -(-rise // run)
            k = at + 1
            while k < len(lba) and abs(pba[k] - pba[at] - ((slope * (lba[k] - lba[at])) >> 24)) <= 2 * epsilon:
                k += 1
            count, at = count + 1, k
        return count

    assert [A.greedy_segments(lba, pba, e) for e in (1, 64, 1 << 40)] == [plain(e) for e in (1, 64, 1 << 40)]


def test_a_range_of_stored_blocks_is_pushed_down(spark, tmp_path):
    seq = spark.range(5000).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("value"))
    C.store(C.encode(seq), str(tmp_path / "blocks"))
    part = C.scan(C.stored(spark, str(tmp_path / "blocks")), 1000, 1300)
    assert sorted((r.pos, r.value) for r in part.collect()) == [(k, 3 * k) for k in range(1000, 1300)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_id,7)" in plan and "LessThanOrEqual(block_id,10)" in plan
