import random
import struct

import pytest

from plumbline.operators import address_map as M
from plumbline.options import MapOptions
from plumbline.sources import traces as T
from plumbline.streaming import map_stream
from plumbline.streaming.map_stream import MergedTable, keyed_stream, merge_stream

LOG = "seq long, op int, lba long, pba long"


def operations(n, seed=1, top=40):
    rng = random.Random(seed)
    return [(k, rng.choice([0, 1, 1, 2]), rng.randrange(top), 1000 + k) for k in range(n)]


def shadow(rows):
    state = {}
    for _, op, lba, pba in sorted(rows):
        if op == 1:
            state[lba] = pba
        elif op == 2:
            state.pop(lba, None)
    return state


def held(df):
    return {r.lba: r.pba for r in df.collect()}


def test_replay_and_merge(spark):
    rows = operations(600)
    assert held(M.replay(spark.createDataFrame(rows, LOG))) == shadow(rows)
    old, new = (spark.createDataFrame(r, LOG) for r in (rows[:300], rows[300:]))
    assert held(M.merge(M.replay(old), new)) == shadow(rows)


def test_delete_get_and_capacity(spark):
    rows = [(1, 1, 5, 50), (2, 2, 5, None), (3, 2, 9, None), (4, 1, 4096, 7), (5, 1, 10_000, 8), (6, 1, 1, 2**62)]
    state = M.replay(spark.createDataFrame(rows, LOG), MapOptions(capacity=8192))
    assert held(state) == {4096: 7, 1: 2**62}
    probes = spark.createDataFrame([(0,), (1,), (5,), (9,), (4096,)], "lba long")
    assert held(M.lookup(state, probes)) == {0: None, 1: 2**62, 5: None, 9: None, 4096: 7}
    assert [r.pba for r in M.at_address(state, 4096).collect()] == [7]


def test_encoded_groups(spark):
    rng = random.Random(4)
    rows = [(k, 1, k, 10 * k) for k in range(3000)] + [(5000 + k, 1, 4096 + k * 3, rng.randrange(2**50)) for k in range(9)] + [(9000 + k, 1, 8192 + k, k) for k in range(8)]
    rows += [(20_000 + k, 1, 12_288 + k, (1234567 * k) ^ 0x5555555555) for k in range(512)]
    state = M.replay(spark.createDataFrame(rows, LOG))
    groups = M.encode(state).persist()
    assert held(M.decode(groups)) == shadow(rows)
    mode = {r.grp: r.mode for r in groups.collect()}
    assert mode[0] == "segments" and mode[2] == "direct"
    assert sum(r.groups for r in M.group_stats(groups).collect()) == 4
    assert M.segment_report(groups).first().segments >= 1


def test_read_your_writes_and_pba(spark):
    rows = [(1, 0, 7, None), (2, 1, 7, 70), (3, 0, 7, None), (4, 2, 7, None), (5, 0, 7, None), (6, 1, 8, 80)]
    log = spark.createDataFrame(rows, LOG)
    assert {r.seq: r.pba for r in T.read_your_writes(log).collect()} == {1: 0, 3: 70, 5: 0}
    assert {r.seq: r.pba for r in T.assign_pba(log).collect()} == {2: 2, 6: 3}


def test_binary_trace_round_trip(spark, tmp_path):
    rows = operations(200, seed=3)
    log = spark.createDataFrame([(s, op, lba, None if op == 2 else pba) for s, op, lba, pba in rows], LOG)
    note = T.write_binary(log, str(tmp_path / "a.bin"))
    assert note["max_lba"] == max(r[2] for r in rows)
    (tmp_path / "b.bin").write_bytes(struct.pack("<QQ", 3, (1 << 60) + 9) + b"short")
    got = T.read_binary(spark, str(tmp_path) + "/*.bin").orderBy("seq").collect()
    assert [(r.seq, r.op, r.lba, r.pba) for r in got] == [(s, op, lba, None if op == 2 else pba) for s, op, lba, pba in rows] + [(200, 1, 3, 9)]


def test_text_traces(spark, tmp_path):
    lines = spark.createDataFrame([("0.1 WS 80",), ("0.2  r  17",), ("bad",), ("0.3 x 8",), ("0.4 W n",), ("",)], "value string")
    assert sorted((r.op, r.lba) for r in T.parse_blank_separated(lines).collect()) == [(0, 2), (1, 10)]
    csv = spark.createDataFrame([("a,b,c,Write,8192",), ("a,b,c,Read,4095",), ("a,b,Read,1",), ("a,b,c,Read,x",)], "value string")
    assert sorted((r.op, r.lba) for r in T.parse_csv(csv).collect()) == [(0, 0), (1, 2)]
    (tmp_path / "r.json").write_text('{"reason":"benchmark-complete","id":"a","typical":{"estimate":1.5}}\nbroken\n{"reason":"other","id":"b"}\n{"reason":"custom-metric","id":"c","value":2}\n')
    assert sorted((r.id, r.value) for r in T.read_bench_json(spark, str(tmp_path / "r.json")).collect()) == [("a", 1.5), ("c", 2.0)]


def _stream(spark, tmp_path, rows, parts=3):
    rng = random.Random(9)
    rng.shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_merged_stream_in_any_order_equals_batch(spark, tmp_path):
    rows = operations(400, seed=6)
    want = shadow(rows)
    table = MergedTable(spark, str(tmp_path / "table"))
    merge_stream(_stream(spark, tmp_path, rows), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert held(table.state()) == want


@pytest.mark.parametrize("rows", [10**6, 5])
def test_a_merged_bucket_is_one_file_unless_it_is_large(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(map_stream, "PART_ROWS", rows)
    log = [(k, 1 + k % 7 // 6, k * 50 % 30_000, k) for k in range(1, 900)]
    table = MergedTable(spark, str(tmp_path / "table"), buckets=4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that few rows are dealt to all tasks
    try:
        merge_stream(_stream(spark, tmp_path, log), table, str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "table" / "data").glob("batch=*/bucket=*")]
    assert max(files) == 1 if rows > 100 else max(files) > 1
    assert held(table.state()) == shadow(log)


def test_a_log_of_many_files_is_streamed_in_four_batches(spark, monkeypatch):
    from plumbline.plans import map_queries

    data, plain, batches = "/root/testdata/sf0.001", MergedTable.merge_batch, []
    monkeypatch.setattr(map_queries, "STREAM_ROWS", 60)
    monkeypatch.setattr(MergedTable, "merge_batch", lambda self, batch, n: batches.append(n) or plain(self, batch, n))
    got = {(r.lba, r.pba, r.grp) for r in map_queries.stream_equals_batch(spark, data).collect()}
    assert got == {(r.lba, r.pba, r.grp) for r in map_queries.lww_map(spark, data).collect()}
    assert batches == [0, 1, 2, 3]


def test_keyed_stream_equals_batch(spark, tmp_path):
    rows = operations(200, seed=7, top=12)
    want = shadow(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = keyed_stream(_stream(spark, tmp_path, rows))
    query = stream.writeStream.format("memory").queryName("keyed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("keyed").collect():
        if r.seq >= last.get(r.lba, (-1,))[0]:
            last[r.lba] = (r.seq, r.pba)
    assert {k: v[1] for k, v in last.items() if v[1] is not None} == want


def test_patch_sweep_has_the_whole_grid(spark):
    from plumbline.operators import address_map, trace_analytics
    from plumbline.plans import map_queries

    grid = {(e, s) for e in (512, 1024, 4096, 16384) for s in (2, 4, 8, 16, 32)}
    got = map_queries.patch_sweep(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 20 and {(r.epsilon, r.skip) for r in got} == grid
    # Straight lines: a segment each, residuals of a bit at most, nothing to save.
    rows = [(g, g * 4096 + k, 1000 * g + 3 * k) for g in range(3) for k in range(50)]
    flat = trace_analytics.patch_sweep(spark.createDataFrame(rows, "grp long, lba long, pba long")).collect()
    assert {(r.epsilon, r.skip) for r in flat} == grid
    assert {(r.segments, r.outliers, r.saved_percent) for r in flat} == {(3, 0, 0.0)}
    assert all(0 <= r.bytes - 3 * (4 + address_map.SEGMENT_BYTES) <= 3 * 7 for r in flat)
