"""Generators, and binary traces that are read and written in parts."""

import struct

import numpy as np
import pytest

from plumbline.plans import baselines
from plumbline.plans import ordering
from plumbline.sources import generators as G
from plumbline.sources import traces as T


def test_generated_sequences(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 700)
    for made, low, high in ((G.gap_keys, 1, 99), (G.zipf_offsets, 17, 116)):
        rows = [tuple(r) for r in made(spark, 3000).orderBy("pos").collect()]
        assert [p for p, _ in rows] == list(range(3000)) and rows == [tuple(r) for r in made(spark, 3000).orderBy("pos").collect()]
        steps = np.diff([0] + [v for _, v in rows])
        assert steps.min() >= low and steps.max() <= high and len(set(steps.tolist())) > 20
    assert (np.asarray(steps) == 17).mean() == pytest.approx(1 / sum(k**-1.5 for k in range(1, 101)), abs=0.05)
    bits = [r.value for r in G.log_normal_bits(spark, 2000).orderBy("pos").collect()]
    assert bits == sorted(set(bits)) and 1990 <= len(bits) <= 2000
    numbers = np.asarray(bits, dtype="<i8").view("<f8")
    assert abs(np.log(numbers).mean()) < 0.1 and abs(np.log(numbers).std() - 1) < 0.1


def test_binary_traces_in_parts(spark, tmp_path):
    log = spark.createDataFrame([(k, k % 3, (k * 37) % 500, None if k % 3 == 2 else k + 1) for k in range(1000)], "seq long, op int, lba long, pba long").repartition(4)
    done = T.write_binary_parts(log, str(tmp_path / "trace"), 5)
    assert sum(r.records for r in done.collect()) == 1000 and done.agg({"max_lba": "max"}).first()[0] == 499
    files = sorted((tmp_path / "trace").glob("*.bin"))
    assert len(files) == 5 and all(f.stat().st_size % 16 == 0 for f in files)
    want = [(k, k % 3, (k * 37) % 500, None if k % 3 == 2 else (k + 1)) for k in range(1000)]
    for read in (lambda: T.read_binary_split(spark, str(tmp_path / "trace" / "*.bin"), records=64), lambda: T.read_binary(spark, str(tmp_path / "trace" / "*.bin"))):
        assert [tuple(r) for r in read().select("seq", "op", "lba", "pba").orderBy("seq").collect()] == want


def test_short_tails_and_wide_addresses(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<QQ", 5, (1 << 60) + 9) + b"short")
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(struct.pack("<QQ", 6, 0))
    got = T.read_binary_split(spark, str(tmp_path) + "/*.bin").orderBy("seq").collect()
    assert [(r.seq, r.op, r.lba, r.pba) for r in got] == [(0, 1, 5, 9), (1, 0, 6, 0)]
    (tmp_path / "d.bin").write_bytes(struct.pack("<QQ", 1 << 63, 0))
    with pytest.raises(Exception, match="InvalidData"):
        T.read_binary_split(spark, str(tmp_path) + "/*.bin").collect()


@pytest.mark.parametrize("name", sorted(baselines.BASELINES))
def test_plain_spark_gives_the_same(spark, name):
    from plumbline import catalogue

    data = "/root/testdata/sf0.001"
    mine, plain = catalogue.queries()[name](spark, data), baselines.BASELINES[name](spark, data)
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(plain.columns)).collect())
    assert rows(mine) == rows(plain)


def test_stored_bytes(spark):
    row = baselines.stored_bytes(spark, "/root/testdata/sf0.001").first()
    assert row.plain_bytes == 8 * row.n > row.dump_bytes
