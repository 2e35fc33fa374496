import random

import numpy as np
import pytest

from plumbline.errors import InvalidData
from plumbline.functions.bits import pack_bits, unpack_bits
from plumbline.operators import address_map as M
from plumbline.operators import monotone_set as E
from plumbline.operators import sequence_codec as C
from plumbline.options import MapOptions, SequenceOptions
from hypothesis import given, settings
from hypothesis import strategies as st


def sequence(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value long")


@pytest.mark.parametrize("size", [0, 1, 10, 128, 129, 256, 1000])
def test_sequence_round_trip(spark, size):
    rng = random.Random(size)
    values = np.cumsum([rng.randint(0, 10**6) for _ in range(size)]).tolist()
    if size > 200:
        values[150] = -(2**40)
        values[151] = 2**45
    blocks = C.encode(sequence(spark, values)).persist()
    got = {r.pos: r.value for r in C.decode(blocks).collect()}
    assert [got[k] for k in range(size)] == values and len(got) == size
    data = C.dump(blocks)
    assert C.load(data) == values
    assert C.size(blocks).first().dump_bytes == len(data)
    if size:
        with pytest.raises(InvalidData):
            C.load(data[:-1])
    assert [r.value for r in C.scan_reverse(blocks, 5, 9).collect()] == values[5:9][::-1]
    asked = spark.createDataFrame([(0,), (size - 1,), (size,)], "pos long")
    assert {(r.pos, r.value) for r in C.get(blocks, asked).collect()} == {(p, values[p] if 0 <= p < size else None) for p in (0, size - 1, size)}


def test_options_are_checked():
    for bad in (0, 256):
        with pytest.raises(ValueError):
            SequenceOptions(penalty=bad)
    assert C.score(10, 0.2, 1, 1) == pytest.approx(50) and C.score(10, 0.4, 1, 1) == pytest.approx(0.25)


@given(st.lists(st.integers(0, 2**63 - 1), max_size=40))
@settings(max_examples=60, deadline=None)
def test_bit_packing(values):
    width = max([v.bit_length() for v in values], default=0)
    assert unpack_bits(pack_bits(np.asarray(values, dtype=np.uint64), width), width, len(values)).tolist() == values


@pytest.mark.parametrize("values", [[], [10, 20, 30, 4095], list(range(1000)), sorted(random.Random(2).sample(range(4096), 500)), [0, 4095]])
def test_elias_fano(spark, values):
    assert E.decode(E.encode(values), len(values)) == values
    if not values:
        return
    sets = spark.createDataFrame([(1, v) for v in values], "grp long, value long")
    assert E.sizes(sets).first().bytes == len(E.encode(values))
    targets = spark.range(0, 4100).selectExpr("1L AS grp", "id AS target")
    for r in E.predecessor(sets, targets).collect():
        k = int(np.searchsorted(values, r.target, "right")) - 1
        assert (r.idx, r.value) == ((k, values[k]) if k >= 0 else (None, None))


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=120), st.sampled_from([1, 16, 512]))
@settings(max_examples=80, deadline=None)
def test_group_values_round_trip(values, epsilon):
    options = MapOptions(epsilon=epsilon)
    mode, n, _, base, width, packed, segs, at, out, _ = M.encode_values(list(range(len(values))), values, options)
    assert M.decode_values(mode, n, base, width, packed, segs, at, out).tolist() == values
    assert (mode == M.DIRECT) == (len(values) <= 8)


def test_lines_take_one_segment_and_outliers_are_bridged():
    line = [100 + 7 * k for k in range(200)]
    assert len(M.fit_group(line, 4, 4)[0]) == 1
    line[50] = 10**9
    segments, outliers = M.fit_group(line, 4, 4)
    assert len(segments) == 1 and outliers == [50]
    steps = M.encode_values(list(range(2000)), [12345 * k for k in range(2000)], MapOptions())
    assert steps[0] == M.SEGMENTS and M.decode_values(*steps[:2], *steps[3:9])[1917] == 12345 * 1917


def test_sets_that_do_not_ascend_are_refused():
    from plumbline.errors import NotSorted

    for values in ([3, 1], [-1, 4]):
        with pytest.raises(NotSorted):
            E.encode(values)
