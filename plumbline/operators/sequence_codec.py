"""A lossless block codec for integer sequences, with decoding by position, by range and in reverse.

Rows are (pos, value), pos from 0. A block is fitted with the line through its first and last value, relative to the
block, in fixed point; what is left, modulo 2**64, is zig-zag coded, so any LONG may follow any other. The width is the
cheapest under n * width + exceptions * 64 * penalty, the smallest of equals; wider codes are exceptions, listed with
their places. Lines, residuals and widths are there as column expressions, to look into. encode() does the same with
one shuffle: a block's values come together and are fitted, coded and packed in arrays of whole batches of blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidData
from ..functions.bits import bit_width, minus, pack_bits, unpack_bits, zigzag
from ..options import SequenceOptions

#: Bits of the slope's fraction.
FRACTION = 16
#: The rise per value from which a slope is the largest there is, and that slope.
_TOP = (1 << 63) - 1
_STEEP = 1 << (63 - FRACTION)
BLOCK = "block_id long, n int, first long, slope long, width int, ex_at array<int>, ex_code array<long>, packed binary"


def block_lines(seq: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """block_id, n, first and slope (fixed point, 0 where values fall, at most the largest LONG) of every block."""
    block = F.expr(f"pos div {options.block}L")
    ends = seq.groupBy(block.alias("block_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last")
    )
    ends = ends.withColumns({"_span": F.expr("greatest(cast(last AS decimal(20,0)) - cast(first AS decimal(20,0)), 0)"), "_m": F.expr("greatest(n - 1, 1)")})
    # Whole steps and the rest apart: neither leaves the numbers' range.
    rise = F.expr(f"if(_span >= {_STEEP} * _m, {_TOP}, (_span div _m) * {1 << FRACTION} + (_span % _m) * {1 << FRACTION} div _m)")
    return ends.select("block_id", "n", "first", rise.cast("long").alias("slope"))


def residuals(seq: DataFrame, options: SequenceOptions = SequenceOptions(), lines: DataFrame | None = None) -> DataFrame:
    """block_id, at (place in the block), pos and code of every value; with the block's line."""
    lines = block_lines(seq, options) if lines is None else lines
    placed = seq.select("pos", "value", F.expr(f"pos div {options.block}L").alias("block_id"), F.expr(f"pos % {options.block}L").cast("int").alias("at"))
    df = placed.join(lines, "block_id")
    return df.select("block_id", "at", "pos", "n", "first", "slope", zigzag(minus(F.col("value"), predicted())).alias("code"))


def predicted() -> Column:
    """The line's value at a place; no more than the block's last value."""
    rise = F.expr(f"if(slope <= {1 << 62} div n, shiftright(cast(at AS long) * slope, {FRACTION}), (cast(at AS decimal(18,0)) * slope) div {1 << FRACTION})")
    return F.col("first") + rise.cast("long")


def width_choice(codes: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """block_id, width and cost: per block a histogram of code widths, then the costs of all 65 widths at once."""
    per = codes.groupBy("block_id", bit_width(F.col("code")).alias("w")).agg(F.count(F.lit(1)).alias("k"))
    blocks = per.groupBy("block_id").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("w", "k"))).alias("h"))
    cost = F.expr(
        f"transform(sequence(0, 64), w -> struct(n * w + {64 * options.penalty}L * aggregate(map_entries(h), 0L, (a, e) -> a + if(e.key > w, e.value, 0L)) AS cost, w AS width))"
    )
    best = F.array_min(cost)
    return blocks.select("block_id", best["width"].alias("width"), best["cost"].alias("cost"))


_POWERS = np.asarray([1 << k for k in range(64)], dtype=np.uint64)


def _risen(at: np.ndarray, slope: int) -> np.ndarray:
    """What a line of fixed-point slope has risen at places."""
    if slope <= (1 << 62) // max(1, len(at)):
        return (at * slope) >> FRACTION
    return np.asarray([(k * slope) >> FRACTION for k in at.tolist()], dtype=np.int64)


def _slope(first: int, last: int, n: int) -> int:
    return min(_TOP, (max(0, last - first) << FRACTION) // max(1, n - 1))


def _coded(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the values of blocks that end at `ends` of a flat array, and the first value and slope of each."""
    begin = np.concatenate([[0], ends[:-1]])
    n = ends - begin
    first, last = values[begin], values[ends - 1]
    slope = np.asarray([_slope(a, b, k) for a, b, k in zip(first.tolist(), last.tolist(), n.tolist())], dtype=np.int64)
    at = np.arange(len(values)) - np.repeat(begin, n)
    rise = at * np.repeat(np.where(slope <= (1 << 62) // n, slope, 0), n) >> FRACTION
    for k in np.flatnonzero(slope > (1 << 62) // n):
        rise[begin[k] : ends[k]] = _risen(np.arange(n[k]), int(slope[k]))
    # Unsigned arithmetic is modulo 2**64.
    rest = (values.view(np.uint64) - np.repeat(first, n).view(np.uint64) - rise.view(np.uint64)).view(np.int64)
    return ((rest << 1) ^ (rest >> 63)).view(np.uint64), first, slope


def encode(seq: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """The blocks of a sequence: see BLOCK. Exceptions' places are packed as 0."""
    placed = F.struct(F.expr(f"pos % {options.block}L").alias("at"), F.col("value").cast("long").alias("value"))
    blocks = seq.groupBy(F.expr(f"pos div {options.block}L").alias("block_id")).agg(F.array_sort(F.collect_list(placed)).alias("c"))
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1)
            edges = c.offsets.to_numpy().astype(np.int64)
            values, ends = c.values.field(0).to_numpy()[edges[0] : edges[-1]], edges[1:] - edges[0]
            code, first, slope = _coded(values, ends)
            n = np.diff(ends, prepend=0)
            wide = np.searchsorted(_POWERS, code, "right")
            # By block, codes wider than each width: a histogram, summed from above.
            count = np.bincount(np.repeat(np.arange(len(n)), n) * 65 + wide, minlength=65 * len(n)).reshape(-1, 65)
            wider = count[:, ::-1].cumsum(axis=1)[:, ::-1] - count
            width = (n[:, None] * np.arange(65) + 64 * options.penalty * wider).argmin(axis=1)
            out = wide > np.repeat(width, n)
            plain = np.where(out, np.uint64(0), code)
            rows = []
            for a, b, w in zip((ends - n).tolist(), ends.tolist(), width.tolist()):
                place = np.flatnonzero(out[a:b])
                rows.append((place, code[a:b][place].view(np.int64), pack_bits(plain[a:b], w)))
            place, codes, packed = zip(*rows)
            columns = [batch.column(0), pa.array(n, pa.int32()), pa.array(first), pa.array(slope), pa.array(width, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names)

    return blocks.select("block_id", F.transform("c", lambda x: F.struct(x["value"].alias("value"))).alias("c")).mapInArrow(pack, BLOCK)


def decode(blocks: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """pos and value of every value of the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_pos, out = [], []
            for block, n, first, slope, width, at, code, packed in zip(*(c.to_pylist() for c in batch.columns)):
                codes = unpack_bits(packed, width, n).view(np.int64)
                if at:
                    codes[at] = code
                place = np.arange(n, dtype=np.int64)
                out.append(first + _risen(place, slope) + _undone(codes))
                out_pos.append(block * options.block + place)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (out_pos, out)], ["pos", "value"])

    names = [x.split()[0] for x in BLOCK.split(", ")]
    return blocks.select(*names).mapInArrow(unpack, "pos long, value long")


def _undone(codes: np.ndarray) -> np.ndarray:
    """The numbers that zig-zag codes stand for."""
    return (codes.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(codes & 1)


def store(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet in ranges of block_id, so that a look-up reads the row groups that hold what it asks for."""
    blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def scan(blocks: DataFrame, start: int, stop: int, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """pos and value of positions from start up to stop, both cut to the sequence. Of stored() blocks others are not read."""
    start = max(0, start)
    some = blocks.where(F.col("block_id").between(start // options.block, max(start, stop - 1) // options.block))
    return decode(some, options).where((F.col("pos") >= start) & (F.col("pos") < stop))


def scan_reverse(blocks: DataFrame, start: int, stop: int, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    return scan(blocks, start, stop, options).orderBy(F.desc("pos"))


def get(blocks: DataFrame, indices: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """Rows of pos with value, null beyond the sequence. Only blocks that are asked for are decoded."""
    wanted = indices.select(F.expr(f"pos div {options.block}L").alias("block_id")).distinct()
    return indices.join(decode(blocks.join(wanted, "block_id", "left_semi"), options), "pos", "left")


def stats(blocks: DataFrame) -> DataFrame:
    """Per width: blocks, values, exceptions and blocks with exceptions."""
    return blocks.groupBy("width").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("n").cast("long").alias("n"), F.sum(F.size("ex_at")).cast("long").alias("exceptions"),
        F.count_if(F.size("ex_at") > 0).alias("with_exceptions"),
    )


def size(blocks: DataFrame) -> DataFrame:
    """One row: values, blocks, and the bytes of the dump format."""
    bits = F.sum(F.col("n").cast("long") * F.col("width"))
    exceptions = F.sum(F.size("ex_at").cast("long"))
    df = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks"), F.coalesce(bits, F.lit(0)).alias("bits"), F.coalesce(exceptions, F.lit(0)).alias("exceptions"))
    words = F.ceil(F.col("bits") / 64)
    return df.select("n", "blocks", (24 + 26 * F.col("blocks") + 8 * (words + F.col("exceptions") + F.ceil(F.col("n") / 64))).cast("long").alias("dump_bytes"))


# Fixed values of the dump format: a count of values, then counted lists of block heads (bit offset, width, flags,
# exception offset, slope, first value), packed words, exceptions and the exceptions' bitmap. All little endian.
_HEAD, _HAS_EXCEPTIONS = struct.Struct("<IBBIQq"), 0x80


def dump(blocks: DataFrame, block: int = 128) -> bytes:
    """One byte string for a sequence that fits the driver: blocks are streamed to it in order."""
    heads, bits, codes, places, n = [], [], [], [], 0
    offset = 0
    for r in blocks.orderBy("block_id").toLocalIterator():
        heads.append(_HEAD.pack(offset, r.width, _HAS_EXCEPTIONS if r.ex_at else 0, len(codes), r.slope, r.first))
        offset += r.n * r.width
        bits.append(np.unpackbits(np.frombuffer(bytes(r.packed), dtype=np.uint8), bitorder="little")[: r.n * r.width])
        places += [n + k for k in r.ex_at]
        codes += list(r.ex_code)
        n += r.n
    packed = np.packbits(np.concatenate([*bits, np.zeros(0, np.uint8)]), bitorder="little").tobytes()
    bitmap = np.zeros(-(-n // 64) * 64, dtype=np.uint8)
    bitmap[places] = 1
    words = packed + b"\0" * (-len(packed) % 8)
    out = [struct.pack("<QI", n, len(heads)), *heads, struct.pack("<I", len(words) // 8), words]
    out += [struct.pack("<I", len(codes)), np.asarray(codes, dtype="<i8").tobytes(), struct.pack("<I", len(bitmap) // 64), np.packbits(bitmap, bitorder="little").tobytes()]
    return b"".join(out)


def load(data: bytes, block: int = 128) -> list[int]:
    """The values of a dump. InvalidData where it ends early."""

    def take(k: int) -> bytes:
        nonlocal at
        if at + k > len(data):
            raise InvalidData("the dump ends early")
        at += k
        return data[at - k : at]

    at = 0
    (n,) = struct.unpack("<Q", take(8))
    lists = []
    for width in (_HEAD.size, 8, 8, 8):
        (count,) = struct.unpack("<I", take(4))
        lists.append(take(count * width))
    heads = list(_HEAD.iter_unpack(lists[0]))
    bits = np.unpackbits(np.frombuffer(lists[1], dtype=np.uint8), bitorder="little")
    codes, bitmap = np.frombuffer(lists[2], dtype="<i8"), np.unpackbits(np.frombuffer(lists[3], dtype=np.uint8), bitorder="little")
    if len(heads) * block < n or len(bitmap) < n:
        raise InvalidData("the dump has fewer blocks than values")
    out: list[int] = []
    for k, (offset, width, _, exception, slope, first) in enumerate(heads):
        size = min(block, n - k * block)
        if offset + size * width > len(bits):
            raise InvalidData("the dump's words end early")
        code = unpack_bits(np.packbits(bits[offset : offset + size * width], bitorder="little").tobytes(), width, size).view(np.int64)
        places = np.flatnonzero(bitmap[k * block : k * block + size])
        if exception + len(places) > len(codes):
            raise InvalidData("the dump's exceptions end early")
        code[places] = codes[exception : exception + len(places)]
        out += (first + _risen(np.arange(size, dtype=np.int64), slope) + _undone(code)).tolist()
    return out


def score(mops: float, size_ratio: float, throughput_ratio: float, latency_ratio: float) -> float:
    """Throughput over size; a hundredth of it unless size <= 0.30, throughput >= 0.95 and latency <= 1.10."""
    good = size_ratio <= 0.30 and throughput_ratio >= 0.95 and latency_ratio <= 1.10
    return mops / size_ratio / (1 if good else 100)


def running_rank(df: DataFrame) -> DataFrame:
    """Exceptions with their rank within the block (how many come before)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("block_id").orderBy("at")) - 1)
