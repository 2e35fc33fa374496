"""A last-writer-wins map from addresses to addresses, with deletes, merged by group and encoded per group.

The state is (lba, pba) without tombstones: absent is absent. A log is reduced per address before anything is joined, so
a hot address is one row per task. Groups are ranges of addresses; each is encoded by how much it holds: nothing, a few
entries against their minimum, or line segments with packed residuals and outliers, unless raw values are smaller.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidData
from ..functions.bits import bit_width, byte_length, pack_bits, unpack_bits
from ..options import MapOptions
from ..sources.traces import READ, WRITE

EMPTY, DIRECT, SEGMENTS, RAW = "empty", "direct", "segments", "raw"
#: Bytes of a group's head, of a segment and of an outlier's place; bits of a slope's fraction.
HEAD_BYTES, SEGMENT_BYTES, PLACE_BYTES, FRACTION = 4, 12, 2, 24
#: In memory: bytes of a group's entry in the array of groups, and of the storage of a payload besides its bytes.
HEAD_WORD_BYTES, STORAGE_BYTES = 8, 16

SEGMENT = "struct<start:int,len:int,base:bigint,slope:bigint,width:int,packed:binary>"
GROUP = f"grp long, mode string, n int, offsets binary, base long, width int, packed binary, segs array<{SEGMENT}>, out_at array<int>, out_value array<long>, bytes long"
_NAMES = [x.split()[0] for x in GROUP.split(", ")]
_WORD = "struct<" + ",".join(x.replace(" ", ":", 1) for x in GROUP.split(", ")[1:]) + ">"
#: A group of values of more than 64 bits: the lower 64 bits and what is above them, each encoded as a group's values are.
WIDE_GROUP = f"grp long, low {_WORD}, high {_WORD}"


def group_of(lba: Column, options: MapOptions = MapOptions()) -> Column:
    return F.floor(lba / F.lit(options.group)).cast("long")


def at_address(state: DataFrame, lba: int, options: MapOptions = MapOptions()) -> DataFrame:
    """The state at one address; the group is given too, so that storage partitioned by grp is pruned."""
    return state.where((F.col("lba") == lba) & (F.col("grp") == lba // options.group))


def last_operations(log: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """lba, seq and pba of each address's last write or delete; pba is null for a delete. Addresses beyond the capacity
    do not exist."""
    changes = log.where(F.col("op") != READ)
    if options.capacity is not None:
        changes = changes.where((F.col("lba") >= 0) & (F.col("lba") < options.capacity))
    value = F.struct(F.when(F.col("op") == WRITE, F.col("pba")).alias("pba"))
    last = changes.groupBy("lba").agg(F.max_by(value, "seq").alias("v"), F.max("seq").alias("seq"))
    return last.select("lba", "seq", F.col("v.pba").alias("pba"))


def replay(log: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """The state after a log: lba, pba and grp."""
    live = last_operations(log, options).where("pba IS NOT NULL")
    return live.select("lba", "pba", group_of(F.col("lba"), options).alias("grp"))


def lookup(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (lba) with pba, null where nothing is mapped."""
    return probes.join(state.select("lba", "pba"), "lba", "left")


def misses(state: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(state, "lba", "left_anti")


def merge(state: DataFrame, log: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """The state after a further log: new operations overlay old entries, deletes take them away."""
    new = last_operations(log, options).withColumnRenamed("pba", "_new")
    both = state.select("lba", "pba").join(new, "lba", "full_outer")
    both = both.select("lba", F.when(F.col("seq").isNotNull(), F.col("_new")).otherwise(F.col("pba")).alias("pba"))
    return both.where("pba IS NOT NULL").select("lba", "pba", group_of(F.col("lba"), options).alias("grp"))


def dense(state: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """grp, offset in the group, idx among its mapped entries, and pba."""
    from pyspark.sql import Window

    order = Window.partitionBy("grp").orderBy("lba")
    return state.select("grp", (F.col("lba") - F.col("grp") * options.group).alias("offset"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "pba")


def group_kinds(state: DataFrame, capacity: int, options: MapOptions = MapOptions()) -> DataFrame:
    """grp, n and mode of every group below the capacity: empty, direct, or to be fitted."""
    spark = state.sparkSession
    n = state.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(-(-capacity // options.group)).select(F.col("id").alias("grp"))
    df = every.join(n, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return df.withColumn("mode", F.when(F.col("n") == 0, EMPTY).when(F.col("n") <= options.direct, DIRECT).otherwise("fitted"))


def direct_sizes(state: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """grp, n, base, width, base_bytes and payload_bytes of the groups with few entries."""
    g = state.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("pba").alias("base"), F.max("pba").alias("top")).where(F.col("n") <= options.direct)
    g = g.withColumns({"width": bit_width(F.col("top") - F.col("base")), "base_bytes": byte_length(F.col("base"))})
    return g.select("grp", "n", "base", "width", "base_bytes", (F.col("base_bytes") + F.ceil(F.col("n") * F.col("width") / 8)).cast("long").alias("payload_bytes"))


# -- the fit of a group's values ------------------------------------------------------------------------------------------


def longest_segment(values: list[int], start: int, epsilon: int) -> tuple[int, int, int, list[int]]:
    """The longest segment from `start`: end, slope (fixed point), base, and places left out as outliers.

    The cone of slopes is kept as exact fractions. A value outside it may be left out if the next two fit (or the values
    end); the base is lowered so that no residual is negative.
    """
    v0, n = values[start], len(values)
    low = high = None
    out: list[int] = []

    def narrowed(k: int):
        x, y = k - start, values[k] - v0
        a, b = (y - epsilon, x), (y + epsilon, x)
        lo = a if low is None or a[0] * low[1] > low[0] * a[1] else low
        hi = b if high is None or b[0] * high[1] < high[0] * b[1] else high
        return (lo, hi) if lo[0] * hi[1] <= hi[0] * lo[1] else None

    k = start + 1
    while k < n:
        cone = narrowed(k)
        if cone is None:
            if k + 1 < n and all(narrowed(j) for j in range(k + 1, min(n, k + 3))):
                out.append(k)
                k += 1
                continue
            break
        low, high = cone
        k += 1
    slope = 0 if low is None else ((low[0] << FRACTION) // low[1] + (high[0] << FRACTION) // high[1]) // 2
    left_out = set(out)
    base = min(values[j] - ((slope * (j - start)) >> FRACTION) for j in range(start, k) if j not in left_out)
    return k, slope, base, out


def fit_group(values: list[int], epsilon: int, skip: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Segments (start, end, base, slope) that cover all values, and the places of outliers. A segment with fewer than
    `skip` values inside, unless at the end, makes its first value an outlier of the segment before."""
    segments: list[tuple[int, int, int, int]] = []
    outliers: list[int] = []
    at, n = 0, len(values)
    while at < n:
        end, slope, base, out = longest_segment(values, at, epsilon)
        if end - at - len(out) < skip and end < n and segments:
            outliers.append(at)
            segments[-1] = (segments[-1][0], at + 1, *segments[-1][2:])
            at += 1
            continue
        segments.append((at, end, base, slope))
        outliers += out
        at = end
    return segments, outliers


def encode_values(offsets: list[int], values: list[int], options: MapOptions) -> tuple:
    """Columns of a group, from mode on. Values from 2**63 on are kept as the signed numbers with the same bits."""
    n, most = len(values), (1 << 64 if options.unsigned else 1 << 63) - 1
    if min(values) < 0 or max(values) > most:
        raise InvalidData(f"a map encodes values from 0 to {most}, not {min(values)} to {max(values)}")
    packed_offsets = pack_bits(np.asarray(offsets, dtype=np.uint64), 12) if options.group <= 4096 else np.asarray(offsets, dtype="<u4").tobytes()
    base, top = min(values), max(values)
    if n <= options.direct:
        width = (top - base).bit_length()
        packed = pack_bits(np.asarray([v - base for v in values], dtype=np.uint64), width)
        return DIRECT, n, packed_offsets, _bits(base), width, packed, [], [], [], HEAD_BYTES + (base.bit_length() + 7) // 8 + len(packed)
    segments, outliers = fit_group(values, options.epsilon, options.skip)
    left_out, rows, size = set(outliers), [], HEAD_BYTES
    for start, end, low, slope in segments:
        if abs(slope) * (end - start) >= 1 << 63:
            size = 8 * n + HEAD_BYTES + 1  # too steep for a line of 64 bits: values stay as they are
            break
        rest = [0 if j in left_out else values[j] - low - ((slope * (j - start)) >> FRACTION) for j in range(start, end)]
        width = max(rest).bit_length()
        packed = pack_bits(np.asarray(rest, dtype=np.uint64), width)
        rows.append({"start": start, "len": end - start, "base": _bits(low), "slope": slope, "width": width, "packed": packed})
        size += SEGMENT_BYTES + len(packed)
    size += (PLACE_BYTES + 8) * len(outliers)
    if size > 8 * n:
        return RAW, n, packed_offsets, 0, 64, pack_bits(np.asarray(values, dtype=np.uint64), 64), [], [], [], HEAD_BYTES + 8 * n
    return SEGMENTS, n, packed_offsets, _bits(base), 0, b"", rows, outliers, [_bits(values[j]) for j in outliers], size


def _bits(value: int) -> int:
    """A number modulo 2**64 as a signed one."""
    return ((value + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def decode_values(mode: str, n: int, base: int, width: int, packed: bytes, segs: list, out_at: list[int], out_value: list[int]) -> np.ndarray:
    """The values modulo 2**64, as signed numbers."""
    if mode != SEGMENTS:
        return unpack_bits(packed, width, n).view(np.int64) + base
    values = np.zeros(n, dtype=np.int64)
    for s in segs:
        line = (np.arange(s["len"], dtype=np.int64) * s["slope"]) >> FRACTION
        values[s["start"] : s["start"] + s["len"]] = s["base"] + line + unpack_bits(s["packed"], s["width"], s["len"]).view(np.int64)
    values[out_at] = out_value
    return values


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def encode(state: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """A row per group that holds anything: see GROUP. Groups are at most `options.group` entries, so a task holds little."""
    schema = _arrow(GROUP, state.sparkSession)
    lists = _lists(state, "decimal(20,0)" if options.unsigned else "long", options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, *encode_values(o, [int(x) for x in v], options)) for g, o, v in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema.names)

    return lists.mapInArrow(run, GROUP)


def _lists(state: DataFrame, kind: str, options: MapOptions) -> DataFrame:
    """grp, offsets and values of every group, by offset."""
    value = F.col("pba").cast(kind)
    lists = state.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((F.col("lba") - F.col("grp") * options.group).alias("offset"), value.alias("pba")))).alias("e"))
    return lists.select("grp", F.transform("e", lambda x: x["offset"]).alias("offsets"), F.transform("e", lambda x: x["pba"]).alias("values"))


def encode_wide(state: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """encode() of whole numbers of either sign of up to 38 digits: see WIDE_GROUP. What is above the lower 64 bits is kept
    plus 2**63."""
    schema, words = _arrow(WIDE_GROUP, state.sparkSession), replace(options, unsigned=True)

    def word(offsets: list[int], values: list[int]) -> dict:
        return dict(zip(_NAMES[1:], encode_values(offsets, values, words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, low, high = [], [], []
            for g, offsets, values in zip(*(c.to_pylist() for c in batch.columns)):
                values = [int(x) for x in values]
                grp.append(g)
                low.append(word(offsets, [x & ((1 << 64) - 1) for x in values]))
                high.append(word(offsets, [(x >> 64) + (1 << 63) for x in values]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((grp, low, high), schema)], schema.names)

    return _lists(state, "decimal(38,0)", options).mapInArrow(run, WIDE_GROUP)


def _places(offsets: bytes, n: int, options: MapOptions) -> np.ndarray:
    """The places of a group's entries."""
    return unpack_bits(offsets, 12, n).astype(np.int64) if options.group <= 4096 else np.frombuffer(offsets, dtype="<u4").astype(np.int64)


def _as_values(df: DataFrame, options: MapOptions) -> DataFrame:
    """pba of a decoded table, from the signed number with the same bits."""
    if not options.unsigned:
        return df
    turn = F.expr(f"cast('{1 << 64}' AS decimal(21,0))")
    value = F.col("pba").cast("decimal(20,0)")
    return df.withColumn("pba", F.when(F.col("pba") < 0, value + turn).otherwise(value).cast("decimal(20,0)"))


def decode(groups: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """lba and pba of every entry of encoded groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lba, pba = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for grp, mode, n, offsets, base, width, packed, segs, at, value, _ in zip(*(c.to_pylist() for c in batch.columns)):
                lba.append(grp * options.group + _places(offsets, n, options))
                pba.append(decode_values(mode, n, base, width, packed, segs, at, value))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lba)), pa.array(np.concatenate(pba))], ["lba", "pba"])

    return _as_values(groups.mapInArrow(run, "lba long, pba long"), options)


def decode_wide(groups: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """lba and pba, DECIMAL(38,0), of every entry of groups from encode_wide()."""

    def values(w: dict) -> np.ndarray:
        return decode_values(*(w[c] for c in ("mode", "n", "base", "width", "packed", "segs", "out_at", "out_value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for grp, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                out[0].append(grp * options.group + _places(low["offsets"], low["n"], options))
                out[1].append(values(low))
                out[2].append(values(high) ^ np.int64(-1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["lba", "pba", "high"])

    df = _as_values(groups.mapInArrow(run, "lba long, pba long, high long"), replace(options, unsigned=True))
    whole = F.expr(f"cast(high * cast('{1 << 64}' AS decimal(20,0)) + pba AS decimal(38,0))")
    return df.select("lba", whole.alias("pba"))


def _field(packed: bytes, k: int, width: int) -> int:
    """The k-th of packed numbers of `width` bits, from the bytes it lies in."""
    at = k * width
    return int.from_bytes(packed[at // 8 : (at + width + 7) // 8], "little") >> (at % 8) & ((1 << width) - 1)


def decode_one(k: int, mode: str, base: int, width: int, packed: bytes, segs: list, out_at: list[int], out_value: list[int]) -> int:
    """The k-th value of an encoded group, modulo 2**64 as a signed number; nothing else is decoded."""
    if mode != SEGMENTS:
        return _bits(base + _field(packed, k, width))
    o = bisect_left(out_at, k)
    if o < len(out_at) and out_at[o] == k:
        return out_value[o]
    s = segs[bisect_right(segs, k, key=lambda s: s["start"]) - 1]
    place = k - s["start"]
    return _bits(s["base"] + (place * s["slope"] >> FRACTION) + _field(s["packed"], place, s["width"]))


def get(groups: DataFrame, probes: DataFrame, options: MapOptions = MapOptions()) -> DataFrame:
    """Distinct probes (lba) with pba from encoded groups, null where nothing is mapped. A group comes to the probes that
    ask for it, and of a group only the entries asked for are decoded."""
    asked = probes.select("lba").where("lba IS NOT NULL").distinct().withColumn("grp", group_of(F.col("lba"), options))
    asked = asked.groupBy("grp").agg(F.collect_list("lba").alias("asked"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lba, pba = [], []
            for wanted, grp, mode, n, offsets, base, width, packed, segs, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                places = np.zeros(0, dtype=np.int64) if mode is None else _places(offsets, n, options)
                for address in wanted:
                    k = int(np.searchsorted(places, address - grp * options.group))
                    there = k < len(places) and places[k] == address - grp * options.group
                    lba.append(address)
                    pba.append(decode_one(k, mode, base, width, packed, segs, at, value) if there else None)
            yield pa.RecordBatch.from_arrays([pa.array(lba, pa.int64()), pa.array(pba, pa.int64())], ["lba", "pba"])

    both = asked.join(groups, "grp", "left").select("asked", *_NAMES[:-1])
    return _as_values(both.mapInArrow(run, "lba long, pba long"), options)


# -- statistics of encoded groups -----------------------------------------------------------------------------------------


def group_stats(groups: DataFrame, capacity: int | None = None, options: MapOptions = MapOptions()) -> DataFrame:
    """Per mode: groups, entries, logical_bytes and physical_bytes. With a capacity, the groups below it that hold nothing
    are counted too, as empty ones."""
    stats = groups.groupBy("mode").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").cast("long").alias("entries"), (8 * F.sum("n")).cast("long").alias("logical_bytes"), F.sum("bytes").alias("physical_bytes")
    )
    if capacity is None:
        return stats
    none = F.lit(-(-capacity // options.group)).cast("long") - F.count(F.lit(1))
    zero = F.lit(0).cast("long")
    empty = groups.agg(none.alias("groups")).where("groups > 0").select(F.lit(EMPTY).alias("mode"), "groups", zero.alias("entries"), zero.alias("logical_bytes"), zero.alias("physical_bytes"))
    return stats.unionByName(empty)


def report(groups: DataFrame, capacity: int, options: MapOptions = MapOptions()) -> DataFrame:
    """One row: entries, groups below the capacity, segments, outliers, logical and physical bytes, the compression factor,
    the bytes of the map in memory and those of a hash map with the same entries."""
    total = -(-capacity // options.group)
    g = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"), F.lit(total).cast("long").alias("groups"),
        F.coalesce(F.sum(F.size("segs")), F.lit(0)).cast("long").alias("segments"), F.coalesce(F.sum(F.size("out_at")), F.lit(0)).cast("long").alias("outliers"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("physical_bytes"), F.coalesce(F.sum(F.col("bytes") + STORAGE_BYTES), F.lit(0)).cast("long").alias("_stored"),
    )
    return g.select(
        "entries", "groups", "segments", "outliers", (8 * F.col("entries")).alias("logical_bytes"), "physical_bytes",
        F.round(8.0 * F.col("entries") / F.greatest("physical_bytes", F.lit(1)), 6).alias("compression_factor"),
        # An array of heads for all groups, and the payloads.
        (F.lit(HEAD_WORD_BYTES * total).cast("long") + F.col("_stored")).alias("memory_bytes"), hash_map_bytes(F.greatest("entries", F.lit(1))).alias("hash_map_bytes"),
    )


def write_report(reported: DataFrame, path: str) -> None:
    """A report as line-wise JSON: a row or a few."""
    reported.coalesce(1).write.mode("overwrite").json(path)


def segments(groups: DataFrame) -> DataFrame:
    """A row per segment: grp, start, len, slope and width."""
    return groups.select("grp", F.explode("segs").alias("s")).select("grp", "s.start", "s.len", "s.slope", "s.width")


def segment_codes(groups: DataFrame) -> DataFrame:
    """grp, start, at and code: the packed number of every value of every segment, outliers' places with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, segs in zip(*(c.to_pylist() for c in batch.columns)):
                for s in segs:
                    n = s["len"]
                    code = unpack_bits(s["packed"], s["width"], n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), pa.array(np.full(n, s["start"], dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(code)], ["grp", "start", "at", "code"])

    return groups.where("size(segs) > 0").select("grp", "segs").mapInArrow(run, "grp long, start int, at int, code long")


def segment_report(groups: DataFrame, immediate_bits: int = 42) -> DataFrame:
    """One row over all segments: how many, which would fit into their own head (flat and short), which are runs of
    step one or zero without residuals, and the bytes of outliers."""
    s = segments(groups).agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if((F.col("slope") == 0) & (F.col("len") * F.col("width") <= immediate_bits)).alias("immediate"),
        F.count_if((F.col("slope") == 1 << FRACTION) & (F.col("width") == 0)).alias("steps"),
        F.count_if((F.col("slope") == 0) & (F.col("width") == 0)).alias("flats"),
    )
    o = groups.agg(F.coalesce(F.sum(F.size("out_at").cast("long") * (PLACE_BYTES + 8)), F.lit(0)).alias("outlier_bytes"))
    return s.crossJoin(o)


def memory(groups: DataFrame, pad: int = STORAGE_BYTES) -> DataFrame:
    """One row, bytes: payloads with their padding."""
    return groups.agg(F.coalesce(F.sum(F.col("bytes") + pad), F.lit(0)).cast("long").alias("bytes"))


def hash_map_bytes(keys: Column) -> Column:
    """Model of a hash map's memory: 17 bytes for each of the slots, a power of two with at most 7/8 in use."""
    return (17 * F.pow(F.lit(2.0), F.ceil(F.log2(keys / F.lit(0.875))))).cast("long")
