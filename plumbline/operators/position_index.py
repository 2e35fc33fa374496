"""A learned position index: line segments that predict a sorted key's position within epsilon.

`build` fits the segments in one pass over range partitions of the keys; a partition's edge is one more segment break,
so the error bound holds for any partitioning. Keys are taken relative to their segment's first key, in integers, before
any floating point, so large keys lose nothing. Keys are signed 64-bit numbers, or unsigned ones in a DECIMAL column:
these are kept less 2**63, in the same order, and probes are then taken so too.

Predictions and lower bounds use the index: distinct keys and segments are sorted together, by ranges, and the last
segment is carried on, so skewed keys make no group; windows and data meet in blocks of positions. Exact look-ups, misses
and hit counts do not use it: they join the probes with the keys, and no segment is fitted for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.bits import byte_key, signed
from ..options import IndexOptions
from ..plans.ordering import as_of, positions
from ..session import shared_dir

#: Bins of the look-up table: four per segment, within these limits.
LEAST_BINS, MOST_BINS = 1024, 1 << 20
SEGMENT_BYTES, BIN_BYTES = 48, 4

SEGMENT = "min_key long, max_key long, slope double, start_idx long, end_idx long"
_COLUMNS = [x.split()[0] for x in SEGMENT.split(", ")]
_CHUNK = 4096
#: Keys that one task of an exact fit sorts and goes through.
EXACT_ROWS = 2_000_000


class Greedy:
    """Shrinking-cone segments of ascending keys at consecutive positions, which may come in parts.

    From its first key a segment goes on while one slope keeps all positions within epsilon. Chunks of keys are tested
    at once: running extremes of the slopes' bounds cross where the cone closes. What is kept from part to part is the
    open segment: its first and last key, the cone, and its positions.
    """

    def __init__(self, epsilon: int, begun: tuple[int, int, float, float, int, int] | None = None):
        self.epsilon, self.begun = epsilon, begun

    def add(self, keys: np.ndarray, first_pos: int) -> list[tuple[int, int, float, int, int]]:
        """The segments that end before the last of the keys."""
        out = self.close() if self.begun and self.begun[5] != first_pos else []
        b, n = 0, len(keys)
        while b < n:
            if self.begun is None:
                self.begun = (int(keys[b]), int(keys[b]), -np.inf, np.inf, first_pos + b, first_pos + b + 1)
                b += 1
                continue
            first, _, low, high, start, _ = self.begun
            stop = min(n, b + _CHUNK)
            # Keys ascend, so a difference that does not fit a signed number wraps to the right unsigned one.
            dk = (keys[b:stop] - np.asarray([first], dtype=np.int64)).view(np.uint64).astype(np.float64)
            di = np.arange(first_pos + b - start, first_pos + stop - start, dtype=np.float64)
            same = dk == 0
            with np.errstate(divide="ignore", invalid="ignore"):
                lows = np.maximum.accumulate(np.where(same, -np.inf, (di - self.epsilon) / dk))
                highs = np.minimum.accumulate(np.where(same, np.inf, (di + self.epsilon) / dk))
            # A run of the first key is held by its start alone: it may be epsilon long.
            bad = np.flatnonzero((np.maximum(lows, low) > np.minimum(highs, high)) | (same & (di > self.epsilon)))
            k = int(bad[0]) if len(bad) else stop - b
            if k:
                self.begun = (first, int(keys[b + k - 1]), max(low, float(lows[k - 1])), min(high, float(highs[k - 1])), start, first_pos + b + k)
            b += k
            if len(bad):
                out += self.close()
        return out

    def close(self) -> list[tuple[int, int, float, int, int]]:
        """The open segment, if there is one."""
        if self.begun is None:
            return []
        first, last, low, high, start, end = self.begun
        slope = (low + high) / 2 if np.isfinite(low) and np.isfinite(high) else (max(low, 0.0) if np.isfinite(low) else 0.0)
        self.begun = None
        return [(first, last, float(slope), start, end)]


def _distance(a: Column, b: Column) -> Column:
    """a - b as a floating-point number, exact before it is rounded."""
    wide = (a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")
    return F.coalesce(F.try_subtract(a, b).cast("double"), wide)


@dataclass
class PositionIndex:
    """data: key and pos. segments: see SEGMENT, with seg_id. The index does not change its data. Of unsigned keys, data
    and segments have the signed form."""

    data: DataFrame
    segments: DataFrame
    options: IndexOptions
    unsigned: bool = False

    def _asked(self, probes: DataFrame, look) -> DataFrame:
        """What `look` makes of the probes, with keys in the form of the data and given back as they came."""
        if not self.unsigned:
            return look(probes)
        inner = probes.withColumnRenamed("key", "_given").withColumn("key", signed(F.col("_given")))
        out = look(inner)
        more = [c for c in out.columns if c not in inner.columns]
        return out.drop("key").withColumnRenamed("_given", "key").select(*probes.columns, *more)

    # -- description -------------------------------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """One row: len, segments, avg_segment_size, index_bytes (segments and look-up table) and total_bytes."""
        s = self.segments.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.col("end_idx") - F.col("start_idx")), F.lit(0)).alias("len"))
        bins = F.greatest(F.lit(LEAST_BINS), F.least(F.lit(MOST_BINS), 4 * F.col("segments")))
        s = s.withColumn("index_bytes", F.col("segments") * SEGMENT_BYTES + F.when(F.col("segments") > 0, (bins + 1) * BIN_BYTES).otherwise(BIN_BYTES))
        return s.select("len", "segments", (F.col("len") / F.greatest("segments", F.lit(1))).alias("avg_segment_size"), "index_bytes", (F.col("index_bytes") + 8 * F.col("len")).alias("total_bytes"))

    def lookup_table(self) -> DataFrame:
        """bin and seg_id: for every bin of equal width in keys, the segments that reach into it."""
        width, low = self._bins()
        # A segment's successor begins at the position where it ends.
        after = self.segments.select(F.col("start_idx").alias("end_idx"), F.col("min_key").alias("_next"))
        ends = self.segments.join(after, "end_idx", "left").withColumn("upto", F.coalesce("_next", "max_key"))
        bin_of = lambda c: F.expr(f"cast((cast({c} AS decimal(38,0)) - {low}) div {width} AS long)")
        return ends.select("seg_id", F.explode(F.sequence(bin_of("min_key"), bin_of("upto"))).alias("bin"))

    def _bins(self) -> tuple[int, int]:
        r = self.segments.agg(F.count(F.lit(1)), F.min("min_key"), F.max("max_key")).first()
        if not r[0]:
            return 1, 0
        bins = max(LEAST_BINS, min(MOST_BINS, 4 * r[0]))
        return max(1, -(-(r[2] - r[1] + 1) // bins)), r[1]

    # -- prediction --------------------------------------------------------------------------------------------------

    def find_segment(self, probes: DataFrame) -> DataFrame:
        """Probes (with a column key) with the last segment that begins at or below the key, or the first segment."""
        return self._asked(probes, self._find)

    def _find(self, probes: DataFrame) -> DataFrame:
        found = as_of(probes.select("key").where("key IS NOT NULL").distinct(), self.segments, "key", "min_key", "start_idx", "_seg")
        first = self.segments.orderBy("start_idx").first()
        if first is not None:
            kinds = dict(self.segments.dtypes)
            first = F.struct(*[F.lit(first[c]).cast(kinds[c]).alias(c) for c in self.segments.columns])
            found = found.withColumn("_seg", F.coalesce("_seg", first))
        return probes.join(found, "key", "left").select(*probes.columns, *[F.col(f"_seg.{c}").alias(c) for c in self.segments.columns])

    def _line(self) -> dict[str, Column]:
        """pred, and lo and hi, the window around it, of rows that have a key and its segment."""
        line = F.col("start_idx") + F.floor(F.least(F.col("slope") * _distance(F.col("key"), F.col("min_key")) + 0.5, F.lit(2.0**62)))
        pred = F.greatest(F.col("start_idx"), F.least(F.col("end_idx") - 1, line.cast("long")))
        e = self.options.epsilon
        return {"pred": pred, "lo": F.greatest(pred - e, F.col("start_idx")), "hi": F.least(pred + e + 1, F.col("end_idx"))}

    def predict(self, probes: DataFrame) -> DataFrame:
        """Probes with pred, the predicted position, and the window [lo, hi) around it; null over no data."""
        return self._asked(probes, lambda p: self._find(p).withColumns(self._line()).select(*p.columns, "seg_id", "pred", "lo", "hi"))

    # -- look-up -----------------------------------------------------------------------------------------------------

    def lookup(self, probes: DataFrame) -> DataFrame:
        """Probes with pos, the first position of their key, or null where it is absent. A row per probe."""
        first = self.data.groupBy("key").agg(F.min("pos").alias("pos"))
        return self._asked(probes, lambda p: p.join(first, "key", "left").select(*p.columns, "pos"))

    def misses(self, probes: DataFrame) -> DataFrame:
        return self._asked(probes, lambda p: p.join(self.data, "key", "left_anti"))

    def count_hits(self, probes: DataFrame) -> DataFrame:
        """One row, hits: the probes that are found, repeated ones counted each."""
        return self._asked(probes, lambda p: p.join(self.data, "key", "left_semi")).agg(F.count(F.lit(1)).alias("hits"))

    def lower_bound(self, probes: DataFrame) -> DataFrame:
        """Probes with lower, the number of keys below: the position where the key is or would be; null for a null key."""
        return self._asked(probes, lambda p: p.join(self._lower(p.select("key").where("key IS NOT NULL").distinct()), "key", "left").select(*p.columns, "lower"))

    def lower_bound_bytes(self, probes: DataFrame, column: str) -> DataFrame:
        """lower_bound() of keys that are the first 8 bytes of a column, as an unsigned number."""
        names = [c for c in probes.columns if c != "key"]
        return self.lower_bound(probes.select(*names, byte_key(F.col(column)).alias("key"))).drop("key")

    def _lower(self, keys: DataFrame) -> DataFrame:
        """key and lower of distinct keys.

        The segment is the last that begins below the key, so a run of equal keys is met at its start even where it
        fills several segments.
        """
        e = 2 * self.options.epsilon + 2
        below = keys.withColumn("_key", F.col("key")).withColumn("key", F.coalesce(F.try_subtract("key", F.lit(1).cast("long")), "key"))
        near = self._find(below).withColumn("key", F.col("_key")).withColumns(self._line()).withColumn("past", F.col("key") > F.col("max_key"))
        spread = F.sequence(F.expr(f"lo div {e}L"), F.expr(f"greatest(hi - 1, lo) div {e}L"))
        blocks = near.where("NOT past").select("key", "lo", "hi", F.explode(spread).alias("block"))
        data = self.data.select(F.expr(f"pos div {e}L").alias("block"), "pos", F.col("key").alias("_k"))
        inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")) & (F.col("_k") < F.col("key"))
        counted = blocks.join(data, "block").groupBy("key").agg(F.count_if(inside).alias("_n"))
        # Only keys at or below the very first have a segment that does not begin below them.
        lower = F.when(F.col("key") <= F.col("min_key"), F.lit(0)).when(F.col("past"), F.col("end_idx")).otherwise(F.col("lo") + F.coalesce("_n", F.lit(0)))
        return near.join(counted, "key", "left").select("key", F.coalesce(lower, F.lit(0)).alias("lower"))

    def segment_of(self, indices: DataFrame) -> DataFrame:
        """Rows of pos with the seg_id whose positions hold it; none outside the data. Positions meet in equal blocks."""
        n = self.data.count()
        size = max(1, n // max(1, self.segments.count()))
        spread = F.sequence(F.expr(f"start_idx div {size}L"), F.expr(f"(end_idx - 1) div {size}L"))
        spans = self.segments.select("seg_id", "start_idx", "end_idx", F.explode(spread).alias("_block"))
        found = indices.withColumn("_block", F.expr(f"pos div {size}L")).join(spans, "_block")
        return found.where("start_idx <= pos AND pos < end_idx").select(*indices.columns, "seg_id")

    def audit(self) -> DataFrame:
        """One row: keys, violations (errors beyond epsilon), max_error and avg_error. A key's error is the distance of
        its prediction from the positions it has; a repeated key counts as often as it is there."""
        own = self.data.groupBy("key").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("_n"))
        error = F.greatest(F.lit(0), F.col("first") - F.col("pred"), F.col("pred") - F.col("last"))
        seen = self._find(own).withColumns(self._line()).withColumn("error", error)
        rows = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return seen.agg(
            rows("_n").alias("keys"), rows(F.when(F.col("error") > self.options.epsilon, F.col("_n"))).alias("violations"),
            F.coalesce(F.max("error"), F.lit(0)).alias("max_error"), F.coalesce(F.sum(F.col("error") * F.col("_n")) / F.sum("_n"), F.lit(0.0)).alias("avg_error"),
        )

    def save(self, path: str) -> None:
        """Segments and data as Parquet, with the options in their names."""
        self.segments.write.mode("overwrite").parquet(f"{path}/segments-{self.options.epsilon}")
        self.data.write.mode("overwrite").parquet(f"{path}/data")

    @classmethod
    def load(cls, spark, path: str, options: IndexOptions, unsigned: bool = False) -> PositionIndex:
        return cls(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/segments-{options.epsilon}"), options, unsigned)


def build(df: DataFrame, key: str = "key", options: IndexOptions | None = None) -> PositionIndex:
    """Index the non-null keys of a column of whole numbers, unsigned ones if it is a DECIMAL column. Equal keys take
    consecutive positions."""
    return fitted(positioned(df, key), options or IndexOptions(), isinstance(df.schema[key].dataType, DecimalType))


def positioned(df: DataFrame, key: str = "key") -> DataFrame:
    """key, in its signed form, and pos of the non-null keys: the data of an index, to be fitted more than once."""
    unsigned = isinstance(df.schema[key].dataType, DecimalType)
    keys = df.where(F.col(key).isNotNull()).select((signed(F.col(key)) if unsigned else F.col(key).cast("long")).alias("key"))
    return positions(keys, ["key"])


def fitted(data: DataFrame, options: IndexOptions, unsigned: bool = False) -> PositionIndex:
    """The index over data that has positions."""
    segments = _exact(data, options.epsilon) if options.exact else _pass(data.repartitionByRange("pos").sortWithinPartitions("pos"), options.epsilon)
    segments = segments.select(*_COLUMNS, F.col("start_idx").alias("seg_id"))
    return PositionIndex(data, segments.persist(), options, unsigned)


def _pass(dealt: DataFrame, epsilon: int, begun: tuple | None = None, last: bool = True) -> DataFrame:
    """The segments of each partition's keys, by position, and whether they are still open. A partition goes on with the
    segment that is begun, and leaves its last one open unless it is the last. What is held is a batch of keys."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = Greedy(epsilon, begun)
        for batch in batches:
            key, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
            rows = [r for a, b in zip(cuts, cuts[1:]) if b > a for r in greedy.add(key[a:b], int(pos[a]))]
            yield made([(*r, None, None, False) for r in rows])
        if last or greedy.begun is None:
            yield made([(*r, None, None, False) for r in greedy.close()])
        else:
            first, top, low, high, start, end = greedy.begun
            yield made([(first, top, 0.0, start, end, low, high, True)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], [*_COLUMNS, "low", "high", "open"])

    return dealt.select("key", "pos").mapInArrow(fit, f"{SEGMENT}, low double, high double, open boolean")


def _exact(data: DataFrame, epsilon: int) -> DataFrame:
    """The segments of one greedy pass over all keys. More than EXACT_ROWS are written by blocks of positions, and a task
    for each block, one after another, goes on with the segment that the block before left open."""
    spark, rows = data.sparkSession, data.count()
    if rows <= EXACT_ROWS:
        return _pass(data.coalesce(1).sortWithinPartitions("pos"), epsilon)
    folder, blocks = f"{shared_dir(spark)}/exact-fit-{uuid.uuid4().hex}", -(-rows // EXACT_ROWS)
    data.select("key", "pos", F.expr(f"pos div {EXACT_ROWS}L").alias("block")).write.partitionBy("block").parquet(f"{folder}/keys")
    begun = None
    for block in range(blocks):
        keys = spark.read.schema("key long, pos long").parquet(f"{folder}/keys/block={block}").coalesce(1).sortWithinPartitions("pos")
        done = f"{folder}/segments/block={block}"
        _pass(keys, epsilon, begun, block == blocks - 1).write.parquet(done)
        r = spark.read.parquet(done).where("open").first()
        begun = r and (r.min_key, r.max_key, r.low, r.high, r.start_idx, r.end_idx)
    return spark.read.parquet(f"{folder}/segments").where("NOT open")
