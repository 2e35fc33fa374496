"""Analytics of operation logs and of the maps they leave: counts, heat, runs, quantiles, sweeps and run history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bit_width
from ..sources.traces import WRITE
from .address_map import FRACTION, PLACE_BYTES, SEGMENT_BYTES, fit_group

#: Bits of an exception in a patched block: a value of 64 and a place of 8.
EXCEPTION_BITS = 72


def count_keys(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("lba").alias("keys"))


def approximate_keys(log: DataFrame, error: float = 0.02) -> DataFrame:
    return log.agg(F.approx_count_distinct("lba", error).alias("keys"))


def write_heat(log: DataFrame, span: int = 100_000) -> DataFrame:
    """Writes per range of addresses."""
    return log.where(F.col("op") == WRITE).groupBy(F.floor(F.col("lba") / span).cast("long").alias("range")).agg(F.count(F.lit(1)).alias("writes"))


def operation_mix(log: DataFrame) -> DataFrame:
    """op, n and share in percent."""
    n = log.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    return n.crossJoin(F.broadcast(total)).select("op", "n", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias("percent"))


def capacity(log: DataFrame) -> DataFrame:
    return log.agg((F.max("lba") + 1).alias("capacity"))


def runs(state: DataFrame) -> DataFrame:
    """Runs of consecutive addresses within a group: grp, start, len and width (bits of the values' spread)."""
    order = Window.partitionBy("grp").orderBy("lba")
    island = state.withColumn("island", F.col("lba") - F.row_number().over(order))
    g = island.groupBy("grp", "island").agg(F.min("lba").alias("start"), F.count(F.lit(1)).alias("len"), (F.max("pba") - F.min("pba")).alias("spread"))
    return g.select("grp", "start", "len", bit_width(F.col("spread")).alias("width"))


def length_quantiles(lengths: DataFrame) -> DataFrame:
    """One row: n, avg, p50, p90, p99 and max of a column len; exact, of values that occur."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY len)")
    return lengths.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("len"), 6).alias("avg"), q(0.5).cast("long").alias("p50"), q(0.9).cast("long").alias("p90"), q(0.99).cast("long").alias("p99"), F.max("len").alias("max")
    )


def histogram(df: DataFrame, column: str, step: int = 1) -> DataFrame:
    """bin (the lowest value of its step) and n."""
    return df.groupBy((F.floor(F.col(column) / step) * step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def patched_width(codes: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Per block, that is by block_id or other columns: width and bits of the cheapest width when each wider code costs EXCEPTION_BITS, and plain_bits at
    the full width. The smallest of equally cheap widths is taken."""
    per = codes.groupBy(*by, bit_width(F.col("code")).alias("w")).agg(F.count(F.lit(1)).alias("k"))
    blocks = per.groupBy(*by).agg(F.sum("k").alias("n"), F.max("w").alias("full"), F.map_from_entries(F.collect_list(F.struct("w", "k"))).alias("h"))
    cost = F.expr(f"transform(sequence(0, full), w -> struct(n * w + {EXCEPTION_BITS}L * aggregate(map_entries(h), 0L, (a, e) -> a + if(e.key > w, e.value, 0L)) AS bits, w AS width))")
    best = F.array_min(cost)
    return blocks.select(*by, best["width"].alias("width"), best["bits"].alias("bits"), (F.col("n") * F.col("full")).alias("plain_bits"))


def greedy_segments(lba: list[int], pba: list[int], epsilon: int) -> int:
    """Segments whose slope is that of the first two points and whose error stays within twice epsilon."""
    n, at, count = len(lba), 0, 0
    while at < n:
        dl = lba[at + 1] - lba[at] if at + 1 < n else 0
        rise = (pba[at + 1] - pba[at]) << FRACTION if dl > 0 else 0
        slope = (abs(rise) // dl) * (1 if rise >= 0 else -1) if dl > 0 else 0  # whole numbers, truncated
        k = at + 1
        while k < n and abs(pba[k] - pba[at] - ((slope * (lba[k] - lba[at])) >> FRACTION)) <= 2 * epsilon:
            k += 1
        count, at = count + 1, k
    return count


def _lists(state: DataFrame) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct("lba", "pba")))
    return state.groupBy("grp").agg(e.alias("e")).select(F.transform("e", lambda x: x["lba"]).alias("lba"), F.transform("e", lambda x: x["pba"]).alias("pba"))


def epsilon_sweep(state: DataFrame, epsilons: list[int], direct: int = 8) -> DataFrame:
    """epsilon and segments over all groups; a group of few entries is one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(epsilons), dtype=np.int64)
        for batch in batches:
            for lba, pba in zip(*(c.to_pylist() for c in batch.columns)):
                total += [1 if len(lba) <= direct else greedy_segments(lba, pba, e) for e in epsilons]
        yield pa.RecordBatch.from_arrays([pa.array(epsilons, pa.int64()), pa.array(total)], ["epsilon", "segments"])

    return _lists(state).mapInArrow(run, "epsilon long, segments long").groupBy("epsilon").agg(F.sum("segments").alias("segments"))


def patch_sweep(state: DataFrame, epsilons: list[int] = (512, 1024, 4096, 16384), skips: list[int] = (2, 4, 8, 16, 32), direct: int = 8) -> DataFrame:
    """For each epsilon and skip: segments, outliers and bytes of all fitted groups, and the percentage saved against the
    fit without outliers at the same epsilon."""
    grid = [(e, s) for e in epsilons for s in skips]

    def size(pba: list[int], e: int, skip: int) -> tuple[int, int, int]:
        segs, out = fit_group(pba, e, skip)
        left, total = set(out), 4
        for a, b, base, slope in segs:
            width = max(0 if j in left else pba[j] - base - ((slope * (j - a)) >> FRACTION) for j in range(a, b)).bit_length()
            total += SEGMENT_BYTES + -(-width * (b - a) // 8)
        return len(segs), len(out), total + (PLACE_BYTES + 8) * len(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((len(grid), 3), dtype=np.int64), np.zeros(len(grid), dtype=np.int64)
        for batch in batches:
            for _, pba in zip(*(c.to_pylist() for c in batch.columns)):
                if len(pba) > direct:
                    one = {e: size(pba, e, 1)[2] for e in epsilons}
                    for k, (e, s) in enumerate(grid):
                        total[k] += size(pba, e, s)
                        plain[k] += one[e]
        cols = [pa.array([g[0] for g in grid], pa.int64()), pa.array([g[1] for g in grid], pa.int64()), *(pa.array(total[:, k]) for k in range(3)), pa.array(plain)]
        yield pa.RecordBatch.from_arrays(cols, ["epsilon", "skip", "segments", "outliers", "bytes", "plain"])

    rows = _lists(state).mapInArrow(run, "epsilon long, skip long, segments long, outliers long, bytes long, plain long")
    g = rows.groupBy("epsilon", "skip").agg(*[F.sum(c).alias(c) for c in ("segments", "outliers", "bytes", "plain")])
    saved = F.round(100.0 * (F.col("plain") - F.col("bytes")) / F.greatest("plain", F.lit(1)), 6)
    return g.select("epsilon", "skip", "segments", "outliers", "bytes", saved.alias("saved_percent"))


def best_setting(sweep: DataFrame) -> DataFrame:
    """The epsilon and skip that save most; the smallest of equals."""
    order = F.struct("saved_percent", -F.col("epsilon"), -F.col("skip"))
    return sweep.agg(F.max_by(F.struct("epsilon", "skip", "saved_percent"), order).alias("b")).select("b.*")


def pivot_report(runs: DataFrame, key: str, by: str, value: str, names: list[str]) -> DataFrame:
    """A row per key, a column per name of `by`, and the ratio of the last to the first."""
    wide = runs.groupBy(key).pivot(by, names).agg(F.max(value))
    return wide.withColumn("ratio", F.round(F.col(names[-1]) / F.col(names[0]), 6))


def run_deltas(history: DataFrame, key: str, order: str, value: str, keep: int = 512) -> DataFrame:
    """The last `keep` runs of each key with the change against the run before, in percent."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    df = history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("delta_percent", F.round(100.0 * (F.col(value) - before) / before, 6))


def tuning_score(throughput_ratio: Column, latency_ratio: Column, memory_ratio: Column) -> Column:
    return throughput_ratio / (latency_ratio * memory_ratio)
