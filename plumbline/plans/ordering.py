"""Positions, running sums and as-of look-ups over a total order, without sending all rows to one task.

Small tables, by count, are ordered in one window. Larger ones are dealt to range partitions of all order columns, so
that a value that many rows share is split by the next column, and sorted within them; nulls come first, as in any
ascending order. The sorted rows are checkpointed with their number: where a range ends does not change when a lost
executor's work is done again. One row of totals a range gives every range its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Rows of a range, about; tables of fewer than two ranges are ordered in one task. Ranges at most: one row each is
#: broadcast.
RANGE_ROWS, MOST_RANGES = 250_000, 100_000


def _ranged(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The rows, sorted, with _id: the range in the upper bits, the number in it in the lower 33."""
    dealt = df.repartitionByRange(min(MOST_RANGES, rows // RANGE_ROWS), *order).sortWithinPartitions(*order)
    return durable(dealt.withColumn("_id", F.monotonically_increasing_id()))


def _before(ranged: DataFrame, total: Column) -> DataFrame:
    """_range and _before, the sum of `total` over the ranges below: one row for each range, summed on the map side."""
    totals = ranged.groupBy(F.shiftright("_id", 33).alias("_range")).agg(total.alias("_total"))
    below = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("_range", F.coalesce(below, F.lit(0)).cast("long").alias("_before"))


def running_sum(df: DataFrame, value: Column, order: list[str], into: str) -> DataFrame:
    """The sum of `value` over all rows up to and including each, in the given order: a total one."""
    df, rows = df.withColumn(into, value.cast("long")), df.count()
    if rows < 2 * RANGE_ROWS:
        return df.withColumn(into, F.sum(into).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranged = _ranged(df, order, rows)
    so_far = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    df = ranged.withColumn("_range", F.shiftright("_id", 33)).withColumn(into, F.sum(into).over(so_far))
    df = df.join(F.broadcast(_before(ranged, F.sum(into))), "_range")
    return df.withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before", "_id")


def positions(df: DataFrame, order: list[str], into: str = "pos") -> DataFrame:
    """The position from 0 of every row in the given order."""
    rows = df.count()
    if rows < 2 * RANGE_ROWS:
        return df.withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranged = _ranged(df, order, rows)
    df = ranged.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(_before(ranged, F.count(F.lit(1)))), "_range")
    return df.withColumn(into, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_range", "_before", "_id")


def as_of(left: DataFrame, right: DataFrame, key: str, start: str, tie: str, into: str) -> DataFrame:
    """The left rows with a struct of the last right row that starts at or below the key, null where there is none. Of
    right rows with the same start the last by `tie`, a number, counts.

    Both sides are sorted together and the last right row is carried on: in a window per range, and from range to range
    by one row each. Keys of the left side are to be distinct, so that no value is many rows.
    """
    value = F.struct(*[F.col(c) for c in right.columns])
    starts = right.select(F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), value.alias(into), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes])
    probes = left.select(F.col(key).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(starts.schema[into].dataType).alias(into), *left.columns)
    both = starts.unionByName(probes)
    rows = both.count()
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if rows < 2 * RANGE_ROWS:
        both = both.withColumn(into, F.last(into, ignorenulls=True).over(so_far(Window.orderBy("_at", "_side", "_tie"))))
        return both.where("_side = 1").select(*left.columns, into)
    ranged = _ranged(both, ["_at", "_side", "_tie"], rows).withColumn("_range", F.shiftright("_id", 33))
    ends = ranged.groupBy("_range").agg(F.max_by(into, F.when(F.col("_side") == 0, F.col("_id"))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_range", carried.alias("_end"))
    within = F.last(into, ignorenulls=True).over(so_far(Window.partitionBy("_range").orderBy("_id")))
    df = ranged.withColumn(into, within).where("_side = 1").join(F.broadcast(ends), "_range")
    return df.select(*left.columns, F.coalesce(into, "_end").alias(into))
