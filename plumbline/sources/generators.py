"""Made data for benchmarks and tests: ascending keys and sequences, the same for the same seed and number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import positions, running_sum

#: Rows of a partition: random numbers follow the partitions, so these are fixed.
_PART_ROWS = 1 << 18
# Fixed values of the sequences: gaps from 1 to 99; Zipf steps over 100 ranks with exponent 1.5, from 16 up.
GAP, RANKS, EXPONENT, LEAST_STEP = 99, 100, 1.5, 16


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, -(-n // _PART_ROWS)))


def gap_keys(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """pos and value: ascending, with uniform gaps."""
    gap = F.floor(F.rand(seed) * GAP).cast("long") + 1
    return running_sum(_rows(spark, n).withColumn("gap", gap), F.col("gap"), ["id"], "value").select(F.col("id").alias("pos"), "value")


def zipf_offsets(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """pos and value: ascending, with steps of Zipf-distributed ranks."""
    weight = [k**-EXPONENT for k in range(1, RANKS + 1)]
    up_to = [sum(weight[: k + 1]) / sum(weight) for k in range(RANKS - 1)]
    rows = _rows(spark, n).withColumn("draw", F.rand(seed))
    rank = F.size(F.filter(F.array(*[F.lit(x) for x in up_to]), lambda x: x < F.col("draw"))) + 1
    return running_sum(rows.withColumn("step", rank + LEAST_STEP), F.col("step"), ["id"], "value").select(F.col("id").alias("pos"), "value")


def log_normal_bits(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """pos and value: the distinct bit patterns of log-normal numbers, ascending; a few less than n."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy().view("<i8"))], ["value"])

    drawn = _rows(spark, n).select(F.exp(F.randn(seed)).alias("x")).mapInArrow(bits, "value long").distinct()
    return positions(drawn, ["value"]).select("pos", "value")
