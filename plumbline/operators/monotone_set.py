"""Sorted integer sets per group: select, predecessor, iteration, and their Elias-Fano size and bytes.

Rows are (grp, value). Select and iteration number the values of a group; the predecessor of a target is a backward
as-of join, made as one window over values and targets together, so that no pairs are formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotSorted

#: Values between entries of the skip table, bytes of an entry, bytes of the head.
SKIP, SKIP_BYTES, HEAD_BYTES = 64, 4, 3


def low_bits(n: Column, bound: Column) -> Column:
    """floor(log2(bound / n)), 0 where the bound is not above n; in whole numbers."""
    return F.when(bound > n, F.length(F.bin(F.expr("1L") * F.floor(bound / n))) - 1).otherwise(0)


def byte_length(n: Column, bound: Column) -> Column:
    low = low_bits(n, bound)
    upper = F.ceil((n + F.floor(bound / F.pow(F.lit(2.0), low)) + 1) / 8)
    return F.when(n == 0, 1).otherwise(HEAD_BYTES + upper + F.ceil(n * low / 8) + SKIP_BYTES * F.ceil(n / SKIP)).cast("long")


def sizes(sets: DataFrame, bound: int = 4096) -> DataFrame:
    """grp, n and bytes."""
    n = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.select("grp", "n", byte_length(F.col("n"), F.lit(bound)).alias("bytes"))


def iterate(sets: DataFrame) -> DataFrame:
    """grp, idx from 0 and value in ascending order."""
    return sets.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("value")) - 1).cast("long").alias("idx"), "value")


def select(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of grp and idx with value, null where the group has no such value."""
    return wanted.join(iterate(sets), ["grp", "idx"], "left")


def predecessor(sets: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct targets (grp, target) with the largest value at or below and its idx; both null where there is none."""
    values = iterate(sets).select("grp", F.col("value").alias("at"), F.lit(0).alias("kind"), F.struct("idx", "value").alias("found"))
    asked = targets.select("grp", F.col("target").alias("at")).distinct()
    asked = asked.select("grp", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<idx:bigint,value:bigint>").alias("found"))
    values = values.withColumn("found", F.col("found").cast("struct<idx:bigint,value:bigint>"))
    order = Window.partitionBy("grp").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = values.unionByName(asked).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("kind = 1")
    return last.select("grp", F.col("at").alias("target"), F.col("found.idx").alias("idx"), F.col("found.value").alias("value"))


def encode(values: list[int], bound: int = 4096) -> bytes:
    """The Elias-Fano bytes of one ascending set: low bits, bytes of the upper part, upper part, lower part, skips."""
    n = len(values)
    if not n:
        return b"\0"
    if min(values) < 0 or any(a > b for a, b in zip(values, values[1:])):
        raise NotSorted("a set to be encoded ascends from 0 up")
    low = int(math.log2(bound // n)) if bound > n else 0
    v = np.asarray(values, dtype=np.int64)
    upper = np.zeros(n + (bound >> low) + 1, dtype=np.uint8)
    at = (v >> low) + np.arange(n)
    upper[at] = 1
    lower = ((v[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    up, down = (np.packbits(x, bitorder="little").tobytes() for x in (upper, lower))
    skips = b"".join(int(a).to_bytes(2, "little") + int(h).to_bytes(2, "little") for a, h in zip(at[::SKIP], (v >> low)[::SKIP]))
    return bytes([low]) + len(up).to_bytes(2, "little") + up + down + skips


def encode_sets(sets: DataFrame, bound: int = 4096) -> DataFrame:
    """grp, n and data, the Elias-Fano bytes of each group's distinct values; a group has at most `bound` of them."""
    lists = sets.groupBy("grp").agg(F.array_sort(F.collect_set(F.col("value").cast("long"))).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array([encode(v, bound) for v in values], pa.binary())], ["grp", "n", "data"])

    return lists.mapInArrow(run, f"grp {sets.schema['grp'].dataType.simpleString()}, n long, data binary")


def decode_sets(encoded: DataFrame) -> DataFrame:
    """grp, idx and value of every value of encoded sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [decode(data, n) for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], ["grp", "values"])

    kind = encoded.schema["grp"].dataType.simpleString()
    lists = encoded.select("grp", "n", "data").mapInArrow(run, f"grp {kind}, values array<long>")
    return lists.select("grp", F.posexplode("values").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


def decode(data: bytes, n: int) -> list[int]:
    if not n or len(data) < HEAD_BYTES:
        return []
    low, size = data[0], int.from_bytes(data[1:3], "little")
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(data[3 : 3 + size], dtype=np.uint8), bitorder="little"))[:n] - np.arange(n)
    lower = np.unpackbits(np.frombuffer(data[3 + size : 3 + size + -(-n * low // 8)], dtype=np.uint8), bitorder="little")[: n * low].reshape(n, low)
    return ((upper << low) + (lower.astype(np.int64) << np.arange(low)).sum(axis=1)).tolist()
