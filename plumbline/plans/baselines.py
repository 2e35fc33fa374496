"""What a Spark user would write without this library: the comparisons that bench.py times beside the library's queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from . import index_queries, map_queries, sequence_queries


def lww_map(spark, sf_dir) -> DataFrame:
    """The last change of each address by a window."""
    order = Window.partitionBy("lba").orderBy(F.desc("seq"))
    last = map_queries.log(spark, sf_dir).where("op <> 0").withColumn("r", F.row_number().over(order)).where("r = 1 AND op = 1")
    return last.select("lba", "pba", F.floor(F.col("lba") / 4096).cast("long").alias("grp"))


def pgm_lower_bound(spark, sf_dir) -> DataFrame:
    """Keys below each probe: keys and probes sorted together in one window."""
    keys = index_queries.lines(spark, sf_dir).select("key", F.lit(0).alias("asked"))
    both = keys.unionByName(index_queries._probes(spark, sf_dir).select("key", F.lit(1).alias("asked")))
    below = F.sum(1 - F.col("asked")).over(Window.orderBy("key").rangeBetween(Window.unboundedPreceding, -1))
    return both.withColumn("lower", F.coalesce(below, F.lit(0))).where("asked = 1").select("key", "lower")


def pgm_lookup(spark, sf_dir) -> DataFrame:
    """Positions by a window over all keys, and a join."""
    data = index_queries.lines(spark, sf_dir).withColumn("pos", F.row_number().over(Window.orderBy("key")) - 1)
    return index_queries._probes(spark, sf_dir).join(data.groupBy("key").agg(F.min("pos").alias("pos")), "key", "left")


def pc_roundtrip(spark, sf_dir) -> DataFrame:
    """The sequence written as plain Parquet and read again."""
    path = f"{shared_dir(spark)}/plain-{uuid.uuid4().hex}"
    sequence_queries.prices(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def ef_predecessor(spark, sf_dir) -> DataFrame:
    """The last member at or below each target by a join on the group and an inequality."""
    sets = sequence_queries._sets(spark, sf_dir)
    reads = map_queries.log(spark, sf_dir).where("op = 0").select(F.floor(F.col("lba") / 4096).cast("long").alias("grp"), (F.col("lba") % 4096).alias("target")).distinct()
    both = reads.join(sets, (reads["grp"] == sets["grp"]) & (sets["value"] <= reads["target"]), "left")
    return both.groupBy(reads["grp"], "target").agg(F.max("value").alias("value"))


def stored_bytes(spark, sf_dir) -> DataFrame:
    """The size of the sequence of cents: 8 bytes a value, and the dump format of the codec."""
    from ..operators.sequence_codec import encode, size

    return size(encode(sequence_queries.prices(spark, sf_dir))).select("n", (8 * F.col("n")).alias("plain_bytes"), "dump_bytes")


BASELINES = {f.__name__: f for f in (lww_map, pgm_lower_bound, pgm_lookup, pc_roundtrip, ef_predecessor)}
