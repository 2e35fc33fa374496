"""Helpers of the training-data operators: shared scratch space, row identity and task sizes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in the contracts, for regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder
    of its own; a cluster has none that all of it shares, and is refused."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = context.getCheckpointDir()
        if base is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="plumbline-")
            context.setCheckpointDir(base)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder. Spark drops the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: compressed and column-prunable, for large intermediates."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a written table of which nothing is left to read."""
    spark = table.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that no plan needs any more: it does so for objects that the driver's
    garbage collectors have found, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int, mega: int = 4) -> Iterator[None]:
    """Arrow batches of at most so many rows and megabytes (a row at least) for the actions inside, where rows are wide:
    both sides hold whole batches."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(mega << 20)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def bounded_batches(spark: SparkSession, rows: int = 2000, mega: int = 4) -> None:
    """The limits of batches_of() for the rest of the session: for tables of texts that are only described here and
    computed by whoever writes them. Lower limits that are set already stay."""
    for name, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mega << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < now <= limit:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(limit))


def trimmed(batches: Iterator) -> Iterator:
    """The batches a task makes; when they end, what its worker has freed goes back to the system, as workers are used
    again by tasks of other kinds."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so that extra columns with clashing names cannot get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Ids that may be broadcast, 8 bytes each and as much again for their table.
BROADCAST_IDS = 500_000


def small(ids: DataFrame) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast where it is counted to be small; beyond, joins shuffle it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the table has such a column already; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a 64-bit hash of the text in a column of its own, and its name. With the doc_id it tells rows
    apart whatever order a source is read in; rows that agree in both are copies of one row."""
    name = unused(docs, "_mark")
    return docs.withColumn(name, mark()), name


def mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def one_each(docs: DataFrame, mark_name: str, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The marked documents without those of `gone`, and one row for each of `repeated`, in the columns of the input.

    Both are tables of doc_id and mark; null doc_ids are equal here. Repeated rows are no more than their copies, and are
    combined on the map side.
    """
    names = [c for c in docs.columns if c != mark_name]

    def joined(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        doc, key = unused(docs, "_doc"), unused(docs, "_key")
        keys = small(keys.select(F.col("doc_id").alias(doc), F.col("mark").alias(key)))
        return left.join(keys, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mark_name) == F.col(key)), how)

    left = joined(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in names])
    row = unused(docs, "_row")
    once = joined(left, repeated, "left_semi").groupBy("doc_id", mark_name).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias(row)).select(f"{row}.*")
    return joined(left, repeated, "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(once)
