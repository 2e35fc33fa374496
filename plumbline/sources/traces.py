"""Operation logs: derivation from an event table, binary and text traces, and what is derived from a log's order.

A log is (seq, op, lba, pba): op 0 reads, 1 writes, 2 deletes; seq is a total order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidData
from ..plans.ordering import running_sum
from ..session import durable

READ, WRITE, DELETE = 0, 1, 2
#: Fixed values of the binary trace: 16-byte records, address then (op << 60) + physical address, little endian.
RECORD, OP_SHIFT = 16, 60
#: Fixed values of the text traces: sectors of 512 bytes, 8 to a page of 4096.
SECTORS_PER_PAGE, PAGE_BYTES = 8, 4096


def from_events(events: DataFrame) -> DataFrame:
    """The log of an event stream: views and clicks read, sign-ups and purchases write, errors delete."""
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(F.col("event_type").isin("view", "click"), READ).when(F.col("event_type").isin("signup", "purchase"), WRITE).otherwise(DELETE)
    return events.select(F.col("event_id").alias("seq"), op.cast("int").alias("op"), (F.col("user_id") * 100 + k).alias("lba"), (F.col("event_id") + 1).alias("pba"))


def _open(path: str):
    """A store and a path in it, for a URI as Spark writes it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else os.path.abspath(path))


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Addresses, operations and physical addresses of whole records."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, 2)
    if len(words) and words[:, 0].max() >= 1 << 63:
        raise InvalidData("an address of 2**63 or more")
    low = words[:, 1] & np.uint64((1 << OP_SHIFT) - 1)
    return words[:, 0].astype(np.int64), (words[:, 1] >> np.uint64(OP_SHIFT)).astype(np.int32), low.astype(np.int64)


def read_binary_split(spark: SparkSession, path: str, delete_pba: int = (1 << OP_SHIFT) - 1, records: int = 1 << 22) -> DataFrame:
    """read_binary() for traces of any size: tasks read stretches of so many records of the files, which pyarrow must be
    able to reach. Files are taken in the order of their names."""
    files = spark.read.format("binaryFile").load(path).select("path", F.expr(f"length div {RECORD}").alias("n"))
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("before", F.coalesce(before, F.lit(0)).cast("long")).where("n > 0")
    parts = files.select("path", "n", "before", F.explode(F.expr(f"sequence(0L, n - 1, {records}L)")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, start, at in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = _open(name)
                with store.open_input_file(place) as file:
                    end = min(n, at + records)
                    while at < end:
                        k = min(end - at, 1 << 16)
                        data = file.read_at(k * RECORD, at * RECORD)
                        yield pa.RecordBatch.from_arrays([pa.array(start + at + np.arange(k)), *map(pa.array, _decoded(data))], ["seq", "lba", "op", "pba"])
                        at += k

    rows = parts.repartition(max(1, parts.count())).mapInArrow(run, "seq long, lba long, op int, pba long")
    gone = (F.col("op") == WRITE) & (F.col("pba") == delete_pba)
    return rows.select("seq", F.when(gone, DELETE).otherwise(F.col("op")).alias("op"), "lba", F.when(~gone, F.col("pba")).alias("pba"))


def write_binary_parts(log: DataFrame, folder: str, parts: int, delete_pba: int = (1 << OP_SHIFT) - 1) -> DataFrame:
    """A trace as so many files under a folder, in the order of seq by their names, written by the tasks; one row per file:
    name, records and max_lba. Files that a lost task left are deleted."""
    is_delete = F.col("op") == DELETE
    word = F.when(is_delete, F.lit(delete_pba)).otherwise(F.coalesce("pba", F.lit(0)))
    rows = log.select("seq", "lba", F.when(is_delete, WRITE).otherwise(F.col("op")).alias("op"), word.alias("pba"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, n, top = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, -1
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                lba, op, pba = (batch.column(k).to_numpy() for k in (1, 2, 3))
                out.write(np.stack([lba.astype("<u8"), (op.astype("<u8") << np.uint64(OP_SHIFT)) + pba.astype("<u8")], axis=1).tobytes())
                n, top = n + len(lba), max(top, int(lba.max(initial=-1)))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([top])], ["name", "records", "max_lba"])

    done = durable(rows.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(run, "name string, records long, max_lba long"))
    store, root = _open(folder)
    kept = {r.name for r in done.select("name").collect()}  # a row per file
    for info in store.get_file_info(FileSelector(root)):
        if info.base_name.startswith("part-") and info.base_name not in kept:
            store.delete_file(info.path)
    return done


def read_binary(spark: SparkSession, path: str, delete_pba: int = (1 << OP_SHIFT) - 1) -> DataFrame:
    """Records of a binary trace in file order. A short tail ends the log; a write of `delete_pba` is a delete.

    Words are unsigned: an address of 2**63 or more is refused. A file is one task, and is read by Spark, from any store;
    read_binary_split() reads files in parts.
    """

    def word(at: int):
        return F.concat(*[F.substring("body", k, 1) for k in range(at + 8, at, -1)])

    size = F.expr(f"cast(floor(length(content) / {RECORD}) as int)")
    files = spark.read.format("binaryFile").load(path).select("path", "content", size.alias("n"))
    rows = files.where("n > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    rows = rows.select("path", "at", F.expr(f"substring(content, at * {RECORD} + 1, {RECORD})").alias("body"))
    number = lambda x: F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")
    rows = rows.select("path", "at", number(word(0)).cast("long").alias("lba"), F.conv(F.substring(F.hex(word(8)), 1, 1), 16, 10).cast("int").alias("op"), F.conv(F.substring(F.hex(word(8)), 2, 15), 16, 10).cast("long").alias("pba"))
    # Files in the order of their names: each file's offset is the sum of the records before, one row per file.
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    rows = rows.join(offsets, "path").withColumn("seq", F.col("_before") + F.col("at"))
    gone = (F.col("op") == WRITE) & (F.col("pba") == delete_pba)
    return rows.select("seq", F.when(gone, DELETE).otherwise(F.col("op")).alias("op"), "lba", F.when(~gone, F.col("pba")).alias("pba"))


def write_binary(log: DataFrame, path: str, delete_pba: int = (1 << OP_SHIFT) - 1) -> dict:
    """One local trace file and its {max_lba} note, streamed through the driver in the order of seq."""
    top = -1
    with open(path, "wb") as out:
        for r in log.orderBy("seq").toLocalIterator():
            pba = delete_pba if r.op == DELETE else r.pba or 0
            op = WRITE if r.op == DELETE else r.op
            out.write(struct.pack("<QQ", r.lba, (op << OP_SHIFT) + pba))
            top = max(top, r.lba)
    note = {"max_lba": top}
    with open(f"{path}.json", "w") as out:
        json.dump(note, out)
    return note


def parse_blank_separated(lines: DataFrame) -> DataFrame:
    """Rows of value such as `time type sector`; types R, W, RS, WS in either case; other lines are skipped. op, lba."""
    part = F.split(F.trim("value"), r"\s+")
    kind = F.lower(F.try_element_at(part, F.lit(2)))
    op = F.when(kind.isin("r", "rs"), READ).when(kind.isin("w", "ws"), WRITE)
    sector = F.try_element_at(part, F.lit(3)).try_cast("long")
    df = lines.withColumns({"op": op, "_s": sector}).withColumn("lba", F.expr(f"_s div {SECTORS_PER_PAGE}"))
    return df.where("op IS NOT NULL AND lba >= 0").drop("_s")


def parse_csv(lines: DataFrame) -> DataFrame:
    """Rows of value with five or more comma-separated fields, operation in the fourth and byte offset in the fifth."""
    part = F.split("value", ",")
    kind = F.lower(F.trim(F.try_element_at(part, F.lit(4))))
    op = F.when(F.contains(kind, F.lit("read")) | (kind == "r"), READ).when(F.contains(kind, F.lit("write")) | (kind == "w"), WRITE)
    df = lines.where(F.size(part) >= 5).withColumn("_b", F.trim(F.try_element_at(part, F.lit(5))).try_cast("long")).withColumn("op", op)
    return df.withColumn("lba", F.expr(f"_b div {PAGE_BYTES}")).where("op IS NOT NULL AND lba >= 0").drop("_b")


def assign_pba(log: DataFrame) -> DataFrame:
    """seq, lba and pba of the writes: a counter over them from 2."""
    writes = log.where(F.col("op") == WRITE).select("seq", "lba")
    return running_sum(writes, F.lit(1), ["seq"], "pba").withColumn("pba", F.col("pba") + 1)


def read_your_writes(log: DataFrame) -> DataFrame:
    """seq, lba and pba of the reads: the latest write before, 0 after a delete and where there is none."""
    before = Window.partitionBy("lba").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col("op") == WRITE, F.col("pba")).when(F.col("op") == DELETE, F.lit(0))
    df = log.withColumn("_last", F.last(value, ignorenulls=True).over(before)).where(F.col("op") == READ)
    return df.select("seq", "lba", F.coalesce("_last", F.lit(0)).alias("pba"))


def first_records(log: DataFrame, n: int) -> DataFrame:
    """The first n records in order."""
    return log.orderBy("seq").limit(n)


def read_bench_json(spark: SparkSession, path: str) -> DataFrame:
    """Finished benchmarks of a line-wise JSON report: reason, id and value; metrics of their own count too, other and
    broken lines are skipped."""
    schema = "reason string, id string, typical struct<estimate:double>, value double"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    value = F.when(F.col("reason") == "benchmark-complete", F.col("typical.estimate")).otherwise(F.col("value"))
    return rows.where(F.col("reason").isin("benchmark-complete", "custom-metric")).select("reason", "id", value.alias("value"))
