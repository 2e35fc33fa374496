"""The address map over a stream of operations, as a table merged per micro-batch or as keyed state.

Order is that of seq, not of arrival: state keeps each address's last seq, deletes included, and an older operation
never overwrites a newer one. So micro-batches may be replayed and come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.address_map import group_of, last_operations
from ..options import MapOptions

#: New rows of a bucket that a task takes, about.
PART_ROWS = 1_000_000

STATE = "lba long, seq long, pba long, grp long"


class MergedTable:
    """A table of (lba, seq, pba, grp) under a folder, in buckets of groups: a micro-batch rewrites the buckets it touches.

    data/batch=N holds the buckets that batch N wrote; list/batch=N says, for every bucket, which batch wrote it last. The
    list is written after the data and counts once it is complete, so a batch that fails or is repeated leaves the last
    good state. Files that neither of the two newest lists names are deleted.
    """

    def __init__(self, spark, path: str, options: MapOptions = MapOptions(), buckets: int = 64):
        self.spark, self.path, self.options, self.buckets = spark, path.rstrip("/"), options, buckets
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, kind: str) -> list[int]:
        folder = self._place(f"{self.path}/{kind}")
        if not self._store.exists(folder):
            return []
        names = [s.getPath() for s in self._store.listStatus(folder)]
        done = [p for p in names if self._store.exists(self._place(f"{p.toString()}/_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _listed(self, batch: int) -> dict[int, int]:
        """Bucket to batch: at most `buckets` rows."""
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.path}/list/batch={batch}").collect()
        return {r.bucket: r.written for r in rows}

    def _read(self, where: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*paths)

    def state(self) -> DataFrame:
        """lba, pba and grp of the live entries."""
        lists = self._batches("list")
        df = self._read(self._listed(lists[-1]) if lists else {})
        return df.where("pba IS NOT NULL").select("lba", "pba", "grp")

    def merge_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. The touched buckets' old rows and the batch, reduced per address, meet in one aggregation."""
        lists = [v for v in self._batches("list") if v < batch_id]
        known = self._listed(lists[-1]) if lists else {}
        new = last_operations(batch, self.options).withColumn("grp", group_of(F.col("lba"), self.options)).persist()
        try:
            bucket = F.pmod("grp", F.lit(self.buckets)).cast("int").alias("bucket")
            touched = {r.bucket: r.n for r in new.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}
            old = self._read({k: v for k, v in known.items() if k in touched})
            both = new.select("lba", "seq", "pba", "grp").unionByName(old).withColumn("bucket", bucket)
            # Rows are dealt by bucket, so that a task writes whole files, and a bucket with many new rows to more tasks.
            part = F.pmod(F.xxhash64("lba"), F.lit(1 + max(touched.values(), default=0) // PART_ROWS)).alias("part")
            dealt = both.withColumn("part", part).repartition("bucket", "part")
            last = dealt.groupBy("bucket", "part", "lba", "grp").agg(F.max("seq").alias("seq"), F.max_by(F.struct("pba"), "seq").alias("v"))
            out = last.select("lba", "seq", F.col("v.pba").alias("pba"), "grp", "bucket")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        finally:
            new.unpersist()
        where = known | dict.fromkeys(touched, batch_id)
        listed = self.spark.createDataFrame(sorted(where.items()), "bucket int, written long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/batch={batch_id}")
        self._clean([*lists[-1:], batch_id])

    def _clean(self, lists: list[int]) -> None:
        used = {(k, v) for n in lists for k, v in self._listed(n).items()}
        for batch in self._batches("data"):
            if batch < lists[-1]:
                for bucket in range(self.buckets):
                    if (bucket, batch) not in used:
                        self._store.delete(self._place(f"{self.path}/data/batch={batch}/bucket={bucket}"), True)
        for batch in self._batches("list"):
            if batch < lists[0]:
                self._store.delete(self._place(f"{self.path}/list/batch={batch}"), True)


def merge_stream(log: DataFrame, table: MergedTable, checkpoint: str):
    """Start merging a streaming log into a table; ends when what is there now is read."""
    return log.writeStream.foreachBatch(table.merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastWriter(StatefulProcessor):
    """Keyed state: the last seq and pba of an address."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("seq", LongType()), StructField("pba", LongType())])
        self._last = handle.getValueState("last", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, pba = self._last.get() if self._last.exists() else (-1, None)
        for part in rows:
            best = part.loc[part["seq"].idxmax()]
            if best["seq"] > seq:
                seq, pba = int(best["seq"]), None if pd.isna(best["pba"]) else int(best["pba"])
        self._last.update((seq, pba))
        yield pd.DataFrame({"lba": [key[0]], "seq": [seq], "pba": pd.array([pba], dtype="Int64")})

    def close(self) -> None:
        pass


def keyed_stream(log: DataFrame) -> DataFrame:
    """A streaming log's changes: lba, seq and pba after each micro-batch (update mode). pba of deletes is null."""
    changes = log.where("op <> 0").select("lba", "seq", F.when(F.col("op") == 1, F.col("pba")).alias("pba"))
    return changes.groupBy("lba").transformWithStateInPandas(LastWriter(), outputStructType="lba long, seq long, pba long", outputMode="Update", timeMode="none")
