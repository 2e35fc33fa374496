"""Exact duplicates by deterministic block naming (DataFrame operations only).

The normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered, so each
block becomes an integer that stands for exactly its bytes. Then adjacent names are paired and the distinct pairs are
numbered again, until one name is left for each document. Two documents are equal if and only if they have as many
blocks and the same last name; no hash decides it.

A block's bytes cross the network once, to be numbered, and are combined on the map side before, so that a block that
a third of all rows share costs one row per map task. Occurrences carry two 64-bit fingerprints of their block instead.
They only route: where two different blocks share both, occurrences carry their bytes and are joined by these.

Defined results: null text counts as empty; empty texts are equal to each other; a null or repeated doc_id is a row of
its own, and keep_id is then the smallest doc_id among the longest rows, nulls last; of repeated rows that agree in doc_id
and length, the one with the smallest hash of its original text stays, and of copies of one row any one. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, mark, marked, one_each

BLOCK_BYTES = 4096


def _texts(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.length(raw).cast("long").alias("points"),
        mark().alias("mark"),
        F.regexp_replace(raw, f"{SPACE}+", "").cast("binary").alias("bytes"),
    )


def _cut(df: DataFrame, size: int) -> DataFrame:
    """A row per block. The sequence is exploded first, so that a block is one slice of the bytes made once."""
    last = F.expr(f"greatest(0L, (length(bytes) - 1L) div {size}L)")
    at = df.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("at"))
    return at.withColumn("block", F.expr(f"substring(bytes, cast(at * {size} + 1 as int), {size})"))


def _marks() -> list:
    return [F.xxhash64("block").alias("f"), F.xxhash64(F.lit(7), F.col("block")).alias("g")]


def _name_blocks(docs: DataFrame, size: int) -> DataFrame:
    """A row per distinct block: fingerprints f and g, its integer name, and the bytes where f and g are ambiguous."""
    distinct = _cut(_texts(docs), size).select(*_marks(), "block").distinct()
    # Sorted within its partition, the number a block gets depends on the distinct blocks alone.
    named = distinct.sortWithinPartitions("block").select("f", "g", "block", F.monotonically_increasing_id().alias("name"))
    return named


def _next_level(level: DataFrame) -> DataFrame:
    """Name the pairs of adjacent names; rows are (row, blocks, at, name) and a missing right half is -1."""
    pairs = level.groupBy("row", "blocks", F.expr("at div 2").alias("at")).agg(
        F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
    )
    pairs = durable(pairs)
    named = (
        pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        .select("a", "b", F.monotonically_increasing_id().alias("name"))
    )
    return durable(pairs.join(named, ["a", "b"]).select("row", "blocks", "at", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per input row: row, doc_id, points and mark (code points and hash of the text), text_sha256, blocks and name.

    Rows are equal texts if and only if blocks and name are equal.
    """
    texts = _texts(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "points", "mark", F.sha2("bytes", 256).alias("text_sha256"), "bytes"
    )

    def occurrences(*more: str) -> DataFrame:
        # The row numbers are made in this one pass, and the checkpoint keeps them whatever is computed again later.
        once = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "points", "mark", "text_sha256")]
        return durable(_cut(texts, block_bytes).select("row", (F.col("last") + 1).alias("blocks"), "at", *_marks(), *once, *more))

    kept = occurrences()
    # Ambiguous fingerprints are all but impossible; they are looked for all the same and told apart by the bytes.
    named = durable(_name_blocks(docs, block_bytes).drop("block"))
    if named.groupBy("f", "g").count().where("count > 1").isEmpty():
        level = kept.join(named, ["f", "g"])
    else:
        kept = occurrences("block")
        level = kept.join(durable(_name_blocks(docs, block_bytes).select("block", "name")), "block")
    level = durable(level.select("row", "blocks", "at", "name"))
    done = [level.where("blocks = 1").select("row", "name")]
    most = kept.where("at = 0").agg(F.max("blocks")).first()[0] or 1
    alive, width = level.where("blocks > 1"), 1
    while width < most:
        width *= 2
        # A document is done at the first level where one name is left, that is where blocks <= width.
        alive = _next_level(alive)
        done.append(alive.where(f"blocks <= {width}").select("row", "name"))
        alive = alive.where(f"blocks > {width}")
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return kept.where("at = 0").select("row", "doc_id", "points", "mark", "text_sha256", "blocks").join(names, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id.
    """
    rows = durable(identities(docs, block_bytes))
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"), F.col("row"))
    groups = rows.groupBy("blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.min_by(F.struct("row", "doc_id"), order).alias("stays")
    )
    # Written first, so that both sides of the join are plain exchanges and a hot group can be split at run time.
    return rows.join(durable(groups), ["blocks", "name"]).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256", "mark",
    )


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with one row of each group of equal texts, in the columns of the input."""
    rows = exact_duplicates(docs, block_bytes).where("group_size > 1")
    # By doc_id and original text, how many rows there are and whether one of them stays.
    several = durable(rows.groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))
    docs, name = marked(docs)
    return one_each(docs, name, several.where("NOT kept").select("doc_id", "mark"), several.where("kept AND rows > 1").select("doc_id", "mark"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(raw) DESC, doc_id) AS keep_id FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
