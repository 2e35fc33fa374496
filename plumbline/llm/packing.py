"""Packing of token sequences by concatenate and cut.

Pass 1 tokenizes every document and writes (part, start in part, ids) to the shared folder; each task carries its own
running sum. The totals of the parts, one number per partition, give each part its global offset by a prefix sum.
Pass 2 adds the offset and cuts the one long sequence into windows of a fixed length. It is a map over the written
table: nothing is shuffled, and a window that crosses partitions has a boundary record on either side.

Ids are those of the tokenizer file, to which none are added: the string of one of its special tokens in a text becomes
that token's id, as it does by default, or is ordinary text with `special` False.

Defined results: null text is empty and gives the closing id alone; repeated and null doc_ids are documents of their
own; an empty table gives no rows; only the last sequence may be shorter than the window. A document longer than a
window gets a piece per window. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import default_path, encoder
from .common import batches_of, columns, trimmed, written

WINDOW, END_ID = 1024, 0

_TOKENS = "part int, start_in_part long, n long, doc_id long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "opens boolean, closes boolean, ids binary"
)


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, special: bool = True) -> DataFrame:
    """A written table of the documents' ids, each with the number of ids before it in its partition.

    Ids are kept in 16 bits where the vocabulary allows it.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(path, special)
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            starts, sizes, ids = [], [], []
            for text in batch.column(1):
                packed = np.frombuffer(enc.ids(text.as_py() or "") + tail, dtype="<u4")
                starts.append(before)
                sizes.append(len(packed))
                ids.append(packed.astype("<u2").tobytes() if packed.max() < 65536 else b"4" + packed.tobytes())
                before += len(packed)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, dtype="i4")), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                 batch.column(0), pa.array(ids, pa.binary())],
                ["part", "start_in_part", "n", "doc_id", "ids"],
            )

    with batches_of(docs.sparkSession, 2000):
        return written(columns(docs, "doc_id", "text").mapInArrow(lambda b: trimmed(run(b)), _TOKENS), "tokens")


def unpacked(ids: bytes) -> np.ndarray:
    """The ids of a row of tokenized(): 16 bits each, or 32 behind a marker byte (the length is then odd)."""
    return np.frombuffer(ids[1:], dtype="<u4") if len(ids) % 2 else np.frombuffer(ids, dtype="<u2").astype("<u4")


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """Ids before each part: the prefix sums of the parts' totals. One number per partition reaches the driver."""
    totals = sorted((r[0], r[1]) for r in tokens.groupBy("part").agg(F.sum("n")).collect())
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part] = total
        total += n
    return offsets


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = True, special: bool = True) -> DataFrame:
    """A row per piece of a document in a sequence; opens and closes mark the first and last piece of its document."""
    tokens = tokenized(docs, tokenizer, special=special)
    offsets = part_offsets(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, start, n, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                packed, at = unpacked(ids), offsets[part] + start
                cuts = [0, *range(window - at % window, n, window), n]
                for a, b in zip(cuts, cuts[1:]):
                    piece = packed[a:b].tobytes()
                    rows.append((doc, a, b - a, zlib.crc32(piece), n, (at + a) // window, (at + a) % window, a == 0, b == n, piece if with_ids else None))
            names = [x.split()[0] for x in _PIECES.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
            for k in range(0, len(rows), 10_000):
                some = list(zip(*rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], names)

    return tokens.mapInArrow(lambda b: trimmed(run(b)), _PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
