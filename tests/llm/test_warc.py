import hashlib
import random

import duckdb
import pandas as pd
import pyarrow as pa

from plumbline.llm import warc
from plumbline.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, refers_to string"


def rows():
    rng = random.Random(5)
    big = "".join(rng.choice("abcé\r\n<>") for _ in range(400_000))
    shared = "<p>" + "ä" * 80
    base = [(1, "http://a/ b\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", shared), (7, "u", shared), (0, "u", shared), (8, "u", big), (9, "u", "\r\n\r\n" * 40), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100)]
    return [(*r, "c", "c") for r in base + [(20 + k, "u", "".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))) for k in range(60)]]


def archived(spark, pages, archive_bytes=50_000):
    folder = scratch_path(spark, "warc-test")
    return warc.write_archives(warc.with_targets(pages), folder, archive_bytes), folder


def test_round_trip_equals_sql(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    archives, folder = archived(spark, pages)
    assert archives.count() > 3
    got = warc.record_table(warc.read_archives(archives, folder, 1000)).toPandas()
    table = pa.Table.from_pylist([{"page_id": r[0], "html": r[2]} for r in rows()])
    con = duckdb.connect()
    con.register("pages", table)
    want = con.execute(warc.SQL).df()
    key = lambda df: sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in df.astype(object).itertuples())
    assert key(got) == key(want)


def test_chunks_carry_the_digest_so_far(spark):
    pages = spark.createDataFrame(rows()[:1], SCHEMA)
    archives, folder = archived(spark, pages)
    chunks = warc.read_archives(archives, folder, 1 << 16).orderBy("chunk").collect()
    payload, seen = rows()[0][2].encode(), b""
    assert len(chunks) > 5
    for k, c in enumerate(chunks):
        assert (c.chunk, c.offset, c.n) == (k, len(seen), len(c.payload)) and c.n <= 1 << 16
        seen += bytes(c.payload)
        assert c.digest == hashlib.sha256(seen).hexdigest() and c.last == (k == len(chunks) - 1)
    assert seen == payload


def test_repeated_and_null_ids_and_empty_table(spark):
    same = "y" * 200
    pages = spark.createDataFrame([(5, "u", same, "", ""), (5, "u", same, "", ""), (6, "u", same, "", ""), (None, "u", same, "", "")], SCHEMA)
    archives, folder = archived(spark, pages)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to) for r in warc.record_table(warc.read_archives(archives, folder)).collect())
    assert got == [("5", "response", 200, None), ("5", "response", 200, None), ("6", "revisit", 200, 5), ("None", "revisit", 200, 5)]
    archives, folder = archived(spark, pages.limit(0))
    assert warc.record_table(warc.read_archives(archives, folder)).count() == 0
