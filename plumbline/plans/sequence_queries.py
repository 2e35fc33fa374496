"""Queries of the sequence codec, the bit functions and the monotone sets, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bit_width, byte_key, unzigzag, zigzag
from ..operators import monotone_set as E
from ..operators import sequence_codec as C
from ..operators.trace_analytics import patched_width
from ..session import shared_dir, table
from . import map_queries
from .ordering import positions, running_sum

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ascending sequence: running lengths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    summed = running_sum(docs, F.coalesce("n_chars", F.lit(0)), ["doc_id"], "value")
    return positions(summed, ["doc_id"]).select("pos", "value")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence without order: cents of the line items."""
    items = table(spark, sf_dir, "lineitem").select(*_ORDER)
    return positions(items, _ORDER).select("pos", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))


def pc_block_line(spark, sf_dir):
    return C.block_lines(prices(spark, sf_dir))


def pc_residuals(spark, sf_dir):
    return C.residuals(prices(spark, sf_dir)).select("block_id", "pos", "code")


def pc_width_choice(spark, sf_dir):
    return C.width_choice(C.residuals(prices(spark, sf_dir)))


def pc_exceptions(spark, sf_dir):
    codes = C.residuals(prices(spark, sf_dir))
    wide = codes.join(C.width_choice(codes).select("block_id", "width"), "block_id").where(bit_width(F.col("code")) > F.col("width"))
    return C.running_rank(wide).select("block_id", "pos", "code", F.col("rank").cast("long").alias("rank"))


def pc_roundtrip(spark, sf_dir):
    return C.decode(C.encode(prices(spark, sf_dir)))


def pc_roundtrip_offsets(spark, sf_dir):
    return C.decode(C.encode(offsets(spark, sf_dir)))


def pc_get(spark, sf_dir):
    """Every position, and some beyond the end."""
    seq = offsets(spark, sf_dir)
    n = seq.count()
    return C.get(C.encode(seq), spark.range(0, n + 300).select(F.col("id").alias("pos")))


def pc_range(spark, sf_dir):
    """A range of a stored sequence."""
    path = f"{shared_dir(spark)}/sequence-{uuid.uuid4().hex}"
    C.store(C.encode(prices(spark, sf_dir)), path)
    return C.scan(C.stored(spark, path), 1000, 1500)


def pc_reverse(spark, sf_dir):
    return C.scan_reverse(C.encode(offsets(spark, sf_dir)), -5, 1 << 40)


def pc_stats(spark, sf_dir):
    return C.stats(C.encode(prices(spark, sf_dir)))


def pc_size(spark, sf_dir):
    return C.size(C.encode(prices(spark, sf_dir)))


def pfor_width_search(spark, sf_dir):
    return patched_width(C.residuals(prices(spark, sf_dir)))


def _steps(spark, sf_dir):
    from pyspark.sql import Window

    step = F.col("value") - F.lag("value").over(Window.partitionBy(F.expr("pos div 4096")).orderBy("pos"))
    return prices(spark, sf_dir).withColumn("step", step).where("step IS NOT NULL")


def zigzag_codes(spark, sf_dir):
    code = zigzag(F.col("step"))
    return _steps(spark, sf_dir).select("pos", "step", code.alias("code"), unzigzag(code).alias("back"))


def bit_widths(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy(bit_width(zigzag(F.col("step"))).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def byte_key_u64(spark, sf_dir):
    """Customers' names as unsigned 64-bit keys, in halves of 32 bits."""
    key = byte_key(F.col("c_name"))
    low = F.pmod(key, F.lit(1 << 32).cast("decimal(20,0)"))
    high = ((key - low) / F.lit(1 << 32)).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", high.alias("high"), low.cast("long").alias("low"))


def _sets(spark, sf_dir):
    return map_queries.live(spark, sf_dir).select("grp", (F.col("lba") % 4096).alias("value"))


def ef_size(spark, sf_dir):
    return E.sizes(_sets(spark, sf_dir))


def ef_select(spark, sf_dir):
    wanted = spark.range(0, 5000).select(F.col("id").alias("idx"))
    groups = _sets(spark, sf_dir).select("grp").distinct()
    return E.select(_sets(spark, sf_dir), groups.crossJoin(F.broadcast(wanted)))


def ef_predecessor(spark, sf_dir):
    reads = map_queries.log(spark, sf_dir).where("op = 0").select(F.floor(F.col("lba") / 4096).cast("long").alias("grp"), (F.col("lba") % 4096).alias("target"))
    return E.predecessor(_sets(spark, sf_dir), reads)


def ef_roundtrip(spark, sf_dir):
    """The sets as Elias-Fano bytes, and back."""
    return E.decode_sets(E.encode_sets(_sets(spark, sf_dir)))


def ef_bytes(spark, sf_dir):
    """The bytes that the sets take, by encoding them."""
    return E.encode_sets(_sets(spark, sf_dir)).select("grp", "n", F.length("data").cast("long").alias("bytes"))


def ef_iter(spark, sf_dir):
    return E.iterate(_sets(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    pc_block_line, pc_residuals, pc_width_choice, pc_exceptions, pc_roundtrip, pc_roundtrip_offsets, pc_get, pc_range, pc_reverse, pc_stats, pc_size,
    pfor_width_search, byte_key_u64, ef_size, ef_select, ef_predecessor, ef_iter, ef_roundtrip, ef_bytes,
)} | {"zigzag": zigzag_codes, "bit_width": bit_widths}

_OFFSETS = "seq AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id) AS BIGINT) AS value FROM documents)"
_PRICES = f"seq AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS pos, CAST(round(l_extendedprice * 100) AS BIGINT) AS value FROM lineitem)"
_WIDTH = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"
_CODES = f"""{_PRICES}, lines AS (
  SELECT pos // 128 AS block_id, count(*) AS n, arg_min(value, pos) AS first, arg_max(value, pos) AS last FROM seq GROUP BY 1),
fit AS (SELECT block_id, n, first, (greatest(last - first, 0) * 65536) // greatest(n - 1, 1) AS slope FROM lines),
d AS (SELECT fit.block_id, pos, n, value - first - (((pos % 128) * slope) >> 16) AS diff FROM seq JOIN fit ON pos // 128 = fit.block_id),
codes AS (SELECT block_id, pos, n, CASE WHEN diff >= 0 THEN 2 * diff ELSE -2 * diff - 1 END AS code FROM d),
wide AS (SELECT *, {_WIDTH.format('code')} AS w FROM codes)"""
_CHOICE = f"""{_CODES}, cost AS (
  SELECT block_id, k.width, count(*) * k.width + 128 * count(*) FILTER (w > k.width) AS cost
  FROM wide CROSS JOIN (SELECT unnest(range(0, 65)) AS width) k GROUP BY block_id, k.width),
choice AS (SELECT block_id, width, cost FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY cost, width) AS r FROM cost) WHERE r = 1)"""
_SETS = f"{map_queries._LIVE}, sets AS (SELECT grp, lba % 4096 AS value, row_number() OVER (PARTITION BY grp ORDER BY lba) - 1 AS idx FROM live)"
_BLOCKS = f"""{_CHOICE}, blocks AS (
  SELECT wide.block_id, any_value(choice.width) AS width, count(*) AS n, count(*) FILTER (w > choice.width) AS ex FROM wide JOIN choice ON wide.block_id = choice.block_id GROUP BY 1)"""

SQL = {
    "pc_block_line": f"WITH {_CODES} SELECT block_id, n, first, slope FROM fit",
    "pc_residuals": f"WITH {_CODES} SELECT block_id, pos, code FROM codes",
    "pc_width_choice": f"WITH {_CHOICE} SELECT block_id, width, cost FROM choice",
    "pc_exceptions": f"""WITH {_CHOICE} SELECT wide.block_id, pos, code, row_number() OVER (PARTITION BY wide.block_id ORDER BY pos) - 1 AS rank
        FROM wide JOIN choice ON wide.block_id = choice.block_id WHERE w > width""",
    "pc_roundtrip": f"WITH {_PRICES} SELECT pos, value FROM seq",
    "pc_roundtrip_offsets": f"WITH {_OFFSETS} SELECT pos, value FROM seq",
    "pc_get": f"WITH {_OFFSETS} SELECT p.pos, value FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents) + 300)) AS pos) p LEFT JOIN seq ON p.pos = seq.pos",
    "pc_range": f"WITH {_PRICES} SELECT pos, value FROM seq WHERE pos >= 1000 AND pos < 1500",
    "pc_reverse": f"WITH {_OFFSETS} SELECT pos, value FROM seq ORDER BY pos DESC",
    "pc_stats": f"""WITH {_BLOCKS} SELECT width, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ex) AS BIGINT) AS exceptions,
        count(*) FILTER (ex > 0) AS with_exceptions FROM blocks GROUP BY width""",
    "pc_size": f"""WITH {_BLOCKS} SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks,
        CAST(24 + 26 * count(*) + 8 * ((sum(n * width) + 63) // 64 + sum(ex) + (sum(n) + 63) // 64) AS BIGINT) AS dump_bytes FROM blocks""",
    "pfor_width_search": f"""WITH {_CODES}, f AS (SELECT block_id, max(w) AS f FROM wide GROUP BY 1),
        cost AS (SELECT wide.block_id, k.width, count(*) * k.width + 72 * count(*) FILTER (w > k.width) AS bits, count(*) * any_value(f) AS plain_bits
                 FROM wide JOIN f ON wide.block_id = f.block_id JOIN (SELECT unnest(range(0, 65)) AS width) k ON k.width <= f GROUP BY 1, 2)
        SELECT block_id, width, bits, plain_bits FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY bits, width) AS r FROM cost) WHERE r = 1""",
    "zigzag": f"""WITH {_PRICES}, s AS (SELECT pos, value - lag(value) OVER (PARTITION BY pos // 4096 ORDER BY pos) AS step FROM seq)
        SELECT pos, step, CASE WHEN step >= 0 THEN 2 * step ELSE -2 * step - 1 END AS code, step AS back FROM s WHERE step IS NOT NULL""",
    "bit_width": f"""WITH {_PRICES}, s AS (SELECT pos, value - lag(value) OVER (PARTITION BY pos // 4096 ORDER BY pos) AS step FROM seq),
        c AS (SELECT CASE WHEN step >= 0 THEN 2 * step ELSE -2 * step - 1 END AS code FROM s WHERE step IS NOT NULL)
        SELECT {_WIDTH.format('code')} AS width, count(*) AS n FROM c GROUP BY 1""",
    "byte_key_u64": """SELECT c_custkey, CAST('0x' || hex(substr(c_name || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0), 1, 4)) AS BIGINT) AS high,
        CAST('0x' || hex(substr(c_name || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0), 5, 4)) AS BIGINT) AS low FROM customer""",
    "ef_size": f"""WITH {_SETS}, g AS (SELECT grp, count(*) AS n FROM sets GROUP BY grp),
        l AS (SELECT grp, n, CASE WHEN 4096 > n THEN CAST(floor(log2(4096 // n)) AS BIGINT) ELSE 0 END AS low FROM g)
        SELECT grp, n, 3 + (n + (4096 >> CAST(low AS INTEGER)) + 1 + 7) // 8 + (n * low + 7) // 8 + 4 * ((n + 63) // 64) AS bytes FROM l""",
    "ef_select": f"""WITH {_SETS}, g AS (SELECT DISTINCT grp FROM sets), w AS (SELECT grp, i.idx FROM g CROSS JOIN (SELECT unnest(range(0, 5000)) AS idx) i)
        SELECT w.grp, w.idx, value FROM w LEFT JOIN sets ON w.grp = sets.grp AND w.idx = sets.idx""",
    "ef_predecessor": f"""WITH {_SETS}, t AS (SELECT DISTINCT lba // 4096 AS grp, lba % 4096 AS target FROM trace WHERE op = 0)
        SELECT t.grp, t.target, max(sets.idx) AS idx, max(sets.value) AS value FROM t LEFT JOIN sets ON t.grp = sets.grp AND sets.value <= t.target GROUP BY t.grp, t.target""",
    "ef_iter": f"WITH {_SETS} SELECT grp, idx, value FROM sets",
}
SQL |= {"ef_roundtrip": SQL["ef_iter"], "ef_bytes": SQL["ef_size"]}
