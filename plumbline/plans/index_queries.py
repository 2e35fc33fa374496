"""Queries of the position index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import byte_key
from ..operators import position_index as P
from ..options import IndexOptions
from ..session import table


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly ascending keys: event times in microseconds."""
    return table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("key"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with repeats: line items by order and line number."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))


def _probes(spark, sf_dir):
    """Line keys, some present and some not: one for each order."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8 + F.col("o_orderkey") % 9).alias("key"))


def _digest(column: str):
    """The first 16 hexadecimal digits of a hash: spread over all unsigned 64-bit numbers."""
    return F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 16)


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned keys over the whole domain: hashes of the orders' keys."""
    return table(spark, sf_dir, "orders").select(F.conv(_digest("o_orderkey"), 16, 10).cast("decimal(20,0)").alias("key"))


def pgm_positions(spark, sf_dir):
    return P.build(times(spark, sf_dir)).data


def pgm_lookup(spark, sf_dir):
    return P.build(lines(spark, sf_dir)).lookup(_probes(spark, sf_dir))


def pgm_lookup_miss(spark, sf_dir):
    return P.build(lines(spark, sf_dir)).misses(_probes(spark, sf_dir))


def pgm_lower_bound(spark, sf_dir):
    return P.build(lines(spark, sf_dir), options=IndexOptions(16)).lower_bound(_probes(spark, sf_dir))


def pgm_batch(spark, sf_dir):
    """A probe per row id, in order, with its position."""
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") * 8 + 1).alias("key"))
    return P.build(lines(spark, sf_dir)).lookup(probes).select("row", "key", "pos")


def pgm_count_hits(spark, sf_dir):
    return P.build(lines(spark, sf_dir)).count_hits(_probes(spark, sf_dir))


def pgm_error_audit(spark, sf_dir):
    keys = P.positioned(times(spark, sf_dir))
    audit = [P.fitted(keys, IndexOptions(e)).audit().select(F.lit(e).alias("epsilon"), "keys", "violations") for e in (4, 32, 128)]
    return audit[0].unionByName(audit[1]).unionByName(audit[2])


def pgm_range_invariants(spark, sf_dir):
    """Windows that are misordered, longer than 2 epsilon + 1 or miss their key's position: none."""
    index = P.build(times(spark, sf_dir), options=IndexOptions(16))
    seen = index.predict(index.data)
    n = lambda c: F.count_if(c)
    return seen.agg(F.count(F.lit(1)).alias("keys"), n(F.col("lo") > F.col("hi")).alias("misordered"), n(F.col("hi") - F.col("lo") > 33).alias("too_long"), n((F.col("pos") < F.col("lo")) | (F.col("pos") >= F.col("hi"))).alias("missed"))


def pgm_stats_invariants(spark, sf_dir):
    """Length and segments of consecutive orders: one greedy pass over an unbroken line makes one segment."""
    index = P.build(orders(spark, sf_dir), options=IndexOptions(32, exact=True))
    return index.stats().select("len", "segments", "avg_segment_size", "index_bytes", "total_bytes")


def pgm_segment_for_index(spark, sf_dir):
    """Positions of all and beyond: each has one segment that holds it, those beyond have none."""
    index = P.build(times(spark, sf_dir), options=IndexOptions(8))
    asked = spark.range(0, index.data.count() + 10).select(F.col("id").alias("pos"))
    return asked.join(index.segment_of(asked).groupBy("pos").agg(F.count(F.lit(1)).alias("n")), "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))


def pgm_lower_bound_u64(spark, sf_dir):
    """Unsigned keys of the whole domain, probed by hashes of the customers' keys."""
    probes = table(spark, sf_dir, "customer").select("c_custkey", F.conv(_digest("c_custkey"), 16, 10).cast("decimal(20,0)").alias("key"))
    return P.build(digests(spark, sf_dir), options=IndexOptions(16)).lower_bound(probes).select("c_custkey", "lower")


def pgm_lookup_u64(spark, sf_dir):
    """Unsigned keys: the orders with the customers' numbers are there."""
    probes = table(spark, sf_dir, "customer").select("c_custkey", F.conv(_digest("c_custkey"), 16, 10).cast("decimal(20,0)").alias("key"))
    return P.build(digests(spark, sf_dir)).lookup(probes).select("c_custkey", "pos")


def pgm_lower_bound_bytes(spark, sf_dir):
    """Byte keys, of which the first 8 count: the customers' hashes as texts among those of the orders."""
    keys = table(spark, sf_dir, "orders").select(byte_key(_digest("o_orderkey")).alias("key"))
    probes = table(spark, sf_dir, "customer").select("c_custkey", _digest("c_custkey").alias("name"))
    return P.build(keys, options=IndexOptions(8)).lower_bound_bytes(probes, "name").select("c_custkey", "lower")


def pgm_audit_errors(spark, sf_dir):
    """Largest and mean error of the predictions, for each epsilon."""
    keys = P.positioned(times(spark, sf_dir))
    audit = [P.fitted(keys, IndexOptions(e)).audit().select(F.lit(e).alias("epsilon"), "max_error", "avg_error") for e in (4, 32, 128)]
    return audit[0].unionByName(audit[1]).unionByName(audit[2])


def pgm_segments(spark, sf_dir):
    return P.build(times(spark, sf_dir), options=IndexOptions(8)).segments


QUERIES = {f.__name__: f for f in (
    pgm_positions, pgm_lookup, pgm_lookup_miss, pgm_lower_bound, pgm_batch, pgm_count_hits, pgm_error_audit, pgm_range_invariants, pgm_stats_invariants,
    pgm_segment_for_index, pgm_segments, pgm_lower_bound_u64, pgm_lookup_u64, pgm_lower_bound_bytes, pgm_audit_errors,
)}

_LINES = "data AS (SELECT l_orderkey * 8 + l_linenumber AS key, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS pos FROM lineitem)"
_ASKED = "asked AS (SELECT o_orderkey * 8 + o_orderkey % 9 AS key FROM orders)"
_U64 = """k AS (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS UBIGINT) AS key FROM orders),
    p AS (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) AS key FROM customer)"""
_FIRST = f"{_LINES}, firsts AS (SELECT key, min(pos) AS pos FROM data GROUP BY key)"

SQL = {
    "pgm_positions": "SELECT epoch_us(ts) AS key, row_number() OVER (ORDER BY ts) - 1 AS pos FROM events",
    "pgm_lookup": f"WITH {_FIRST}, {_ASKED} SELECT asked.key, pos FROM asked LEFT JOIN firsts ON asked.key = firsts.key",
    "pgm_lookup_miss": f"WITH {_LINES}, {_ASKED} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM data)",
    "pgm_lower_bound": f"""WITH {_LINES}, {_ASKED}, both_ AS (SELECT key, 1 AS asked FROM asked UNION ALL SELECT key, 0 AS asked FROM data),
        n AS (SELECT key, asked, coalesce(sum(1 - asked) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM both_)
        SELECT key, CAST(below AS BIGINT) AS lower FROM n WHERE asked = 1""",
    "pgm_lower_bound_u64": f"""WITH {_U64}, both_ AS (SELECT key, NULL AS c_custkey, 0 AS asked FROM k UNION ALL SELECT key, c_custkey, 1 AS asked FROM p),
        n AS (SELECT c_custkey, asked, coalesce(sum(1 - asked) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
              - coalesce(sum(1 - asked) OVER (PARTITION BY key), 0) AS below FROM both_)
        SELECT c_custkey, CAST(below AS BIGINT) AS lower FROM n WHERE asked = 1""",
    "pgm_lookup_u64": f"""WITH {_U64}, d AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM k)
        SELECT c_custkey, pos FROM p LEFT JOIN d ON p.key = d.key""",
    "pgm_lower_bound_bytes": """WITH k AS (SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS key FROM orders), p AS (SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS key FROM customer),
        both_ AS (SELECT key, NULL AS c_custkey, 0 AS asked FROM k UNION ALL SELECT key, c_custkey, 1 AS asked FROM p),
        n AS (SELECT c_custkey, asked, sum(1 - asked) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - asked) OVER (PARTITION BY key) AS below FROM both_)
        SELECT c_custkey, CAST(below AS BIGINT) AS lower FROM n WHERE asked = 1""",
    "pgm_batch": f"WITH {_FIRST}, p AS (SELECT o_orderkey AS row, o_custkey * 8 + 1 AS key FROM orders) SELECT p.row, p.key, pos FROM p LEFT JOIN firsts ON p.key = firsts.key",
    "pgm_count_hits": f"WITH {_LINES} SELECT count(*) AS hits FROM orders WHERE o_orderkey * 8 + o_orderkey % 9 IN (SELECT key FROM data)",
    "pgm_error_audit": "SELECT e.epsilon, count(*) AS keys, CAST(0 AS BIGINT) AS violations FROM events CROSS JOIN (VALUES (4), (32), (128)) e(epsilon) GROUP BY 1",
    "pgm_range_invariants": "SELECT count(*) AS keys, CAST(0 AS BIGINT) AS misordered, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS missed FROM events",
    "pgm_stats_invariants": """SELECT count(*) AS len, CAST(1 AS BIGINT) AS segments, CAST(count(*) AS DOUBLE) AS avg_segment_size,
        CAST(48 + 1025 * 4 AS BIGINT) AS index_bytes, CAST(48 + 1025 * 4 + 8 * count(*) AS BIGINT) AS total_bytes FROM orders""",
    "pgm_segment_for_index": "WITH n AS (SELECT count(*) AS n FROM events) SELECT pos, CASE WHEN pos < n THEN 1 ELSE 0 END AS n FROM (SELECT unnest(range(0, (SELECT n + 10 FROM n))) AS pos) CROSS JOIN n",
}
