"""Queries over operation logs and the address map, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import address_map as M
from ..operators import trace_analytics as A
from ..options import MapOptions
from ..session import shared_dir, table
from ..sources import traces as T
from .ordering import positions

SMALL = MapOptions(group=16)

_LOG = """trace AS (
  SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 2 END AS op,
         user_id * 100 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS lba, event_id + 1 AS pba FROM events)"""
_LIVE = f"""{_LOG}, last AS (
  SELECT *, row_number() OVER (PARTITION BY lba ORDER BY seq DESC) AS r FROM trace WHERE op <> 0),
live AS (SELECT lba, pba, lba // 4096 AS grp FROM last WHERE r = 1 AND op = 1)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_events(table(spark, sf_dir, "events"))


def live(spark: SparkSession, sf_dir: str, options: MapOptions = MapOptions()) -> DataFrame:
    return M.replay(log(spark, sf_dir), options)


def _probes(spark, sf_dir):
    return log(spark, sf_dir).where("op = 0").select("lba").distinct()


def lww_map(spark, sf_dir):
    return live(spark, sf_dir)


def point_get(spark, sf_dir):
    return M.lookup(live(spark, sf_dir), _probes(spark, sf_dir))


def point_get_miss(spark, sf_dir):
    return M.misses(live(spark, sf_dir), _probes(spark, sf_dir))


def delete_semantics(spark, sf_dir):
    return M.last_operations(log(spark, sf_dir)).where("pba IS NULL").select("lba", "seq")


def incremental_merge(spark, sf_dir):
    """The first half of the log replayed, the second merged into it."""
    every = log(spark, sf_dir)
    half = (every.agg(F.max("seq")).first()[0] or 0) // 2
    return M.merge(M.replay(every.where(F.col("seq") <= half)), every.where(F.col("seq") > half))


def read_your_writes(spark, sf_dir):
    return T.read_your_writes(log(spark, sf_dir))


def trace_assign_pba(spark, sf_dir):
    return T.assign_pba(log(spark, sf_dir))


def trace_limit(spark, sf_dir):
    return T.first_records(log(spark, sf_dir), 1000)


def count_keys(spark, sf_dir):
    return A.count_keys(log(spark, sf_dir))


def distinct_writes(spark, sf_dir):
    """Per written address, the number (from 0) of its last write among all writes."""
    numbered = T.assign_pba(log(spark, sf_dir)).withColumn("nr", F.col("pba") - 2)
    return numbered.groupBy("lba").agg(F.max("nr").alias("last_write"))


def write_count(spark, sf_dir):
    return log(spark, sf_dir).agg(F.count_if(F.col("op") == 1).alias("writes"), F.countDistinct(F.when(F.col("op") == 1, F.col("lba"))).alias("keys"))


def write_heatmap(spark, sf_dir):
    return A.write_heat(log(spark, sf_dir), 1000)


def op_mix(spark, sf_dir):
    return A.operation_mix(log(spark, sf_dir))


def capacity(spark, sf_dir):
    return A.capacity(log(spark, sf_dir))


def group_density(spark, sf_dir):
    g = live(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("pba").alias("min_pba"), F.max("pba").alias("max_pba"))
    return g.withColumn("density", F.round(F.col("n") / 4096, 6))


def group_mode(spark, sf_dir):
    every = log(spark, sf_dir)
    top = A.capacity(every).first()[0] or 0
    return M.group_kinds(M.replay(every, SMALL), top, SMALL).groupBy("mode").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("entries"))


def direct_encode(spark, sf_dir):
    return M.direct_sizes(live(spark, sf_dir, SMALL), SMALL)


def dense_rank_in_group(spark, sf_dir):
    return M.dense(live(spark, sf_dir))


def group_roundtrip(spark, sf_dir):
    return M.decode(M.encode(live(spark, sf_dir)))


def group_roundtrip_small(spark, sf_dir):
    return M.decode(M.encode(live(spark, sf_dir, SMALL), SMALL), SMALL)


def group_stats(spark, sf_dir):
    return M.group_stats(M.encode(live(spark, sf_dir)))


def group_segments(spark, sf_dir):
    return M.segment_report(M.encode(live(spark, sf_dir)))


def map_get(spark, sf_dir):
    """Point look-ups in the encoded groups."""
    return M.get(M.encode(live(spark, sf_dir)), _probes(spark, sf_dir))


def map_get_small(spark, sf_dir):
    return M.get(M.encode(live(spark, sf_dir, SMALL), SMALL), _probes(spark, sf_dir), SMALL)


def group_roundtrip_u64(spark, sf_dir):
    """Values far apart: 2**64 - 1 less a multiple of the squares, in a long log below zero and of more than 64 bits."""
    options = MapOptions(group=64)
    square = "cast(pba AS decimal(19,0)) * cast(pba AS decimal(19,0))"
    state = live(spark, sf_dir, options).withColumn("pba", F.expr(f"cast('{(1 << 64) - 1}' AS decimal(20,0)) - {square} * 1000003"))
    return M.decode_wide(M.encode_wide(state, options), options).select("lba", F.col("pba").cast("string").alias("pba"))


def sorted_map(spark, sf_dir):
    """The map in the order of its addresses, with each entry's place."""
    return positions(live(spark, sf_dir).select("lba", "pba"), ["lba"], "place")


def _top(spark, sf_dir) -> int:
    return A.capacity(log(spark, sf_dir)).first()[0] or 0


def map_group_stats(spark, sf_dir):
    """Kinds and bytes of all groups below the capacity, empty ones too."""
    return M.group_stats(M.encode(live(spark, sf_dir, SMALL), SMALL), _top(spark, sf_dir), SMALL)


def _timeline(spark, sf_dir):
    """An encoded map that lines fit: event numbers to seconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    state = table(spark, sf_dir, "events").select(F.col("event_id").alias("lba"), seconds.alias("pba"))
    return M.encode(state.withColumn("grp", M.group_of(F.col("lba"))))


def map_timeline(spark, sf_dir):
    return M.decode(_timeline(spark, sf_dir))


def map_report(spark, sf_dir):
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return M.report(_timeline(spark, sf_dir), top + 1)


def map_segment_quantiles(spark, sf_dir):
    """Lengths of the map's segments."""
    return A.length_quantiles(M.segments(_timeline(spark, sf_dir)))


def map_segment_widths(spark, sf_dir):
    return A.histogram(M.segments(_timeline(spark, sf_dir)), "width")


def map_segment_lengths(spark, sf_dir):
    return A.histogram(M.segments(_timeline(spark, sf_dir)), "len", 10)


def map_segment_patches(spark, sf_dir):
    """Per segment of the map, the cheapest width with patched exceptions."""
    return A.patched_width(M.segment_codes(_timeline(spark, sf_dir)), ("grp", "start"))


def best_patch(spark, sf_dir):
    """The setting of the patch sweep that saves most."""
    return A.best_setting(A.patch_sweep(live(spark, sf_dir)))


def map_memory(spark, sf_dir):
    return M.memory(M.encode(live(spark, sf_dir)))


def segment_len_quantiles(spark, sf_dir):
    return A.length_quantiles(A.runs(live(spark, sf_dir)))


def bitwidth_hist(spark, sf_dir):
    return A.histogram(A.runs(live(spark, sf_dir)), "width")


def seglen_hist(spark, sf_dir):
    return A.histogram(A.runs(live(spark, sf_dir)), "len", 10)


def logical_bytes(spark, sf_dir):
    g = live(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"))
    return g.select("entries", (8 * F.col("entries")).alias("logical_bytes"), M.hash_map_bytes(F.col("entries")).alias("hash_map_bytes"))


def epsilon_sweep(spark, sf_dir):
    return A.epsilon_sweep(live(spark, sf_dir), [1, 4, 8, 16, 32, 64, 128, 256, 512, 1024])


def patch_sweep(spark, sf_dir):
    return A.patch_sweep(live(spark, sf_dir))


def regress_delta(spark, sf_dir):
    """Each day's writes per operation kind against the day before."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return A.run_deltas(days, "event_type", "day", "n")


def op_pivot(spark, sf_dir):
    """Operations per range of addresses, a column per kind."""
    named = F.element_at(F.array(F.lit("reads"), F.lit("writes"), F.lit("deletes")), F.col("op") + 1)
    n = log(spark, sf_dir).groupBy(F.floor(F.col("lba") / 1000).cast("long").alias("range"), named.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return A.pivot_report(n, "range", "kind", "n", ["reads", "writes", "deletes"])


#: Rows of a file of the streamed log, about.
STREAM_ROWS = 500_000


def stream_equals_batch(spark, sf_dir):
    """The log as a stream in four parts, by hash and so out of order, each a micro-batch of one file or more that is merged
    into a table in the shared folder; its final state."""
    import uuid

    from ..streaming.map_stream import MergedTable, merge_stream

    folder = f"{shared_dir(spark)}/map-stream-{uuid.uuid4().hex}"
    every = log(spark, sf_dir)
    files = max(1, -(-every.count() // (4 * STREAM_ROWS)))
    every.repartition(4 * files, "seq").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")
    merged = MergedTable(spark, f"{folder}/table")
    merge_stream(stream, merged, f"{folder}/checkpoint").awaitTermination()
    return merged.state()


QUERIES = {f.__name__: f for f in (
    lww_map, point_get, point_get_miss, delete_semantics, incremental_merge, read_your_writes, trace_assign_pba, trace_limit, count_keys, distinct_writes,
    write_count, write_heatmap, op_mix, capacity, group_density, group_mode, direct_encode, dense_rank_in_group, group_roundtrip, group_roundtrip_small,
    group_stats, group_segments, map_memory, segment_len_quantiles, bitwidth_hist, seglen_hist, logical_bytes, epsilon_sweep, patch_sweep, regress_delta,
    op_pivot, stream_equals_batch, map_get, map_get_small, group_roundtrip_u64, sorted_map, map_group_stats, map_report, map_segment_quantiles,
    map_segment_widths, map_segment_lengths, map_segment_patches, best_patch, map_timeline,
)}

_RUNS = f"""WITH {_LIVE}, r AS (SELECT *, lba - row_number() OVER (PARTITION BY grp ORDER BY lba) AS island FROM live),
runs AS (SELECT grp, min(lba) AS start, count(*) AS len, max(pba) - min(pba) AS spread FROM r GROUP BY grp, island),
w AS (SELECT *, CASE WHEN spread = 0 THEN 0 ELSE length(bin(spread)) END AS width FROM runs)"""
_SMALL = _LIVE.replace("lba // 4096", "lba // 16")

SQL = {
    "lww_map": f"WITH {_LIVE} SELECT lba, pba, grp FROM live",
    "point_get": f"WITH {_LIVE} SELECT p.lba, live.pba FROM (SELECT DISTINCT lba FROM trace WHERE op = 0) p LEFT JOIN live ON p.lba = live.lba",
    "point_get_miss": f"WITH {_LIVE} SELECT DISTINCT lba FROM trace WHERE op = 0 AND lba NOT IN (SELECT lba FROM live)",
    "delete_semantics": f"WITH {_LIVE} SELECT lba, seq FROM last WHERE r = 1 AND op = 2",
    "incremental_merge": f"WITH {_LIVE} SELECT lba, pba, grp FROM live",
    "read_your_writes": f"""WITH {_LOG}, x AS (
        SELECT seq, lba, op, last_value(CASE op WHEN 1 THEN pba WHEN 2 THEN 0 END IGNORE NULLS)
               OVER (PARTITION BY lba ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM trace)
        SELECT seq, lba, coalesce(v, 0) AS pba FROM x WHERE op = 0""",
    "trace_assign_pba": f"WITH {_LOG} SELECT seq, lba, 1 + row_number() OVER (ORDER BY seq) AS pba FROM trace WHERE op = 1",
    "trace_limit": f"WITH {_LOG} SELECT seq, op, lba, pba FROM trace ORDER BY seq LIMIT 1000",
    "count_keys": f"WITH {_LOG} SELECT count(DISTINCT lba) AS keys FROM trace",
    "distinct_writes": f"WITH {_LOG}, n AS (SELECT lba, row_number() OVER (ORDER BY seq) - 1 AS nr FROM trace WHERE op = 1) SELECT lba, max(nr) AS last_write FROM n GROUP BY lba",
    "write_count": f"WITH {_LOG} SELECT count(*) AS writes, count(DISTINCT lba) AS keys FROM trace WHERE op = 1",
    "write_heatmap": f"WITH {_LOG} SELECT lba // 1000 AS range, count(*) AS writes FROM trace WHERE op = 1 GROUP BY 1",
    "op_mix": f"WITH {_LOG} SELECT op, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM trace), 6) AS percent FROM trace GROUP BY op",
    "capacity": f"WITH {_LOG} SELECT max(lba) + 1 AS capacity FROM trace",
    "group_density": f"WITH {_LIVE} SELECT grp, count(*) AS n, min(pba) AS min_pba, max(pba) AS max_pba, round(count(*) / 4096.0, 6) AS density FROM live GROUP BY grp",
    "group_mode": f"""WITH {_SMALL}, every AS (SELECT unnest(range(0, (SELECT (max(lba) + 16) // 16 FROM trace))) AS grp),
        n AS (SELECT every.grp, count(live.lba) AS n FROM every LEFT JOIN live ON every.grp = live.grp GROUP BY every.grp)
        SELECT CASE WHEN n = 0 THEN 'empty' WHEN n <= 8 THEN 'direct' ELSE 'fitted' END AS mode, count(*) AS groups, CAST(sum(n) AS BIGINT) AS entries FROM n GROUP BY 1""",
    "direct_encode": f"""WITH {_SMALL}, g AS (SELECT grp, count(*) AS n, min(pba) AS base, max(pba) - min(pba) AS spread FROM live GROUP BY grp HAVING count(*) <= 8),
        w AS (SELECT grp, n, base, CASE WHEN spread = 0 THEN 0 ELSE length(bin(spread)) END AS width, (CASE WHEN base = 0 THEN 0 ELSE length(bin(base)) END + 7) // 8 AS base_bytes FROM g)
        SELECT grp, n, base, width, base_bytes, base_bytes + (n * width + 7) // 8 AS payload_bytes FROM w""",
    "dense_rank_in_group": f"WITH {_LIVE} SELECT grp, lba - grp * 4096 AS \"offset\", row_number() OVER (PARTITION BY grp ORDER BY lba) - 1 AS idx, pba FROM live",
    "group_roundtrip": f"WITH {_LIVE} SELECT lba, pba FROM live",
    "group_roundtrip_small": f"WITH {_LIVE} SELECT lba, pba FROM live",
    "segment_len_quantiles": f"""{_RUNS} SELECT count(*) AS n, round(avg(len), 6) AS avg, quantile_disc(len, 0.5) AS p50, quantile_disc(len, 0.9) AS p90,
        quantile_disc(len, 0.99) AS p99, max(len) AS max FROM w""",
    "bitwidth_hist": f"{_RUNS} SELECT CAST(width AS BIGINT) AS bin, count(*) AS n FROM w GROUP BY 1",
    "seglen_hist": f"{_RUNS} SELECT (len // 10) * 10 AS bin, count(*) AS n FROM w GROUP BY 1",
    "logical_bytes": f"""WITH {_LIVE} SELECT count(*) AS entries, 8 * count(*) AS logical_bytes,
        CAST(17 * pow(2, ceil(log2(count(*) / 0.875))) AS BIGINT) AS hash_map_bytes FROM live""",
    "regress_delta": """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2),
        l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM d),
        k AS (SELECT event_type, day, n, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM l WHERE r <= 512)
        SELECT event_type, day, n, round(100.0 * (n - before) / before, 6) AS delta_percent FROM k""",
    "op_pivot": f"""WITH {_LOG}, p AS (SELECT lba // 1000 AS range, nullif(count(*) FILTER (op = 0), 0) AS reads, nullif(count(*) FILTER (op = 1), 0) AS writes,
        nullif(count(*) FILTER (op = 2), 0) AS deletes FROM trace GROUP BY 1) SELECT range, reads, writes, deletes, round(deletes / reads, 6) AS ratio FROM p""",
    "map_get": f"WITH {_LIVE} SELECT p.lba, live.pba FROM (SELECT DISTINCT lba FROM trace WHERE op = 0) p LEFT JOIN live ON p.lba = live.lba",
    "map_get_small": f"WITH {_LIVE} SELECT p.lba, live.pba FROM (SELECT DISTINCT lba FROM trace WHERE op = 0) p LEFT JOIN live ON p.lba = live.lba",
    "group_roundtrip_u64": f"WITH {_LIVE} SELECT lba, CAST(18446744073709551615::HUGEINT - pba::HUGEINT * pba * 1000003 AS VARCHAR) AS pba FROM live",
    "map_timeline": "SELECT event_id AS lba, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS pba FROM events",
    "sorted_map": f"WITH {_LIVE} SELECT lba, pba, row_number() OVER (ORDER BY lba) - 1 AS place FROM live",
    "stream_equals_batch": f"WITH {_LIVE} SELECT lba, pba, grp FROM live",
}
