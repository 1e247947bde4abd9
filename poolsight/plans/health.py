"""Family F queries: node and fabric health."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.functions import text as T
from poolsight.operators import health as ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query


@query(
    "gpu_health_rollup",
    """WITH g AS (SELECT gpu_uuid, MAX(temp_c) AS max_temp_c, MAX(power_w) AS max_power_w, COUNT(*) FILTER (WHERE (throttle & 200) <> 0) AS hw_throttle_samples,
    arg_min(COALESCE(ecc, -999), (ts, sample_id)) AS e0, arg_max(COALESCE(ecc, -999), (ts, sample_id)) AS e1,
    SUM(iters) AS iters, date_sub('second', MIN(ts), MAX(ts)) AS elapsed FROM gpu_samples GROUP BY 1),
  d AS (SELECT *, CASE WHEN e0 = -999 OR e1 = -999 THEN -1 ELSE e1 - e0 END AS ecc_delta FROM g)
SELECT gpu_uuid, max_temp_c, max_power_w, hw_throttle_samples, ecc_delta, 2.0 * 8192 * 8192 * 8192 * iters / NULLIF(elapsed, 0) / 1e12 AS tflops,
  concat_ws('; ', CASE WHEN ecc_delta NOT IN (-1, 0) THEN CAST(ecc_delta AS VARCHAR) || ' uncorrected ECC errors' END,
    CASE WHEN hw_throttle_samples > 0 THEN 'HW throttle observed under load' END) AS failures,
  CASE WHEN ecc_delta IN (-1, 0) AND hw_throttle_samples = 0 THEN 'PASS' ELSE 'FAIL' END AS burn FROM d""",
)
def gpu_health_rollup(spark, root):
    return ops.gpu_health(B.gpu_samples(spark, root))


@query("throttle_mask", "SELECT sample_id, (throttle & 200) <> 0 AS hw_throttled FROM gpu_samples")
def throttle_mask(spark, root):
    return ops.throttle_mask(B.gpu_samples(spark, root)).select("sample_id", "hw_throttled")


BW = """SELECT run, collective, nranks, cnt, type_size, sec, rank, base / 1e9 / sec AS algbw, base / 1e9 / sec *
  CASE WHEN collective = 'all_reduce' THEN 2.0 * (nranks - 1) / CAST(nranks AS DOUBLE)
       WHEN collective IN ('all_gather', 'reduce_scatter', 'alltoall', 'gather', 'scatter') THEN (nranks - 1) / CAST(nranks AS DOUBLE) ELSE 1.0 END AS busbw
  FROM (SELECT *, CAST(cnt * type_size * CASE WHEN collective IN ('all_gather', 'reduce_scatter', 'alltoall', 'gather', 'scatter') THEN nranks
    WHEN collective = 'hypercube' THEN nranks - 1 ELSE 1 END AS DOUBLE) AS base FROM collective_bench)"""


@query("bus_bandwidth", f"SELECT run, collective, nranks, cnt, sec, algbw, busbw FROM ({BW})")
def bus_bandwidth(spark, root):
    return ops.bus_bandwidth(B.collective_bench(spark, root)).select(
        "run", "collective", "nranks", "cnt", "sec", "algbw", "busbw"
    )


@query(
    "bench_peak",
    f"SELECT collective, nranks, MAX(busbw) AS peak_busbw, MAX(busbw) >= 400 AS meets_bar FROM ({BW}) GROUP BY 1, 2",
)
def bench_peak(spark, root):
    return ops.bench_peak(ops.bus_bandwidth(B.collective_bench(spark, root)), ["collective", "nranks"], 400)


@query(
    "soak_drift",
    """SELECT run, CAST(SUM(10) AS BIGINT) AS iters, MIN(sec) AS min_s, MAX(sec) AS max_s, (MAX(sec) - MIN(sec)) / MIN(sec) * 100 AS drift_pct,
  SUM(CAST(cnt * type_size AS DOUBLE) * 10) / SUM(sec) / 1e9 * (2.0 * (MAX(nranks) - 1) / MAX(nranks)) AS sustained_busbw FROM collective_bench GROUP BY 1""",
)
def soak_drift(spark, root):
    windows = B.collective_bench(spark, root).select(
        "run", F.col("sec").alias("seconds"), F.lit(10).alias("iters"),
        (F.col("cnt") * F.col("type_size")).cast("double").alias("bytes"), "nranks",
    )
    return ops.soak_drift(windows)


def counter_snapshots(spark, root):
    key, user = F.col("event_id"), F.col("user_id")
    names = F.array(*[F.lit(n) for n in ("rx_bytes", "tx_bytes", "rdma_read_data", "port_rcv_data", "link_error", "tx_bytes_wr")])
    return B.table(spark, root, "events").select(
        (user % 30).alias("run"),
        (key % 4).alias("device"),
        F.get(names, (key % 6).cast("int")).alias("counter"),
        F.when((key % 6 == 5) | (user % 2 == 0), "end").otherwise("start").alias("phase"),
        (key * 1000003).alias("value"),
    )


DELTAS = """SELECT run, counter, (e - COALESCE(s, 0)) / 1e9 AS delta_gb FROM (SELECT run, counter, SUM(value) FILTER (WHERE phase = 'end') AS e, SUM(value) FILTER (WHERE phase = 'start') AS s FROM (
  SELECT user_id % 30 AS run, CASE event_id % 6 WHEN 0 THEN 'rx_bytes' WHEN 1 THEN 'tx_bytes' WHEN 2 THEN 'rdma_read_data' WHEN 3 THEN 'port_rcv_data' WHEN 4 THEN 'link_error' ELSE 'tx_bytes_wr' END AS counter,
    CASE WHEN event_id % 6 = 5 OR user_id % 2 = 0 THEN 'end' ELSE 'start' END AS phase, event_id * 1000003 AS value FROM events)
  WHERE counter LIKE '%byte%' OR counter LIKE '%data%' GROUP BY 1, 2) WHERE e IS NOT NULL"""


@query("counter_delta", DELTAS)
def counter_delta(spark, root):
    return ops.counter_delta(counter_snapshots(spark, root))


@query(
    "topk_counters",
    f"""SELECT run, counter, delta_gb, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY abs(delta_gb) DESC, counter) AS rank FROM ({DELTAS})) WHERE rank <= 4""",
)
def topk_counters(spark, root):
    return ops.topk_counters(ops.counter_delta(counter_snapshots(spark, root)))


@query(
    "reduce_modes",
    """SELECT collective, run, MIN(sec) FILTER (WHERE rank = 0) AS rank0, ROUND(AVG(sec), 9) AS avg, MIN(sec) AS min, MAX(sec) AS max, ROUND(SUM(sec), 9) AS sum
  FROM collective_bench GROUP BY 1, 2""",
)
def reduce_modes(spark, root):
    modes = ops.reduce_modes(B.collective_bench(spark, root), ["collective", "run"])
    return modes.withColumn("avg", F.round("avg", 9)).withColumn("sum", F.round("sum", 9))


@query(
    "wrong_elements",
    """SELECT vec_id, COUNT(*) FILTER (WHERE (pos + vec_id) % 97 = 0) AS wrong, COUNT(*) AS checked FROM (
  SELECT vec_id, unnest(range(64)) AS pos FROM embeddings) GROUP BY 1""",
)
def wrong_elements(spark, root):
    """The expected copy differs by one wherever (pos + vec_id) is a multiple of 97."""
    cells = B.table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    got = cells.select("vec_id", "pos", F.col("v").cast("double").alias("value"))
    off = F.when((F.col("pos") + F.col("vec_id")) % 97 == 0, 1.0).otherwise(0.0)
    return ops.wrong_elements(got, got.withColumn("value", F.col("value") + off), ["vec_id", "pos"], 1e-6)


@query(
    "ranks_seen",
    """SELECT run, COUNT(DISTINCT rank) AS ranks, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes_seen, COUNT(DISTINCT rank) = 8 AS all_reported
  FROM (SELECT user_id AS run, event_id % 8 AS rank, CAST(user_id % 20 + event_id % 3 AS VARCHAR) AS node FROM events) GROUP BY 1""",
)
def ranks_seen(spark, root):
    key, user = F.col("event_id"), F.col("user_id")
    checkins = B.table(spark, root, "events").select(
        user.alias("run"), (key % 8).alias("rank"), (user % 20 + key % 3).alias("node")
    )
    return ops.ranks_seen(checkins, 8)


@query(
    "size_parse",
    """SELECT run, rank, CASE cnt // 1048576 % 11 WHEN 0 THEN '.5K' WHEN 1 THEN '1e3' WHEN 2 THEN '-2.M' ELSE size END AS size,
  CASE cnt // 1048576 % 11 WHEN 0 THEN 512 WHEN 1 THEN 1000 WHEN 2 THEN -2097152 ELSE CASE WHEN unit = '' THEN n WHEN unit = 'K' THEN n * 1024 WHEN unit = 'M' THEN n * 1048576 WHEN unit = 'G' THEN n * 1073741824 ELSE -1 END END AS bytes FROM (
  SELECT run, rank, cnt, CAST(cnt / 1048576 AS BIGINT) || u AS size, u, upper(left(trim(u), 1)) AS unit, CAST(cnt / 1048576 AS DOUBLE) AS n FROM (
    SELECT *, CASE nranks WHEN 8 THEN '' WHEN 16 THEN 'k' WHEN 24 THEN ' MB' ELSE CASE WHEN cnt % 3 = 0 THEN 'G' ELSE 'x' END END AS u FROM collective_bench))""",
)
def size_parse(spark, root):
    ranks = F.col("nranks")
    unit = F.when(ranks == 8, "").when(ranks == 16, "k").when(ranks == 24, " MB").otherwise(
        F.when(F.col("cnt") % 3 == 0, "G").otherwise("x")
    )
    count = (F.col("cnt") / 1048576).cast("bigint")
    plain = F.concat(count.cast("string"), unit)
    odd = F.when(count % 11 == 0, ".5K").when(count % 11 == 1, "1e3").when(count % 11 == 2, "-2.M").otherwise(plain)
    sized = B.collective_bench(spark, root).select("run", "rank", odd.alias("size"))
    return sized.withColumn("bytes", T.size_bytes(F.col("size")))
