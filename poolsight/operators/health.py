"""Node and fabric health (family F)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsight.functions import fabric as X
from poolsight.functions import order as O


def gpu_health(samples: DataFrame) -> DataFrame:
    """Per GPU: peaks, hardware-throttled samples, ECC growth, TFLOPS and a list of failures.

    All measures are mergeable aggregates (max_by/min_by for first and last), so a GPU with a
    huge sample count never sorts in one task.
    """
    taken = O.major_minor(O.micros(F.col("ts")), F.col("sample_id"))
    rolled = samples.groupBy("gpu_uuid").agg(
        F.max("temp_c").alias("max_temp_c"),
        F.max("power_w").alias("max_power_w"),
        F.count_if(X.hardware_throttled(F.col("throttle"))).alias("hw_throttle_samples"),
        F.min_by("ecc", taken).alias("_start"),
        F.max_by("ecc", taken).alias("_end"),
        F.sum("iters").alias("iters"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("elapsed_s"),
    )
    delta = F.coalesce(F.col("_end") - F.col("_start"), F.lit(-1))
    ecc_failed = ~F.col("ecc_delta").isin(-1, 0)
    throttled = F.col("hw_throttle_samples") > 0
    return (
        rolled.withColumn("ecc_delta", delta.cast("bigint"))
        .select(
            "gpu_uuid",
            "max_temp_c",
            "max_power_w",
            "hw_throttle_samples",
            "ecc_delta",
            X.matmul_tflops(F.col("iters"), F.nullif("elapsed_s", F.lit(0))).alias("tflops"),
            F.concat_ws(
                "; ",
                F.when(ecc_failed, F.concat(F.col("ecc_delta").cast("string"), F.lit(" uncorrected ECC errors"))),
                F.when(throttled, F.lit("HW throttle observed under load")),
            ).alias("failures"),
        )
        .withColumn("burn", F.when(F.col("failures") == "", "PASS").otherwise("FAIL"))
    )


def throttle_mask(samples: DataFrame) -> DataFrame:
    return samples.withColumn("hw_throttled", X.hardware_throttled(F.col("throttle")))


def bus_bandwidth(bench: DataFrame) -> DataFrame:
    """Algorithm and bus bandwidth in GB/s for each timing sample."""
    size = X.moved_bytes(F.col("collective"), F.col("cnt"), F.col("type_size"), F.col("nranks"))
    return bench.withColumn("algbw", X.algorithm_bandwidth(size, F.col("sec"))).withColumn(
        "busbw", F.col("algbw") * X.bus_factor(F.col("collective"), F.col("nranks"))
    )


def bench_peak(bandwidth: DataFrame, by: Sequence[str], bar_gbps: float | None = None) -> DataFrame:
    """Peak bus bandwidth per group against an optional bar."""
    peaks = bandwidth.groupBy(*by).agg(F.max("busbw").alias("peak_busbw"))
    passed = F.lit(True) if bar_gbps is None else F.col("peak_busbw") >= F.lit(float(bar_gbps))
    return peaks.withColumn("meets_bar", passed)


def soak_drift(windows: DataFrame, ring: bool = False) -> DataFrame:
    """Spread of window times and sustained bandwidth per run (run, seconds, iters, bytes, nranks)."""
    rolled = windows.groupBy("run").agg(
        F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
        F.sum("iters").alias("iters"),
        F.sum("seconds").alias("elapsed_s"),
        F.sum(F.col("bytes") * F.col("iters")).alias("_moved"),
        F.max("nranks").alias("nranks"),
    )
    algbw = F.col("_moved") / F.col("elapsed_s") / F.lit(1e9)
    factor = F.lit(1.0) if ring else X.bus_factor(F.lit("all_reduce"), F.col("nranks"))
    return rolled.select(
        "run",
        "iters",
        "min_s",
        "max_s",
        ((F.col("max_s") - F.col("min_s")) / F.col("min_s") * 100).alias("drift_pct"),
        (algbw * factor).alias("sustained_busbw"),
    )


def counter_delta(snapshots: DataFrame) -> DataFrame:
    """Byte and data counters summed over devices at the first and last snapshot, delta in 1e9."""
    moving = snapshots.filter(F.col("counter").rlike("byte|data"))
    at_phase = moving.groupBy("run", "counter").agg(
        F.sum(F.when(F.col("phase") == "end", F.col("value"))).alias("_end"),
        F.sum(F.when(F.col("phase") == "start", F.col("value"))).alias("_start"),
    )
    return at_phase.filter(F.col("_end").isNotNull()).select(
        "run", "counter", ((F.col("_end") - F.coalesce("_start", F.lit(0))) / F.lit(1e9)).alias("delta_gb")
    )


def topk_counters(deltas: DataFrame, k: int = 4) -> DataFrame:
    """Largest counters per run by size of change; the rank filter prunes before the shuffle."""
    biggest = Window.partitionBy("run").orderBy(F.abs("delta_gb").desc(), "counter")
    return deltas.withColumn("rank", F.row_number().over(biggest)).filter(F.col("rank") <= k)


def reduce_modes(timings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank-0, average, min, max and sum of per-rank times."""
    return timings.groupBy(*by).agg(
        F.min(F.when(F.col("rank") == 0, F.col("sec"))).alias("rank0"),
        F.avg("sec").alias("avg"),
        F.min("sec").alias("min"),
        F.max("sec").alias("max"),
        F.sum("sec").alias("sum"),
    )


def wrong_elements(result: DataFrame, expected: DataFrame, keys: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Elements of the result that differ from the expected ones, per first key."""
    pairs = result.join(expected.withColumnRenamed("value", "_want"), list(keys))
    return pairs.groupBy(keys[0]).agg(
        F.count_if(F.abs(F.col("value") - F.col("_want")) > tol).alias("wrong"), F.count(F.lit(1)).alias("checked")
    )


def ranks_seen(checkins: DataFrame, world: int) -> DataFrame:
    """Ranks that reported and the sorted node list; the list is bounded by the pool's nodes."""
    pairs = checkins.groupBy("run").agg(
        F.countDistinct("rank").alias("ranks"),
        F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("nodes_seen"),
    )
    return pairs.withColumn("all_reported", F.col("ranks") == world)
