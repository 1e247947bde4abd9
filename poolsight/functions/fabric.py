"""Collective bandwidth and GPU health arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hardware-caused throttle reasons (slowdown, thermal, power brake).
HW_THROTTLE_MASK = 0x8 | 0x40 | 0x80
MATMUL_N = 8192

# Collectives by how their bytes and bus factor are counted.
ALL_RANK_BYTES = ("all_gather", "reduce_scatter", "alltoall", "gather", "scatter")
OTHER_RANK_BYTES = ("hypercube",)
RING_TWICE = ("all_reduce",)
RING_ONCE = ("all_gather", "reduce_scatter", "alltoall", "gather", "scatter")


def moved_bytes(collective: Column, count: Column, type_size: Column, nranks: Column) -> Column:
    ranks = (
        F.when(collective.isin(*ALL_RANK_BYTES), nranks)
        .when(collective.isin(*OTHER_RANK_BYTES), nranks - 1)
        .otherwise(F.lit(1))
    )
    return (count * type_size * ranks).cast("double")


def algorithm_bandwidth(size: Column, seconds: Column) -> Column:
    """GB/s with 10^9 bytes per GB."""
    return size / F.lit(1e9) / seconds


def bus_factor(collective: Column, nranks: Column) -> Column:
    n = nranks.cast("double")
    return (
        F.when(collective.isin(*RING_TWICE), F.lit(2.0) * (n - 1) / n)
        .when(collective.isin(*RING_ONCE), (n - 1) / n)
        .otherwise(F.lit(1.0))
    )


def hardware_throttled(reasons: Column) -> Column:
    return reasons.bitwiseAND(F.lit(HW_THROTTLE_MASK).cast("bigint")) != 0


def matmul_tflops(iterations: Column, seconds: Column, n: int = MATMUL_N) -> Column:
    return F.lit(2.0 * n**3) * iterations / seconds / F.lit(1e12)
