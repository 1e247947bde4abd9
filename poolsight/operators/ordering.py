"""Running sums and positions that do not put a whole group into one task.

A window per group would sort a hot group in a single task. Here rows are range-partitioned by
(group, order), so a hot group spreads over as many partitions as its rows need, whatever the
type or the spread of the order columns. Rows are sorted only inside (group, partition); the sums
of a group's earlier partitions are added from a table with one row per group and partition. The
partitioned rows are written once, so the partition numbers both steps see are the same and the
input is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsight.sources import workspace


def same(names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with their prefixed twins."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return condition


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with `_range`, the number of their partition in the order of (by, order)."""
    spread = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    return workspace.materialise(spread, "ranged")


def running_totals(df: DataFrame, order: Sequence[str], values: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums; `values` maps each new column to the summed one.

    A null group is a group, null order values come first.
    """
    by = list(by)
    rows = ranged(df, by, order)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(source).alias(f"_total_{name}") for name, source in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*by, "_range")],
        *[F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}") for name in values],
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", *[F.sum(source).over(inside).alias(f"_local_{name}") for name, source in values.items()])
    return local.join(carry, same([*by, "_range"], "_of_")).select(
        *df.columns,
        *[(F.col(f"_local_{name}") + F.col(f"_carry_{name}")).alias(name) for name in values],
    )


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position in `order` (which must be unique per group), hot groups split by range."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(counted, order, {name: "_one"}, by).drop("_one")
