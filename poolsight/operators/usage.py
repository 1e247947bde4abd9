"""Usage, chargeback and attribution (family A).

Every operator filters and projects first, so the scan reads only the leaves it needs and the
date bound is pushed down. Sums combine map-side, so a hot principal or SKU costs one partial
row per task. Result order is left to the caller (see `newest_first`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsight.functions import usage as U
from poolsight.operators import ordering
from poolsight.sources import workspace

UNMAPPED = "unmapped"


def qualifying(usage: DataFrame, days: int, as_of: dt.date | None, layout: U.UsageLayout) -> DataFrame:
    return usage.filter(U.is_gpu_usage(layout) & U.lookback(days, as_of))


def usage_daily(usage, days=30, as_of=None, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    """Units per date, workspace, SKU, principal, job and workload type."""
    return (
        qualifying(usage, days, as_of, layout)
        .groupBy(
            "usage_date",
            "workspace_id",
            "sku_name",
            U.principal(layout).alias("principal"),
            F.col(layout.job_id).alias("job_id"),
            U.workload_type(layout).alias("workload_type"),
        )
        .agg(F.sum("usage_quantity").alias("dbus"))
    )


def usage_by_sku(usage, cutoff: dt.date, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    """Units by SKU and feature after an exclusive cutoff date."""
    return (
        usage.filter(U.is_gpu_usage(layout) & (F.col("usage_date") > F.lit(cutoff)))
        .groupBy(
            "usage_date",
            "workspace_id",
            "sku_name",
            "usage_unit",
            F.col(layout.compute_type).alias("compute_type"),
            F.col(layout.workload_type).alias("notebook_type"),
        )
        .agg(F.sum("usage_quantity").alias("usage_qty"))
    )


def usage_by_bucket(usage, days=30, as_of=None, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    """Reserved against on-demand, with distinct workloads and principals.

    A first aggregation collapses to (group, workload, principal), so the Expand that two
    distinct counts need runs over that far smaller relation.
    """
    group = ["capacity_bucket", "sku_name", "pool_id"]
    fine = (
        qualifying(usage, days, as_of, layout)
        .groupBy(
            U.capacity_bucket(layout).alias("capacity_bucket"),
            "sku_name",
            F.col(layout.pool_id).alias("pool_id"),
            F.col(layout.workload_id).alias("_workload"),
            U.principal(layout).alias("_principal"),
        )
        .agg(
            F.sum("usage_quantity").alias("_dbus"),
            F.min("usage_date").alias("_first"),
            F.max("usage_date").alias("_last"),
        )
    )
    return fine.groupBy(*group).agg(
        F.countDistinct("_workload").alias("cli_workloads"),
        F.countDistinct("_principal").alias("principals"),
        F.sum("_dbus").alias("dbus"),
        F.min("_first").alias("first_seen"),
        F.max("_last").alias("last_seen"),
    )


#: Windows of one SKU and cloud up to which usage is compared with each of them.
FEW_WINDOWS = 32


def with_list_price(usage: DataFrame, prices: DataFrame, few_windows: int = FEW_WINDOWS) -> DataFrame:
    """LEFT join to the price in force: equal SKU and cloud, half-open window, null end = open.

    While every SKU has few windows, the equi keys give a hash join with the window as residual. A SKU with
    many would compare each of its usage rows with all of them, so beyond `few_windows` the windows in
    force are looked up once an instant (`prices_at`), and usage joins on SKU, cloud and time alone. No hint
    is set: the planner broadcasts what it has measured as small, and otherwise AQE splits hot keys.
    Overlapping windows fan out, as in a plain SQL join.
    """
    windows = prices.select(
        F.col("sku_name").alias("_sku"),
        F.col("cloud").alias("_cloud"),
        F.col("price_start_time").alias("_from"),
        F.col("price_end_time").alias("_to"),
        F.col("pricing.default").cast("double").alias("list_price"),
    )
    most = windows.groupBy("_sku", "_cloud").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    same_sku = (F.col("sku_name") == F.col("_sku")) & (F.col("cloud") == F.col("_cloud"))
    if most <= few_windows:
        in_force = (
            same_sku
            & (F.col("usage_start_time") >= F.col("_from"))
            & (F.col("_to").isNull() | (F.col("usage_start_time") < F.col("_to")))
        )
        return usage.join(windows, in_force, "left").drop("_sku", "_cloud", "_from", "_to")
    instants = usage.select(
        F.col("sku_name").alias("_sku"), F.col("cloud").alias("_cloud"), F.col("usage_start_time").alias("_at")
    ).dropna().distinct()
    found = prices_at(instants, windows)
    return usage.join(found, same_sku & (F.col("usage_start_time") == F.col("_at")), "left").drop("_sku", "_cloud", "_at")


def prices_at(instants: DataFrame, windows: DataFrame) -> DataFrame:
    """(_sku, _cloud, _at, list_price): the windows in force at each instant, all of them where they overlap.

    The bounds of a SKU's windows cut time into numbered segments; a window is the segments from its start
    to its end. Instants and bounds are put in order together, range by range, and an instant's segment is
    the highest number so far: a running maximum that earlier ranges hand on. A SKU with most of the
    instants or windows spreads over ranges, and the work grows with rows and windows, not their product.
    """
    key = ["_sku", "_cloud"]
    real = windows.filter(F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_from") < F.col("_to"))))
    bounds = real.select(*key, F.explode(F.array("_from", "_to")).alias("_at")).dropna().distinct()
    numbered = workspace.materialise(ordering.positions(bounds, ["_at"], key, "_segment"), "price-bounds")
    lines = instants.select(*key, "_at", F.lit(None).cast("long").alias("_segment")).unionByName(numbered)
    rows = ordering.ranged(lines, key, ["_at"])
    tops = rows.groupBy(*key, "_range").agg(F.max("_segment").alias("_top"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*key, "_range", F.max("_top").over(earlier).alias("_carry"))
    # a bound counts at its own instant: windows are closed at their start and open at their end
    here = Window.partitionBy(*key, "_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("*", F.max("_segment").over(here).alias("_highest")).filter(F.col("_segment").isNull())
    placed = placed.join(carried, [*key, "_range"]).select(*key, "_at", F.greatest("_highest", "_carry").alias("_segment"))

    starts = numbered.select(*key, F.col("_at").alias("_from"), F.col("_segment").alias("_first"))
    ends = numbered.select(*key, F.col("_at").alias("_to"), F.col("_segment").alias("_end"))
    last = numbered.groupBy(*key).agg(F.max("_segment").alias("_last"))
    spans = real.join(starts, [*key, "_from"]).join(ends, [*key, "_to"], "left").join(last, key)
    covered = F.explode(F.sequence("_first", F.coalesce(F.col("_end") - 1, F.col("_last"))))
    return placed.join(spans.select(*key, covered.alias("_segment"), "list_price"), [*key, "_segment"]).select(*key, "_at", "list_price")


def overlapping_prices(prices: DataFrame) -> DataFrame:
    """Price windows that start before the previous one of the same SKU and cloud ended."""
    per_sku = Window.partitionBy("sku_name", "cloud").orderBy("price_start_time")
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    ended = F.max(F.coalesce(F.col("price_end_time").cast("timestamp_ntz"), far)).over(
        per_sku.rowsBetween(Window.unboundedPreceding, -1)
    )
    return prices.withColumn("_ended", ended).filter(F.col("price_start_time") < F.col("_ended")).drop("_ended")


def usage_by_principal(usage, prices, days=30, as_of=None, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    """Chargeback per principal with an estimated list cost; unpriced rows keep their units.

    The distinct job count is taken over a (principal, job) rollup, so the shuffle carries one
    row per pair and task instead of the priced facts, and no Expand is needed.
    """
    facts = qualifying(usage, days, as_of, layout).select(
        U.principal(layout).alias("principal"),
        F.col(layout.job_id).alias("_job"),
        "usage_date",
        "usage_quantity",
        "sku_name",
        "cloud",
        "usage_start_time",
    )
    per_job = (
        with_list_price(facts, prices)
        .groupBy("principal", "_job")
        .agg(
            F.sum("usage_quantity").alias("_dbus"),
            F.sum(F.col("usage_quantity") * F.col("list_price")).alias("_cost"),
            F.max("usage_date").alias("_last"),
        )
    )
    return per_job.groupBy("principal").agg(
        F.sum("_dbus").alias("dbus"),
        F.sum("_cost").alias("est_list_cost_usd"),
        F.count("_job").alias("jobs"),
        F.max("_last").alias("last_active"),
    )


def attribution_coverage(usage, days=30, as_of=None, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    return (
        qualifying(usage, days, as_of, layout)
        .groupBy(
            "usage_date",
            U.identity_status(layout).alias("identity_status"),
            U.tag_status(layout).alias("tag_status"),
        )
        .agg(F.sum("usage_quantity").alias("dbus"))
    )


def tag_inventory(usage, days=30, as_of=None, layout=U.DEFAULT_LAYOUT) -> DataFrame:
    """Units and jobs per tag key and value; untagged rows drop out with the inner explode."""
    tagged = qualifying(usage, days, as_of, layout).select(
        F.col(layout.job_id).alias("_job"),
        "usage_quantity",
        F.explode(F.col(layout.tags)).alias("tag_key", "tag_value"),
    )
    per_job = tagged.groupBy("tag_key", "tag_value", "_job").agg(F.sum("usage_quantity").alias("_dbus"))
    return per_job.groupBy("tag_key", "tag_value").agg(
        F.sum("_dbus").alias("dbus"), F.count("_job").alias("jobs")
    )


def reservation_utilization(
    usage,
    days=30,
    as_of=None,
    reserved_gpus: int = 160,
    units_per_gpu_hour: float = U.UNITS_PER_H100_HOUR,
    layout=U.DEFAULT_LAYOUT,
) -> DataFrame:
    """Daily units split by bucket, as GPU-hours and as a share of the reservation."""
    reserved = U.capacity_bucket(layout) == "reserved"
    units = F.col("usage_quantity")
    total = F.sum(units)
    rate = F.lit(float(units_per_gpu_hour))
    return (
        qualifying(usage, days, as_of, layout)
        .groupBy("usage_date")
        .agg(
            total.alias("dbus"),
            F.sum(F.when(reserved, units).otherwise(0.0)).alias("reserved_dbus"),
            F.sum(F.when(reserved, 0.0).otherwise(units)).alias("on_demand_dbus"),
            F.round(total / rate, 1).alias("est_gpu_hours"),
            F.round(F.lit(100) * total / rate / F.lit(int(reserved_gpus) * 24), 1).alias(
                "est_pct_of_reservation"
            ),
        )
    )


def first_team_of(members: DataFrame) -> DataFrame:
    """Lower-cased member -> its first team in config order; positions are unique, and found on numbers."""
    who = F.lower("member")
    first = members.groupBy(who.alias("_member")).agg(F.min("pos").alias("_pos"))
    found = members.join(first, (who == F.col("_member")) & (F.col("pos") == F.col("_pos")))
    return found.select("_member", "team").distinct()


def team_map_join(df: DataFrame, members: DataFrame, principal: str = "principal") -> DataFrame:
    """Case-insensitive lookup; a null or unknown principal is kept as `unmapped`."""
    looked_up = df.join(first_team_of(members), F.lower(F.col(principal)) == F.col("_member"), "left")
    return looked_up.drop("_member").withColumn("team", F.coalesce("team", F.lit(UNMAPPED)))


def teams_of_join(principals: DataFrame, members: DataFrame, principal: str = "principal") -> DataFrame:
    """Every team of each principal; a principal in none disappears."""
    listed = members.select(F.lower("member").alias("_member"), "team", "pos").distinct()
    return principals.join(listed, F.lower(F.col(principal)) == F.col("_member")).drop("_member")


def usage_by_team(by_principal: DataFrame, members: DataFrame) -> DataFrame:
    """Roll the principal result up to teams; a job of two principals counts for both."""
    return (
        team_map_join(by_principal, members)
        .groupBy("team")
        .agg(
            F.coalesce(F.sum("dbus"), F.lit(0.0)).alias("dbus"),
            F.coalesce(F.sum("est_list_cost_usd"), F.lit(0.0)).alias("est_list_cost_usd"),
            F.count("principal").alias("principals"),
            F.sum("jobs").alias("runs"),
        )
    )


def unmapped_total(by_team: DataFrame) -> DataFrame:
    unmapped = F.when(F.col("team") == UNMAPPED, F.col("dbus"))
    return by_team.agg(F.coalesce(F.sum(unmapped), F.lit(0.0)).alias("unmapped_dbus"))


def newest_first(df: DataFrame, column: str = "usage_date", *ties: str) -> DataFrame:
    """Presentation order; kept out of the operators so inner results never sort."""
    return df.orderBy(F.col(column).desc(), *ties)
