"""Expressions over the usage fact table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UsageLayout:
    """Where the nested usage fields live; override it to match a warehouse's own names."""

    compute_type: str = "product_features.pool.compute_type"
    workload_type: str = "product_features.notebook.workload_type"
    run_as: str = "identity_metadata.run_as"
    owned_by: str = "identity_metadata.owned_by"
    created_by: str = "identity_metadata.created_by"
    job_id: str = "usage_metadata.job_id"
    pool_id: str = "usage_metadata.pool_id"
    workload_id: str = "usage_metadata.workload_id"
    tags: str = "custom_tags"


DEFAULT_LAYOUT = UsageLayout()

# Bucket labels, the SKU fragment of reserved capacity and the two type codes.
RESERVED_SKU_FRAGMENT = "PROVISIONED_CAPACITY"
RESERVED_TYPE = "RESERVED_COMPUTE"
ON_DEMAND_TYPE = "ON_DEMAND_COMPUTE"

# Fixed value: billed units per H100 GPU-hour.
UNITS_PER_H100_HOUR = 8.884

MAX_LOOKBACK_DAYS = 730


def is_gpu_usage(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    """A row counts when either product feature is present."""
    return F.col(layout.compute_type).isNotNull() | F.col(layout.workload_type).isNotNull()


def principal(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    return F.coalesce(F.col(layout.run_as), F.col(layout.owned_by), F.col(layout.created_by))


def workload_type(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    return F.coalesce(F.col(layout.compute_type), F.col(layout.workload_type))


def capacity_bucket(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    """Never null: the SKU decides first, then the compute type, then the notebook feature."""
    compute = F.col(layout.compute_type)
    return (
        F.when(
            F.col("sku_name").contains(RESERVED_SKU_FRAGMENT) | (compute == RESERVED_TYPE),
            "reserved",
        )
        .when(compute == ON_DEMAND_TYPE, "on_demand")
        .when(F.col(layout.workload_type).isNotNull(), "on_demand_notebook")
        .otherwise("unknown")
    )


# The labels of the coverage report.
def identity_status(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    return F.when(principal(layout).isNull(), "unattributed").otherwise("attributed")


def tag_status(layout: UsageLayout = DEFAULT_LAYOUT) -> Column:
    """A null map has null size, so it reads as untagged like an empty one."""
    return F.when(F.size(F.col(layout.tags)) > 0, "tagged").otherwise("untagged")


def lookback(days: int, as_of: dt.date | None = None, column: str = "usage_date") -> Column:
    """Inclusive lower bound `as_of - days`; a plain comparison, so it reaches the scan."""
    days = int(days)
    if not 1 <= days <= MAX_LOOKBACK_DAYS:
        raise ValueError(f"lookback must be 1..{MAX_LOOKBACK_DAYS} days, got {days}")
    if as_of is None:
        return F.col(column) >= F.date_sub(F.current_date(), days)
    return F.col(column) >= F.lit(as_of - dt.timedelta(days=days))
