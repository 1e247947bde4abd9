"""Order keys that keep first/last aggregates in the hash path."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINOR_RANGE = Decimal(10) ** 19  # above any non-negative bigint


def major_minor(major: Column, minor: Column) -> Column:
    """One decimal that orders like (major, minor), both integral and minor not negative.

    A struct as the ordering of min_by/max_by forces a sort-based aggregate over the whole
    input; a decimal stays in a fixed-width buffer, so the hash aggregate combines map-side.
    """
    return major.cast("decimal(19,0)") * F.lit(_MINOR_RANGE) + minor.cast("decimal(19,0)")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
