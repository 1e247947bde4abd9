"""Attributes of a variant that are asked for often, stored as typed columns beside it.

Spark pushes the extraction of a key into a parquet scan, but the scan still reads the whole variant, since a key may
lie in its unshredded rest. A leaf is a column of its own: a query that asks for it reads no byte of the variant,
and a filter on it prunes row groups. The variant stays whole, so other keys are extracted as before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute(variant: str | Column, key: str, as_type: str = "string") -> Column:
    """A dotted attribute name is one key, hence the quoted path."""
    return F.try_variant_get(variant, f'$["{key}"]', as_type)


@dataclass(frozen=True)
class Leaf:
    """One key of a variant column (a dotted path names a struct's field) and the type it is stored as."""

    variant: str
    key: str
    as_type: str = "string"

    @property
    def column(self) -> str:
        return "leaf_" + re.sub(r"\W", "_", f"{self.variant}.{self.key}")


def promote(table: DataFrame, leaves: Iterable[Leaf]) -> DataFrame:
    """Add each leaf's column, extracted as `attribute` does: null where the key is absent or does not fit the type.

    The caller's columns stay; one that has a leaf's name is replaced, and two leaves of one name are refused.
    """
    columns = {leaf.column: attribute(leaf.variant, leaf.key, leaf.as_type) for leaf in leaves}
    if len(columns) < len(set(leaves)):
        raise ValueError("two leaves share a column name")
    return table.withColumns(columns) if columns else table


def attribute_of(table: DataFrame, variant: str, key: str, as_type: str = "string") -> Column:
    """The key's leaf where the table holds one of this type, and else its extraction from the variant."""
    column = Leaf(variant, key).column
    held = column in table.columns and table.schema[column].dataType.simpleString() == as_type
    return F.col(column) if held else attribute(variant, key, as_type)
