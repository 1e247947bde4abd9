"""The first rows of every group without sorting rows: selection by histograms.

Where a rank falls is found on the order values alone. The values of a group are counted in equal
intervals, the interval that holds the rank is cut again, and once it holds few rows its values are
counted one by one. Counts combine map-side, so a group that holds most of the rows costs no more than
another, and rows are only filtered: none is shuffled, sorted or written. Rows that tie at a cut are the
one exception, since only a number given to them can tell them apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsight.operators import ordering
from poolsight.sources import workspace

#: Intervals an interval is cut into, and rows of an interval up to which its values are counted one by one.
PARTS, FEW = 4096, 1 << 17
#: Codes stay below 2^61 in size, so that differences fit a long.
SPARE_BITS = 2


def code_of(order: Column, kind: T.DataType) -> Column:
    """A long that never falls as `order` rises; values it does not tell apart are told apart by themselves later."""
    least = F.lit(-(1 << 61)).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(order.cast("binary"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), least)
    if isinstance(kind, T.DateType):
        return F.coalesce(F.datediff(order, F.lit("1970-01-01").cast("date")).cast("long"), least)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.shiftright(F.unix_micros(order.cast("timestamp")), SPARE_BITS), least)
    if not isinstance(kind, T.IntegralType):
        bound = F.lit(float(1 << 62))
        order = F.when(order.isNotNull(), F.floor(F.greatest(F.least(order.cast("double"), bound), -bound)))
    return F.coalesce(F.shiftright(order.cast("long"), SPARE_BITS), least)


def first_rows(df: DataFrame, order: str, ranks: Mapping[str, Column], by: Sequence[str] = (), code: Column | None = None) -> DataFrame:
    """Add a boolean column for each rank: whether the row is among the first so many of its group.

    `ranks` are expressions of `_n`, the group's rows. Null order values come first; rows of equal order
    values are taken in no fixed order, exactly as many as the rank leaves. Null groups are groups.
    """
    by = list(by)
    order_column = F.col(order)
    code = code_of(order_column, df.schema[order].dataType) if code is None else code
    # a constant group where none is named, so that every join has a key
    rows = df.withColumn("_group", F.lit(1))
    group = ["_group", *by]
    keys = rows.select(*group, order_column.alias("_value"), code.alias("_code"))
    sizes = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))
    sizes = sizes.select("*", *[rank.cast("long").alias(f"_rank_{name}") for name, rank in ranks.items()])
    sizes = workspace.materialise(sizes, "selection-sizes")
    cuts = _values(keys, group, _narrow(keys, group, _asked(sizes, group, ranks)))
    cuts = workspace.materialise(cuts, "selection-cuts")
    wide = cuts.groupBy(*group).agg(
        *[F.max(F.when(F.col("_cut") == name, F.struct("_take", "_tied", "_value"))).alias(f"_cut_{name}") for name in ranks]
    )
    known = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_n", *[f"_rank_{name}" for name in ranks]).join(
        wide, ordering.same(group, "_of_"), "left"
    ).drop(*group)
    known = workspace.materialise(known, "selection-known")
    placed = _with_cuts(rows, known, group)
    tied = cuts.filter(F.col("_take") < F.col("_tied"))
    if not tied.limit(1).count():
        return placed.select(*df.columns, *[_before(name, order_column).alias(name) for name in ranks])
    split = F.lit(False)
    for name in ranks:
        c = F.col(f"_cut_{name}")
        split = split | F.coalesce((c["_take"] < c["_tied"]) & order_column.eqNullSafe(c["_value"]), F.lit(False))
    clear = placed.filter(~split).select(*df.columns, *[_before(name, order_column).alias(name) for name in ranks])
    numbered = ordering.positions(placed.filter(split).withColumn("_any", F.rand()), ["_any"], [*group, order], "_place")
    return clear.unionByName(numbered.select(*df.columns, *[_before(name, order_column, F.col("_place")).alias(name) for name in ranks]))


def _with_cuts(rows: DataFrame, known: DataFrame, group: list[str]) -> DataFrame:
    """Every row beside its group's cuts; those of a table without groups are one row of constants."""
    if len(group) > 1:
        return rows.join(known, ordering.same(group, "_of_")).drop(*[f"_of_{c}" for c in group])
    only = [f.name for f in known.schema if not f.name.startswith("_of_")]
    return rows.select("*", *[known.select(c).scalar().alias(c) for c in only])


def _asked(sizes: DataFrame, group: list[str], ranks: Mapping[str, Column]) -> DataFrame:
    """One row a rank that falls inside its group, with the interval of all codes."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_cut"), F.col(f"_rank_{name}").alias("_rank")) for name in ranks]))
    asked = sizes.select(*group, "_n", "_lo", "_hi", each.alias("_x")).select(*group, "_n", "_lo", "_hi", "_x.*")
    return asked.filter((F.col("_rank") > 0) & (F.col("_rank") < F.col("_n")))


def _inside(keys: DataFrame, group: list[str], cuts: DataFrame) -> DataFrame:
    """The order values inside each rank's interval; only these columns travel."""
    if len(group) == 1:
        # at most a row a rank, so no join is needed
        of = [F.struct(F.lit(r["_cut"]).alias("_cut"), *[F.lit(r[c]).cast("long").alias(c) for c in ("_rank", "_lo", "_hi")]) for r in cuts.collect()]
        none = F.array().cast("array<struct<_cut:string,_rank:bigint,_lo:bigint,_hi:bigint>>")
        beside = keys.select("*", F.explode(F.array(*of) if of else none).alias("_of")).select(*keys.columns, "_of.*")
        return beside.filter(F.col("_code").between(F.col("_lo"), F.col("_hi")))
    of = cuts.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_cut", "_rank", "_lo", "_hi")
    return keys.join(of, ordering.same(group, "_of_") & F.col("_code").between(F.col("_lo"), F.col("_hi")))


def _narrow(keys: DataFrame, group: list[str], cuts: DataFrame) -> DataFrame:
    """Shrink each rank's interval until it holds few rows or a single code."""
    open_ = (F.col("_n") > FEW) & (F.col("_hi") > F.col("_lo"))
    while True:
        if not cuts.filter(open_).limit(1).count():
            return cuts
        step = F.expr(f"(_hi - _lo) div {PARTS} + 1")
        counted = _inside(keys, group, cuts.filter(open_)).withColumn("_step", step).groupBy(
            *group, "_cut", "_rank", "_lo", "_step", F.expr("(_code - _lo) div _step").alias("_part")
        ).agg(F.count(F.lit(1)).alias("_n"))
        within = _holding(counted, group, "_part")
        lo = F.col("_lo") + F.col("_part") * F.col("_step")
        narrowed = within.select(*group, "_n", lo.alias("_lo"), (lo + F.col("_step") - 1).alias("_hi"), "_cut", F.col("_left").alias("_rank"))
        cuts = workspace.materialise(cuts.filter(~open_).unionByName(narrowed), "selection-cuts")


def _holding(counted: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of the counted intervals or values of each rank, the one that holds it; `_left` is the rank inside."""
    before = F.sum("_n").over(Window.partitionBy(*group, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return counted.withColumn("_left", F.col("_rank") - before).filter(F.col("_left").between(1, F.col("_n")))


def _values(keys: DataFrame, group: list[str], cuts: DataFrame) -> DataFrame:
    """The order value each rank falls on, how many of the rows that have it are taken, and how many have it."""
    counted = _inside(keys, group, cuts).groupBy(*group, "_cut", "_rank", "_value").agg(F.count(F.lit(1)).alias("_n"))
    return _holding(counted, group, "_value").select(*group, "_cut", "_value", F.col("_left").alias("_take"), F.col("_n").alias("_tied"))


def _before(name: str, order: Column, place: Column | None = None) -> Column:
    rank, cut = F.col(f"_rank_{name}"), F.col(f"_cut_{name}")
    same = order.eqNullSafe(cut["_value"])
    taken = (place <= cut["_take"]) if place is not None else (cut["_take"] == cut["_tied"])
    inside = (order < cut["_value"]) | (order.isNull() & cut["_value"].isNotNull()) | (same & taken)
    return F.when(rank >= F.col("_n"), True).when(rank <= 0, False).otherwise(F.coalesce(inside, F.lit(False)))
