"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts lie side by side. Keys are drawn
with a chance in proportion to their size; weighted quantiles of the draw cut the order into many
fine ranges, and a range that turns out overfull is cut again from a draw inside it. Exact byte and
row totals of the ranges then give every record its place in the whole order, and its shard follows
from the bytes before it: shards differ by less than the longest record. Nothing but the splitters
and one total per range reaches the driver; both are bounded by `shards * fine`.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from poolsight.llm.catalog import query, table
from poolsight.llm.storage import materialise

#: Fine ranges a shard, draws a fine range, and times a mean range's bytes that make a range overfull.
FINE, DRAWS, OVERFULL, ROUNDS = 16, 24, 2.0, 3
LOWEST = -(1 << 63)


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _draw(keys: DataFrame, rate: Column | float, salt: int) -> list[tuple[int, int, float]]:
    """Keys kept with chance size * rate; a key sure to be kept keeps its own weight."""
    pull = F.col("__size") * (rate if isinstance(rate, Column) else F.lit(rate))
    rows = (
        keys.withColumn("__pull", pull)
        .filter(_unit(F.col("__h"), F.col("__id"), F.lit(salt)) < F.col("__pull"))
        .groupBy("__h", "__id")
        .agg(F.sum(F.greatest(F.col("__pull"), F.lit(1.0))).alias("w"))
        .collect()
    )
    return sorted((r["__h"], r["__id"], r["w"]) for r in rows)


def _quantiles(draw: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys that cut the drawn weight into about equal parts."""
    if not draw or parts < 2:
        return []
    weight = np.cumsum([w for _, _, w in draw])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)
    return sorted({draw[i][:2] for i in np.minimum(at, len(draw) - 1)})


def range_of(splitters: list[tuple[int, int]]):
    """A column function: how many splitters are at or before a key."""
    hashes = np.array([h for h, _ in splitters], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(h: pd.Series, ident: pd.Series) -> pd.Series:
        h, ident = h.to_numpy(np.int64), ident.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for i in np.flatnonzero(low < high):
            low[i] = bisect_right(splitters, (int(h[i]), int(ident[i])))
        return pd.Series(low.astype(np.int32))

    return place


def sampled_splitters(keys: DataFrame, ranges: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Splitters of (hash, id) keys and the exact (bytes, rows) of each range between them.

    At most ROUNDS times, ranges holding OVERFULL times their share are cut by a draw of their own.
    A range of one single key can't be cut by any splitter and stays.
    """
    total = keys.agg(F.sum("__size")).first()[0] or 0
    if not total:
        return [], [(0, 0)]
    draws = float(ranges * DRAWS)
    splitters = _quantiles(_draw(keys, draws / total, 0), ranges)
    for attempt in range(ROUNDS + 1):
        found = (
            keys.withColumn("__range", range_of(splitters)("__h", "__id"))
            .groupBy("__range")
            .agg(
                F.sum("__size").alias("size"),
                F.count(F.lit(1)).alias("n"),
                F.min(F.struct("__h", "__id")).alias("lo"),
                F.max(F.struct("__h", "__id")).alias("hi"),
            )
            .collect()
        )
        by = {r["__range"]: r for r in found}
        over = [r for r in found if r["size"] > OVERFULL * total / ranges and r["lo"] != r["hi"]]
        if attempt == ROUNDS or not over:
            return splitters, [(by[i]["size"], by[i]["n"]) if i in by else (0, 0) for i in range(len(splitters) + 1)]
        rates = [0.0] * (len(splitters) + 1)
        for r in over:
            rates[r["__range"]] = DRAWS * min(ranges, r["size"] * ranges / total) / r["size"]
        inside = keys.withColumn("__range", range_of(splitters)("__h", "__id")).filter(
            F.col("__range").isin([r["__range"] for r in over])
        )
        draw = _draw(inside, F.array(*map(F.lit, rates))[F.col("__range")], attempt + 1)
        place = lambda key: bisect_right(splitters, key)
        parts: dict[int, list] = {}
        for h, i, w in draw:
            parts.setdefault(place((h, i)), []).append((h, i, w))
        more = []
        for r in over:
            own = parts.get(r["__range"], [])
            more += _quantiles(own, max(2, round(r["size"] * ranges / total)))
            more.append((r["hi"]["__h"], r["hi"]["__id"]))
        splitters = sorted({*splitters, *more})
    raise AssertionError("not reached")


def shard_records(
    docs: DataFrame, shards: int, text: str = "text", ident: str = "doc_id", fine: int = FINE
) -> DataFrame:
    """All rows and columns of `docs`, plus `__size`, `__shard` and `__slot`.

    A record's size is its text's UTF-8 bytes and one more; shards hold nearly equal bytes, slots
    run from 0 without gaps in the order of (text hash, id). Null texts have no bytes and hash as
    null, null ids sort first, repeated rows take neighbouring slots in any order, an empty table
    gives an empty result. Columns of the names used here are the caller's to rename beforehand.
    """
    keyed = docs.withColumns(
        {
            "__size": record_size(F.col(text)),
            "__h": F.xxhash64(F.col(text)),
            "__id": F.coalesce(F.col(ident).cast("long"), F.lit(LOWEST)),
        }
    )
    keys = materialise(keyed.select("__size", "__h", "__id"), "shard-keys")
    splitters, totals = sampled_splitters(keys, shards * fine)
    bytes_before = np.concatenate([[0], np.cumsum([b for b, _ in totals])]).astype(np.int64)
    rows_before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64)
    total = max(1, int(bytes_before[-1]))
    order = Window.partitionBy("__range").orderBy("__h", "__id")
    literal = lambda a: F.array(*[F.lit(int(x)).cast("long") for x in a])[F.col("__range")]

    def placed(rows: DataFrame) -> DataFrame:
        start = literal(bytes_before[:-1]) + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        middle = start - F.col("__size") / 2
        return rows.withColumn("__range", range_of(splitters)("__h", "__id")).withColumns(
            {
                "__rank": literal(rows_before[:-1]) + F.row_number().over(order) - 1,
                "__shard": F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"),
            }
        )

    first = {r["__shard"]: r["r"] for r in placed(keys).groupBy("__shard").agg(F.min("__rank").alias("r")).collect()}
    starts = F.array(*[F.lit(int(first.get(s, 0))).cast("long") for s in range(shards)])
    return (
        placed(keyed)
        .withColumn("__slot", F.col("__rank") - starts[F.col("__shard")])
        .drop("__h", "__id", "__range", "__rank")
    )


def shard_report(docs: DataFrame, shards: int) -> DataFrame:
    """Where each row goes, with the checksum of its text (0 for null); texts themselves aren't moved."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shard_records(docs.withColumn("__crc", crc), shards).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_sampled_splitters")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"), 16)
