"""Co-location of holds by one sweep over their starts and ends.

GPUs of a node that every hold takes or leaves together are one bit, so a hold is a mask. A node's state
in the sweep is a vector of counts by mask: how many holds of each mask have started and ended so far.
It answers "how many of these share a GPU with me" as a sum over the masks that meet mine, and it adds up:
the sums of the ranges before a range are its carry, so a node that holds most of the rows is swept in as
many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsight.operators import ordering

#: GPUs of one node that some hold tells apart, at most: a mask is a long.
MOST_BITS = 62


def colocation(probes: DataFrame) -> DataFrame:
    """Per probe: how many other holds overlapped it on its node, and how many of these share a GPU.

    Input: probe_id, boot_id, gpu_uuids (array), hold_start, hold_end. The overlaps of a hold are the starts
    before its end, less the ends up to its start, less itself; ends sort before starts of the same
    moment. Two rows a hold are swept, whatever the GPUs. A null node is a node, a hold without GPUs shares
    none, a hold that does not end after its start is left out.
    """
    gpus = F.array_sort(F.array_distinct(F.col("gpu_uuids").cast("array<string>")))
    real = probes.filter(F.col("hold_end") > F.col("hold_start")).select(
        "probe_id", "boot_id", F.coalesce(gpus, F.array().cast("array<string>")).alias("gpus"), "hold_start", "hold_end"
    )
    masks = _masks(real.select("boot_id", "gpus").distinct())
    placed = real.join(masks, F.col("boot_id").eqNullSafe(F.col("_boot")) & (F.col("gpus") == F.col("_gpus")))
    ends = F.struct(F.col("hold_end").alias("at"), F.lit(0).cast("long").alias("starts"), F.lit(1).cast("long").alias("ends"))
    starts = F.struct(F.col("hold_start").alias("at"), F.lit(1).cast("long").alias("starts"), F.lit(0).cast("long").alias("ends"))
    edges = placed.select("probe_id", "boot_id", "mask", F.explode(F.array(ends, starts)).alias("x")).select("probe_id", "boot_id", "mask", "x.*")
    rows = ordering.ranged(edges, ["boot_id"], ["at", "starts", "probe_id"]).withColumn("carry", F.lit(False))
    swept = (
        rows.unionByName(_carries(rows), allowMissingColumns=True)
        .repartition("boot_id", "_range")
        .sortWithinPartitions("boot_id", "_range", F.desc("carry"), "at", "starts", "probe_id")
        .select("boot_id", "_range", "mask", "starts", "ends", "carry", "probe_id")
    )
    out = T.StructType([swept.schema["probe_id"], swept.schema["boot_id"], T.StructField("node", T.LongType()), T.StructField("gpu", T.LongType())])
    read = swept.mapInArrow(_sweep, out)
    counted = read.groupBy("probe_id", "boot_id").agg(F.sum("node").alias("cotenants"), F.sum("gpu").alias("gpu_cotenants"))
    placement = F.when(F.col("cotenants") == 0, "alone").when(F.col("gpu_cotenants") == 0, "shared_node").otherwise("shared_gpu")
    return counted.withColumn("placement", placement)


def _masks(sets: DataFrame) -> DataFrame:
    """(_boot, _gpus, mask) of the distinct GPU sets of each node.

    A GPU's mark is the sum of the hashes of the sets it is in, so GPUs that go together share a mark and a bit.
    """
    member = sets.select("boot_id", "gpus", F.explode("gpus").alias("gpu"))
    marks = member.groupBy("boot_id", "gpu").agg(F.sum(F.xxhash64("gpus").cast("decimal(20,0)")).cast("string").alias("mark"))
    bits = marks.groupBy("boot_id").agg(F.array_sort(F.collect_set("mark")).alias("bits")).toDF("_of_boot_id", "bits")
    marks = marks.join(bits, ordering.same(["boot_id"], "_of_")).select(
        F.col("boot_id").alias("_of_boot_id"), F.col("gpu").alias("_of_gpu"), (F.array_position("bits", F.col("mark")) - 1).cast("int").alias("bit")
    )
    too_many = F.raise_error(F.lit(f"more than {MOST_BITS} GPUs of a node are told apart")).cast("long")
    shifted = F.when(F.col("bit") >= MOST_BITS, too_many).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    masked = member.join(marks, ordering.same(["boot_id", "gpu"], "_of_")).groupBy("boot_id", "gpus").agg(F.bit_or(shifted).alias("mask"))
    every = sets.select(F.col("boot_id").alias("_boot"), F.col("gpus").alias("_gpus")).join(
        masked, F.col("_boot").eqNullSafe(F.col("boot_id")) & (F.col("_gpus") == F.col("gpus")), "left"
    )
    return every.select("_boot", "_gpus", F.coalesce("mask", F.lit(0)).alias("mask"))


def _carries(rows: DataFrame) -> DataFrame:
    """What earlier ranges of a node started and ended, by mask; a row a (node, range, mask), first ranges have none."""
    totals = rows.groupBy("boot_id", "_range", "mask").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    split = totals.groupBy("boot_id").agg(F.collect_set("_range").alias("_ranges"), F.collect_set("mask").alias("_masks")).filter(F.size("_ranges") > 1)
    grid = split.select(F.col("boot_id").alias("_of_boot_id"), F.explode("_ranges").alias("_of__range"), "_masks").select(
        "_of_boot_id", "_of__range", F.explode("_masks").alias("_of_mask")
    )
    filled = grid.join(totals, ordering.same(["boot_id", "_range", "mask"], "_of_"), "left").select(
        F.col("_of_boot_id").alias("boot_id"), F.col("_of__range").alias("_range"), F.col("_of_mask").alias("mask"), "starts", "ends"
    )
    before = Window.partitionBy("boot_id", "mask").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.select("boot_id", "_range", "mask", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("starts", "ends")])
    return carried.filter((F.col("starts") > 0) | (F.col("ends") > 0)).withColumn("carry", F.lit(True))


def _meeting(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: dict[int, list[int]], kept_rows: int):
    """Per row: started and ended so far in its group, of all holds and of those whose mask meets the row's.

    `first` is each row's first row of the group; the first `kept_rows` rows go on from the state `kept`.
    """
    totals = np.zeros((4, len(mask)), dtype=np.int64)

    def fill(out: np.ndarray, meets: np.ndarray, ask: np.ndarray, wanted) -> None:
        for line, values, at in ((out, starts, 0), (out + 1, ends, 1)):
            run = np.concatenate([[0], np.cumsum(np.where(meets, values, 0))])
            got = run[1:] - run[first]
            got[:kept_rows] += sum(n[at] for m, n in kept.items() if wanted(m))
            totals[line][ask] = got[ask]

    everything = np.ones(len(mask), dtype=bool)
    fill(0, everything, everything, lambda m: True)
    for own in np.unique(mask).tolist():
        if own:
            fill(2, (mask & own) != 0, mask == own, lambda m, own=own: m & own != 0)
    return totals


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each edge says of its probe; rows come by (node, range), carries first, then in time."""
    group, kept = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).dictionary_encode()
        code = node.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        part, mask, starts, ends = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        carry = batch.column(5).to_numpy(zero_copy_only=False)
        begins = np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1]))
        at = np.flatnonzero(begins)
        first = np.repeat(at, np.diff(np.append(at, len(code))))
        head = (batch.column(0)[0].as_py(), int(part[0]))
        if head != group:
            kept = {}
        open_rows = int(at[1]) if len(at) > 1 else len(code)
        all_started, all_ended, gpu_started, gpu_ended = _meeting(mask, starts, ends, first, kept, open_rows)
        # at its end a hold reads what has started, itself too; at its start what had ended
        node_says = np.where(ends == 1, all_started - 1, -all_ended)
        gpu_says = np.where(mask == 0, 0, np.where(ends == 1, gpu_started - 1, -gpu_ended))
        real = pa.array(~carry)
        yield pa.RecordBatch.from_arrays(
            [c.filter(real) for c in (batch.column(6), batch.column(0), pa.array(node_says), pa.array(gpu_says))], names=["probe_id", "boot_id", "node", "gpu"]
        )
        last = int(at[-1])
        group = (batch.column(0)[last].as_py(), int(part[last]))
        kept = kept if last == 0 else {}
        for m in np.unique(mask[last:]).tolist():
            own, old = mask[last:] == m, kept.get(m, [0, 0])
            kept[m] = [old[0] + int(starts[last:][own].sum()), old[1] + int(ends[last:][own].sum())]
