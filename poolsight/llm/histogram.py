"""Histograms of a fixed number of buckets, counted over all rows of a table.

A task counts its own rows in one array and emits it in packed blocks; blocks are added up by block
in a stream. Only the fixed-size total comes to the driver, whatever the number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64
SCHEMA = "block int, counts binary"


def _pack(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8"
    return kind.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[2:]), dtype=packed[:2].decode())


def _rows(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, counts in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(counts)], pa.binary())], ["block", "counts"])


def histogram(df: DataFrame, buckets: int, extract: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """Counts of `buckets` (a multiple of BLOCKS) over the bucket numbers that `extract` reads off each batch."""
    width = buckets // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.uint32)
        for batch in batches:
            for numbers in extract(batch):
                at, n = np.unique(numbers, return_counts=True)
                total[at] += n.astype(np.uint32)
        parts = total.reshape(BLOCKS, width)
        yield from _rows({b: parts[b] for b in range(BLOCKS) if parts[b].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _unpack(packed)
                sums[block] = sums[block] + counts if block in sums else counts.astype(np.uint64)
        yield from _rows(sums)

    rows = df.mapInArrow(count, SCHEMA).repartition(BLOCKS, "block").mapInArrow(add, SCHEMA).collect()
    out = np.zeros((BLOCKS, width), dtype=np.uint64)
    for row in rows:
        out[row["block"]] = _unpack(row["counts"])
    return out.reshape(-1)
