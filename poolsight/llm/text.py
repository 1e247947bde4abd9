"""Words of whole Arrow string columns as 64-bit hashes, without a Python loop over words.

A column's bytes are walked in segments cut at separators, so memory is bounded by the segment
(or the longest single word) and not by the longest text. Every byte maps to a random 64-bit
value; a word's hash is the polynomial of these values, taken from one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, SEGMENT * 2), _powers(_INVERSE, SEGMENT * 2)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def ascii_lower(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[65:91] = values[97:123]
    return out


class Words:
    """What separates words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, lower: bool) -> None:
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[np.frombuffer(separators, dtype=np.uint8)] = False
        self.values = ascii_lower(_VALUES) if lower else _VALUES

    def spans(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last byte of each word; no word crosses a text start."""
        inside = self.is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        starts = starts[starts < len(data)]
        first[starts] = inside[starts]
        ends = starts[starts > 0] - 1
        last[ends] = inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        global _POWERS, _INVERSES
        if len(data) > len(_POWERS):
            powers, inverses = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        else:
            powers, inverses = _POWERS, _INVERSES
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(self.values[data] * powers[: len(data)], out=total[1:])
        return mix((total[end] - total[begin]) * inverses[begin] + (end - begin).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, begin: int, limit: int, end: int, is_word: np.ndarray) -> int:
    """The last separator at or before `limit`, else the first after it, else the text's end."""
    back = np.flatnonzero(~is_word[data[begin + 1 : limit]])
    if len(back):
        return begin + 1 + int(back[-1])
    for at in range(limit, end, SEGMENT):
        ahead = np.flatnonzero(~is_word[data[at : min(at + SEGMENT, end)]])
        if len(ahead):
            return at + int(ahead[0])
    return end


def word_hashes(column: pa.Array, words: Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, rows, hashes, offsets of each row's words) for runs of whole texts.

    Short texts share a run of about one segment; a longer text is a run of its own, hashed
    segment by segment.
    """
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + SEGMENT, side="right")) - 1
        stop = max(row + 1, min(stop, n))
        lo, hi = offsets[row], offsets[stop]
        if hi - lo <= SEGMENT:
            part = data[lo:hi]
            begin, end = words.spans(part, offsets[row:stop] - lo)
            hashes = words.hashes(part, begin, end) if len(begin) else np.zeros(0, np.uint64)
            bounds = np.searchsorted(begin, offsets[row : stop + 1] - lo)
        else:
            pieces = []
            at = int(lo)
            while at < hi:
                to = int(hi) if hi - at <= SEGMENT else _cut(data, at, at + SEGMENT, int(hi), words.is_word)
                part = data[at:to]
                begin, end = words.spans(part, np.zeros(1, np.int64))
                if len(begin):
                    pieces.append(words.hashes(part, begin, end))
                at = to
            hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
            bounds = np.array([0, len(hashes)])
        yield row, stop - row, hashes, bounds
        row = stop


def small_batches(batches, rows: int = 512):
    """Views of at most `rows` rows, so that buffers built per batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
