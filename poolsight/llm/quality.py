"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words in a fixed number of buckets (root counts, scaled to length one)
and the bins its statistics fall into: shares of byte classes, of distinct, repeated and most common
words, lengths, and the recorded number of characters. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so all pairwise interactions cost time linear in the features. It is fitted in numpy on a bounded
sample of labelled rows and applied to whole texts inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsight.llm.catalog import query, table
from poolsight.llm.text import SEGMENT, Words, small_batches, string_buffers, word_hashes

#: Labelled rows used to fit, at most: half of them for each label where there are as many.
FIT_ROWS = 8000
BUCKETS = 1 << 15
RANK = 8
BINS = 12
EPOCHS = 12
THRESHOLD = 0.3
WORDS = Words(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)

#: Byte classes: lower, upper, digit, blank, line end, stop, quote or bracket, !?, bar or slash, other sign, control, non-ASCII.
CLASSES = 12
_CLASS = np.full(256, 11, dtype=np.uint8)
_CLASS[:128] = 9
_CLASS[:32] = 10
_CLASS[127] = 10
for _at, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"'\"()[]{}-", b"!?", b"|/\\")):
    _CLASS[np.frombuffer(_members, dtype=np.uint8)] = _at


def class_counts(column: pa.Array) -> np.ndarray:
    """Bytes of each class in each text, walked in bounded segments."""
    data, offsets = string_buffers(column)
    out = np.zeros((len(column), CLASSES))
    for lo in range(0, len(data), SEGMENT):
        hi = min(lo + SEGMENT, len(data))
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, hi, side="left"))
        lengths = np.diff(np.clip(offsets[first : last + 1], lo, hi))
        row = np.repeat(np.arange(last - first) * CLASSES, lengths)
        out[first:last] += np.bincount(row + _CLASS[data[lo:hi]], minlength=(last - first) * CLASSES).reshape(-1, CLASSES)
    return out


@dataclass
class Features:
    """Rows of sparse words (row pointers, buckets, values) and dense statistics."""

    at: np.ndarray
    buckets: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def features(text: pa.Array, n_chars: pa.Array) -> Features:
    """Features of whole texts; null and empty texts have no words and zero statistics."""
    rows = len(text)
    classes = class_counts(text)
    size = classes.sum(axis=1)
    counts, distinct, most, again = (np.zeros(rows) for _ in range(4))
    pieces_row, pieces_bucket, pieces_n = [], [], []
    for first, n, h, bounds in word_hashes(text, WORDS):
        words = np.diff(bounds)
        counts[first : first + n] = words
        if not len(h):
            continue
        row = np.repeat(np.arange(n), words)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again[first : first + n] = np.bincount(row[1:][same], minlength=n)
        key, times = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), return_counts=True)
        owner = (key >> np.uint64(40)).astype(np.int64)
        distinct[first : first + n] = np.bincount(owner, minlength=n)
        np.maximum.at(most, first + owner, times)
        merged = owner * BUCKETS + (key & np.uint64(BUCKETS - 1)).astype(np.int64)
        merged, where = np.unique(merged, return_inverse=True)
        pieces_row.append(first + merged // BUCKETS)
        pieces_bucket.append(merged % BUCKETS)
        pieces_n.append(np.bincount(where, weights=times))
    row = np.concatenate(pieces_row) if pieces_row else np.zeros(0, np.int64)
    bucket = np.concatenate(pieces_bucket) if pieces_bucket else np.zeros(0, np.int64)
    value = np.sqrt(np.concatenate(pieces_n)) if pieces_n else np.zeros(0)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
    value = value / norm[row]
    chars = np.array([-1.0 if x is None else float(x) for x in n_chars.to_pylist()])
    words, whole = np.maximum(counts, 1), np.maximum(size, 1)
    stats = np.column_stack(
        [
            classes / whole[:, None],
            np.log1p(size),
            np.log1p(counts),
            distinct / words,
            most / words,
            again / words,
            size / words,
            np.where(chars < 0, -1.0, np.log1p(np.maximum(chars, 0))),
        ]
    )
    return Features(np.searchsorted(row, np.arange(rows + 1)), bucket, value.astype(np.float32), stats)


@dataclass
class Machine:
    """A fitted factorisation machine; features are buckets, then BINS for each statistic."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def encode(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row pointers, feature numbers and values with the statistics' bins put behind the words."""
        rows, n = f.stats.shape
        bins = np.column_stack([np.searchsorted(self.edges[i], f.stats[:, i], side="right") for i in range(n)])
        ids = BUCKETS + np.arange(n) * BINS + bins
        at = f.at + np.arange(rows + 1) * n
        index, value = np.empty(at[-1], dtype=np.int64), np.empty(at[-1], dtype=np.float32)
        word_place = np.arange(len(f.buckets)) + np.repeat(np.arange(rows), np.diff(f.at)) * n
        index[word_place], value[word_place] = f.buckets, f.values
        stat_place = (at[1:, None] - n + np.arange(n)).ravel()
        index[stat_place], value[stat_place] = ids.ravel(), n**-0.5
        return at, index, value

    def margin(self, at: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has features, so sums by row are reduceat over the row pointers."""
        begins = at[:-1] - at[0]
        v = self.factors[index] * value[:, None]
        sums = np.add.reduceat(v, begins, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), begins)
        linear = np.add.reduceat(self.weights[index] * value, begins)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, f: Features) -> np.ndarray:
        if not len(f.stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.encode(f)), -30, 30).astype(np.float64)))


def fit(f: Features, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Machine:
    """Weighted logistic loss by AdaGrad over small batches, with a light pull to zero."""
    rng = np.random.default_rng(seed)
    n_stats = f.stats.shape[1]
    edges = np.array([np.quantile(f.stats[:, i], np.linspace(0, 1, BINS + 1)[1:-1]) for i in range(n_stats)])
    size = BUCKETS + n_stats * BINS
    m = Machine(edges, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32))
    at, index, value = m.encode(f)
    share = np.clip(np.average(label, weights=weight), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    rate, pull = 0.25, 2e-5
    sum_w, sum_v, sum_b = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for part in np.array_split(order, max(1, len(order) // 64)):
            lengths = at[part + 1] - at[part]
            rows = np.repeat(np.arange(len(part)), lengths)
            take = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(at[part], lengths)
            ids, x = index[take], value[take]
            begins = np.cumsum(lengths) - lengths
            v = m.factors[ids]
            vx = v * x[:, None]
            sums = np.add.reduceat(vx, begins, axis=0)
            margin = m.bias + np.add.reduceat(m.weights[ids] * x, begins) + 0.5 * (
                (sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), begins)
            )
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[part]) * weight[part] / len(part)
            sx = (slope[rows] * x).astype(np.float32)
            # the derivative of the pairwise term by v_if is x_i (sum_j v_jf x_j - v_if x_i)
            used, where = np.unique(ids, return_inverse=True)
            grad_w = np.bincount(where, weights=sx, minlength=len(used)).astype(np.float32) + pull * m.weights[used]
            step = sx[:, None] * (sums[rows] - vx)
            grad_v = np.stack([np.bincount(where, weights=step[:, k], minlength=len(used)) for k in range(RANK)], axis=1)
            grad_v = grad_v.astype(np.float32) + pull * m.factors[used]
            sum_w[used] += grad_w**2
            sum_v[used] += grad_v**2
            m.weights[used] -= rate * grad_w / np.sqrt(sum_w[used])
            m.factors[used] -= 0.2 * rate * grad_v / np.sqrt(sum_v[used])
            grad_b = float(slope.sum())
            sum_b += grad_b**2
            m.bias -= rate * grad_b / sum_b**0.5
    return m


def constant(share: float) -> Machine:
    """A machine that gives every text one score."""
    share, n_stats = min(max(share, 1e-3), 1 - 1e-3), CLASSES + 7
    size = BUCKETS + n_stats * BINS
    return Machine(np.zeros((n_stats, BINS - 1)), float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))


def held_out(ident: Column, parts: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % parts == remainder


def _features_of(df: DataFrame, text: str, n_chars: str | None) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("amounts", pa.binary()), ("stats", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            f = features(batch.column(2), batch.column(3))
            cut = lambda a: [a[f.at[i] : f.at[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cut(f.buckets)), pa.array(cut(f.values)), pa.array([s.tobytes() for s in f.stats])],
                schema=schema,
            )

    chosen = df.select("doc_id", "label", F.col(text).alias("text"), _chars(df, n_chars).alias("n_chars"))
    return chosen.mapInArrow(run, "doc_id long, label int, buckets binary, amounts binary, stats binary")


def _chars(df: DataFrame, n_chars: str | None) -> Column:
    return F.col(n_chars).cast("long") if n_chars and n_chars in df.columns else F.lit(None).cast("long")


def train(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", n_chars: str | None = "n_chars"
) -> Machine:
    """Fit on at most `fit_rows` labelled rows of the learning fold, drawn by a hash of their ids.

    Of rows that repeat an id one is fitted on, that with the least hash of its text, so the bound holds
    however often ids repeat. Only doc_id, the text and the recorded length are read of `docs`.
    Both labels are drawn evenly where they can be and weighted back to their shares among all labelled
    rows. Null labels and labels other than 0 and 1 are left out, of contradicting ones the lower holds.
    Where the rows to fit on hold less than two labels, every text scores alike: the share of label 1.
    """
    usable = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id"), 5, 0))
    )
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {label: min(n, max(fit_rows // 2, fit_rows - min(totals.values()))) for label, n in totals.items()}
    draws = [usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in share.items()]
    known = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if len(draws) < 2:
        return constant(known)
    chosen = F.broadcast(draws[0].union(draws[1]))  # at most fit_rows rows of two numbers
    read = docs.select("doc_id", F.struct(F.col(text).alias("text"), _chars(docs, n_chars).alias("n_chars")).alias("read"))
    once = read.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min_by("read", F.xxhash64("read")).alias("read"))
    rows = _features_of(once.select("doc_id", "label", "read.*"), "text", "n_chars").collect()
    if len({r["label"] for r in rows}) < 2:
        return constant(known)
    rows.sort(key=lambda r: (r["doc_id"], r["stats"], r["buckets"]))
    buckets = [np.frombuffer(r["buckets"], np.int64) for r in rows]
    f = Features(
        np.concatenate([[0], np.cumsum([len(b) for b in buckets])]),
        np.concatenate(buckets),
        np.concatenate([np.frombuffer(r["amounts"], np.float32) for r in rows]),
        np.array([np.frombuffer(r["stats"]) for r in rows]),
    )
    label = np.array([r["label"] for r in rows])
    drawn = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    weight = np.array([totals[c] / drawn[c] for c in label])
    return fit(f, label, weight / weight.mean())


def quality_score(docs: DataFrame, machine: Machine, text: str = "text", n_chars: str | None = "n_chars") -> Column:
    """The score of each row of `docs` as a column: 0 to 1, also for null, empty and very long texts."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array, chars: pa.Array) -> pa.Array:
        parts = [
            shared.value.score(features(texts.slice(i, 256), chars.slice(i, 256))) for i in range(0, len(texts), 256)
        ]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.col(text), _chars(docs, n_chars))


@query("op2_factorisation_machine")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), quality_score(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
