"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes; a forward and a backward gated recurrent layer read each window,
every position is labelled from both states, and a document's score is the mean of its positions'
probabilities. The network is trained in numpy by backpropagation through time on a bounded sample
of windows, and applied to every byte of every text inside tasks, one time step of thousands of
windows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsight.llm.catalog import query, table
from poolsight.llm.quality import held_out
from poolsight.llm.text import small_batches, string_buffers

#: Bytes to a window; states start anew in each.
WINDOW = 96
HIDDEN = 12
#: Labelled documents used to fit, at most, spread evenly over the languages, and windows taken of each.
FIT_DOCS, FIT_WINDOWS = 2400, 6
EPOCHS, BATCH = 5, 96
#: Windows that go through the network together.
TOGETHER = 2048
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by direction: input table (256, 3H), recurrent (H, 2H) and (H, H); and the read-out."""

    langs: list[str]
    table: list[np.ndarray]
    gates: list[np.ndarray]
    blend: list[np.ndarray]
    read: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.gates, *self.blend, self.read, self.bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        langs,
        [draw(256, 3 * hidden, scale=0.5) for _ in range(2)],
        [draw(hidden, 2 * hidden, scale=hidden**-0.5) for _ in range(2)],
        [draw(hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
        draw(2 * hidden, len(langs), scale=0.3),
        np.zeros(len(langs), np.float32),
    )


def _layer(net: Network, d: int, x: np.ndarray, live: np.ndarray | None, keep: bool):
    """States after each of the T steps of one direction; x is (T, N) bytes, live (T, N) marks real bytes.

    z, r = gates(x_t, h); c = tanh(table(x_t) + (r * h) blend); h' = h + z * (c - h)
    """
    steps, n = x.shape
    hidden = net.blend[d].shape[0]
    order = range(steps) if d == 0 else range(steps - 1, -1, -1)
    states = np.empty((steps, n, hidden), np.float32)
    # the gates are tanh of half their input: halving the parameters once spares it at each step
    tab = net.table[d].copy()
    tab[:, : 2 * hidden] *= 0.5
    gates, blend = net.gates[d] * np.float32(0.5), net.blend[d]
    h = np.zeros((n, hidden), np.float32)
    a, zr, rh, c = (np.empty((n, w * hidden), np.float32) for w in (3, 2, 1, 1))
    kept = []
    for t in order:
        np.take(tab, x[t], axis=0, out=a, mode="clip")
        np.matmul(h, gates, out=zr)
        zr += a[:, : 2 * hidden]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, hidden:], h, out=rh)
        np.matmul(rh, blend, out=c)
        c += a[:, 2 * hidden :]
        np.tanh(c, out=c)
        if keep:
            kept.append((t, zr.copy(), c.copy(), h.copy()))
        c -= h
        c *= zr[:, :hidden]
        if live is not None:
            c *= live[t][:, None]
        h = np.add(h, c, out=states[t])
    return states, kept


def position_chances(net: Network, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """(T, N, languages): the probabilities at every position."""
    both = np.concatenate([_layer(net, d, x, live, False)[0] for d in (0, 1)], axis=2)
    out = both.reshape(-1, both.shape[2]) @ net.read
    out += net.bias
    np.exp(np.clip(out, -30, 30, out=out), out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out.reshape(*x.shape, -1)


def gradients(net: Network, x: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over live positions, and its gradient by backpropagation through time."""
    layers = [_layer(net, d, x, live, True) for d in (0, 1)]
    both = np.concatenate([s for s, _ in layers], axis=2)
    logits = both @ net.read + net.bias
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    total = live.sum()
    picked = p[:, np.arange(len(label)), label]
    loss = float(-(np.log(picked + 1e-9) * live).sum() / total)
    p[:, np.arange(len(label)), label] -= 1
    p *= (live / total)[:, :, None]
    g_read = both.reshape(-1, both.shape[2]).T @ p.reshape(-1, p.shape[2])
    g_bias = p.sum(axis=(0, 1))
    back = p @ net.read.T
    hidden = net.blend[0].shape[0]
    out = {"table": [], "gates": [], "blend": []}
    for d in (0, 1):
        g_gates, g_blend = np.zeros_like(net.gates[d]), np.zeros_like(net.blend[d])
        pushed = np.empty((len(x), x.shape[1], 3 * hidden), np.float32)
        g_h = np.zeros((x.shape[1], hidden), np.float32)
        for t, zr, c, h in reversed(layers[d][1]):
            z, r = zr[:, :hidden], zr[:, hidden:]
            g_h = g_h + back[t, :, d * hidden : (d + 1) * hidden]
            moved = g_h * live[t][:, None]
            g_c = moved * z * (1 - c * c)
            g_rh = g_c @ net.blend[d].T
            g_blend += (r * h).T @ g_c
            g_zr = np.concatenate([moved * (c - h) * z * (1 - z), g_rh * h * r * (1 - r)], axis=1)
            g_gates += h.T @ g_zr
            pushed[t, :, : 2 * hidden], pushed[t, :, 2 * hidden :] = g_zr, g_c
            g_h = g_h - moved * z + g_rh * r + g_zr @ net.gates[d].T
        g_table = np.zeros_like(net.table[d])
        np.add.at(g_table, x.ravel(), pushed.reshape(-1, 3 * hidden))
        out["table"].append(g_table)
        out["gates"].append(g_gates)
        out["blend"].append(g_blend)
    return loss, [*out["table"], *out["gates"], *out["blend"], g_read, g_bias]


def fit(x: np.ndarray, live: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam with clipped gradients; x and live are (windows, T)."""
    net, rng = new_network(langs, seed=seed), np.random.default_rng(seed)
    values = net.parameters()
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    batches = max(1, len(x) // BATCH)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), batches):
            step += 1
            _, grads = gradients(net, x[part].T, live[part].T.astype(np.float32), label[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / (epochs * batches))
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(owner text, first byte) of every window; texts never share one."""
    per = -(-np.diff(offsets) // width)
    owner = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return owner, offsets[owner] + number * width


def document_chances(net: Network, column: pa.Array) -> np.ndarray:
    """(texts, languages): the mean probabilities over all bytes of each text; zero rows for empty ones."""
    data, offsets = string_buffers(column)
    owner, first = windows(data, offsets)
    sums = np.zeros((len(column), len(net.langs)))
    size = offsets[owner + 1] - first
    # full windows and tails go apart: only tails need the mask
    for whole in (True, False):
        chosen = np.flatnonzero((size >= WINDOW) == whole)
        if not whole:
            chosen = chosen[np.argsort(size[chosen], kind="stable")]
        for at in range(0, len(chosen), TOGETHER):
            part = chosen[at : at + TOGETHER]
            width = int(min(WINDOW, size[part].max()))
            place = first[part][None, :] + np.arange(width)[:, None]
            live = None if whole else (np.arange(width)[:, None] < size[part][None, :]).astype(np.float32)
            chances = position_chances(net, data[np.minimum(place, len(data) - 1)], live)
            chances = chances.sum(axis=0) if live is None else np.einsum("tnl,tn->nl", chances, live)
            np.add.at(sums, owner[part], chances)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", fit_docs: int = FIT_DOCS) -> Network:
    """Fit on windows of at most `fit_docs` labelled documents of the learning fold, drawn by a hash.

    Of each, up to FIT_WINDOWS windows evenly spread over the whole text are used. Documents without a
    language or a letter teach nothing; without any teacher the network knows no language.
    """
    usable = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(ident), 4, 2) & has_letter(F.col(text)))
    usable = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(ident), F.col(text)).alias("k"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return new_network([])
    schema = pa.schema([("lang", pa.string()), ("k", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        for batch in small_batches(batches):
            data, offsets = string_buffers(batch.column(1))
            owner, first = windows(data, offsets)
            rows, pieces = [], []
            for i in range(batch.num_rows):
                own = np.flatnonzero(owner == i)
                for w in own[np.unique(np.linspace(0, len(own) - 1, min(len(own), FIT_WINDOWS)).astype(int))] if len(own) else ():
                    rows.append(i)
                    pieces.append(data[first[w] : min(first[w] + WINDOW, offsets[i + 1])].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(2).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.binary())], schema=schema
            )

    # a little over the wanted share of each language by hash, then exactly the least hashes, equal rows once
    per = -(-fit_docs // len(langs))
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, 1.2 * per / n + 1e-9)])
    unit = F.shiftrightunsigned("k", 11).cast("double") / F.lit(float(1 << 53))
    drawn = usable.filter(unit <= share[F.col("lang")]).dropDuplicates(["lang", "k"])
    least = F.row_number().over(Window.partitionBy("lang").orderBy(unit, "k"))
    drawn = drawn.withColumn("place", least).filter(F.col("place") <= per).drop("place")
    rows = drawn.mapInArrow(cut, "lang string, k long, bytes binary").collect()
    rows.sort(key=lambda r: (r["k"], r["lang"], r["bytes"]))
    if not rows:
        return new_network([])
    x, live = np.zeros((len(rows), WINDOW), np.uint8), np.zeros((len(rows), WINDOW), bool)
    for i, r in enumerate(rows):
        x[i, : len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
        live[i, : len(r["bytes"])] = True
    return fit(x, live, np.array([langs.index(r["lang"]) for r in rows]), langs)


def identify(docs: DataFrame, net: Network, text: str = "text") -> Column:
    """A struct (lang, score) for each row of `docs`.

    Null texts and texts without a letter are `und` with score 0, and so is all text when the network
    knows no language. Ties go to the language first in the alphabet. Texts are read whole.
    """
    if not net.langs:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        known = shared.value
        chances = [document_chances(known, texts.slice(i, 256)) for i in range(0, len(texts), 256)]
        chances = np.concatenate(chances) if chances else np.zeros((0, len(known.langs)))
        best = chances.argmax(axis=1)
        names = pa.array(known.langs).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(np.clip(chances.max(axis=1), 0, 1))], ["lang", "score"])

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return F.when(has_letter(F.col(text)), guess(F.col(text))).otherwise(none)


@query("op6_byte_bigru")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs)
    guessed = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), identify(docs, net).alias("guess"))
    return guessed.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))
