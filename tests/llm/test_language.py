import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, nothing
from pyspark.sql import functions as F

from poolsight.llm import language as L

PARTS = {"xx": ["ka", "ro", "ti", "mu"], "yy": ["sch", "ei", "ung", "pf"], "zz": ["ção", "lh", "ês", "ado"]}


def corpus(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang, "s", None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b", "c"], 4)
    x, live, label = rng.integers(0, 256, (7, 3)).astype(np.uint8), np.ones((7, 3), np.float32), np.array([0, 2, 1])
    live[4:, 1] = 0
    _, grads = L.gradients(net, x, live, label)
    for value, grad in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = L.gradients(net, x, live, label)[0]
        value[at] = old - 1e-2
        down = L.gradients(net, x, live, label)[0]
        value[at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.03)


def test_positions_read_both_directions():
    net = L.new_network(["a", "b"], 4)
    x = np.array([[1], [2], [3], [4]], np.uint8)
    base = L.position_chances(net, x, None)
    for change in (0, 3):
        y = x.copy()
        y[change] = 200
        assert (np.abs(L.position_chances(net, y, None) - base).max(axis=(1, 2)) > 1e-7).all()


def by_hand(net, text, width):
    """One window at a time, one step at a time."""
    data, hidden = np.frombuffer(text.encode(), np.uint8), net.blend[0].shape[0]
    sig = lambda v: 1 / (1 + np.exp(-v))
    total = np.zeros(len(net.langs))
    for at in range(0, len(data), width):
        part = data[at : at + width]
        states = []
        for d in (0, 1):
            h, own = np.zeros(hidden), []
            for byte in part if d == 0 else part[::-1]:
                a = net.table[d][byte].astype(float)
                zr = sig(a[: 2 * hidden] + h @ net.gates[d])
                z, r = zr[:hidden], zr[hidden:]
                c = np.tanh(a[2 * hidden :] + (r * h) @ net.blend[d])
                h = h + z * (c - h)
                own.append(h)
            states.append(own if d == 0 else own[::-1])
        logits = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1) @ net.read + net.bias
        p = np.exp(logits)
        total += (p / p.sum(1, keepdims=True)).sum(0)
    return total / max(1, len(data))


def test_documents_pool_every_byte():
    net = L.new_network(["a", "b", "c"])
    texts = ["", None, "short", "é" * 77, "exactly " * 24, "x" * 1000, "one more byte " * 7]
    got = L.document_chances(net, pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, by_hand(net, t or "", L.WINDOW), atol=1e-4)


def test_learns_languages_apart(spark):
    docs = corpus(spark)
    net = L.train(docs)
    assert net.langs == sorted(PARTS)
    rows = docs.select("lang", L.held_out(F.col("doc_id"), 4, 2).alias("out"), L.identify(docs, net).alias("g")).filter("out").collect()
    assert np.mean([r["g"]["lang"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["g"]["score"] <= 1 for r in rows)
    again = L.train(docs.repartition(5))
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters(), strict=True))


def test_awkward_rows(spark):
    docs = corpus(spark, 60)
    net = L.train(docs)
    odd = documents(spark, extra=[(9000, "123 !!", "xx", "a", 1), (9001, "é", None, "a", 1)]).withColumn("score", F.lit("theirs"))
    rows = odd.select("doc_id", "text", L.identify(odd, net).alias("g")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["g"]["lang"] == "und") != letters and 0 <= r["g"]["score"] <= 1
    assert nothing(spark).select(L.identify(nothing(spark), net)).collect() == []
    silent = L.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0]["lang"] for r in docs.select(L.identify(docs, silent)).collect()} == {"und"}


def test_the_bound_on_fitted_documents_holds_for_copies(spark, monkeypatch):
    """A third of all rows are one row; the windows fitted on come from at most the bound's documents."""
    rows = [(i, f"text number {i} of some words", "en" if i % 2 else "de") for i in range(400)] + [(3, "one row again and again", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(L, "fit", lambda x, live, y, langs: seen.append(len(x)) or L.new_network(langs))
    L.train(docs, fit_docs=60)
    L.train(docs, fit_docs=100_000)
    assert seen[0] <= 60 and 290 <= seen[1] <= 401
