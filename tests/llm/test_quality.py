import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, nothing, words
from pyspark.sql import functions as F

from poolsight.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    """Prose is good; shouted, repeated and barred lines are not."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = words(rng, rng.randint(20, 200), 3000) + "."
        if not good:
            kind = rng.randrange(3)
            t = t.upper().replace(" ", "!! ") if kind == 0 else " ".join(x + " " + x + " " + x for x in t.split()) if kind == 1 else t.replace(" ", " | ")
        docs.append((i, t, "en", "a", len(t)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def slow_margin(m, at, index, value, row):
    ids, x = index[at[row] : at[row + 1]], value[at[row] : at[row + 1]].astype(float)
    out = m.bias + float((m.weights[ids] * x).sum())
    for i in range(len(ids)):
        for j in range(i):
            out += float(m.factors[ids[i]].astype(float) @ m.factors[ids[j]].astype(float)) * x[i] * x[j]
    return out


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    texts = pa.array(["a b c a", None, "", "X y | z!! é", "one " * 50])
    f = Q.features(texts, pa.array([7, None, 0, 3, -1]))
    n = f.stats.shape[1]
    size = Q.BUCKETS + n * Q.BINS
    m = Q.Machine(np.sort(rng.random((n, Q.BINS - 1)), axis=1), 0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, Q.RANK)).astype(np.float32))
    at, index, value = m.encode(f)
    got = m.margin(at, index, value)
    assert np.allclose(got, [slow_margin(m, at, index, value, i) for i in range(5)], atol=1e-3)
    assert len(m.score(Q.features(pa.array([], pa.string()), pa.array([], pa.int64())))) == 0


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(20)] + ["q" * 3_000_000, " ".join(f"u{i}" for i in range(300_000))]
    whole = Q.features(pa.array(texts), pa.array([1] * len(texts)))
    for i, t in enumerate(texts):
        own = Q.features(pa.array([t]), pa.array([1]))
        part = slice(whole.at[i], whole.at[i + 1])
        assert (own.buckets == whole.buckets[part]).all() and np.allclose(own.values, whole.values[part])
        assert np.allclose(own.stats[0], whole.stats[i])
    words_ = texts[3].split()
    assert np.isclose(whole.stats[3][Q.CLASSES + 2], len(set(words_)) / len(words_))


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    machine = Q.train(docs, labels, fit_rows=300)
    scored = docs.select("doc_id", Q.held_out(F.col("doc_id"), 5, 0).alias("out"), Q.quality_score(docs, machine).alias("s"))
    rows = scored.join(labels, "doc_id").filter("out").collect()
    good, bad = ([r["s"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 10 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r["s"] <= 1 for r in rows)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 150)
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs.repartition(5), turned.union(turned))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors) and a.bias == b.bias


@pytest.mark.parametrize("which", ["none", "one", "odd"])
def test_poor_labels(spark, which):
    docs, labels = corpus(spark, 60)
    labels = {"none": labels.limit(0), "one": labels.filter("quality = 1"), "odd": labels.select("doc_id", F.lit(None).cast("int").alias("quality"))}[which]
    machine = Q.train(docs, labels)
    scores = {r[0] for r in docs.select(Q.quality_score(docs, machine)).collect()}
    assert len(scores) == 1 and (which != "one" or scores.pop() > 0.9)


def test_awkward_rows_get_scores(spark):
    docs, labels = corpus(spark, 100)
    machine = Q.train(docs, labels)
    for odd in (documents(spark), documents(spark).drop("n_chars").withColumn("score", F.lit("theirs"))):
        rows = odd.select("doc_id", "text", Q.quality_score(odd, machine).alias("s")).collect()
        assert len(rows) == odd.count() and all(0 <= r["s"] <= 1 for r in rows)
    assert nothing(spark).select(Q.quality_score(nothing(spark), machine)).collect() == []


def test_the_bound_on_fitted_rows_holds_for_repeated_ids(spark, monkeypatch):
    """One id in a third of all rows: one of its rows is fitted on; other columns named like ours do not matter."""
    docs, labels = corpus(spark, 300)
    hot = labels.filter(~Q.held_out(F.col("doc_id"), 5, 0)).first()["doc_id"]
    copies = spark.range(3000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("copy "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    seen = []
    monkeypatch.setattr(Q, "fit", lambda f, label, weight: seen.append(len(label)) or Q.constant(0.5))
    clash = docs.union(copies).withColumns({"label": F.lit("theirs"), "read": F.lit(1), "stats": F.lit(2)})
    Q.train(clash, labels, fit_rows=50)
    Q.train(clash, labels, fit_rows=10_000)
    assert seen[0] <= 50 and seen[1] == labels.filter(~Q.held_out(F.col("doc_id"), 5, 0)).count()
