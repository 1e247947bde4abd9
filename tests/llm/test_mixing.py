import hashlib
import math
from collections import Counter

from cases import documents, nothing
from pyspark.sql import functions as F

from poolsight.llm.mixing import poisson_mix


def count_by_hand(name, rate, seed=7):
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{name}|{part}".encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate / parts, 0
        term = cdf = math.exp(-mean)
        while cdf <= u and k < 94:
            k += 1
            term = term * mean / k
            cdf += term
        total += k
    return total


def test_counts_are_the_inverse_at_hashed_numbers(spark):
    docs = documents(spark).withColumns({c: F.lit("theirs") for c in ("copy", "repeats", "repeat_rate", "shuffle_key")})
    rows = poisson_mix(docs, {"b": 40, None: 1}, default_weight=2, epochs=3.0).collect()
    per_source = Counter(r["source"] for r in docs.collect())
    weights = {s: {"b": 40, None: 1}.get(s, 2) for s in per_source}
    expected = Counter()
    for r in docs.collect():
        rate = 3.0 * sum(per_source.values()) * weights[r["source"]] / (sum(weights.values()) * per_source[r["source"]])
        name = r["doc_id"] if r["doc_id"] is not None else "text:" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        expected[(r["doc_id"], r["text"])] += count_by_hand(name, rate)
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got == +expected
    assert all(1 <= r["__copy"] <= r["__repeats"] for r in rows)
    assert {r[c] for r in rows for c in ("copy", "repeats", "repeat_rate", "shuffle_key")} == {"theirs"}


def test_large_rates_keep_their_mean(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    n = poisson_mix(docs, epochs=50.0).count()
    assert abs(n - 20_000) < 5 * math.sqrt(20_000)


def test_order_is_shuffled_and_repeatable(spark):
    docs = documents(spark)
    first = poisson_mix(docs).select("doc_id", "__copy", "__shuffle_key").orderBy("__shuffle_key").collect()
    again = poisson_mix(docs.repartition(7)).select("doc_id", "__copy", "__shuffle_key").orderBy("__shuffle_key").collect()
    assert Counter(first) == Counter(again)
    ids = [r["doc_id"] for r in first if r["doc_id"] is not None]
    assert ids != sorted(ids)


def test_nothing_and_no_weight(spark):
    assert poisson_mix(nothing(spark)).collect() == []
    assert poisson_mix(documents(spark), default_weight=0).collect() == []
