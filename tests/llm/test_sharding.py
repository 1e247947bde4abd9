import zlib
from collections import defaultdict

import pytest
from cases import documents, nothing
from pyspark.sql import functions as F

from poolsight.llm import sharding
from poolsight.llm.sharding import shard_records, shard_report


def check(rows, shards):
    sizes, slots = [0] * shards, defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_bytes_are_even_and_slots_have_no_gaps(spark, shards):
    docs = documents(spark, rows=300).filter("doc_id is null or doc_id < 4000")
    placed = shard_records(docs.withColumn("shard", F.lit("theirs")), shards)
    rows = placed.select("text", F.col("__size").alias("size"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot")).collect()
    assert len(rows) == docs.count()
    check(rows, shards)
    assert {r[0] for r in placed.select("shard").distinct().collect()} == {"theirs"}


def test_one_text_holds_most_rows(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    report = shard_records(docs, 8)
    rows = report.select("text", F.col("__size").alias("size"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot")).collect()
    check(rows, 8)


def test_overfull_ranges_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 1)
    keys = spark.range(5000).select(
        F.when(F.col("id") < 10, 100_000).otherwise(1).cast("long").alias("__size"), (F.col("id") % 7).alias("__h"), F.col("id").alias("__id")
    )
    splitters, totals = sharding.sampled_splitters(keys, 64)
    assert sum(b for b, _ in totals) == 10 * 100_000 + 4990 and sum(n for _, n in totals) == 5000
    assert splitters == sorted(set(splitters)) and len(totals) == len(splitters) + 1


def test_report_of_repeated_rows_and_nothing(spark):
    rows = shard_report(documents(spark), 16).collect()
    assert len(rows) == documents(spark).count()
    by = {(r["doc_id"], r["size"]): r["text_crc32"] for r in rows}
    assert by[(3000, 1)] == 0 and by[(3003, 4)] == zlib.crc32(b"one")
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert shard_report(nothing(spark), 16).collect() == []
