"""Selection by histograms against sorting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from poolsight.operators import prep, selection


def chosen(df, order, cap, by=()):
    return selection.first_rows(df, order, {"kept": F.lit(cap), "half": F.ceil(F.col("_n") / 2)}, by).collect()


def check(rows, kept, order, cap):
    """The kept orders are the least ones, null first, as many as the rank says, for both ranks."""
    least = lambda n: sorted(((r[order] is not None, r[order]) if r[order] is not None else (False,)) for r in rows)[:n]
    for name, n in (("kept", cap), ("half", -(-len(rows) // 2))):
        got = sorted(((r[order] is not None, r[order]) if r[order] is not None else (False,)) for r in kept if r[name])
        assert got == least(n)


VALUES = {
    "bigint": lambda r: r.choice([r.randint(-(2**63), 2**63 - 1), r.randint(-50, 50), -(2**63), 2**63 - 1]),
    "int": lambda r: r.randint(-9, 9),
    "string": lambda r: "".join(r.choice("abé\U0001f600 ") for _ in range(r.randint(0, 12))),
    "date": lambda r: dt.date(1969, 1, 1) + dt.timedelta(days=r.randint(0, 900)),
    "timestamp_ntz": lambda r: dt.datetime(1969, 1, 1) + dt.timedelta(microseconds=r.randint(0, 10**14)),
    "double": lambda r: r.choice([r.uniform(-1e30, 1e30), r.uniform(-1, 1), 0.5]),
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_least_rows_of_any_type(spark, monkeypatch, kind):
    """With few intervals a step, ties, nulls and a hot group, every rank is exact."""
    monkeypatch.setattr(selection, "PARTS", 256)
    monkeypatch.setattr(selection, "FEW", 5)
    rng = random.Random(kind)
    rows = [(i, rng.choice(["hot"] * 8 + ["x", None]), None if rng.random() < 0.1 else VALUES[kind](rng)) for i in range(240)]
    rows += [(1000 + i, "hot", rows[3][2]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, g string, v {kind}")
    out = chosen(df, "v", 25, ["g"])
    assert sorted(r["id"] for r in out) == sorted(r[0] for r in rows)
    for g in ("hot", "x", None):
        mine = [r for r in out if r["g"] == g]
        check(mine, mine, "v", 25)


def test_one_group_all_alike_and_empty(spark):
    same = spark.range(5000).select(F.lit(7).alias("v"), F.lit("p").alias("kept_as_is"))
    out = chosen(same, "v", 1234)
    assert sum(r["kept"] for r in out) == 1234 and sum(r["half"] for r in out) == 2500
    assert chosen(same.limit(0), "v", 3) == []
    assert sum(r["kept"] for r in chosen(same, "v", 0)) == 0 and all(r["kept"] for r in chosen(same, "v", 5000))


def test_a_split_moves_no_rows(spark):
    """The rows' own columns reach no exchange: they are read, filtered by cuts and given out."""
    df = spark.range(50_000).select("id", (F.col("id") % 3).alias("g"), F.repeat(F.lit("long payload "), 20).alias("payload"))
    path = prep.workspace.fresh_path(spark, "rows")
    df.write.parquet(path)
    rows = spark.read.parquet(path)
    for out in (prep.split_train_test(rows, "id", 0.2, 0, "g", 0.15), prep.train_row_cap(rows, "id", 100, ["g"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert all("payload" not in line for line in moved) and "Window" not in plan and "SortMergeJoin" not in plan


def test_split_sizes_with_one_key_in_a_third_of_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("row"))
    split = prep.split_train_test(df, "k", 0.5, 1, validation_share=0.6).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("row").alias("d")).collect()
    assert {r["split"]: (r["n"], r["d"]) for r in split} == {"test": (15_000, 15_000), "validation": (9_000, 9_000), "train": (6_000, 6_000)}
