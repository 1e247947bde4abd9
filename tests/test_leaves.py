"""Typed leaves of variants: equal answers, and the variant's bytes stay unread."""

import tempfile

import pytest
from pyspark.sql import functions as F

from poolsight.operators import telemetry as ops
from poolsight.sources import sinks
from poolsight.sources.leaves import Leaf, attribute, attribute_of, promote


@pytest.fixture(scope="module")
def logs(spark):
    """Attributes of some hundred bytes, most of them keys that are seldom seen."""
    rare = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit('"k'), ((F.col("id") * 7 + i * 31) % 400).cast("string"), F.lit('":"'), F.sha2(F.concat(F.col("id"), i), 256), F.lit('"')))
    run = F.when(F.col("id") % 7 == 0, "null").when(F.col("id") % 11 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit('"r'), (F.col("id") % 20).cast("string"), F.lit('"')))
    text = F.concat(F.lit(f'{{"{ops.RUN_KEY}":'), run, F.when(F.col("id") % 50 == 0, f',"{ops.REQUESTER_KEY}":"ann"').otherwise(""), F.lit(","), F.array_join(rare, ","), F.lit("}"))
    return spark.range(20000).select(
        F.timestamp_seconds(F.lit(1767225600) + F.col("id")).cast("timestamp_ntz").alias("time"), F.lit("svc").alias("service_name"), F.lit("INFO").alias("severity_text"),
        F.struct(F.when(F.col("id") % 13 != 0, F.parse_json(text)).alias("attributes")).alias("resource"),
        F.parse_json(F.lit('"line"')).alias("body"),
    ).withColumn("date", F.to_date("time"))


def stored(spark, logs, leaves=()):
    path = tempfile.mkdtemp(prefix="run-") + "/logs"
    sinks.write_telemetry(logs, path, leaves)
    return spark.read.parquet(path)


def bytes_read(spark, df):
    files = spark._jvm.org.apache.hadoop.fs.FileSystem
    before = sum(s.getBytesRead() for s in files.getAllStatistics())
    df.write.format("noop").mode("overwrite").save()
    return sum(s.getBytesRead() for s in files.getAllStatistics()) - before


def test_same_answers_and_a_fraction_of_the_bytes(spark, logs):
    # reads of several ranges at once are not counted by the file system's statistics
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    try:
        plain, leafy = stored(spark, logs), stored(spark, logs, ops.IDENTITY_LEAVES)
        for view in (ops.summary, ops.identity_view):
            assert view(plain).exceptAll(view(leafy)).count() == 0 == view(leafy).exceptAll(view(plain)).count()
        assert bytes_read(spark, ops.summary(leafy)) * 10 < bytes_read(spark, ops.summary(plain))
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")


def test_the_scan_reads_the_leaves_and_not_the_variant(spark, logs):
    leafy = stored(spark, logs, ops.IDENTITY_LEAVES)
    plan = ops.summary(leafy)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "leaf_resource_attributes_workload_run_id:string" in schema and "resource:" not in schema
    run = attribute_of(leafy, "resource.attributes", ops.RUN_KEY)
    filtered = leafy.filter(run == "r3").select("time")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(leaf_resource_attributes_workload_run_id,r3)" in filtered.split("PushedFilters: ")[1].split("\n")[0]


def test_other_keys_and_types_still_come_from_the_variant(spark, logs):
    leafy = stored(spark, logs, ops.IDENTITY_LEAVES)
    for key, as_type in (("k3", "string"), (ops.RUN_KEY, "bigint")):
        got = leafy.select("time", attribute_of(leafy, "resource.attributes", key, as_type).alias("v"))
        expected = logs.select("time", attribute("resource.attributes", key, as_type).alias("v"))
        assert got.exceptAll(expected).count() == 0 and got.filter("v IS NOT NULL").count() > 0


def test_clashing_names_and_empty_tables(spark, logs):
    with pytest.raises(ValueError):
        promote(logs, [Leaf("resource.attributes", "a.b"), Leaf("resource.attributes", "a_b")])
    mine = logs.withColumn(ops.IDENTITY_LEAVES[1].column, F.lit("mine"))
    assert promote(mine, ops.IDENTITY_LEAVES).filter(F.col(ops.IDENTITY_LEAVES[1].column) == "mine").count() == 0
    assert promote(logs.limit(0), ops.IDENTITY_LEAVES).count() == 0
    assert promote(logs, []).columns == logs.columns
