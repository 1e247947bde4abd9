"""Every query of the subpackage at the smallest size, against its oracle or its stated shape."""

import pytest
from pyspark.sql import functions as F

from poolsight.llm import registry
from tests.oracle import compare, connect

ROOT = "/root/testdata/sf0.001"
NATIVE = ("op5", "op8", "op10", "op11")


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, ROOT)
    if name.startswith(NATIVE):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
    if name in registry.ORACLES:
        assert compare(duck, df, registry.ORACLES[name]) is None
    elif name.startswith("op7"):
        assert df.count() == 10 * spark.read.parquet(f"{ROOT}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    else:
        rows = df.select("doc_id").collect()
        assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id").collect())


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_columns_of_the_contracts(spark):
    want = {
        "op2": "doc_id bigint, held_out boolean, score double, predicted int",
        "op6": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op7": "query_id bigint, rank int, vec_id bigint, score double",
        "op11": "page_id bigint, host string, path string, rule string, verdict string",
        "op12": "item_id bigint, rank int, doc_id bigint, score bigint",
        "op13": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    }
    for name, query in registry.QUERIES.items():
        if columns := want.get(name.split("_")[0]):
            assert ", ".join(" ".join(c) for c in query(spark, ROOT).dtypes) == columns


def test_held_out_folds(spark):
    from poolsight.llm.quality import held_out
    import zlib

    for r in spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("a"), held_out(F.col("id"), 4, 2).alias("b")).collect():
        crc = zlib.crc32(str(r["id"]).encode())
        assert (r["a"], r["b"]) == (crc % 5 == 0, crc % 4 == 2)
