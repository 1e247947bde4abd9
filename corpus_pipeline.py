"""A corpus pipeline of five operators: reject, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; between stages
`run` writes Parquet and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import table
from poolsight.llm.decontamination import decontaminate, drop_contaminated
from poolsight.llm.jaccard import keep_one, ngram_jaccard_join
from poolsight.llm.mixing import poisson_mix
from poolsight.llm.quality import THRESHOLD, quality_score, train
from poolsight.llm.sharding import shard_records
from poolsight.llm.storage import materialise

#: Words to a shingle and per cent of similarity of the near-duplicate stage; shards of the last.
NEAR_WORDS, NEAR_PERCENT, SHARDS = 5, 80, 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at the threshold or above stay.

    Null and empty texts get a score like any other; repeated rows and null ids are judged each. An empty table
    stays empty. Only doc_id, text and n_chars are read, so other columns may have any name.
    """
    machine = train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(docs, machine) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of the Jaccard join connect, the document of the least id stays.

    Documents without words have no links and stay. Of rows that repeat id and text one stays, since they
    are copies of each other. An empty table stays empty; all columns are kept.
    """
    return keep_one(docs, ngram_jaccard_join(docs, NEAR_WORDS, NEAR_PERCENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null and wordless texts hold nothing and stay; repeated rows go or stay alike; an empty table or benchmark
    drops nothing. All columns are kept, whatever their names.
    """
    return drop_contaminated(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as their source's weight asks, in a new global order.

    A null source is a source; repeated rows draw alike and each keeps its copies; an empty table stays empty.
    """
    return poisson_mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there.

    Null texts have size 1; equal texts share a range unless it is overfull. An empty table stays empty. The
    added columns `size`, `shard` and `slot` take the place of columns of these names.
    """
    placed = shard_records(docs, SHARDS)
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    return placed.select(*kept, F.col("__size").alias("size"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
