"""The stored workload catalog: hash buckets of names, rewritten only where a name changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from poolsight.operators import ledger
from poolsight.sources import versions, workspace

BUCKET = "bucket"


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def create(spark: SparkSession, root: str, schema: StructType) -> versions.Table:
    """A store without rows; `schema` is that of the workloads."""
    return versions.create(spark, root, StructType([*schema.fields]).add(BUCKET, IntegerType()), BUCKET)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The workloads of the newest commit; a frame taken before a later commit keeps its own."""
    return versions.read(spark, versions.latest(spark, root)).drop(BUCKET)


def upsert(spark: SparkSession, root: str, source: DataFrame, buckets: int, owner: str | None = None) -> versions.Table:
    """Insert or update by name, never delete, and commit at once: `ledger.upsert_by_name` on stored rows.

    `buckets` must be the same at every call; size it so that a bucket of rows fits a task. Only buckets that
    hold a name whose stored row differs from the source's are rewritten, so a repeated sync writes and
    commits nothing. Names are unique in the source; a null name matches nothing and is inserted each time.
    When another writer commits first, the merge is done again on its result.
    """

    # read three times below: written once, so that it is computed once and is the same each time
    placed = workspace.materialise(source.withColumn(BUCKET, bucket_of(F.col("name"), buckets)), "upsert-source")

    def step(base: versions.Table) -> versions.Table:
        hit = _folders(placed, base)
        changed = _changed(placed, versions.read(spark, base, hit), owner)
        touched = _folders(changed, base)
        if not touched:
            return base
        # every source row of a touched bucket is merged; unchanged ones come out as they were
        mine = placed.filter(F.col(BUCKET).isin([int(value.split("=")[1]) for value in touched]))
        target = versions.read(spark, base, touched)
        merged = ledger.upsert_by_name(target.drop(BUCKET), mine.drop(BUCKET), owner)
        merged = merged.withColumn(BUCKET, bucket_of(F.col("name"), buckets)).hint("rebalance", BUCKET)
        staged = versions.stage(merged, base)
        return versions.commit(spark, base, {value: staged.get(value, []) for value in touched})

    return versions.retry(spark, root, step)


def _folders(rows: DataFrame, table: versions.Table) -> list[str]:
    """Folders of the buckets that occur, at most as many as there are buckets."""
    return [f"{table.key}={row[0]}" for row in rows.select(BUCKET).distinct().collect()]


def _changed(source: DataFrame, target: DataFrame, owner: str | None) -> DataFrame:
    """Source rows without an equal stored row; id and created_* are the stored row's own and don't count."""
    fields = [c for c in source.columns if c not in ("id", "created_by", "created_at", "name", BUCKET)]
    matchable = target if owner is None else target.filter(F.col("created_by") == owner)
    stored = matchable.select(*[F.col(c).alias(f"__{c}") for c in ("name", *fields)])
    same = [F.col("name") == F.col("__name"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fields]]
    return source.join(stored, same, "left_anti")
