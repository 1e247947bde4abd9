"""Identity that changes while a run lives, stamped on telemetry as of each record's own time.

Records and changes are both streams and may come in any order. A batch first keeps its changes, then stamps its
records with all changes known by then. A change that comes after records it concerns has the parts that
hold them rewritten, and no others. So after draining the table equals a batch lookup over all rows, however
late a record or a change was, and nothing is held in state or dropped by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from poolsight.operators import telemetry
from poolsight.sources import versions
from poolsight.streaming.jobs import COMPACT_EVERY, trigger_of

STAMPS = ("requester", "team")
#: What a record said of itself is kept beside the stamp, so that it can be stamped anew.
OWN = "__own_"
#: Order of rows inside a file; a lookup by time skips row groups.
CLUSTERED_BY = ("time", "run_id")


def stamp_versions(
    records: DataFrame, changes: DataFrame, out: str, checkpoint: str, drain: bool = False, every: int = COMPACT_EVERY, target_bytes: int = 256 << 20
) -> StreamingQuery:
    """Append records (run_id, time, ...) with the requester and team in force at their time to a dated table.

    `changes` is a stream of (run_id, changed_at, requester, team); see `telemetry.stamp_as_of` for nulls and ties.
    Each batch is one commit of the records and one, before it, of the changes; a batch replayed after a failure
    is not added twice. After `every` batches small files are packed. A batch reads the changes of its
    own runs and, if it brings changes, the stored rows from the earliest of them on. A column `date` of the
    records is replaced by the date of `time`. One query must write a table, as its batches follow each other.
    """
    spark = records.sparkSession
    shaped, told = _with_own(records), _dated(changes.select("run_id", "changed_at", *STAMPS), "changed_at")
    versions.create(spark, _changes(out), told.schema, "date")
    versions.create(spark, _records(out), shaped.schema, "date")
    feed = shaped.select(F.struct("*").alias("record"), F.lit(None).cast(_struct(told)).alias("change")).unionByName(
        told.select(F.lit(None).cast(_struct(shaped)).alias("record"), F.struct("*").alias("change"))
    )

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        new = batch.filter("record IS NOT NULL").select("record.*")
        fresh = batch.filter("change IS NOT NULL").select("change.*")
        history = versions.latest(spark, _changes(out))
        if number > history.done.get(stream, -1):
            history = versions.append(spark, _changes(out), versions.stage(fresh, history), {stream: number})
        known = versions.read(spark, history).drop("date")

        def step(base: versions.Table) -> versions.Table:
            if number <= base.done.get(stream, -1):
                return base
            stale = _stale_parts(spark, base, fresh, known)
            again = versions.located(spark, base, stale).drop("__folder")
            staged = [versions.stage(_clustered(_stamped(rows, known)), base) for rows in ([new, again] if stale else [new])]
            live = {
                value: [part for part in base.parts.get(value, []) if part.name not in stale] + [part for one in staged for part in one.get(value, [])]
                for value in {*base.parts, *(value for one in staged for value in one)}
            }
            return versions.commit(spark, base, live, {stream: number})

        versions.retry(spark, _records(out), step)
        if (number + 1) % every == 0:
            for table, order in ((_records(out), CLUSTERED_BY), (_changes(out), ("run_id", "changed_at"))):
                versions.compact(spark, table, order, target_bytes)
                versions.clean(spark, table)

    return trigger_of(feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), drain).start()


def read_stamped(spark: SparkSession, out: str) -> DataFrame:
    """The records of all whole batches so far, stamped with the changes of these batches."""
    table = versions.latest(spark, _records(out))
    return versions.read(spark, table).drop(*[OWN + name for name in STAMPS])


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """Every change so far."""
    return versions.read(spark, versions.latest(spark, _changes(out))).drop("date")


def _stale_parts(spark: SparkSession, base: versions.Table, fresh: DataFrame, known: DataFrame) -> set[str]:
    """Names of the parts with a row whose stamp the fresh changes alter; at most as many as the list has."""
    since = fresh.dropna(subset=["run_id", "changed_at"]).groupBy("run_id").agg(F.min("changed_at").alias("_since"))
    first = since.agg(F.min("_since").cast("string"), F.min(F.to_date("_since")).cast("string")).first()
    if first[0] is None:
        return set()
    moment = base.schema["time"].dataType
    earliest = F.lit(first[0]).cast(fresh.schema["changed_at"].dataType).cast(moment)
    # a folder of rows without a time comes after all dates and is left out: no change concerns them
    dates = [value for value in base.parts if f"date={first[1]}" <= value < "date=:"]
    rows = versions.located(spark, base, _names(base, dates)).filter(F.col("time") >= earliest)
    concerned = rows.join(since, "run_id").filter(F.col("time") >= F.col("_since").cast(moment))
    was = concerned.select("run_id", "time", "__folder", *[OWN + name for name in STAMPS], *[F.col(name).alias(f"_was_{name}") for name in STAMPS])
    changed = F.lit(False)
    for name in STAMPS:
        changed = changed | ~F.col(name).eqNullSafe(F.col(f"_was_{name}"))
    return {row[0] for row in _stamped(was, known).filter(changed).select("__folder").distinct().collect()}


def _names(base: versions.Table, dates: Iterable[str]) -> list[str]:
    return [part.name for value in dates for part in base.parts[value]]


def _stamped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Stamp from what the records said of themselves, whatever they were stamped with before."""
    bare = rows.withColumns({name: F.col(OWN + name) for name in STAMPS})
    return telemetry.stamp_as_of(bare, known)


def _with_own(records: DataFrame) -> DataFrame:
    own = {name: F.col(name).cast("string") if name in records.columns else F.lit(None).cast("string") for name in STAMPS}
    return _dated(records.withColumns({**own, **{OWN + name: value for name, value in own.items()}}), "time")


def _dated(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("date", F.to_date(at))


def _clustered(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "date").sortWithinPartitions("date", *CLUSTERED_BY)


def _struct(rows: DataFrame) -> str:
    return rows.schema.simpleString()


def _records(out: str) -> str:
    return f"{out}/records"


def _changes(out: str) -> str:
    return f"{out}/changes"
