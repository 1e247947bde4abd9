"""Identity in force at a record's time: nulls, ties, hot runs, and streams in any order."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from poolsight.operators import telemetry as ops
from poolsight.sources import versions
from poolsight.streaming import identity

NOON = dt.datetime(2026, 3, 1, 12)
RECORDS = "n int, run_id int, time timestamp_ntz, requester string"
CHANGES = "run_id int, changed_at timestamp_ntz, requester string, team string"


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


def by_hand(records, changes):
    """Each record against every change of its run."""
    expected = set()
    for n, run, time, own in records:
        held = [c for c in changes if None not in (run, time, c[0], c[1]) and c[0] == run and c[1] <= time]
        requester, team = max(((c[1], *((v is not None, v or "") for v in c[2:])) for c in held), default=(None, (False, ""), (False, "")))[1:]
        expected.add((n, own or requester[1] or None, team[1] or None))
    return expected


def rows(df):
    return sorted((r.n, r.requester, r.team) for r in df.select("n", "requester", "team").collect())


def made_up(seed, records=3000, changes=400):
    draw = random.Random(seed)
    times = [at(draw.randrange(-3000, 3000)) for _ in range(200)]
    # run 1 holds a third of all records and most changes
    runs = [1, 1, 1, 2, 3, 4, 5, 6, None]
    told = [(draw.choice(runs), draw.choice([*times, None]), draw.choice(["a", "b", "c", None]), draw.choice(["x", "y", None])) for _ in range(changes)]
    sent = [(n, draw.choice(runs), draw.choice([*times, None]), draw.choice(["self", None, None])) for n in range(records)]
    return sent, told


def test_a_change_at_noon_splits_the_day(spark):
    records = spark.createDataFrame([(1, 7, at(-1), None), (2, 7, at(0), None), (3, 7, at(1), "self"), (4, 8, at(1), None)], RECORDS)
    changes = spark.createDataFrame([(7, at(-90), "ann", "red"), (7, at(0), "bo", "blue")], CHANGES)
    assert rows(ops.stamp_as_of(records, changes)) == [(1, "ann", "red"), (2, "bo", "blue"), (3, "self", "blue"), (4, None, None)]


def test_against_every_pair_with_nulls_and_ties(spark):
    sent, told = made_up(1)
    got = ops.stamp_as_of(spark.createDataFrame(sent, RECORDS), spark.createDataFrame(told, CHANGES))
    assert rows(got) == sorted(by_hand(sent, told), key=lambda r: r[0])


def test_repeated_rows_stay_and_empty_tables_give_none(spark):
    records = spark.createDataFrame([(1, 7, at(1), None)] * 3, RECORDS)
    changes = spark.createDataFrame([(7, at(0), "bo", "blue")] * 2, CHANGES)
    assert rows(ops.stamp_as_of(records, changes)) == [(1, "bo", "blue")] * 3
    assert rows(ops.stamp_as_of(records, changes.limit(0))) == [(1, None, None)] * 3
    assert rows(ops.stamp_as_of(records.limit(0), changes)) == []


def test_a_hot_run_is_no_single_task(spark):
    records = spark.range(20000).select(F.col("id").alias("n"), F.lit(1).alias("run_id"), (F.lit(NOON) + F.make_dt_interval(secs=F.col("id"))).alias("time"))
    changes = spark.createDataFrame([(1, at(m), f"r{m}", "t") for m in range(300)], CHANGES)
    stamped = ops.stamp_as_of(records, changes)
    assert stamped.filter("requester <> concat('r', least(cast(n div 60 as int), 299))").count() == 0
    plan = stamped._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


class Place:
    """Folders of one stream, its records and its changes."""

    def __init__(self, spark):
        base = tempfile.mkdtemp(prefix="run-")
        self.spark, self.out, self.checkpoint = spark, f"{base}/out", f"{base}/checkpoint"
        self.sources = {"records": (f"{base}/records", RECORDS), "changes": (f"{base}/changes", CHANGES)}
        for path, schema in self.sources.values():
            spark.createDataFrame([], schema).write.parquet(path)

    def add(self, name, values):
        path, schema = self.sources[name]
        self.spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(path)

    def drain(self, files=1000, **options):
        streams = [self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path) for path, schema in self.sources.values()]
        query = identity.stamp_versions(*streams, self.out, self.checkpoint, drain=True, **options)
        query.awaitTermination()
        return query

    def stamped(self):
        return identity.read_stamped(self.spark, self.out)


def test_late_records_and_late_changes_are_stamped_by_their_time(spark):
    place = Place(spark)
    place.add("changes", [(7, at(-90), "ann", "red")])
    place.add("records", [(1, 7, at(-1), None), (2, 7, at(5), None), (3, 7, None, None)])
    place.drain()
    assert rows(place.stamped()) == [(1, "ann", "red"), (2, "ann", "red"), (3, None, None)]
    # the change of noon comes after a record it concerns; the next record is late and older than the change
    place.add("changes", [(7, at(0), "bo", "blue")])
    place.drain()
    place.add("records", [(4, 7, at(-2), None), (5, 7, at(9), "self")])
    place.drain()
    assert rows(place.stamped()) == [(1, "ann", "red"), (2, "bo", "blue"), (3, None, None), (4, "ann", "red"), (5, "self", "blue")]


def test_a_change_rewrites_only_parts_it_alters(spark):
    place = Place(spark)
    place.add("records", [(1, 7, at(0), None), (2, 7, at(-3000), None)])
    place.drain()
    place.add("records", [(3, 8, at(0), None)])
    place.drain()
    before = versions.latest(spark, place.out + "/records").parts
    place.add("changes", [(7, at(-5), "bo", "blue")])
    place.drain()
    after = versions.latest(spark, place.out + "/records").parts
    old, new = ({part.name for parts in table.values() for part in parts} for table in (before, after))
    assert len(old) == 3 and len(old & new) == 2
    # the same identity told again alters nothing
    place.add("changes", [(7, at(1), "bo", "blue")])
    place.drain()
    assert {part.name for parts in versions.latest(spark, place.out + "/records").parts.values() for part in parts} == new


def test_any_order_of_batches_gives_the_batch_result(spark):
    sent, told = made_up(2, 400, 60)
    place = Place(spark)
    for start in range(4):
        place.add("records", sent[start::4])
        place.add("changes", told[start::4])
    query = place.drain(files=1, every=2)
    assert len(query.recentProgress) > 3
    assert rows(place.stamped()) == sorted(by_hand(sent, told), key=lambda r: r[0])
    assert identity.read_changes(spark, place.out).count() == len(told)


def test_a_replayed_batch_is_not_added_twice(spark, monkeypatch):
    place = Place(spark)
    place.add("records", [(1, 7, at(5), None)])
    place.add("changes", [(7, at(0), "bo", "blue")])
    commit, fails = versions.commit, [True]

    def failing(spark, base, parts, done=None):
        made = commit(spark, base, parts, done)
        if base.root.endswith("/records") and fails and fails.pop():
            raise OSError("lost after its commit")
        return made

    monkeypatch.setattr(versions, "commit", failing)
    try:
        place.drain()
    except Exception as lost:
        assert "lost after its commit" in str(lost)
    place.drain()
    assert rows(place.stamped()) == [(1, "bo", "blue")]
    assert identity.read_changes(spark, place.out).count() == 1
