"""Run ledger, capacity and fair share (family B).

The ledger is one join of runs and workloads; every capacity figure is one aggregate over
it, joined back by shape or team. The reference tables of teams and shapes are small by
nature, but no broadcast is forced: the planner checks their size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolsight.functions import ledger as L
from poolsight.operators import ordering

# Shapes always offered beside the reserved one.
OFFERED_SHAPES = ("GPU_1xA10", "GPU_1xH100")


@dataclass(frozen=True)
class Reservation:
    total_nodes: int
    gpus_per_node: int = 8
    accelerator_type: str = "GPU_8xH100"
    region: str = ""


WORKLOAD_COLUMNS = ("team", "use_case", "name", "shape", "nodes", "kind", "ref", "needs_torch")


def runs_with_workloads(runs: DataFrame, workloads: DataFrame) -> DataFrame:
    details = workloads.select(F.col("id").alias("workload_id"), *WORKLOAD_COLUMNS)
    return runs.join(details, "workload_id")


def runs_in_state(ledger: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    return ledger.filter(L.state_in(states))


def my_runs(ledger: DataFrame, user: str, teams: Sequence[str]) -> DataFrame:
    """Runs the user asked for or whose team the user is in, marked active or past."""
    mine = (F.col("requested_by") == user) | F.col("team").isin(*teams)
    section = F.when(L.state_in(L.ACTIVE_STATES), "active").otherwise("past")
    return ledger.filter(mine).withColumn("section", section)


def workloads_of_teams(workloads: DataFrame, teams: Sequence[str] | None = None) -> DataFrame:
    """An empty list means no filter."""
    return workloads.filter(F.col("team").isin(*teams)) if teams else workloads


def active_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest active runs first; planned as a top-k, so each task keeps only `limit` rows."""
    return runs.filter(L.state_in(L.ACTIVE_STATES)).orderBy("created_at", "id").limit(limit)


def membership_gate(
    requests: DataFrame, members: DataFrame, use_cases: DataFrame | None = None
) -> DataFrame:
    """Add `allowed` and `reason` to requests (principal, team[, use_case]); team null = no workload.

    Membership is deduplicated before each lookup, so a request never fans out.
    """
    listed = members.select(F.lower("member").alias("_who"), F.col("team").alias("_team")).distinct()
    anyone = listed.select(F.col("_who").alias("_any")).distinct()
    who = F.lower("principal")
    gated = requests.join(anyone, who == F.col("_any"), "left").join(
        listed, (who == F.col("_who")) & (F.col("team") == F.col("_team")), "left"
    )
    reason = (
        F.when(F.col("team").isNull(), "workload_not_found")
        .when(F.col("_any").isNull(), "read_only")
        .when(F.col("_who").isNull(), "not_a_member")
    )
    if use_cases is not None:
        cases = use_cases.select(F.col("team").alias("_ct"), F.col("use_case").alias("_case")).distinct()
        gated = gated.join(
            cases, (F.col("team") == F.col("_ct")) & (F.col("use_case") == F.col("_case")), "left"
        )
        reason = reason.when(F.col("_case").isNull(), "not_a_use_case")
    return gated.select(
        *requests.columns, reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("ok")).alias("reason")
    )


def in_flight_nodes(ledger: DataFrame, by: Sequence[str] = ("shape", "team")) -> DataFrame:
    held = runs_in_state(ledger, L.HOLDING_STATES)
    return held.groupBy(*by).agg(F.sum("nodes").cast("bigint").alias("in_flight"))


def shape_set(workloads: DataFrame, reservation: Reservation) -> DataFrame:
    """Distinct shapes: those in use, the reserved one and the ones always offered."""
    fixed = F.array(*[F.lit(s) for s in (reservation.accelerator_type, *OFFERED_SHAPES)])
    offered = workloads.sparkSession.range(1).select(F.explode(fixed).alias("shape"))
    return workloads.select("shape").distinct().union(offered).distinct()


def shape_capacity(
    shapes: DataFrame, ledger: DataFrame, reservation: Reservation, quotas: Mapping[str, int]
) -> DataFrame:
    """Quota, reserved nodes, nodes in flight and nodes admittable now, per shape."""
    used = in_flight_nodes(ledger, ["shape"])
    return _with_capacity(shapes.join(used, "shape", "left"), reservation, quotas)


def _with_capacity(counted: DataFrame, reservation: Reservation, quotas: Mapping[str, int]) -> DataFrame:
    """Capacity figures beside `shape` and its nodes in flight."""
    quota = F.lit(0)
    for shape, nodes in quotas.items():
        quota = F.when(F.col("shape") == shape, nodes).otherwise(quota)
    reserved = F.when(F.col("shape") == reservation.accelerator_type, reservation.total_nodes).otherwise(0)
    figures = counted.select(
        *[c for c in counted.columns if c != "in_flight"],
        quota.cast("bigint").alias("platform_quota_nodes"),
        reserved.cast("bigint").alias("reserved_nodes"),
        F.coalesce("in_flight", F.lit(0)).cast("bigint").alias("in_flight"),
    )
    free = L.admittable([F.col("platform_quota_nodes"), F.col("reserved_nodes")], F.col("in_flight"))
    return figures.withColumn("admittable", free)


def team_headroom(asked: DataFrame, teams: DataFrame, ledger: DataFrame) -> DataFrame:
    """Quota minus nodes in flight for each asked team; an unknown team has none."""
    used = in_flight_nodes(ledger, ["team"])
    known = asked.select("team").distinct().join(teams.select("team", "quota_nodes"), "team", "left")
    room = F.col("quota_nodes") - F.coalesce("in_flight", F.lit(0))
    return known.join(used, "team", "left").select(
        "team", F.greatest(F.lit(0), F.coalesce(room, F.lit(0))).cast("bigint").alias("headroom")
    )


def _with_share_ratio(df: DataFrame, teams: DataFrame, ledger: DataFrame) -> DataFrame:
    used = in_flight_nodes(ledger, ["team"]).withColumnRenamed("in_flight", "_used")
    ratio = F.coalesce("_used", F.lit(0)) / F.nullif(F.greatest("quota_nodes", F.lit(0)), F.lit(0))
    rated = df.join(teams.select("team", "quota_nodes"), "team", "left").join(used, "team", "left")
    return rated.withColumn("share_ratio", F.coalesce(ratio, F.lit(L.NO_QUOTA_RATIO))).drop("quota_nodes", "_used")


def share_ratios(asked: DataFrame, teams: DataFrame, ledger: DataFrame) -> DataFrame:
    """Nodes in flight over quota, over all shapes; no quota or unknown team sorts last."""
    return _with_share_ratio(asked.select("team").distinct(), teams, ledger)


def fair_share_rank(ledger: DataFrame, teams: DataFrame) -> DataFrame:
    """Queue position per shape by (share ratio, run id).

    The order is kept per shape because capacity is per shape; a null shape is a shape. A hot shape
    is counted range by range.
    """
    queued = runs_in_state(ledger, ["QUEUED"]).select("id", "shape", "team", "nodes")
    rated = _with_share_ratio(queued, teams, ledger)
    return ordering.positions(rated, ["share_ratio", "id"], ["shape"], "queue_position")


def fits_now(
    ledger: DataFrame, teams: DataFrame, reservation: Reservation, quotas: Mapping[str, int]
) -> DataFrame:
    """Each queued run against free nodes of its shape and room of its team, taken alone.

    One aggregate by shape and team, over queued and holding runs, gives the team's room and, summed
    over the few teams of a shape, the shape's free nodes.
    """
    queued = runs_in_state(ledger, ["QUEUED"]).select("id", "shape", "team", "nodes")
    held = F.coalesce(F.sum(F.when(L.state_in(L.HOLDING_STATES), F.col("nodes"))), F.lit(0)).cast("bigint")
    counted = runs_in_state(ledger, ["QUEUED", *L.HOLDING_STATES]).groupBy("shape", "team").agg(held.alias("_held"))
    counted = counted.withColumn("in_flight", F.sum("_held").over(Window.partitionBy("shape")))
    free = _with_capacity(counted, reservation, quotas).select(
        F.col("shape").alias("_of_shape"), F.col("team").alias("_of_team"), "_held", "admittable"
    )
    room = F.coalesce(F.col("quota_nodes") - F.col("_held"), F.lit(0))
    return (
        queued.join(free, ordering.same(["shape", "team"], "_of_"))
        .join(teams.select("team", "quota_nodes"), "team", "left")
        .select("id", "shape", "team", "nodes", "admittable", room.cast("bigint").alias("team_room"))
        .withColumn(
            "fits", (F.col("admittable") >= F.col("nodes")) & (F.col("team_room") >= F.col("nodes"))
        )
    )


def allocation_summary(teams: DataFrame, reservation: Reservation) -> DataFrame:
    allocated = F.coalesce(F.sum("quota_nodes"), F.lit(0)).cast("bigint")
    nodes = F.lit(reservation.total_nodes).cast("bigint")
    return teams.agg(
        nodes.alias("reserved_nodes"),
        (nodes * reservation.gpus_per_node).alias("gpus"),
        allocated.alias("allocated_nodes"),
        (nodes - allocated).alias("unallocated_nodes"),
    )


def team_overview(
    teams: DataFrame, members: DataFrame, use_cases: DataFrame, ledger: DataFrame, reservation: Reservation
) -> DataFrame:
    """Quota, nodes in flight on the reserved shape, member count and use cases per team.

    The use-case list comes from config, so the collected array is bounded by the config size.
    """
    reserved = ledger.filter(F.col("shape") == reservation.accelerator_type)
    heads = members.groupBy("team").agg(F.count("member").alias("members"))
    cases = use_cases.groupBy("team").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "use_case"))), lambda c: c.use_case), ", "
        ).alias("use_cases")
    )
    return (
        teams.select("team", "quota_nodes")
        .join(in_flight_nodes(reserved, ["team"]), "team", "left")
        .join(heads, "team", "left")
        .join(cases, "team", "left")
        .select(
            "team",
            F.col("quota_nodes").cast("bigint").alias("quota_nodes"),
            F.coalesce("in_flight", F.lit(0)).cast("bigint").alias("in_flight"),
            F.coalesce("members", F.lit(0)).alias("members"),
            F.coalesce("use_cases", F.lit("")).alias("use_cases"),
        )
    )


def run_state_map(polls: DataFrame) -> DataFrame:
    """Ledger state and clipped detail for each poll (life, result, message, state)."""
    state = L.ledger_state(F.col("life"), F.col("result"), F.col("state"))
    finished = L.is_terminal(F.col("life"))
    return polls.select(
        "seq",
        "run_id",
        state.alias("state"),
        F.when(finished, L.clipped_detail(F.col("message"))).alias("detail"),
        finished.alias("finished"),
    )


def fold_polls(polls: DataFrame, by: str = "run_id") -> DataFrame:
    """State of each run after all its polls: the first terminal poll settles it for good.

    Written as order-free aggregates, so the same fold runs on a batch, on a stream, and with
    map-side combination for a run that holds a large share of the polls.
    """
    settled_seq = F.when(L.is_terminal(F.col("life")), F.col("seq"))
    # The state travels as its index: text in the buffer would force a sort-based aggregate.
    index = F.when(F.col("result") == "SUCCESS", 0).when(F.col("result") == "CANCELED", 1).otherwise(2)
    running = F.max((F.col("life") == "RUNNING").cast("int")) == 1
    folded = polls.groupBy(by).agg(
        F.min_by(index, settled_seq).alias("_index"),
        F.min_by("ts", settled_seq).alias("finished_at"),
        F.min(settled_seq).alias("settled_seq"),
        running.alias("_running"),
        F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("polls"),
    )
    return _named_states(folded, by)


def merge_folds(folds: DataFrame, by: str = "run_id") -> DataFrame:
    """Fold of folds: rows of `fold_polls` over parts of the polls give the fold over all of them."""
    index = F.array_position(F.array(*[F.lit(s) for s in L.TERMINAL_STATES]), F.col("state")) - 1
    merged = folds.groupBy(by).agg(
        F.min_by(index, "settled_seq").alias("_index"),
        F.min_by("finished_at", "settled_seq").alias("finished_at"),
        F.min("settled_seq").alias("settled_seq"),
        (F.max((F.col("state") == "RUNNING").cast("int")) == 1).alias("_running"),
        F.max("last_seq").alias("last_seq"),
        F.sum("polls").alias("polls"),
    )
    return _named_states(merged, by)


def _named_states(folded: DataFrame, by: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in L.TERMINAL_STATES])
    settled = F.get(names, F.col("_index").cast("int"))
    return folded.select(
        by,
        F.coalesce(settled, F.when(F.col("_running"), "RUNNING"), F.lit("SUBMITTED")).alias("state"),
        "finished_at",
        "settled_seq",
        "last_seq",
        "polls",
    )


def upsert_by_name(target: DataFrame, source: DataFrame, owner: str | None = None) -> DataFrame:
    """Insert or update workloads by name, never delete.

    A matched row keeps its id and created_* and takes every other field from the source. With
    `owner`, only rows created by it may match (others pass through and the source inserts).
    One full outer join, so it needs no table format with MERGE.
    """
    kept = ["id", "created_by", "created_at"]
    fields = [c for c in target.columns if c not in (*kept, "name")]
    matchable = target if owner is None else target.filter(F.col("created_by") == owner)
    t, s = matchable.alias("t"), source.alias("s")
    found = F.col("s.name").isNotNull()
    merged = t.join(s, F.col("t.name") == F.col("s.name"), "full").select(
        *[F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) for c in kept],
        F.coalesce("t.name", "s.name").alias("name"),
        *[F.when(found, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in fields],
    )
    if owner is None:
        return merged.select(*target.columns)
    untouched = target.filter(~F.col("created_by").eqNullSafe(F.lit(owner)))
    return merged.unionByName(untouched).select(*target.columns)


def catalog_shadow(files: DataFrame) -> DataFrame:
    """One path per manifest: the live file if there is one, else its example."""
    example = F.col("path").contains(".example")
    return files.groupBy(L.manifest_key(F.col("path")).alias("key")).agg(
        F.coalesce(F.min(F.when(~example, F.col("path"))), F.max(F.when(example, F.col("path")))).alias("path")
    )


def live_manifests(files: DataFrame) -> DataFrame:
    """The files (path, ...) that no live twin shadows; decided on paths, before anything is parsed."""
    return files.join(catalog_shadow(files).select("path"), "path", "left_semi")


def catalog_entries(manifests: DataFrame, team: str) -> DataFrame:
    """Catalog rows from the parsed live manifests (see sources.files); those without a command are left out."""
    name = F.regexp_replace(L.manifest_key(F.col("path")), r"^[./]+", "").alias("name")
    stem = F.regexp_extract("path", r"([^/]+)\.yaml$", 1)
    hints = F.concat(F.array(stem), F.coalesce("include_paths", F.array().cast("array<string>")))
    shape = F.coalesce("accelerator_type", F.lit(""))
    return (
        manifests.filter(F.col("command").isNotNull())
        .select(
            name,
            F.lit("yaml").alias("kind"),
            F.col("path").alias("ref"),
            F.lit(team).alias("team"),
            L.use_case(hints).alias("use_case"),
            F.coalesce("accelerator_type", F.lit("GPU_1xA10")).alias("shape"),
            L.node_count(F.col("num_accelerators"), shape).alias("nodes"),
            L.needs_torch(F.col("command")).alias("needs_torch"),
            F.lit("repo").alias("source"),
        )
    )


def peak_concurrency(
    holds: DataFrame, start: str, end: str, by: Sequence[str] = (), known_cap: int | None = None
) -> DataFrame:
    """Most holds [start, end) active at once, per group.

    +1/-1 steps are first summed per instant (map-side), then run range by range, so a group with a
    third of all holds, or one dense hour of it, still spreads.
    """
    steps = holds.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
                F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    )
    net = steps.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("net"))
    running = ordering.running_totals(net, ["at"], {"active": "net"}, by)
    peak = F.coalesce(F.max("active"), F.lit(0)).cast("bigint")
    out = running.groupBy(*by).agg(peak.alias("peak"))
    if known_cap is None:
        return out
    return out.withColumn("cap", F.greatest(F.col("peak"), F.lit(known_cap).cast("bigint")))


def param_query(spark: SparkSession, text: str, args: Mapping[str, object], **views: DataFrame) -> DataFrame:
    """Run SQL with typed named parameters (`:name`) over given DataFrames (`{view}`)."""
    return spark.sql(text, args=dict(args), **views)
