"""Family B queries: run ledger, capacity, catalog and inline SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.functions import ledger as L
from poolsight.operators import colocation
from poolsight.operators import ledger as ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.sources import files, sinks, workload_store, workspace

HELD = "state IN ('SUBMITTED', 'RUNNING')"
IN_FLIGHT = f"SELECT shape, team, CAST(SUM(nodes) AS BIGINT) AS in_flight FROM ledger WHERE {HELD} GROUP BY 1, 2"
SHAPES = """SELECT DISTINCT shape FROM workloads UNION SELECT 'GPU_8xH100' UNION SELECT 'GPU_1xA10' UNION SELECT 'GPU_1xH100'"""
CAPACITY = f"""SELECT s.shape, CAST(CASE WHEN s.shape = 'GPU_8xH100' THEN 4 ELSE 0 END AS BIGINT) AS platform_quota_nodes,
  CAST(CASE WHEN s.shape = 'GPU_8xH100' THEN 20 ELSE 0 END AS BIGINT) AS reserved_nodes, COALESCE(f.n, 0) AS in_flight,
  GREATEST(0, CASE WHEN s.shape = 'GPU_8xH100' THEN 4 ELSE 999 END - COALESCE(f.n, 0)) AS admittable
  FROM ({SHAPES}) s LEFT JOIN (SELECT shape, CAST(SUM(nodes) AS BIGINT) AS n FROM ledger WHERE {HELD} GROUP BY 1) f ON s.shape = f.shape"""
TEAM_USED = f"SELECT team, CAST(SUM(nodes) AS BIGINT) AS used FROM ledger WHERE {HELD} GROUP BY 1"
RATIO = f"""SELECT a.team, CASE WHEN COALESCE(quota_nodes, 0) <= 0 THEN 1e9 ELSE COALESCE(used, 0) / CAST(quota_nodes AS DOUBLE) END AS share_ratio
  FROM (SELECT DISTINCT team FROM workloads) a LEFT JOIN teams t ON a.team = t.team LEFT JOIN ({TEAM_USED}) u ON a.team = u.team"""


@query(
    "runs_workloads_join",
    "SELECT id, workload_id, requested_by, created_at, state, detail, team, use_case, name, shape, nodes, kind, ref, needs_torch FROM ledger",
)
def runs_workloads_join(spark, root):
    return B.ledger(spark, root)


@query("run_state_filter", f"SELECT id, state, team FROM ledger WHERE {HELD}")
def run_state_filter(spark, root):
    return ops.runs_in_state(B.ledger(spark, root), L.HOLDING_STATES).select("id", "state", "team")


@query(
    "my_runs_filter",
    """SELECT id, requested_by, team, state, CASE WHEN state IN ('QUEUED', 'SUBMITTED', 'RUNNING') THEN 'active' ELSE 'past' END AS section
  FROM ledger WHERE requested_by = 'Customer#000000101' OR team IN ('team-3', 'team-7')""",
)
def my_runs_filter(spark, root):
    mine = ops.my_runs(B.ledger(spark, root), "Customer#000000101", ["team-3", "team-7"])
    return mine.select("id", "requested_by", "team", "state", "section").orderBy(F.col("id").desc())


@query(
    "workloads_by_team",
    "SELECT id, team, use_case, name FROM workloads WHERE team IN ('team-1', 'team-2', 'team-25') ORDER BY team, use_case, id",
)
def workloads_by_team(spark, root):
    listed = ops.workloads_of_teams(B.workloads(spark, root), ["team-1", "team-2", "team-25"])
    return listed.select("id", "team", "use_case", "name").orderBy("team", "use_case", "id")


@query(
    "membership_gate",
    """SELECT r.id, r.requested_by AS principal, w.team, w.use_case,
  w.team IS NOT NULL AND m.member IS NOT NULL AND u.team IS NOT NULL AS allowed,
  CASE WHEN w.team IS NULL THEN 'workload_not_found' WHEN a.member IS NULL THEN 'read_only' WHEN m.member IS NULL THEN 'not_a_member'
       WHEN u.team IS NULL THEN 'not_a_use_case' ELSE 'ok' END AS reason
  FROM runs r LEFT JOIN workloads w ON w.id = r.workload_id + CASE WHEN r.id % 50 = 0 THEN 1000000000 ELSE 0 END
  LEFT JOIN (SELECT DISTINCT lower(member) AS member FROM members) a ON a.member = lower(r.requested_by)
  LEFT JOIN (SELECT DISTINCT lower(member) AS member, team FROM members) m ON m.member = lower(r.requested_by) AND m.team = w.team
  LEFT JOIN (SELECT DISTINCT team, use_case FROM use_cases) u ON u.team = w.team AND u.use_case = w.use_case""",
)
def membership_gate(spark, root):
    gone = F.when(F.col("id") % 50 == 0, 1000000000).otherwise(0)
    asked = B.runs(spark, root).select(
        "id", F.col("requested_by").alias("principal"), (F.col("workload_id") + gone).alias("workload_id")
    )
    wanted = B.workloads(spark, root).select(F.col("id").alias("workload_id"), "team", "use_case")
    requests = asked.join(wanted, "workload_id", "left").drop("workload_id")
    return ops.membership_gate(requests, B.members(spark, root), B.use_cases(spark, root))


@query("in_flight_nodes", IN_FLIGHT)
def in_flight_nodes(spark, root):
    return ops.in_flight_nodes(B.ledger(spark, root))


@query("shape_set_union", SHAPES)
def shape_set_union(spark, root):
    return ops.shape_set(B.workloads(spark, root), B.RESERVATION)


@query("shape_capacity", CAPACITY)
def shape_capacity(spark, root):
    shapes = ops.shape_set(B.workloads(spark, root), B.RESERVATION)
    return ops.shape_capacity(shapes, B.ledger(spark, root), B.RESERVATION, B.QUOTAS)


@query(
    "team_headroom",
    f"""SELECT a.team, CAST(GREATEST(0, COALESCE(quota_nodes - COALESCE(used, 0), 0)) AS BIGINT) AS headroom
  FROM (SELECT DISTINCT team FROM workloads) a LEFT JOIN teams t ON a.team = t.team LEFT JOIN ({TEAM_USED}) u ON a.team = u.team""",
)
def team_headroom(spark, root):
    return ops.team_headroom(B.workloads(spark, root), B.teams(spark, root), B.ledger(spark, root))


@query("share_ratio", RATIO)
def share_ratio(spark, root):
    return ops.share_ratios(B.workloads(spark, root), B.teams(spark, root), B.ledger(spark, root))


@query(
    "fair_share_rank",
    f"""SELECT id, shape, l.team, nodes, share_ratio, ROW_NUMBER() OVER (PARTITION BY shape ORDER BY share_ratio, id) AS queue_position
  FROM ledger l JOIN ({RATIO}) r ON l.team = r.team WHERE state = 'QUEUED'""",
)
def fair_share_rank(spark, root):
    return ops.fair_share_rank(B.ledger(spark, root), B.teams(spark, root))


@query(
    "fits_now",
    f"""SELECT id, l.shape, l.team, nodes, c.admittable, COALESCE(CAST(quota_nodes - COALESCE(f.in_flight, 0) AS BIGINT), 0) AS team_room,
  c.admittable >= nodes AND COALESCE(quota_nodes - COALESCE(f.in_flight, 0), 0) >= nodes AS fits
  FROM ledger l JOIN ({CAPACITY}) c ON c.shape = l.shape LEFT JOIN teams t ON t.team = l.team
  LEFT JOIN ({IN_FLIGHT}) f ON f.shape = l.shape AND f.team = l.team WHERE state = 'QUEUED'""",
)
def fits_now(spark, root):
    return ops.fits_now(B.ledger(spark, root), B.teams(spark, root), B.RESERVATION, B.QUOTAS)


@query(
    "allocation_summary",
    """SELECT CAST(20 AS BIGINT) AS reserved_nodes, CAST(160 AS BIGINT) AS gpus, CAST(SUM(quota_nodes) AS BIGINT) AS allocated_nodes,
  CAST(20 - SUM(quota_nodes) AS BIGINT) AS unallocated_nodes FROM teams""",
)
def allocation_summary(spark, root):
    return ops.allocation_summary(B.teams(spark, root), B.RESERVATION)


@query(
    "team_overview",
    f"""SELECT t.team, CAST(quota_nodes AS BIGINT) AS quota_nodes, COALESCE(f.n, 0) AS in_flight, COALESCE(m.n, 0) AS members, COALESCE(u.cases, '') AS use_cases
  FROM teams t LEFT JOIN (SELECT team, CAST(SUM(nodes) AS BIGINT) AS n FROM ledger WHERE {HELD} AND shape = 'GPU_8xH100' GROUP BY 1) f ON f.team = t.team
  LEFT JOIN (SELECT team, COUNT(*) AS n FROM members GROUP BY 1) m ON m.team = t.team
  LEFT JOIN (SELECT team, string_agg(use_case, ', ' ORDER BY pos) AS cases FROM use_cases GROUP BY 1) u ON u.team = t.team""",
)
def team_overview(spark, root):
    return ops.team_overview(
        B.teams(spark, root), B.members(spark, root), B.use_cases(spark, root), B.ledger(spark, root), B.RESERVATION
    )


@query(
    "limit_active",
    "SELECT id, state, created_at FROM runs WHERE state IN ('QUEUED', 'SUBMITTED', 'RUNNING') ORDER BY created_at, id LIMIT 100",
)
def limit_active(spark, root):
    return ops.active_runs(B.runs(spark, root)).select("id", "state", "created_at")


@query(
    "failure_classify",
    """SELECT job_run_id, result, message, CASE WHEN result IS NULL THEN 'unfinished' WHEN result = 'SUCCESS' THEN 'success'
  WHEN COALESCE(message, '') LIKE '%GPU quota%' THEN 'quota_refused' ELSE 'other_failed' END AS outcome FROM job_runs""",
)
def failure_classify(spark, root):
    from poolsight.operators import acceptance

    return acceptance.failure_classify(B.job_runs(spark, root))


@query(
    "node_count",
    """SELECT id, CAST(GREATEST(1, num_accelerators // CASE WHEN shape LIKE '%8x%' THEN 8 ELSE 1 END) AS INT) AS nodes FROM workloads""",
)
def node_count(spark, root):
    nodes = L.node_count(F.col("num_accelerators"), F.col("shape")).alias("nodes")
    return B.workloads(spark, root).select("id", nodes)


@query(
    "run_state_map",
    """SELECT seq, run_id, CASE WHEN life IN ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED') THEN CASE WHEN result IN ('SUCCESS', 'CANCELED') THEN result ELSE 'FAILED' END
  WHEN life = 'RUNNING' THEN 'RUNNING' ELSE state END AS state,
  CASE WHEN life IN ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED') THEN substr(message, 1, 400) END AS detail,
  life IN ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED') AS finished FROM run_polls""",
)
def run_state_map(spark, root):
    return ops.run_state_map(B.run_polls(spark, root))


FOLDED = """SELECT run_id,
  COALESCE(arg_min(final, seq) FILTER (WHERE final IS NOT NULL), CASE WHEN bool_or(life = 'RUNNING') THEN 'RUNNING' ELSE 'SUBMITTED' END) AS state,
  arg_min(ts, seq) FILTER (WHERE final IS NOT NULL) AS finished_at, MAX(seq) AS last_seq, COUNT(*) AS polls
  FROM (SELECT *, CASE WHEN life IN ('TERMINATED', 'INTERNAL_ERROR', 'SKIPPED') THEN CASE WHEN result IN ('SUCCESS', 'CANCELED') THEN result ELSE 'FAILED' END END AS final
        FROM run_polls) GROUP BY 1"""


@query("run_state_fold", FOLDED)
def run_state_fold(spark, root):
    return ops.fold_polls(B.run_polls(spark, root)).drop("settled_seq")


@query(
    "upsert_by_name",
    """SELECT COALESCE(t.id, s.id) AS id, COALESCE(t.name, s.name) AS name, COALESCE(t.created_by, s.created_by) AS created_by,
  CASE WHEN s.name IS NOT NULL THEN s.team ELSE t.team END AS team, CASE WHEN s.name IS NOT NULL THEN s.nodes ELSE t.nodes END AS nodes,
  CASE WHEN s.name IS NOT NULL THEN s.shape ELSE t.shape END AS shape
  FROM (SELECT * FROM workloads WHERE num_accelerators <= 30) t
  FULL JOIN (SELECT id + 1000000 AS id, name, 'sync' AS created_by, 'moved' AS team, nodes + 1 AS nodes, shape FROM workloads WHERE num_accelerators >= 20) s ON t.name = s.name""",
)
def upsert_by_name(spark, root):
    merged = ops.upsert_by_name(*upsert_sides(spark, root))
    return merged.select("id", "name", "created_by", "team", "nodes", "shape")


def upsert_sides(spark, root):
    everything = B.workloads(spark, root).withColumn("created_at", B.ntz("2024-01-01 00:00:00"))
    target = everything.filter(F.col("num_accelerators") <= 30)
    source = (
        everything.filter(F.col("num_accelerators") >= 20)
        .withColumn("id", F.col("id") + 1000000)
        .withColumn("created_by", F.lit("sync"))
        .withColumn("team", F.lit("moved"))
        .withColumn("nodes", F.col("nodes") + 1)
    )
    return target, source


# Enough for the tables the queries run on; a store takes a count that keeps a bucket within a task.
STORE_BUCKETS = 64
STORED = ["id", "name", "created_by", "team", "nodes", "shape"]


@query(
    "upsert_stored",
    """WITH target AS (SELECT * FROM workloads WHERE num_accelerators <= 30),
  first AS (SELECT id + 1000000 AS id, name, 'sync' AS created_by, 'moved' AS team, nodes + 1 AS nodes, shape FROM workloads WHERE num_accelerators >= 20),
  merged AS (SELECT COALESCE(t.id, s.id) AS id, COALESCE(t.name, s.name) AS name, COALESCE(t.created_by, s.created_by) AS created_by,
    COALESCE(s.team, t.team) AS team, COALESCE(s.nodes, t.nodes) AS nodes, COALESCE(s.shape, t.shape) AS shape FROM target t FULL JOIN first s ON t.name = s.name)
SELECT id, name, created_by, team, nodes, shape, CAST(2 AS BIGINT) AS commits FROM merged""",
)
def upsert_stored(spark, root):
    """The catalog is stored, synced, synced again without a change (which commits nothing) and read back."""
    target, source = upsert_sides(spark, root)
    path = workspace.fresh_path(spark, "workload-store")
    workload_store.create(spark, path, target.schema)
    for rows in (target, source, source):
        stored = workload_store.upsert(spark, path, rows, STORE_BUCKETS)
    return workload_store.read(spark, path).select(*STORED, F.lit(stored.number).cast("bigint").alias("commits"))


@query(
    "upsert_by_owner",
    """WITH t AS (SELECT * FROM workloads WHERE num_accelerators <= 30),
  s AS (SELECT id + 1000000 AS id, name, 'sync' AS created_by, 'moved' AS team, nodes + 1 AS nodes, shape FROM workloads WHERE num_accelerators >= 20),
  own AS (SELECT * FROM t WHERE created_by = 'repo-sync')
SELECT id, name, created_by, team, nodes, shape FROM t WHERE created_by <> 'repo-sync' OR name NOT IN (SELECT name FROM s)
UNION ALL SELECT own.id, name, own.created_by, s.team, s.nodes, s.shape FROM own JOIN s USING (name)
UNION ALL SELECT id, name, created_by, team, nodes, shape FROM s WHERE name NOT IN (SELECT name FROM own)""",
)
def upsert_by_owner(spark, root):
    """Rows made by hand never match: they stay, and the source inserts beside them."""
    return ops.upsert_by_name(*upsert_sides(spark, root), owner="repo-sync").select("id", "name", "created_by", "team", "nodes", "shape")


# The manifests' live and example twins share fam/name; parts 2k and 2k+1 share a stem number.
KEYED = """SELECT *, replace(replace(path, '.example.yaml', ''), '.yaml', '') AS key, path LIKE '%.example%' AS is_example FROM manifests"""
SHADOWED = f"""SELECT key, COALESCE(MIN(path) FILTER (WHERE NOT is_example), MAX(path) FILTER (WHERE is_example)) AS path FROM ({KEYED}) GROUP BY 1"""
STEM = "regexp_extract(path, '([^/]+)[.]yaml$', 1)"
RULES = ", ".join(f"({at}, '{word}', '{case}')" for at, (word, case) in enumerate(L.USE_CASE_RULES))
RULE = f"(SELECT arg_min(r.use_case, r.place) FROM (VALUES {RULES}) r(place, word, use_case) WHERE contains({{h}}, r.word))"
USE_CASE = f"COALESCE({RULE.format(h=STEM)}, {RULE.format(h='include_path')}, 'env-diagnostics')"


def parsed_manifests(spark, root):
    return files.parse_manifests(B.manifest_files(spark, root))


MANIFEST_ROWS = """SELECT path, CASE WHEN NOT broken THEN shape END AS accelerator_type, CASE WHEN NOT broken THEN num_accelerators END AS num_accelerators,
  CASE WHEN NOT broken THEN command END AS command, CASE WHEN NOT broken THEN include_path END AS first_include,
  CASE WHEN broken THEN 'unparsable' WHEN command IS NULL THEN 'no command' END AS problem FROM manifests"""


def manifest_rows(parsed):
    return parsed.select(
        "path", "accelerator_type", "num_accelerators", "command",
        F.get("include_paths", F.lit(0)).alias("first_include"), "problem",
    )


@query("scan_manifests", MANIFEST_ROWS)
def scan_manifests(spark, root):
    return manifest_rows(parsed_manifests(spark, root))


@query("scan_manifest_files", MANIFEST_ROWS)
def scan_manifest_files(spark, root):
    """The same manifests as YAML files in their folders, found and read back."""
    folder = workspace.fresh_path(spark, "manifests")
    sinks.write_files(B.manifest_files(spark, root), folder)
    return manifest_rows(files.parse_manifests(files.manifest_files(spark, folder)))


@query("catalog_shadow", SHADOWED)
def catalog_shadow(spark, root):
    return ops.catalog_shadow(B.manifest_files(spark, root))


@query("use_case_classify", f"SELECT path, {USE_CASE} AS use_case FROM manifests WHERE NOT broken")
def use_case_classify(spark, root):
    stem = F.regexp_extract("path", r"([^/]+)\.yaml$", 1)
    parsed = parsed_manifests(spark, root).filter(F.coalesce(F.col("problem"), F.lit("")) != "unparsable")
    return parsed.select("path", L.use_case(F.concat(F.array(stem), "include_paths")).alias("use_case"))


@query(
    "needs_torch_flag",
    "SELECT path, CASE WHEN contains(command, 'torch') THEN 1 ELSE 0 END AS needs_torch FROM manifests WHERE NOT broken AND command IS NOT NULL",
)
def needs_torch_flag(spark, root):
    runnable = parsed_manifests(spark, root).filter(F.col("command").isNotNull())
    return runnable.select("path", L.needs_torch(F.col("command")).alias("needs_torch"))


@query(
    "scan_catalog_json",
    f"""SELECT s.key AS name, m.path AS ref, 'team-0' AS team, {USE_CASE.replace('(path,', '(m.path,')} AS use_case, COALESCE(shape, 'GPU_1xA10') AS shape,
  CAST(GREATEST(1, num_accelerators // CASE WHEN COALESCE(shape, '') LIKE '%8x%' THEN 8 ELSE 1 END) AS INT) AS nodes,
  CASE WHEN contains(command, 'torch') THEN 1 ELSE 0 END AS needs_torch
  FROM manifests m JOIN ({SHADOWED}) s ON s.path = m.path WHERE NOT broken AND command IS NOT NULL""",
)
def scan_catalog_json(spark, root):
    """Write the generated catalog as JSON, read it back with the declared schema and a set team."""
    path = workspace.fresh_path(spark, "catalog")
    parsed = files.parse_manifests(ops.live_manifests(B.manifest_files(spark, root)))
    sinks.write_catalog_json(ops.catalog_entries(parsed, "someone"), path)
    return files.catalog_json(spark, path, "team-0", lines=True).select("name", "ref", "team", "use_case", "shape", "nodes", "needs_torch")


@query(
    "peak_concurrency",
    """SELECT boot_id, MAX(active) AS peak, GREATEST(MAX(active), 4) AS cap FROM (
  SELECT boot_id, moment, CAST(SUM(net) OVER (PARTITION BY boot_id ORDER BY moment) AS BIGINT) AS active FROM (
    SELECT boot_id, moment, SUM(step) AS net FROM (
      SELECT boot_id, hold_start AS moment, 1 AS step FROM probes UNION ALL SELECT boot_id, hold_end, -1 FROM probes) GROUP BY 1, 2)) GROUP BY 1""",
)
def peak_concurrency(spark, root):
    return ops.peak_concurrency(B.probes(spark, root), "hold_start", "hold_end", ["boot_id"], B.KNOWN_CAP)


@query(
    "colocation_join",
    """SELECT a.probe_id, a.boot_id, COUNT(b.probe_id) AS cotenants,
  COUNT(CASE WHEN a.gpu IN (b.gpu, b.gpu2) OR a.gpu2 IN (b.gpu, b.gpu2) THEN 1 END) AS gpu_cotenants,
  CASE WHEN COUNT(b.probe_id) = 0 THEN 'alone' WHEN COUNT(CASE WHEN a.gpu IN (b.gpu, b.gpu2) OR a.gpu2 IN (b.gpu, b.gpu2) THEN 1 END) = 0 THEN 'shared_node'
       ELSE 'shared_gpu' END AS placement
  FROM (SELECT * FROM probes WHERE hold_end > hold_start) a LEFT JOIN (SELECT * FROM probes WHERE hold_end > hold_start) b
    ON a.boot_id = b.boot_id AND a.probe_id <> b.probe_id AND a.hold_start < b.hold_end AND b.hold_start < a.hold_end GROUP BY ALL""",
)
def colocation_join(spark, root):
    return colocation.colocation(B.probes(spark, root))


MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
MONTH_VALUES = ", ".join(f"('{name}', {number})" for number, name in enumerate(MONTHS, 1))


@query(
    "literal_values",
    f"""SELECT v.name AS month_name, v.num AS month_num, COUNT(o_orderkey) AS orders
  FROM (VALUES {MONTH_VALUES}) AS v(name, num) LEFT JOIN orders ON month(o_orderdate) = v.num GROUP BY 1, 2""",
)
def literal_values(spark, root):
    named = spark.sql(f"SELECT * FROM VALUES {MONTH_VALUES} AS v(month_name, month_num)")
    counts = (
        B.table(spark, root, "orders")
        .groupBy(F.month("o_orderdate").alias("month_num"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return named.join(counts, "month_num", "left").select(
        "month_name", "month_num", F.coalesce("orders", F.lit(0)).alias("orders")
    )


@query(
    "param_query",
    """SELECT 'hello' AS message, CAST(month(o_orderdate) AS INT) AS month_num, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue
  FROM orders WHERE month(o_orderdate) <= 3 GROUP BY 2 ORDER BY 2""",
)
def param_query(spark, root):
    statement = """SELECT :message AS message, month(o_orderdate) AS month_num, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
  FROM {orders} WHERE month(o_orderdate) <= :max_month_num GROUP BY month(o_orderdate) ORDER BY month_num"""
    return ops.param_query(
        spark, statement, {"message": "hello", "max_month_num": 3}, orders=B.table(spark, root, "orders")
    )


@query(
    "union_all",
    """SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem
  UNION ALL SELECT 'event', event_id, ts FROM events""",
)
def union_all(spark, root):
    branches = [("order", "orders", "o_orderkey", "o_orderdate"), ("line", "lineitem", "l_orderkey", "l_shipdate"), ("event", "events", "event_id", "ts")]
    frames = [
        B.table(spark, root, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(at).alias("at"))
        for kind, name, key, at in branches
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "scan_config",
    """SELECT t.team, t.pos AS team_pos, CAST(quota_nodes AS BIGINT) AS quota_nodes, u.use_case, 20 AS total_nodes,
  CASE WHEN t.pos % 2 = 0 THEN '' ELSE 'about ' || u.use_case END AS description,
  (SELECT COUNT(*) FROM members m WHERE m.team = t.team) AS members FROM teams t JOIN use_cases u ON u.team = t.team WHERE t.team IN (SELECT team FROM members)""",
)
def scan_config(spark, root):
    """Config documents written as JSON files, read with the declared schema and exploded.

    One small document per member, so no member list is gathered. Use cases are plain names for
    even teams and objects for odd ones, to exercise the widening.
    """
    listed = B.use_cases(spark, root)
    as_object = F.struct(F.col("use_case").alias("name"), F.concat(F.lit("about "), "use_case").alias("description"))
    even = F.substring("team", 6, 9).cast("int") % 2 == 0
    cases = F.when(even, F.to_json(F.array("use_case"))).otherwise(F.to_json(F.array(as_object)))
    documents = (
        B.members(spark, root)
        .select("team", "member")
        .join(B.teams(spark, root).select("team", "quota_nodes"), "team")
        .join(listed.select("team", cases.alias("cases")), "team")
        .select(
            F.concat(
                F.lit('{"reservation": {"total_nodes": 20, "accelerator_type": "GPU_8xH100"}, "platform_quotas": {"GPU_8xH100": 4}, "teams": [{"name": "'),
                "team", F.lit('", "quota_nodes": '), F.col("quota_nodes").cast("string"), F.lit(', "members": '),
                F.to_json(F.array("member")), F.lit(', "use_cases": '), "cases", F.lit("}]}"),
            ).alias("text"),
        )
    )
    path = workspace.fresh_path(spark, "config")
    documents.write.text(path)
    config = files.config_document(spark, path, lines=True)
    heads = files.config_members(config).groupBy("team").agg(F.count(F.lit(1)).alias("members"))
    return (
        files.config_teams(config)
        .drop("pos")
        .distinct()
        .join(files.config_use_cases(config).drop("pos").distinct(), "team")
        .join(heads, "team", "left")
        .select(
            "team",
            F.substring("team", 6, 9).cast("int").alias("team_pos"),
            F.col("quota_nodes").cast("bigint").alias("quota_nodes"),
            "use_case",
            F.lit(20).alias("total_nodes"),
            "description",
            F.coalesce("members", F.lit(0)).cast("bigint").alias("members"),
        )
    )
