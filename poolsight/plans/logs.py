"""Family D queries: log and receipt mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from poolsight.functions import text as T
from poolsight.operators import logs as ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.sources import files, sinks, workspace

ANSI = "regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g')"


@query(
    "result_line_kv",
    """SELECT event_id, run, key, trim(both '''' from raw) AS value FROM (
  SELECT event_id, run, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)=(''[^'']*''|\\S+)', 1)) AS key,
    unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)=(''[^'']*''|\\S+)', 2)) AS raw FROM log_lines WHERE line LIKE 'RESULT %')""",
)
def result_line_kv(spark, root):
    return ops.result_line_kv(B.log_lines(spark, root))


SENTINELS = ("RESULT gpu=0", "CUDA error", "Submitted workload", "never printed")


@query(
    "sentinel_presence",
    """SELECT run, sentinel, COUNT(*) AS lines FROM log_lines JOIN (VALUES ('RESULT gpu=0'), ('CUDA error'), ('Submitted workload'), ('never printed')) s(sentinel)
  ON contains(line, sentinel) GROUP BY 1, 2""",
)
def sentinel_presence(spark, root):
    return ops.sentinel_presence(B.log_lines(spark, root), SENTINELS)


@query(
    "sentinel_index",
    """WITH patterns AS (SELECT 'GPU model ' || CAST(c_custkey AS VARCHAR) || '''' AS sentinel FROM customer UNION ALL SELECT '[3' UNION ALL SELECT '}'
    UNION ALL SELECT 'CUDA error' UNION ALL SELECT 'exit 137' UNION ALL SELECT 'never printed')
SELECT event_id, sentinel FROM log_lines JOIN patterns ON contains(line, sentinel)""",
)
def sentinel_index(spark, root):
    """A sentinel for each customer, and some common ones, looked for in every line by their rarest grams."""
    few = spark.createDataFrame([(s,) for s in ("[3", "}", "CUDA error", "exit 137", "never printed")], "sentinel string")
    named = B.table(spark, root, "customer").select(F.concat(B.text("GPU model ", F.col("c_custkey")), F.lit("'")).alias("sentinel"))
    return ops.pattern_hits(B.log_lines(spark, root), named.unionByName(few), "event_id", "line", "sentinel")


@query(
    "job_run_id_extract",
    f"""SELECT event_id, COALESCE(NULLIF(regexp_extract({ANSI}, 'Job Run ID:\\s*(\\d+)', 1), ''),
  NULLIF(regexp_extract({ANSI}, '"?run_id"?\\D*(\\d{{8,}})', 1), '')) AS job_run_id FROM log_lines""",
)
def job_run_id_extract(spark, root):
    return B.log_lines(spark, root).select("event_id", T.job_run_id(F.col("line")).alias("job_run_id"))


@query("ansi_strip", f"SELECT event_id, {ANSI} AS line FROM log_lines")
def ansi_strip(spark, root):
    return B.log_lines(spark, root).select("event_id", T.strip_ansi(F.col("line")).alias("line"))


@query(
    "tail_truncate",
    "SELECT doc_id, right(text, 400) AS tail, left(text, 400) AS head FROM documents",
)
def tail_truncate(spark, root):
    text = F.col("text")
    return B.table(spark, root, "documents").select(
        "doc_id", F.right(text, F.lit(400)).alias("tail"), F.substring(text, 1, 400).alias("head")
    )


@query(
    "failure_symptom",
    """SELECT event_id, CASE WHEN contains(line, 'exit 137') AND NOT contains(line, 'Traceback') THEN 'host_ram_oom'
  WHEN contains(line, 'CUDA') AND contains(line, 'out of memory') THEN 'gpu_oom' WHEN contains(line, 'grpc-status: 0') THEN 'telemetry_auth_hidden'
  WHEN contains(line, 'Unknown field') AND contains(line, 'env_variables') THEN 'env_variables_misplaced'
  WHEN contains(line, 'usage_policy_name') THEN 'missing_usage_policy' WHEN contains(line, 'PERMISSION_DENIED') THEN 'wrong_workspace'
  WHEN contains(line, 'qemu') AND contains(line, 'Segmentation fault') THEN 'docker_emulation' END AS cause FROM log_lines""",
)
def failure_symptom(spark, root):
    return B.log_lines(spark, root).select("event_id", T.failure_symptom(F.col("line")).alias("cause"))


@query(
    "link_extract",
    """SELECT path, unnest(regexp_extract_all(command, '\\$CODE_SOURCE_PATH/(\\S+\\.(?:py|sh))', 1)) AS link FROM manifests WHERE NOT broken AND command IS NOT NULL""",
)
def link_extract(spark, root):
    parsed = files.parse_manifests(B.manifest_files(spark, root)).filter(F.col("command").isNotNull())
    return parsed.select("path", F.explode(T.links(F.col("command"))).alias("link"))


def launcher_lines(spark, root, *kept):
    """Launcher log lines per run, derived from events, with the node each was written on."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    message = (
        F.when(kind == "signup", "Recorded condition marker /work/LauncherStarted")
        .when(kind == "error", F.concat(B.text("User command exited with code ", key % 3)))
        .when(kind == "purchase", F.concat(F.lit("  job_id="), user.cast("string")))
        .when(kind == "view", F.concat(F.lit("  workload_id=w-"), user.cast("string")))
        .otherwise("Recorded condition marker /work/UserCodeStarted")
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(kind == "error", "ERROR").otherwise("INFO")
    line = F.when(key % 23 == 0, "free text").otherwise(
        F.concat(stamp, F.lit(" - "), level, F.lit(" - "), message)
    )
    return B.table(spark, root, "events").select(user.alias("node"), line.alias("value"), *kept)


FIRST_NODE, NODES = 5_000_000_000, 20


def written_logs(spark, root):
    """The launcher lines as text chunks in one folder for each of the pool's nodes, read back with
    the node from the path. Node numbers are longer than an int.

    Rebalancing by node keeps the files few, and splits a node that holds most of the lines.
    """
    path = workspace.fresh_path(spark, "logs")
    lines = launcher_lines(spark, root).withColumn("node", FIRST_NODE + F.col("node") % NODES)
    lines.hint("rebalance", "node").write.partitionBy("node").text(path)
    return files.log_text(spark, path)


def launcher_log(spark, root):
    """The same lines as a table, for queries that are not about files."""
    return launcher_lines(spark, root).withColumnRenamed("value", "line")


LAUNCHER = """SELECT user_id AS node, date_trunc('second', ts) AS logged_at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_id % 23 = 0 AS free, event_id, event_type FROM events"""


@query(
    "scan_log_text",
    f"SELECT {FIRST_NODE} + node % {NODES} AS node, COUNT(*) AS lines, CAST(SUM(CASE WHEN free THEN 1 ELSE 0 END) AS BIGINT) AS free_lines FROM ({LAUNCHER}) GROUP BY 1",
)
def scan_log_text(spark, root):
    return written_logs(spark, root).groupBy("node").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") == "free text").alias("free_lines")
    )


# Events whose lines share a chunk, and characters by which a chunk reaches into the next one's first line.
CHUNK_EVENTS, REACH = 5000, 9

LINE_TEXT = """CASE WHEN event_id % 23 = 0 THEN 'free text' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_type = 'error' THEN ' - ERROR - ' ELSE ' - INFO - ' END ||
  CASE event_type WHEN 'signup' THEN 'Recorded condition marker /work/LauncherStarted' WHEN 'error' THEN 'User command exited with code ' || CAST(event_id % 3 AS VARCHAR)
    WHEN 'purchase' THEN '  job_id=' || CAST(user_id AS VARCHAR) WHEN 'view' THEN '  workload_id=w-' || CAST(user_id AS VARCHAR)
    ELSE 'Recorded condition marker /work/UserCodeStarted' END END"""


@query(
    "log_lines_stitched",
    f"""WITH lines AS (SELECT {FIRST_NODE} + user_id % {NODES} AS node, event_id, event_id // {CHUNK_EVENTS} AS part, {LINE_TEXT} AS line FROM events)
SELECT node, CASE WHEN part > 0 AND event_id = MIN(event_id) OVER (PARTITION BY node, part) THEN part - 1 ELSE part END AS chunk,
  ROW_NUMBER() OVER w AS number, CAST(SUM(strlen(line) + 1) OVER w - strlen(line) - 1 AS BIGINT) AS "offset", line
  FROM lines WINDOW w AS (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def log_lines_stitched(spark, root):
    """Each node's log as chunks that end inside a line, read back whole, numbered and placed."""
    path = workspace.fresh_path(spark, "chunks")
    key = F.col("event_id")
    lines = launcher_lines(spark, root, "event_id").select(
        (FIRST_NODE + F.col("node") % NODES).alias("node"), key, F.floor(key / CHUNK_EVENTS).alias("part"), F.concat("value", F.lit("\n")).alias("text")
    )
    lines = lines.withColumn("first", F.min("event_id").over(Window.partitionBy("node", "part")))
    head = F.struct((F.col("part") - 1).alias("chunk"), F.substring("text", 1, REACH).alias("text"))
    rest = F.struct(F.col("part").alias("chunk"), F.expr(f"substring(text, {REACH + 1})").alias("text"))
    whole = F.struct(F.col("part").alias("chunk"), F.col("text"))
    is_cut = (F.col("part") > 0) & (key == F.col("first"))
    pieces = lines.select("node", key, F.explode(F.when(is_cut, F.array(head, rest)).otherwise(F.array(whole))).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p.text"))), lambda p: p["text"]), "")
    texts = pieces.groupBy("node", F.col("p.chunk").alias("chunk")).agg(joined.alias("text"))
    name = F.concat(F.lit("node_"), F.col("node").cast("string"), F.lit("/logs-"), F.col("chunk").cast("string"), F.lit(".chunk.txt"))
    sinks.write_files(texts.select(name.alias("path"), "text"), path)
    return files.log_lines(spark, path).select("node", "chunk", "number", "offset", "line")


@query(
    "launcher_parse",
    f"""SELECT node, CASE WHEN NOT free THEN logged_at END AS logged_at, CASE WHEN NOT free THEN level END AS level FROM ({LAUNCHER})""",
)
def launcher_parse(spark, root):
    return ops.launcher_parse(launcher_log(spark, root)).select("node", "logged_at", "level")


@query(
    "correlation_ids",
    f"""SELECT node, CASE WHEN bool_or(event_type = 'purchase') THEN CAST(node AS VARCHAR) END AS job_id,
  CASE WHEN bool_or(event_type = 'view') THEN 'w-' || CAST(node AS VARCHAR) END AS workload_id, CAST(NULL AS VARCHAR) AS run_id
  FROM ({LAUNCHER}) WHERE NOT free AND event_type IN ('purchase', 'view') GROUP BY node""",
)
def correlation_ids(spark, root):
    parsed = ops.launcher_parse(launcher_log(spark, root))
    return ops.correlation_ids(parsed, "node").select("node", "job_id", "workload_id", "run_id")


@query(
    "phase_duration",
    f"""SELECT node, MIN(logged_at) FILTER (WHERE event_type = 'signup') AS started_at,
  MIN(logged_at) FILTER (WHERE event_type = 'click') AS user_code_at, MAX(logged_at) FILTER (WHERE event_type = 'error') AS exited_at,
  CAST(MAX(event_id % 3) FILTER (WHERE event_type = 'error') AS INT) AS exit_code,
  date_diff('second', MIN(logged_at) FILTER (WHERE event_type = 'signup'), MAX(logged_at) FILTER (WHERE event_type = 'error')) AS seconds
  FROM ({LAUNCHER}) WHERE NOT free GROUP BY node""",
)
def phase_duration(spark, root):
    parsed = ops.launcher_parse(launcher_log(spark, root)).filter(F.col("message").isNotNull())
    return ops.phase_duration(parsed, "node")


def payloads(spark, root):
    """One check payload per event; every eleventh is cut short."""
    key, kind = F.col("event_id"), F.col("event_type")
    ok = F.when(key % 3 == 0, "true").when(key % 3 == 1, "false").otherwise("null")
    body = F.concat(
        F.lit('{"check": "'), kind, F.lit('", "results": {"first": {"ok": '), ok, F.lit(', "detail": "d'),
        key.cast("string"), F.lit('"}, "second": {"ok": true, "detail": "fine"}}}'),
    )
    cut = F.when(key % 11 == 0, F.lit("Traceback: no result")).otherwise(body)
    return B.table(spark, root, "events").select(key.alias("event_id"), kind.alias("check_name"), cut.alias("payload"))


@query(
    "json_results_explode",
    """SELECT event_id, event_type AS check_name, probe, ok, detail FROM (
  SELECT event_id, event_type, 'first' AS probe, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS ok, 'd' || CAST(event_id AS VARCHAR) AS detail FROM events WHERE event_id % 11 <> 0
  UNION ALL SELECT event_id, event_type, 'second', TRUE, 'fine' FROM events WHERE event_id % 11 <> 0
  UNION ALL SELECT event_id, event_type, '_output', FALSE, 'unreadable payload' FROM events WHERE event_id % 11 = 0)""",
)
def json_results_explode(spark, root):
    return ops.json_results(payloads(spark, root))


@query(
    "melt_metrics",
    """SELECT CAST(o_orderkey AS VARCHAR) || '.' || metric AS key, value FROM (
  SELECT o_orderkey, 'total' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 'exact', CAST(CAST(o_totalprice AS DECIMAL(14, 1)) AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 'small', CAST(o_orderkey % 100 AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 'maybe', 1.5 FROM orders WHERE o_orderkey % 3 = 2)""",
)
def melt_metrics(spark, root):
    key = F.col("o_orderkey")
    maybe = F.when(key % 3 == 0, F.lit(None).cast("double")).when(key % 3 == 1, F.lit(float("nan"))).otherwise(1.5)
    wide = B.table(spark, root, "orders").select(
        key.alias("dataset"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").cast("decimal(14,1)").alias("exact"), (key % 100).cast("smallint").alias("small"),
        maybe.alias("maybe"), F.col("o_orderstatus").alias("status"),
    )
    return ops.melt_metrics(wide, "dataset", ["total", "customer", "exact", "small", "maybe", "status"])


@query(
    "key_sanitise",
    """SELECT 'param' AS kind, run, key, value FROM (SELECT user_id AS run, CASE WHEN event_type = 'view' THEN 'a_b_c' ELSE 'lr/' || event_type || ' x.y-z_' END AS key,
    left(arg_max(repeat(props, 60), event_id), 500) AS value FROM events GROUP BY 1, 2)
  UNION ALL SELECT 'metric', user_id, 'loss_' || event_type, CAST(CAST(event_id AS DOUBLE) AS BIGINT)::VARCHAR FROM events WHERE event_id % 3 <> 2""",
)
def key_sanitise(spark, root):
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    events = B.table(spark, root, "events")
    name = F.when(kind == "view", F.when(key % 2 == 0, "a:b:c").otherwise("a=b=c")).otherwise(
        F.concat(F.lit("lr/"), kind, F.lit(" x.y-z%"))
    )
    params = events.select(user.alias("run"), name.alias("key"), F.repeat("props", 60).alias("value"), key.alias("seq"))
    value_kind = F.when(key % 3 == 0, "int").when(key % 3 == 1, "float").otherwise("bool")
    metrics = events.select(
        user.alias("run"), F.concat(F.lit("loss@"), kind).alias("key"), value_kind.alias("kind"),
        key.cast("string").alias("value"), key.alias("step"),
    )
    clean = ops.sanitise_params(params).select(F.lit("param").alias("kind"), "run", "key", "value")
    numbers = ops.sanitise_metrics(metrics).select(
        F.lit("metric").alias("kind"), "run", "key", F.col("value").cast("bigint").cast("string").alias("value")
    )
    return clean.unionByName(numbers)


@query(
    "receipt_lookup",
    """SELECT j.job_run_id, j.result, r.receipt_id, r.params FROM job_runs j LEFT JOIN (
  SELECT job_run_id, arg_min(receipt_id, (logged_at, receipt_id)) AS receipt_id, arg_min(gpu_uuids, (logged_at, receipt_id)) AS params FROM receipts GROUP BY 1) r
  ON r.job_run_id = j.job_run_id""",
)
def receipt_lookup(spark, root):
    receipts = B.receipts(spark, root).select(
        "job_run_id", "logged_at", "receipt_id", F.col("gpu_uuids").alias("params")
    )
    runs = B.job_runs(spark, root).select("job_run_id", "result")
    return ops.receipt_lookup(runs, receipts)


def loss_history(spark, root):
    return B.loss_curve(spark, root).select("run", F.lit("train_loss").alias("key"), F.col("loss").alias("value"), "step", "ts")


@query(
    "metric_history_latest",
    "SELECT run, 'train_loss' AS key, COUNT(*) AS points, MAX(step) AS last_step, arg_max(loss, step) AS latest FROM loss_curve GROUP BY 1",
)
def metric_history_latest(spark, root):
    return ops.metric_history_latest(loss_history(spark, root))


@query(
    "run_archive_copy",
    """SELECT run, kind, key, value, step, ts FROM (
  SELECT c_custkey AS run, 'param' AS kind, 'segment' AS key, c_mktsegment AS value, CAST(NULL AS BIGINT) AS step, CAST(NULL AS TIMESTAMP) AS ts FROM customer
  UNION ALL SELECT run, 'metric', 'step_no', CAST(step AS VARCHAR), step, ts FROM loss_curve
  UNION ALL SELECT c_custkey, 'tag', 'name', c_name, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 'tag', 'archive.source_run_id', CAST(c_custkey AS VARCHAR), NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 'tag', 'archive.source_workspace', 'pool-a', NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 'tag', 'archive.artifacts_error', CASE WHEN c_custkey % 2 = 0 THEN left('HTTP 404 ' || repeat('x', 300), 250) ELSE 'no artifacts' END, NULL, NULL
    FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT c_custkey, 'status', 'status', CASE WHEN c_custkey % 3 = 0 THEN 'FAILED' ELSE 'FINISHED' END, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 'artifact', 'client_logs/run-' || CAST(c_custkey AS VARCHAR) || '.log', '/home/u/run-' || CAST(c_custkey AS VARCHAR) || '.log', NULL, NULL FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT o_custkey, 'artifact', 'out/' || CAST(o_orderkey AS VARCHAR), 'out/' || CAST(o_orderkey AS VARCHAR), NULL, NULL FROM orders)""",
)
def run_archive_copy(spark, root):
    customer = B.table(spark, root, "customer")
    run = F.col("c_custkey").alias("run")
    params = customer.select(run, F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
    tags = customer.select(run, F.lit("name").alias("key"), F.col("c_name").alias("value"))
    metrics = B.loss_curve(spark, root).select("run", F.lit("step_no").alias("key"), F.col("step").alias("value"), "step", "ts")
    artifacts = B.table(spark, root, "orders").select(
        F.col("o_custkey").alias("run"), B.text("out/", F.col("o_orderkey")).alias("path")
    )
    key = F.col("c_custkey")
    runs = customer.select(run, F.when(key % 3 == 0, "FAILED").otherwise("FINISHED").alias("status"))
    errors = customer.filter(key % 2 == 0).select(run, F.concat(F.lit("HTTP 404 "), F.repeat(F.lit("x"), 300)).alias("message"))
    client_logs = customer.filter(key % 5 == 0).select(run, F.concat(F.lit("/home/u/run-"), key.cast("string"), F.lit(".log")).alias("path"))
    return ops.archive_runs(params, metrics, tags, artifacts, runs, {"source_workspace": "pool-a"}, errors, client_logs)
