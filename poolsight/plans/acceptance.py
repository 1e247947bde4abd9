"""Family E queries: verdicts, drift, registry integrity and sinks of the results sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.operators import acceptance as ops
from poolsight.operators import ledger as ledger_ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.sources import sinks, workspace

EXPECT_FAIL = """(probe IN ('catalog_bucket_read', 'pypi_egress', 'mlflow_artifact_upload') OR (probe = 'root_storage_tcp443' AND shape <> 'CPU'))"""
DRIFT = f"""SELECT id, run, check_name, shape, probe, ok, detail, CASE WHEN ok IS NULL THEN 'skipped' WHEN ok THEN 'pass' ELSE 'fail' END AS got,
  CASE WHEN {EXPECT_FAIL} THEN 'fail' ELSE 'pass' END AS expected,
  CASE WHEN ok IS NULL THEN '' WHEN ok AND {EXPECT_FAIL} THEN 'CHANGED' WHEN NOT ok AND NOT {EXPECT_FAIL} THEN 'REGRESSION' ELSE '' END AS drift FROM check_results"""
CLASS = """CASE WHEN result IS NULL THEN 'unfinished' WHEN result = 'SUCCESS' THEN 'success' WHEN COALESCE(message, '') LIKE '%GPU quota%' THEN 'quota_refused' ELSE 'other_failed' END"""


@query("drift_classify", DRIFT)
def drift_classify(spark, root):
    return ops.drift_classify(B.check_results(spark, root))


@query(
    "verdict_counts",
    f"""SELECT COUNT(*) AS results, COUNT(*) FILTER (WHERE got = 'pass') AS passed, COUNT(*) FILTER (WHERE got = 'fail') AS failed,
  COUNT(*) FILTER (WHERE got = 'skipped') AS skipped, COUNT(*) FILTER (WHERE drift = 'CHANGED') AS changed,
  COUNT(*) FILTER (WHERE drift = 'REGRESSION') AS regressions FROM ({DRIFT})""",
)
def verdict_counts(spark, root):
    return ops.verdict_counts(ops.drift_classify(B.check_results(spark, root)))


@query(
    "pool_ready",
    """SELECT run, COALESCE(bool_and(ok) FILTER (WHERE probe <> 'burn_runs_terminal'), TRUE) AS pool_ready,
  COUNT(ok) FILTER (WHERE probe <> 'burn_runs_terminal') AS checks_counted FROM check_results GROUP BY 1""",
)
def pool_ready(spark, root):
    return ops.pool_ready(B.check_results(spark, root), ["run"])


@query(
    "acceptance_verdict",
    """SELECT run, CASE WHEN bool_or(status = 'FAIL') THEN 'NOT ACCEPTED' WHEN bool_or(status IN ('BLOCKED', 'SKIPPED', 'NA') OR scope = 'smoke') THEN 'ACCEPTED WITH CAVEATS'
  ELSE 'ACCEPTED' END AS verdict, CAST(CASE WHEN bool_or(status = 'FAIL') THEN 1 ELSE 0 END AS INT) AS exit_code FROM checks GROUP BY 1""",
)
def acceptance_verdict(spark, root):
    return ops.acceptance_verdict(B.checks(spark, root))


MISSING = "SELECT id, asset FROM registry WHERE asset IS NOT NULL AND asset NOT IN (SELECT path FROM assets)"
UNCLAIMED = """SELECT path FROM assets a WHERE regexp_matches(path, '^workloads/[^/]*[.]yaml$') AND NOT regexp_matches(path, '^workloads/w10[^/]*[.]yaml$')
  AND path NOT IN (SELECT asset FROM registry WHERE asset IS NOT NULL)
  AND NOT (path NOT LIKE '%.example.yaml' AND replace(path, '.yaml', '.example.yaml') IN (SELECT path FROM assets))"""
LINKED = """SELECT id, asset, sentinel, bool_or(COALESCE(contains(f.text, sentinel), FALSE)) AS found FROM (
  SELECT id, asset, unnest(sentinels) AS sentinel FROM registry WHERE asset IN (SELECT path FROM assets)) r
  LEFT JOIN (SELECT path AS a, path AS linked FROM assets UNION SELECT path, unnest(regexp_extract_all(text, '\\$CODE_SOURCE_PATH/(\\S+\\.(?:py|sh))', 1)) FROM assets WHERE path LIKE '%.yaml') l
    ON l.a = r.asset LEFT JOIN assets f ON f.path = l.linked GROUP BY 1, 2, 3"""


@query("registry_missing_asset", MISSING)
def registry_missing_asset(spark, root):
    return ops.registry_missing_asset(B.registry(spark, root), B.assets(spark, root))


EXEMPT = ("workloads/probes/*.yaml", "workloads/w10*.yaml")


@query("asset_unclaimed", UNCLAIMED)
def asset_unclaimed(spark, root):
    return ops.asset_unclaimed(B.assets(spark, root), B.registry(spark, root), EXEMPT)


@query("sentinel_link", LINKED)
def sentinel_link(spark, root):
    return ops.sentinel_link(B.registry(spark, root), B.assets(spark, root))


@query(
    "registry_drift_summary",
    f"""WITH l AS (SELECT *, id IN (SELECT id FROM registry WHERE sentinels_pending IS NOT NULL) AS waits FROM ({LINKED}) WHERE NOT found),
  c AS (SELECT (SELECT COUNT(*) FROM registry) AS tests, (SELECT COUNT(*) FROM registry WHERE sentinels IS NOT NULL) AS sentinel_linked,
    (SELECT COUNT(*) FROM ({MISSING})) AS missing_assets, (SELECT COUNT(*) FROM l WHERE NOT waits) AS missing_sentinels,
    (SELECT COUNT(*) FROM l WHERE waits) AS pending, (SELECT COUNT(*) FROM ({UNCLAIMED})) AS unclaimed_assets,
    (SELECT COUNT(*) FROM (SELECT id FROM registry GROUP BY 1 HAVING COUNT(*) > 1)) AS duplicate_ids)
SELECT *, missing_assets + missing_sentinels + unclaimed_assets + CASE WHEN duplicate_ids > 0 THEN 1 ELSE 0 END AS problems,
  CASE WHEN missing_assets + missing_sentinels + unclaimed_assets + duplicate_ids > 0 THEN 1 ELSE 0 END AS exit_code FROM c""",
)
def registry_drift_summary(spark, root):
    return ops.registry_drift_summary(B.registry(spark, root), B.assets(spark, root), EXEMPT)


@query("duplicate_ids", "SELECT id, COUNT(*) AS rows FROM registry GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_ids(spark, root):
    return ops.duplicate_ids(B.registry(spark, root))


FABRIC = """SELECT o_orderkey AS receipt_id, o_custkey AS job_run_id, o_orderdate AS logged_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' ELSE 'MULTINODE_NCCL_V5_OK' END AS probe_sentinel,
  CAST(8 * (1 + o_custkey % 4) - CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 0 END AS VARCHAR) AS world_size, o_totalprice / 1000 AS busbw_gbps FROM orders"""
FABRIC_RUNS = """SELECT c_custkey AS job_run_id, CASE WHEN c_custkey % 6 = 0 THEN 'FAILED' WHEN c_custkey % 6 <> 1 THEN 'SUCCESS' END AS result,
  1 + c_custkey % 4 AS nodes FROM customer"""


@query(
    "fabric_verdict",
    f"""WITH f AS (SELECT DISTINCT ON (job_run_id) * FROM ({FABRIC}) ORDER BY job_run_id, logged_at, receipt_id)
SELECT r.job_run_id, nodes, world_size, busbw_gbps, CASE WHEN nodes > 1 THEN
  COALESCE(result, '') = 'SUCCESS' AND COALESCE(probe_sentinel, '') = 'MULTINODE_NCCL_V5_OK' AND COALESCE(world_size, '') = CAST(nodes * 8 AS VARCHAR) END AS ok
FROM ({FABRIC_RUNS}) r LEFT JOIN f USING (job_run_id)""",
)
def fabric_verdict(spark, root):
    key, run = F.col("o_orderkey"), F.col("o_custkey")
    receipts = B.table(spark, root, "orders").select(
        key.alias("receipt_id"), run.alias("job_run_id"), F.col("o_orderdate").alias("logged_at"),
        F.when(key % 7 == 0, "timeout").otherwise("MULTINODE_NCCL_V5_OK").alias("probe_sentinel"),
        (8 * (1 + run % 4) - F.when(key % 5 == 0, 8).otherwise(0)).cast("string").alias("world_size"),
        (F.col("o_totalprice") / 1000).alias("busbw_gbps"),
    )
    runs = B.table(spark, root, "customer").select(
        F.col("c_custkey").alias("job_run_id"),
        F.when(F.col("c_custkey") % 6 == 0, "FAILED").when(F.col("c_custkey") % 6 != 1, "SUCCESS").alias("result"),
        (1 + F.col("c_custkey") % 4).alias("nodes"),
    )
    return ops.fabric_verdict(runs, receipts)


@query(
    "failed_receipts",
    """WITH f AS (SELECT DISTINCT ON (job_run_id) * FROM receipts ORDER BY job_run_id, logged_at, receipt_id)
SELECT c_custkey AS job_run_id, receipt_id, CASE WHEN receipt_id IS NULL THEN 'no receipt' WHEN burn <> 'PASS' THEN 'burn' ELSE 'gpus_visible' END AS reason
FROM customer LEFT JOIN f ON f.job_run_id = c_custkey WHERE c_custkey % 3 > 0 AND NOT COALESCE(burn = 'PASS' AND gpus_visible = '8', FALSE)""",
)
def failed_receipts(spark, root):
    runs = B.table(spark, root, "customer").select(
        F.col("c_custkey").alias("job_run_id"), F.when(F.col("c_custkey") % 3 > 0, "SUCCESS").otherwise("FAILED").alias("result")
    )
    return ops.failed_receipts(runs, B.receipts(spark, root))


@query(
    "distinct_hardware",
    """WITH f AS (SELECT DISTINCT ON (job_run_id) * FROM receipts ORDER BY job_run_id, logged_at, receipt_id),
  j AS (SELECT job_run_id, burn, gpus_visible, gpu_uuids, burn = 'PASS' AND gpus_visible = '8' AS passed
    FROM (SELECT DISTINCT o_custkey AS job_run_id FROM orders) JOIN f USING (job_run_id))
SELECT (SELECT COUNT(*) FROM j) AS success_runs, (SELECT COUNT(*) FROM j WHERE passed) AS nodes_pass, n // 8 AS distinct_nodes,
  (SELECT COUNT(*) FROM j WHERE passed) = (SELECT COUNT(*) FROM j) AS burn_all_pass, n // 8 = (SELECT COUNT(*) FROM j WHERE passed) AS nodes_distinct,
  n // 8 >= 20 AS pool_coverage
FROM (SELECT COUNT(DISTINCT u) AS n FROM (SELECT unnest(string_split(gpu_uuids, ',')) AS u FROM j WHERE passed))""",
)
def distinct_hardware(spark, root):
    runs = B.table(spark, root, "orders").select(F.col("o_custkey").alias("job_run_id")).distinct()
    runs = runs.withColumn("result", F.lit("SUCCESS"))
    return ops.distinct_hardware(runs, B.receipts(spark, root), 20)


@query(
    "outcome_tally",
    f"""SELECT COUNT(*) FILTER (WHERE c IN ('success', 'other_failed')) AS done, COUNT(*) FILTER (WHERE c = 'quota_refused') AS quota_refusals,
  COUNT(*) FILTER (WHERE c = 'unfinished') AS unfinished, GREATEST(4, (SELECT MAX(active) FROM (SELECT CAST(SUM(net) OVER (ORDER BY moment) AS BIGINT) AS active FROM (
    SELECT moment, SUM(step) AS net FROM (SELECT hold_start AS moment, 1 AS step FROM probes UNION ALL SELECT hold_end, -1 FROM probes) GROUP BY 1)))) AS final_cap
  FROM (SELECT {CLASS} AS c FROM job_runs)""",
)
def outcome_tally(spark, root):
    peak = ledger_ops.peak_concurrency(B.probes(spark, root), "hold_start", "hold_end")
    return ops.outcome_tally(B.job_runs(spark, root), peak, B.KNOWN_CAP)


@query(
    "completion_gate",
    """SELECT COUNT(*) FILTER (WHERE result = 'SUCCESS') AS completed, COUNT(*) AS total,
  CAST(CASE WHEN COUNT(*) FILTER (WHERE result = 'SUCCESS') = 0 THEN 1 ELSE 0 END AS INT) AS exit_code FROM job_runs""",
)
def completion_gate(spark, root):
    done = F.coalesce(F.col("result") == "SUCCESS", F.lit(False))
    return ops.completion_gate(B.job_runs(spark, root).select(done.alias("completed")))


@query(
    "table_fingerprint",
    """SELECT o_orderpriority, COUNT(*) AS rows, CAST(SUM(CAST('0x' || left(md5(concat(length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey, length(CAST(o_custkey AS VARCHAR)), ':', o_custkey, length(o_orderstatus), ':', o_orderstatus)), 12) AS BIGINT)) AS VARCHAR) AS fingerprint
  FROM orders GROUP BY 1""",
)
def table_fingerprint(spark, root):
    orders = B.table(spark, root, "orders")
    return ops.table_fingerprint(orders, ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query(
    "table_difference",
    """SELECT o_orderkey AS key, 1 AS before, CASE WHEN o_orderkey % 1499 = 0 THEN 0 ELSE 1 END AS after FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 1499 = 0
UNION ALL SELECT o_orderkey + 1000000000, 0, 1 FROM orders WHERE o_orderkey % 1201 = 0""",
)
def table_difference(spark, root):
    """Orders against a copy with some owners changed, some orders gone and some new ones far beyond the others."""
    before = B.table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    owner = F.when(F.col("o_orderkey") % 997 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey")
    kept = before.filter("o_orderkey % 1499 <> 0").select("o_orderkey", owner, "o_orderstatus")
    added = before.filter("o_orderkey % 1201 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_custkey", "o_orderstatus")
    low, high = before.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return ops.changed_rows(before, kept.unionByName(added), before.columns, "o_orderkey", low, high)


@query(
    "key_skew",
    """SELECT l_suppkey, n AS rows, n / (total / CAST(keys AS DOUBLE)) AS ratio, abs(n / (total / CAST(keys AS DOUBLE)) - 1) <= 0.03 AS balanced
  FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1), (SELECT CAST(COUNT(*) AS DOUBLE) AS total, COUNT(DISTINCT l_suppkey) AS keys FROM lineitem)""",
)
def key_skew(spark, root):
    return ops.key_skew(B.table(spark, root, "lineitem"), "l_suppkey")


@query("row_count_control", "SELECT 'lineitem' AS table_name, COUNT(*) AS rows FROM lineitem")
def row_count_control(spark, root):
    return ops.row_count(B.table(spark, root, "lineitem"), "lineitem")


SHEET = ", ".join(
    f"COALESCE({c}, '') AS \"{h}\"" if c in ("test", "verdict", "hardware", "result_note", "evidence") else f"'' AS \"{h}\""
    for c, h in sinks.RESULT_COLUMNS
)


@query("write_results_csv", f"SELECT {SHEET} FROM registry")
def write_results_csv(spark, root):
    """Written as CSV and read back; empty text comes back as null, so it is filled again."""
    path = workspace.fresh_path(spark, "results_csv")
    table = B.registry(spark, root)
    sinks.write_results_csv(table, path)
    schema = sinks.results_table(table).schema
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").csv(path).na.fill("")


CELLS = " || ' | ' || ".join(
    f"replace(replace(COALESCE({c}, ''), '|', '\\|'), chr(10), ' ')" if c in ("test", "verdict", "hardware", "result_note", "evidence") else "''"
    for c, _ in sinks.RESULT_COLUMNS
)


HEADINGS = " | ".join(h for _, h in sinks.RESULT_COLUMNS)
RULE = " | ".join("---" for _ in sinks.RESULT_COLUMNS)


@query(
    "write_results_md",
    f"SELECT '| ' || {CELLS} || ' |' AS value FROM registry UNION ALL SELECT '| {HEADINGS} |' UNION ALL SELECT '| {RULE} |'",
)
def write_results_md(spark, root):
    path = workspace.fresh_path(spark, "results_md")
    sinks.write_results_md(B.registry(spark, root), path)
    return spark.read.text(path)
