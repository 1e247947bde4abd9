"""SQL text of the bindings, for the oracles only.

Each view gives the driver's tables the shape an operator expects. Values are assigned with
CASE over whole tables; no view drops rows to stay small. The DataFrame twins are in
`bindings.py`.
"""

VIEWS = {
    "usage": """
SELECT CAST(l_shipdate AS DATE) AS usage_date, l_shipdate AS usage_start_time,
  l_suppkey % 5 AS workspace_id, 'DBU' AS usage_unit,
  CASE WHEN l_suppkey % 2 = 0 THEN 'AWS' ELSE 'AZURE' END AS cloud,
  CASE WHEN l_returnflag = 'R' THEN 'GPU_PROVISIONED_CAPACITY_S' WHEN l_returnflag = 'A' THEN 'GPU_ON_DEMAND_S'
       ELSE 'GPU_REGIONAL_S' END || CAST(l_suppkey AS VARCHAR) AS sku_name,
  CASE WHEN l_linenumber % 4 = 1 THEN 'RESERVED_COMPUTE' WHEN l_linenumber % 4 = 2 THEN 'ON_DEMAND_COMPUTE' END AS compute_type,
  CASE WHEN l_linenumber % 4 = 3 THEN 'NOTEBOOK' END AS workload_type,
  CAST(NULL AS VARCHAR) AS run_as, CASE WHEN o_orderpriority = '5-LOW' THEN c_mktsegment END AS owned_by,
  CASE WHEN o_orderstatus <> 'P' THEN c_name END AS created_by,
  o_orderkey AS job_id, CASE WHEN l_returnflag = 'R' THEN 'pool-' || CAST(l_suppkey % 3 AS VARCHAR) END AS pool_id,
  CASE WHEN l_linenumber % 4 = 2 THEN 'w-' || CAST(o_orderkey AS VARCHAR) END AS workload_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN c_mktsegment END AS tag_segment,
  CASE WHEN l_linenumber <= 3 THEN o_orderpriority END AS tag_priority,
  l_quantity AS usage_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "list_prices": """
SELECT 'GPU_PROVISIONED_CAPACITY_S' || CAST(s_suppkey AS VARCHAR) AS sku_name, 'AWS' AS cloud,
  TIMESTAMP '1995-01-01 00:00:00' AS price_start_time, TIMESTAMP '1998-01-01 00:00:00' AS price_end_time,
  2.0 + 0.25 * (s_suppkey % 4) AS price FROM supplier
UNION ALL SELECT 'GPU_PROVISIONED_CAPACITY_S' || CAST(s_suppkey AS VARCHAR), 'AWS',
  TIMESTAMP '1998-01-01 00:00:00', CAST(NULL AS TIMESTAMP), 2.5 + 0.25 * (s_suppkey % 4) FROM supplier
UNION ALL SELECT 'GPU_ON_DEMAND_S' || CAST(s_suppkey AS VARCHAR), 'AZURE',
  TIMESTAMP '1996-01-01 00:00:00', CAST(NULL AS TIMESTAMP), 4.0 FROM supplier""",
    "teams": """
SELECT 'team-' || CAST(n_nationkey AS VARCHAR) AS team, n_nationkey AS pos, 2 * (n_nationkey % 5) AS quota_nodes FROM nation""",
    "members": """
SELECT 'team-' || CAST(c_nationkey AS VARCHAR) AS team, c_nationkey AS pos,
  CASE WHEN c_custkey % 7 <> 0 THEN UPPER(c_name) ELSE 'x' || c_name END AS member FROM customer
UNION ALL SELECT 'team-24', 24, CASE WHEN c_custkey % 10 = 1 THEN c_name ELSE 'y' || c_name END FROM customer""",
    "use_cases": """
SELECT 'team-' || CAST(n_nationkey AS VARCHAR) AS team, n_regionkey AS pos, 'uc-' || CAST(n_regionkey % 3 AS VARCHAR) AS use_case FROM nation""",
    "workloads": """
SELECT p_partkey AS id, 'wl-' || CAST(p_partkey AS VARCHAR) AS name, 'team-' || CAST(p_partkey % 26 AS VARCHAR) AS team,
  'uc-' || CAST(p_partkey % 3 AS VARCHAR) AS use_case, 'yaml' AS kind, 'workloads/wl-' || CAST(p_partkey AS VARCHAR) || '.yaml' AS ref,
  CASE WHEN p_partkey % 3 = 0 THEN 'GPU_8xH100' WHEN p_partkey % 3 = 1 THEN 'GPU_1xH100' ELSE 'GPU_1xA10' END AS shape,
  1 + p_size % 2 AS nodes, p_size AS num_accelerators, p_partkey % 2 AS needs_torch,
  CASE WHEN p_partkey % 5 = 0 THEN 'hand' ELSE 'repo-sync' END AS created_by FROM part""",
    "runs": """
SELECT o_orderkey AS id, o_custkey AS workload_id, 'Customer#' || LPAD(CAST(o_custkey AS VARCHAR), 9, '0') AS requested_by, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3000 = 0 THEN 'RUNNING' WHEN o_orderkey % 3000 = 1 THEN 'SUBMITTED' WHEN o_orderkey % 100 = 2 THEN 'QUEUED'
       WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'CANCELED' ELSE 'SUCCESS' END AS state,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Workspace has exceeded its GPU quota' WHEN o_orderstatus = 'F' THEN 'user code failed' ELSE '' END AS detail
FROM orders""",
    "ledger": """
SELECT r.id, r.workload_id, r.requested_by, r.created_at, r.state, r.detail, w.team, w.use_case, w.name, w.shape, w.nodes, w.kind, w.ref, w.needs_torch
FROM runs r JOIN workloads w ON w.id = r.workload_id""",
    "run_polls": """
SELECT event_id AS seq, ts, user_id AS run_id,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'INTERNAL_ERROR' WHEN 'purchase' THEN 'TERMINATED' ELSE 'RUNNING' END AS life,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'SUCCESS' WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'CANCELED' END AS result,
  REPEAT(props || ' ', 60) AS message,
  CASE WHEN event_id % 2 = 0 THEN 'SUBMITTED' ELSE 'RUNNING' END AS state FROM events""",
    "otel_logs": """
SELECT event_id, ts AS time, event_type AS service_name, CAST(user_id AS VARCHAR) AS mlflow_run_id,
  CASE WHEN user_id % 3 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) END AS requester,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN' ELSE 'INFO' END AS severity_text,
  CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' THEN 13 ELSE 9 END AS severity_number,
  props AS attributes, 'value ' || event_type AS body FROM events""",
    "timeline": """
SELECT c_custkey AS run_id, c_name AS run_as, CAST(c_custkey % 150 AS VARCHAR) AS param_a,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 150 AS VARCHAR) ELSE 'x' END AS param_b,
  TIMESTAMP '2024-01-01 00:00:00' AS period_start_time,
  CASE WHEN c_nationkey % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS result_state FROM customer""",
    "gpu_samples": """
SELECT event_id AS sample_id, ts, user_id % 20 AS node, event_id % 8 AS gpu, 'GPU-' || CAST(user_id % 20 AS VARCHAR) || '-' || CAST(event_id % 8 AS VARCHAR) AS gpu_uuid,
  CAST(FLOOR(value) AS BIGINT) % 90 AS temp_c, value AS power_w, CASE WHEN user_id % 4 = 0 THEN 4 ELSE event_id % 256 END AS throttle,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 7 ELSE CAST(FLOOR(event_id / 4000.0) AS BIGINT) END AS ecc,
  25 + event_id % 50 AS iters FROM events""",
    "collective_bench": """
SELECT l_orderkey AS run, CASE l_partkey % 10 WHEN 0 THEN 'all_reduce' WHEN 1 THEN 'all_gather' WHEN 2 THEN 'reduce_scatter'
  WHEN 3 THEN 'alltoall' WHEN 4 THEN 'broadcast' WHEN 5 THEN 'reduce' WHEN 6 THEN 'gather' WHEN 7 THEN 'scatter' WHEN 8 THEN 'sendrecv' ELSE 'hypercube' END AS collective,
  8 * (1 + l_suppkey % 4) AS nranks, l_partkey * 1048576 AS cnt, 4 AS type_size, (l_quantity + 1) / 1000.0 AS sec,
  l_linenumber - 1 AS rank FROM lineitem""",
    "probes": """
SELECT event_id AS probe_id, 'boot-' || CAST(user_id % 20 AS VARCHAR) AS boot_id, ts AS hold_start,
  ts + INTERVAL '10' SECOND * CAST(FLOOR(value) AS INT) AS hold_end, event_id % 8 AS gpu, (event_id + user_id) % 8 AS gpu2 FROM events""",
    "loss_curve": """
SELECT user_id AS run, event_id AS step, ts,
  CASE WHEN user_id % 50 = 7 AND event_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value / 50.0 END AS loss FROM events""",
    "check_results": """
SELECT event_id AS id, user_id AS run, event_type AS check_name, CASE WHEN user_id % 2 = 0 THEN 'CPU' ELSE 'GPU_1xA10' END AS shape,
  CASE user_id % 6 WHEN 0 THEN 'pypi_egress' WHEN 1 THEN 'root_storage_tcp443' WHEN 2 THEN 'burn_runs_terminal' WHEN 3 THEN 'catalog_bucket_read'
    WHEN 4 THEN 'root_storage_tcp443' ELSE 'cli_ready' END AS probe,
  CASE WHEN user_id % 10 = 3 THEN TRUE ELSE CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END END AS ok, props AS detail FROM events""",
    "checks": """
SELECT user_id AS run, CASE WHEN user_id % 3 = 0 AND event_type = 'error' THEN 'FAIL' WHEN user_id % 3 = 1 AND event_type = 'view' THEN 'SKIPPED' ELSE 'PASS' END AS status,
  CASE WHEN user_id % 11 = 2 THEN 'smoke' ELSE 'full' END AS scope FROM events""",
    "registry": """
SELECT 'test-' || CAST(CASE WHEN p_partkey % 40 = 39 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS id,
  CASE WHEN p_partkey % 9 <> 0 THEN 'workloads/w' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN '.example.yaml' ELSE '.yaml' END END AS asset,
  p_name AS test, CASE p_partkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'BLOCKED' ELSE 'NOT RUN' END AS verdict,
  p_brand AS hardware, 'a|b' || chr(10) || p_type AS result_note, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS evidence,
  CASE WHEN p_partkey % 7 <> 0 THEN ['RESULT burn=PASS', 'torchrun'] END AS sentinels,
  CASE WHEN p_partkey % 8 = 1 THEN 'waiting for a node' END AS sentinels_pending FROM part""",
    "assets": """
SELECT 'workloads/w' || CAST(p_partkey + 5 AS VARCHAR) || CASE WHEN p_partkey % 4 = 3 THEN '.example.yaml' ELSE '.yaml' END AS path,
  'torchrun $CODE_SOURCE_PATH/scripts/s' || CAST((p_partkey + 5) % 50 AS VARCHAR) || '.py && echo started' AS text FROM part
UNION ALL SELECT 'workloads/w' || CAST(p_partkey + 5 AS VARCHAR) || '.yaml', 'live copy' FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT 'workloads/probes/w' || CAST(p_partkey AS VARCHAR) || '.yaml', 'probe' FROM part
UNION ALL SELECT 'scripts/s' || CAST(n_nationkey AS VARCHAR) || '.py', 'print("RESULT burn=PASS")' FROM nation""",
    "log_lines": """
SELECT event_id, user_id AS run, CASE event_type
  WHEN 'error' THEN chr(27) || '[31mSubmitted workload with Job Run ID: ' || CAST(968264353316767 + event_id AS VARCHAR) || chr(27) || '[0m'
  WHEN 'purchase' THEN 'RESULT gpu=' || CAST(event_id % 8 AS VARCHAR) || ' name=''GPU model ' || CAST(user_id AS VARCHAR) || ''' tflops=' || CAST(event_id % 700 AS VARCHAR)
  WHEN 'view' THEN 'Hyperparameters path: /Workspace/Users/u' || CAST(user_id AS VARCHAR) || '@example.com/x'
  WHEN 'click' THEN CASE event_id % 7 WHEN 0 THEN 'Killed with exit 137' WHEN 1 THEN 'Traceback: exit 137' WHEN 2 THEN 'RuntimeError: CUDA error: out of memory'
    WHEN 3 THEN 'export OK grpc-status: 0' WHEN 4 THEN 'Unknown field env_variables' WHEN 5 THEN '{"run_id": ' || CAST(10000000 + event_id AS VARCHAR) || '}' ELSE 'PERMISSION_DENIED' END
  ELSE 'noise' END AS line FROM events""",
    "receipts": """
SELECT o_orderkey AS receipt_id, o_custkey AS job_run_id, o_orderdate AS logged_at,
  CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS burn, CASE WHEN o_orderkey % 9 = 0 THEN '4' ELSE '8' END AS gpus_visible,
  'GPU-' || CAST(o_custkey % 400 AS VARCHAR) || '-0,GPU-' || CAST(o_custkey % 400 AS VARCHAR) || '-1,GPU-' || CAST(o_custkey % 400 AS VARCHAR) || '-2,GPU-' || CAST(o_custkey % 400 AS VARCHAR) || '-3' AS gpu_uuids
FROM orders""",
    "job_runs": """
SELECT o_orderkey AS job_run_id, CASE WHEN o_orderkey % 3000 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'CANCELED' ELSE 'SUCCESS' END AS result,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Workspace has exceeded its GPU quota' WHEN o_orderstatus = 'F' THEN 'user code failed' END AS message
FROM orders""",
    "manifests": """
SELECT p_partkey AS k, 'fam' || CAST(p_partkey % 40 AS VARCHAR) || '/' ||
  CASE p_partkey % 6 WHEN 0 THEN 'probes' WHEN 1 THEN 'tabicl' WHEN 2 THEN 'plain' WHEN 3 THEN 'rdma-stress' WHEN 4 THEN 'xgboost' ELSE 'misc' END || '-' || CAST(p_partkey // 2 AS VARCHAR) ||
  CASE WHEN p_partkey % 3 = 0 THEN '.example.yaml' ELSE '.yaml' END AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'experiments/multinode/' WHEN 1 THEN 'experiments/foundation-models/lora/' WHEN 2 THEN 'experiments/other/' WHEN 3 THEN 'experiments/env-flexibility/' ELSE 'data/' END AS include_path,
  CASE WHEN p_partkey % 3 = 0 THEN 'GPU_8xH100' WHEN p_partkey % 3 = 1 THEN 'GPU_1xA10' END AS shape,
  p_size AS num_accelerators,
  CASE WHEN p_partkey % 13 = 5 THEN NULL WHEN p_partkey % 2 = 0 THEN 'torchrun $CODE_SOURCE_PATH/run' || CAST(p_partkey AS VARCHAR) || '.py' ELSE 'bash $CODE_SOURCE_PATH/a.sh ' || p_brand END AS command,
  p_partkey % 17 = 3 AS broken FROM part""",
    "pred_bin": """
SELECT d.doc_id AS id, d.source, l.quality AS y, CAST(d.n_chars % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pred_multi": """
SELECT doc_id AS id, source, lang AS y, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS yhat FROM documents""",
    "pred_reg": """
SELECT o_orderkey AS id, o_orderpriority AS dataset, o_totalprice AS y, o_totalprice * CAST(90 + o_orderkey % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS yhat FROM orders""",
    "features": """
SELECT o_orderkey AS id, o_orderpriority AS priority, c_mktsegment AS segment, c_acctbal AS balance,
  CASE o_orderkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || 'e2' ELSE CAST(o_custkey AS VARCHAR) END AS target,
  o_totalprice AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part
FROM orders JOIN customer ON o_custkey = c_custkey""",
}
