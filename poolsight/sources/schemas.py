"""Declared schemas. Nothing is inferred at read time."""

from __future__ import annotations

USAGE = """
  usage_date date, usage_start_time timestamp_ntz, workspace_id bigint, cloud string, sku_name string,
  usage_unit string, usage_quantity double,
  product_features struct<pool: struct<compute_type: string>, notebook: struct<workload_type: string>>,
  identity_metadata struct<run_as: string, owned_by: string, created_by: string>,
  usage_metadata struct<job_id: bigint, pool_id: string, workload_id: string>,
  custom_tags map<string, string>
"""

LIST_PRICES = """
  sku_name string, cloud string, price_start_time timestamp_ntz, price_end_time timestamp_ntz,
  pricing struct<`default`: double>
"""

JOB_RUN_TIMELINE = """
  run_id bigint, job_parameters map<string, string>, identity_metadata struct<run_as: string>,
  period_start_time timestamp_ntz, result_state string
"""

TELEMETRY_LOGS = """
  record_id string, time timestamp_ntz, date date, service_name string, event_name string,
  trace_id string, span_id string, time_unix_nano bigint, observed_time_unix_nano bigint,
  severity_number string, severity_text string, body variant, attributes variant,
  dropped_attributes_count int, flags int,
  resource struct<attributes: variant, dropped_attributes_count: int>,
  resource_schema_url string,
  instrumentation_scope struct<name: string, version: string, attributes: variant,
                               dropped_attributes_count: int>,
  log_schema_url string
"""

# Gauges and counters exported every ten seconds; GPU gauges carry the GPU's number as an attribute.
TELEMETRY_METRICS = """
  record_id string, time timestamp_ntz, date date, service_name string, name string, kind string,
  value double, attributes variant, resource struct<attributes: variant>
"""

EVENTS = """
  event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string
"""

# `use_cases` entries may be plain names or objects, so each is read as raw JSON text.
CONFIG = """
  reservation struct<total_nodes: int, gpus_per_node: int, accelerator_type: string, region: string>,
  platform_quotas map<string, int>, catalog_team string,
  teams array<struct<name: string, quota_nodes: int, members: array<string>, use_cases: array<string>>>
"""

CATALOG = """
  name string, kind string, ref string, team string, use_case string, shape string, nodes int,
  needs_torch int, source string
"""

MANIFEST = """
  path string, experiment_name string, accelerator_type string, num_accelerators int,
  include_paths array<string>, command string, max_retries int, timeout_minutes int, problem string
"""

CHECK_RESULTS = "map<string, struct<ok: boolean, detail: string>>"
CHECK_PAYLOAD = f"`check` string, results {CHECK_RESULTS}"
