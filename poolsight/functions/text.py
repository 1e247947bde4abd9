"""Expressions that mine log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the log formats.
ANSI_PATTERN = r"\x1b\[[0-9;]*m"
JOB_RUN_PATTERN = r"Job Run ID:\s*(\d+)"
RUN_ID_PATTERN = r'"?run_id"?\D*(\d{8,})'
REQUESTER_PATTERN = r"/Workspace/Users/([^/]+)/"
LINK_PATTERN = r"\$CODE_SOURCE_PATH/(\S+\.(?:py|sh))"
RESULT_PREFIX = "RESULT "
RESULT_PAIR_PATTERN = r"([A-Za-z_][A-Za-z0-9_]*)=('[^']*'|\S+)"
LAUNCHER_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - ([A-Z]+) - (.*)$"
CORRELATION_PATTERN = r"^\s*([a-z_]+_id)=(\S+)\s*$"
EXIT_CODE_PATTERN = r"exited with code (\d+)"
START_MARKER = "LauncherStarted"
USER_CODE_MARKER = "UserCodeStarted"
KEY_BAD_CHARS = r"[^A-Za-z0-9_\-. /]"
PARAM_CHARS = 500
CORRELATION_KEYS = (
    "job_id", "job_task_run_id", "mlflow_experiment_id", "mlflow_run_id", "run_id",
    "workload_id", "workspace_id",
)
# Symptom fragments (all must occur) -> cause; first rule that holds wins.
SYMPTOM_RULES = (
    (("CUDA", "out of memory"), "gpu_oom"),
    (("grpc-status: 0",), "telemetry_auth_hidden"),
    (("Unknown field", "env_variables"), "env_variables_misplaced"),
    (("usage_policy_name",), "missing_usage_policy"),
    (("PERMISSION_DENIED",), "wrong_workspace"),
    (("qemu", "Segmentation fault"), "docker_emulation"),
)
HOST_OOM_CAUSE = "host_ram_oom"


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_PATTERN, "")


def job_run_id(text: Column) -> Column:
    """The submit confirmation first, else the first long run_id in a JSON-ish reply."""
    clean = strip_ansi(text)
    return F.coalesce(_first_group(clean, JOB_RUN_PATTERN), _first_group(clean, RUN_ID_PATTERN))


def requester(override: Column, path: Column) -> Column:
    """An explicit submitter wins over the one derived from the workspace path."""
    return F.coalesce(F.nullif(override, F.lit("")), _first_group(path, REQUESTER_PATTERN))


def result_pairs(line: Column) -> Column:
    """Map entries of a RESULT line, in order, as array<struct<key, value>>."""
    keys = F.regexp_extract_all(line, F.lit(RESULT_PAIR_PATTERN), 1)
    values = F.regexp_extract_all(line, F.lit(RESULT_PAIR_PATTERN), 2)
    return F.when(line.startswith(RESULT_PREFIX), F.arrays_zip(keys.alias("key"), values.alias("value")))


def present_sentinels(text: Column, sentinels: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in sentinels]), lambda s: text.contains(s))


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK_PATTERN), 1)


def failure_symptom(text: Column) -> Column:
    """Exit 137 without a traceback is host memory; the rest are ordered fragment rules."""
    cause = F.when(text.contains("exit 137") & ~text.contains("Traceback"), HOST_OOM_CAUSE)
    for fragments, name in SYMPTOM_RULES:
        hit = F.lit(True)
        for fragment in fragments:
            hit = hit & text.contains(fragment)
        cause = cause.when(hit, name)
    return cause


def clean_key(key: Column) -> Column:
    return F.regexp_replace(key, KEY_BAD_CHARS, "_")


SIZE_PATTERN = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(.?)"


def size_bytes(text: Column) -> Column:
    """A number as C reads it (sign, fraction, exponent) and a unit letter, `4K`, `.5M`, `1e3`, to bytes.

    Other units and text without a leading number give -1.
    """
    number = _first_group(text, SIZE_PATTERN)
    unit = F.upper(F.regexp_extract(text, SIZE_PATTERN, 2))
    factor = (
        F.when(unit == "", 1.0)
        .when(unit == "K", 1024.0)
        .when(unit == "M", 1024.0**2)
        .when(unit == "G", 1024.0**3)
    )
    return F.coalesce(number.cast("double") * factor, F.lit(-1.0))


def number_or_null(text: Column) -> Column:
    """Numeric text as double; text that is not a finite-format number becomes null."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, text.try_cast("double"))
