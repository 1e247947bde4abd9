"""Expressions over runs, workloads and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLDING_STATES = ("SUBMITTED", "RUNNING")
ACTIVE_STATES = ("QUEUED", "SUBMITTED", "RUNNING")
# API life-cycle states that end a run.
TERMINAL_LIFE = ("TERMINATED", "INTERNAL_ERROR", "SKIPPED")
TERMINAL_STATES = ("SUCCESS", "CANCELED", "FAILED")
DETAIL_CHARS = 400
QUOTA_MESSAGE = "GPU quota"
NO_CAP_NODES = 999
NO_QUOTA_RATIO = 1e9

# Experiment family -> use case, first match wins, with a default.
USE_CASE_RULES = (
    ("node-acceptance", "node-acceptance"),
    ("probes", "env-diagnostics"),
    ("scheduling-isolation", "scheduling-isolation"),
    ("vendored-wheels", "dependencies"),
    ("env-flexibility", "dependencies"),
    ("docker-otel-zerobus", "telemetry"),
    ("foundation-models", "foundation-models"),
    ("tabicl", "classic-ml"),
    ("xgboost", "classic-ml"),
    ("multi-language", "multi-language"),
    ("multinode", "node-acceptance"),
    ("rdma-stress", "node-acceptance"),
)
DEFAULT_USE_CASE = "env-diagnostics"


def state_in(states: Sequence[str] | None, column: str = "state") -> Column:
    """None selects every state."""
    return F.lit(True) if states is None else F.col(column).isin(*states)


def is_terminal(life: Column) -> Column:
    return life.isin(*TERMINAL_LIFE)


def final_state(result: Column) -> Column:
    return F.when(result.isin("SUCCESS", "CANCELED"), result).otherwise("FAILED")


def ledger_state(life: Column, result: Column, current: Column) -> Column:
    """State after one poll: terminal lives settle, RUNNING shows, anything else changes nothing."""
    return (
        F.when(is_terminal(life), final_state(result))
        .when(life == "RUNNING", "RUNNING")
        .otherwise(current)
    )


def clipped_detail(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, DETAIL_CHARS)


def outcome_class(result: Column, message: Column) -> Column:
    return (
        F.when(result.isNull(), "unfinished")
        .when(result == "SUCCESS", "success")
        .when(F.coalesce(message, F.lit("")).contains(QUOTA_MESSAGE), "quota_refused")
        .otherwise("other_failed")
    )


def node_count(accelerators: Column, shape: Column) -> Column:
    """Whole nodes for an accelerator count; shapes with `8x` hold eight per node."""
    per_node = F.when(shape.contains("8x"), 8).otherwise(1)
    whole = F.floor(F.coalesce(accelerators, F.lit(1)) / per_node).cast("int")
    return F.greatest(F.lit(1), whole)


def use_case(hints: Column, rules: Sequence[tuple[str, str]] = USE_CASE_RULES,
             default: str = DEFAULT_USE_CASE) -> Column:
    """First rule that matches the first hint that matches any rule."""

    def of_hint(hint: Column) -> Column:
        return F.coalesce(*[F.when(hint.contains(key), F.lit(case)) for key, case in rules])

    matched = F.filter(F.transform(hints, of_hint), lambda case: case.isNotNull())
    return F.coalesce(F.get(matched, F.lit(0)), F.lit(default))


def needs_torch(command: Column) -> Column:
    return command.contains("torch").cast("int")


def manifest_key(path: Column) -> Column:
    """Directory and stem: a live file and its `.example` twin share one key."""
    return F.regexp_replace(F.regexp_replace(path, r"\.example\.yaml", ""), r"\.yaml", "")


def admittable(caps: Sequence[Column], in_flight: Column) -> Column:
    """Smallest positive cap minus what is in flight, never negative."""
    positive = F.filter(F.array(*caps), lambda cap: cap > 0)
    bound = F.coalesce(F.array_min(positive), F.lit(NO_CAP_NODES).cast("bigint"))
    return F.greatest(F.lit(0).cast("bigint"), bound - in_flight)
