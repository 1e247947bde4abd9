"""Verdicts, drift and registry integrity (family E)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsight.functions import ledger as L
from poolsight.functions import text as T
from poolsight.operators import logs
from poolsight.sources import workspace

# Probes expected to fail everywhere, and those expected to fail off CPU.
EXPECTED_BROKEN = ("catalog_bucket_read", "pypi_egress", "mlflow_artifact_upload")
BROKEN_OFF_CPU = ("root_storage_tcp443",)
NOT_A_VERDICT = ("burn_runs_terminal",)
GPUS_PER_NODE = 8

PASS_MARK, FAIL_MARK, SKIP_MARK = "pass", "fail", "skipped"


def drift_classify(results: DataFrame, broken=EXPECTED_BROKEN, broken_off_cpu=BROKEN_OFF_CPU) -> DataFrame:
    """Got against expected: CHANGED when a known failure passes, REGRESSION the other way."""
    probe = F.col("probe")
    expect_fail = probe.isin(*broken) | (probe.isin(*broken_off_cpu) & (F.col("shape") != "CPU"))
    ok = F.col("ok")
    return results.select(
        *results.columns,
        F.when(ok.isNull(), SKIP_MARK).when(ok, PASS_MARK).otherwise(FAIL_MARK).alias("got"),
        F.when(expect_fail, FAIL_MARK).otherwise(PASS_MARK).alias("expected"),
        F.when(ok.isNull(), "").when(ok & expect_fail, "CHANGED").when(~ok & ~expect_fail, "REGRESSION")
        .otherwise("").alias("drift"),
    )


def verdict_counts(drifted: DataFrame) -> DataFrame:
    return drifted.agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("got") == PASS_MARK).alias("passed"),
        F.count_if(F.col("got") == FAIL_MARK).alias("failed"),
        F.count_if(F.col("got") == SKIP_MARK).alias("skipped"),
        F.count_if(F.col("drift") == "CHANGED").alias("changed"),
        F.count_if(F.col("drift") == "REGRESSION").alias("regressions"),
    )


def pool_ready(results: DataFrame, by: Sequence[str] = (), ignored=NOT_A_VERDICT) -> DataFrame:
    """AND over checks that ran; skipped and purely informative ones do not count."""
    counted = F.when(~F.col("probe").isin(*ignored), F.col("ok"))
    return results.groupBy(*by).agg(
        F.coalesce(F.bool_and(counted), F.lit(True)).alias("pool_ready"),
        F.count(counted).alias("checks_counted"),
    )


def acceptance_verdict(checks: DataFrame, by: str = "run") -> DataFrame:
    """FAIL beats everything; a soft status or smoke scope adds caveats. Exit code 1 only on FAIL."""
    failed = F.max((F.col("status") == "FAIL").cast("int")) == 1
    soft = F.max(
        (F.col("status").isin("BLOCKED", "SKIPPED", "NA") | (F.col("scope") == "smoke")).cast("int")
    ) == 1
    return checks.groupBy(by).agg(
        F.when(failed, "NOT ACCEPTED").when(soft, "ACCEPTED WITH CAVEATS").otherwise("ACCEPTED").alias("verdict"),
        F.when(failed, 1).otherwise(0).alias("exit_code"),
    )


def registry_missing_asset(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry rows whose asset is not among the files; a row without asset is skipped."""
    named = registry.filter(F.col("asset").isNotNull())
    return named.join(_large(files.select(F.col("path").alias("asset"))), "asset", "left_anti").select("id", "asset")


def _large(side: DataFrame) -> DataFrame:
    """A side as long as the registry or the files, joined by sorting.

    Its size on disk, by which the planner broadcasts, is a small part of what its texts take in the driver's memory.
    """
    return side.hint("merge")


GLOB_PARTS = re.compile(r"(\*\*/?)|(\*)|(\?)|(\[!?[^\]]+\])|(.)")


def glob_pattern(globs: Sequence[str]) -> str:
    """One anchored regex for shell globs: `*` and `?` stay inside a folder, `**` crosses folders."""

    def part(found: re.Match) -> str:
        deep, star, one, charset, plain = found.groups()
        if deep:
            return "(?:.*/)?" if deep.endswith("/") else ".*"
        if charset:
            return "[" + ("^" if charset[1] == "!" else "") + charset[1:-1].lstrip("!").replace("\\", "\\\\") + "]"
        return "[^/]*" if star else "[^/]" if one else re.escape(plain)

    return "^(" + "|".join(GLOB_PARTS.sub(part, g) for g in globs) + ")$"


def asset_unclaimed(
    files: DataFrame, registry: DataFrame, exempt_globs: Sequence[str], root: str = "workloads"
) -> DataFrame:
    """Top-level manifests that no row claims and no glob exempts.

    A live file beside its `.example` twin rolls up into the twin.
    """
    top = files.select("path").filter(F.col("path").rlike(rf"^{re.escape(root)}/[^/]*\.yaml$"))
    if exempt_globs:
        top = top.filter(~F.col("path").rlike(glob_pattern(exempt_globs)))
    twins = files.select(F.col("path").alias("_twin"))
    claimed = registry.filter(F.col("asset").isNotNull()).select(F.col("asset").alias("path"))
    live_twin = F.regexp_replace("path", r"\.yaml$", ".example.yaml")
    return top.join(_large(claimed), "path", "left_anti").join(
        _large(twins), (~F.col("path").endswith(".example.yaml")) & (live_twin == F.col("_twin")), "left_anti"
    )


def sentinel_link(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Each declared sentinel against its asset and the scripts the asset refers to.

    Rows whose asset is missing are left to `registry_missing_asset`. Paths are resolved by equi
    joins. Each file's text moves once, beside the sentinels asked of it (a part of the registry's),
    however many assets share the file.
    """
    assets = files.join(_large(registry.select(F.col("asset").alias("path")).distinct()), "path", "left_semi")
    scripts = assets.filter(F.col("path").endswith(".yaml")).select(
        F.col("path").alias("asset"), F.explode(T.links(F.col("text"))).alias("path")
    )
    linked = scripts.unionByName(assets.select(F.col("path").alias("asset"), "path")).distinct()
    declared = registry.select("id", "asset", F.explode("sentinels").alias("sentinel"))
    pairs = declared.join(_large(linked), "asset")
    asked = pairs.groupBy("path").agg(F.collect_set("sentinel").alias("asked"))
    found = F.filter("asked", lambda sentinel: F.contains(F.col("text"), sentinel))
    hits = (
        asked.join(_large(files.select("path", "text")), "path")
        .select("path", F.explode(found).alias("sentinel"))
        .withColumn("_hit", F.lit(True))
    )
    return (
        pairs.join(_large(hits), ["path", "sentinel"], "left")
        .groupBy("id", "asset", "sentinel")
        .agg(F.bool_or(F.col("_hit").isNotNull()).alias("found"))
    )


def registry_drift_summary(registry: DataFrame, files: DataFrame, exempt_globs: Sequence[str]) -> DataFrame:
    """Tests, sentinel-linked tests, problems by kind and pending ones, with an exit code.

    A missing sentinel is pending, not a problem, where its row says why (`sentinels_pending`).
    Each check is reduced to one count before the counts meet.
    """
    waiting = registry.filter(F.col("sentinels_pending").isNotNull()).select("id").distinct().withColumn("_p", F.lit(1))
    absent = sentinel_link(registry, files).filter(~F.col("found")).join(_large(waiting), "id", "left")
    size = F.count(F.lit(1))
    # the sentinels are linked once for both of their counts
    linked = absent.agg(F.count_if(F.col("_p").isNull()).alias("missing"), F.count("_p").alias("pending"))
    counts = {
        "tests": registry.agg(size.alias("n")),
        "sentinel_linked": registry.agg(F.count_if(F.size("sentinels") > 0).alias("n")),
        "missing_assets": registry_missing_asset(registry, files).agg(size.alias("n")),
        "unclaimed_assets": asset_unclaimed(files, registry, exempt_globs).agg(size.alias("n")),
        "duplicate_ids": duplicate_ids(registry).agg(size.alias("n")),
    }
    rows = linked.selectExpr("stack(2, 'missing_sentinels', missing, 'pending', pending) AS (kind, n)")
    for kind, frame in counts.items():
        rows = rows.unionByName(frame.select(F.lit(kind).alias("kind"), "n"))
    kinds = ("tests", "sentinel_linked", "missing_assets", "missing_sentinels", "pending", "unclaimed_assets", "duplicate_ids")
    summary = rows.agg(*[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in kinds])
    duplicated = (F.col("duplicate_ids") > 0).cast("bigint")
    problems = F.col("missing_assets") + F.col("missing_sentinels") + F.col("unclaimed_assets") + duplicated
    return summary.withColumn("problems", problems).withColumn("exit_code", F.when(problems > 0, 1).otherwise(0))


def duplicate_ids(registry: DataFrame) -> DataFrame:
    return registry.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def distinct_hardware(runs: DataFrame, receipts: DataFrame, requested: int) -> DataFrame:
    """Passing first receipts of SUCCESS runs against the distinct nodes their GPU ids prove.

    One receipt counts per run, the first. Host names repeat across nodes, so nodes are counted as distinct GPU ids over eight. The
    distinct count spreads over the ids and no id list is gathered.
    """
    done = runs.filter(F.col("result") == "SUCCESS").select("job_run_id")
    joined = done.join(logs.first_receipts(receipts), "job_run_id", "left")
    passed = (F.col("burn") == "PASS") & (F.col("gpus_visible") == str(GPUS_PER_NODE))
    flagged = joined.select(
        F.coalesce(passed, F.lit(False)).alias("passed"), F.split("gpu_uuids", ",").alias("ids")
    )
    per_run = flagged.agg(
        F.count(F.lit(1)).alias("success_runs"), F.count_if("passed").alias("nodes_pass")
    )
    ids = flagged.filter("passed").select(F.explode("ids").alias("uuid")).agg(F.countDistinct("uuid").alias("n"))
    distinct = F.floor(ids.scalar() / GPUS_PER_NODE).cast("bigint")
    return per_run.select("success_runs", "nodes_pass", distinct.alias("distinct_nodes")).select(
        "*",
        ((F.col("nodes_pass") == F.col("success_runs")) & (F.col("success_runs") > 0)).alias("burn_all_pass"),
        (F.col("distinct_nodes") == F.col("nodes_pass")).alias("nodes_distinct"),
        (F.col("distinct_nodes") >= requested).alias("pool_coverage"),
    )


def failed_receipts(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """SUCCESS runs whose first receipt does not pass, and why: none found, burn or GPU count."""
    done = runs.filter(F.col("result") == "SUCCESS").select("job_run_id")
    joined = done.join(logs.first_receipts(receipts), "job_run_id", "left")
    reason = (
        F.when(F.col("receipt_id").isNull(), "no receipt")
        .when(~F.col("burn").eqNullSafe(F.lit("PASS")), "burn")
        .when(~F.col("gpus_visible").eqNullSafe(F.lit(str(GPUS_PER_NODE))), "gpus_visible")
    )
    return joined.select("job_run_id", "receipt_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


# Fixed value: printed by a fabric probe whose result is right on every rank.
FABRIC_SENTINEL = "MULTINODE_NCCL_V5_OK"


def fabric_verdict(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Whether each fabric run (job_run_id, result, nodes) proved its fabric; null below two nodes.

    It did if it succeeded and its first receipt shows the sentinel and one rank for every GPU asked for.
    """
    found = runs.join(logs.first_receipts(receipts), "job_run_id", "left")
    proved = (
        F.col("result").eqNullSafe(F.lit("SUCCESS"))
        & F.col("probe_sentinel").eqNullSafe(F.lit(FABRIC_SENTINEL))
        & F.col("world_size").eqNullSafe((F.col("nodes") * GPUS_PER_NODE).cast("string"))
    )
    return found.select(
        "job_run_id", "nodes", "world_size", "busbw_gbps", F.when(F.col("nodes") >= 2, proved).alias("ok")
    )


def failure_classify(runs: DataFrame) -> DataFrame:
    return runs.select("*", L.outcome_class(F.col("result"), F.col("message")).alias("outcome"))


def outcome_tally(outcomes: DataFrame, holds: DataFrame, known_cap: int) -> DataFrame:
    """Finished runs, quota refusals and the final cap (raised when concurrency passed it).

    `holds` is one row with the peak concurrency.
    """
    kind = L.outcome_class(F.col("result"), F.col("message"))
    return outcomes.agg(
        F.count_if(kind.isin("success", "other_failed")).alias("done"),
        F.count_if(kind == "quota_refused").alias("quota_refusals"),
        F.count_if(kind == "unfinished").alias("unfinished"),
    ).withColumn("final_cap", F.greatest(F.lit(known_cap).cast("bigint"), holds.select("peak").scalar()))


def completion_gate(tasks: DataFrame, must_complete: bool = False) -> DataFrame:
    """Completed of total tasks; none completed is a failure."""
    counted = tasks.agg(F.count_if("completed").alias("completed"), F.count(F.lit(1)).alias("total"))
    if must_complete:
        failed = F.raise_error(F.lit("no task completed")).cast("bigint")
        counted = counted.withColumn("completed", F.when(F.col("completed") == 0, failed).otherwise(F.col("completed")))
    return counted.withColumn("exit_code", F.when(F.col("completed") == 0, 1).otherwise(0))


def row_hash(columns: Sequence[str]) -> Column:
    """48 bits of a row; each cell carries its length, so nulls, the text of a null and any separator differ."""
    text = [F.col(c).cast("string") for c in columns]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.conv(F.substring(F.md5(F.concat(*cells)), 1, 12), 16, 10).cast("decimal(20,0)")


def table_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free content hash: row count and sum of 48-bit row hashes, equal if unchanged.

    A sum combines map-side and needs no sort; duplicates count, unlike in an XOR.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_hash(columns)).cast("string").alias("fingerprint")
    )


#: Children of a node, and levels below the root, of a fingerprint tree.
FAN, DEPTH = 16, 3


def fingerprint_tree(df: DataFrame, columns: Sequence[str], key: str, low: int, high: int) -> DataFrame:
    """(level, node, rows, fingerprint) of equal ranges of a whole-number key between `low` and `high`.

    Level 0 is the root, level DEPTH the leaves; a node is the sum of its children, so one pass over the rows
    counts the leaves and the rest adds up. Keys outside the bounds and null keys fall into node -1 of each level.
    Two trees compare only if they were made with the same bounds. It has at most 16^3 leaves: store it.
    """
    leaf = _leaf(key, low, high)
    leaves = df.groupBy(leaf.alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_hash(columns)).cast("decimal(38,0)").alias("sum")
    )
    above = [F.struct(F.lit(d).alias("level"), F.when(F.col("leaf") < 0, -1).otherwise(F.expr(f"leaf div {FAN ** (DEPTH - d)}")).cast("long").alias("node")) for d in range(DEPTH + 1)]
    nodes = leaves.select("rows", "sum", F.explode(F.array(*above)).alias("x")).groupBy("x.level", "x.node")
    return nodes.agg(F.sum("rows").alias("rows"), F.sum("sum").cast("string").alias("fingerprint"))


def _leaf_width(low: int, high: int) -> int:
    return (high - low) // FAN**DEPTH + 1


def _leaf(key: str, low: int, high: int) -> Column:
    inner = F.expr(f"(`{key}` - {low}) div {_leaf_width(low, high)}")
    return F.when(F.col(key).between(low, high), inner).otherwise(-1).cast("long")


def differing_ranges(before: DataFrame, after: DataFrame, low: int, high: int) -> list[tuple[int | None, int | None]]:
    """Key ranges in which two trees differ, found root first: children are looked at only below differing nodes.

    Neighbouring ranges are one; (None, None) stands for the keys outside the bounds.
    """
    width, suspects = _leaf_width(low, high), None
    for level in range(DEPTH + 1):
        sides = [t.filter(F.col("level") == level) for t in (before, after)]
        if suspects is not None:
            sides = [t.filter(F.when(F.col("node") < 0, -1).otherwise(F.expr(f"node div {FAN}")).isin(suspects)) for t in sides]
        old, new = (t.select("node", *[F.col(c).alias(f"{side}_{c}") for c in ("rows", "fingerprint")]) for t, side in zip(sides, ("old", "new"), strict=True))
        changed = ~(F.col("old_rows").eqNullSafe(F.col("new_rows")) & F.col("old_fingerprint").eqNullSafe(F.col("new_fingerprint")))
        suspects = sorted(r["node"] for r in old.join(new, "node", "full").filter(changed).select("node").collect())
        if not suspects:
            return []
    out: list[tuple[int | None, int | None]] = []
    for node in suspects:
        start, end = (None, None) if node < 0 else (low + node * width, min(high, low + (node + 1) * width - 1))
        if out and start is not None and out[-1][1] == start - 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def changed_rows(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str, low: int, high: int) -> DataFrame:
    """(key, before, after): how many of a key's rows only one side has, for keys whose rows differ.

    The trees say where to look; only differing key ranges are read again, and the bounds reach the scans.
    Repeated rows count; null keys are compared like any other.
    """
    trees = [workspace.materialise(fingerprint_tree(df, columns, key, low, high), "tree") for df in (before, after)]
    inside = _within(key, differing_ranges(*trees, low, high), low, high)
    parts = [df.filter(inside).select(F.col(key).alias("key"), row_hash(columns).alias("hash"), F.lit(n).alias("n")) for df, n in ((before, -1), (after, 1))]
    net = parts[0].unionByName(parts[1]).groupBy("key", "hash").agg(F.sum("n").alias("n")).filter("n <> 0")
    return net.groupBy("key").agg(F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("before"), F.sum(F.greatest(F.col("n"), F.lit(0))).alias("after"))


#: Spans of keys that a scan is given as its bounds.
SPANS = 16


def _within(key: str, ranges: Sequence[tuple[int | None, int | None]], low: int, high: int) -> Column:
    """Whether a key lies in one of the ranges, of which there may be as many as leaves.

    A condition of thousands of nested ranges runs out of stack, so the leaves they cover are one flat set. The scan gets
    the ranges joined over all but their widest gaps.
    """
    known, width = sorted(r for r in ranges if r[0] is not None), _leaf_width(low, high)
    leaves = [leaf for start, end in known for leaf in range((start - low) // width, (end - low) // width + 1)]
    spans = F.lit(False)
    if len(known) < len(ranges):
        leaves.append(-1)
        spans = F.col(key).isNull() | (F.col(key) < low) | (F.col(key) > high)
    wide = sorted(range(1, len(known)), key=lambda i: known[i - 1][1] - known[i][0])[: SPANS - 1]
    cuts = [0, *sorted(wide), len(known)] if known else []
    for first, after in zip(cuts[:-1], cuts[1:], strict=True):
        spans = spans | F.col(key).between(known[first][0], known[after - 1][1])
    return spans & _leaf(key, low, high).isin(leaves)


def key_skew(df: DataFrame, key: str, tolerance: float = 0.03) -> DataFrame:
    """Rows per key over the even share, and whether each key is within tolerance."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    even = counts.agg(F.sum("rows") / F.count(F.lit(1))).scalar()
    ratio = F.col("rows") / even
    return counts.select(key, "rows", ratio.alias("ratio")).withColumn(
        "balanced", F.abs(F.col("ratio") - 1) <= tolerance
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
