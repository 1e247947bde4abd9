"""The driver's tables shaped as the operators' inputs (nested, typed, whole tables)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.operators import ledger as ledger_ops
from poolsight.operators import telemetry as telemetry_ops

AS_OF = dt.date(2001, 6, 1)
DAYS = 730
CUTOFF = dt.date(1999, 9, 1)
RESERVATION = ledger_ops.Reservation(total_nodes=20, gpus_per_node=8, accelerator_type="GPU_8xH100")
QUOTAS = {"GPU_8xH100": 4}
KNOWN_CAP = 4


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def text(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def usage(spark: SparkSession, root: str) -> DataFrame:
    li, o, c = (table(spark, root, t) for t in ("lineitem", "orders", "customer"))
    supp, line, flag = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_returnflag")
    low = F.col("o_orderpriority") == "5-LOW"
    segment, priority = F.when(~low, F.col("c_mktsegment")), F.when(line <= 3, F.col("o_orderpriority"))
    segment_tag, priority_tag = (F.lit("segment"), segment), (F.lit("priority"), priority)
    tags = (
        F.when(segment.isNotNull() & priority.isNotNull(), F.create_map(*segment_tag, *priority_tag))
        .when(segment.isNotNull(), F.create_map(*segment_tag))
        .when(priority.isNotNull(), F.create_map(*priority_tag))
    )
    sku = F.when(flag == "R", "GPU_PROVISIONED_CAPACITY_S").when(flag == "A", "GPU_ON_DEMAND_S").otherwise("GPU_REGIONAL_S")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            F.col("l_shipdate").cast("date").alias("usage_date"),
            F.col("l_shipdate").alias("usage_start_time"),
            (supp % 5).alias("workspace_id"),
            F.when(supp % 2 == 0, "AWS").otherwise("AZURE").alias("cloud"),
            F.concat(sku, supp.cast("string")).alias("sku_name"),
            F.lit("DBU").alias("usage_unit"),
            F.col("l_quantity").alias("usage_quantity"),
            F.struct(
                F.struct(
                    F.when(line % 4 == 1, "RESERVED_COMPUTE").when(line % 4 == 2, "ON_DEMAND_COMPUTE").alias("compute_type")
                ).alias("pool"),
                F.struct(F.when(line % 4 == 3, "NOTEBOOK").alias("workload_type")).alias("notebook"),
            ).alias("product_features"),
            F.struct(
                F.lit(None).cast("string").alias("run_as"),
                F.when(low, F.col("c_mktsegment")).alias("owned_by"),
                F.when(F.col("o_orderstatus") != "P", F.col("c_name")).alias("created_by"),
            ).alias("identity_metadata"),
            F.struct(
                F.col("o_orderkey").alias("job_id"),
                F.when(flag == "R", text("pool-", supp % 3)).alias("pool_id"),
                F.when(line % 4 == 2, text("w-", F.col("o_orderkey"))).alias("workload_id"),
            ).alias("usage_metadata"),
            tags.alias("custom_tags"),
        )
    )


def list_prices(spark: SparkSession, root: str) -> DataFrame:
    """Three windows per supplier SKU; reserved on AZURE has no price on purpose."""
    key = F.col("s_suppkey")
    step = F.lit(0.25) * (key % 4)

    def window(prefix: str, cloud: str, start: str, end: str | None, price: Column) -> Column:
        return F.struct(
            text(prefix, key).alias("sku_name"),
            F.lit(cloud).alias("cloud"),
            ntz(start).alias("price_start_time"),
            (ntz(end) if end else F.lit(None).cast("timestamp_ntz")).alias("price_end_time"),
            F.struct(price.cast("double").alias("default")).alias("pricing"),
        )

    reserved, on_demand = "GPU_PROVISIONED_CAPACITY_S", "GPU_ON_DEMAND_S"
    windows = F.array(
        window(reserved, "AWS", "1995-01-01 00:00:00", "1998-01-01 00:00:00", F.lit(2.0) + step),
        window(reserved, "AWS", "1998-01-01 00:00:00", None, F.lit(2.5) + step),
        window(on_demand, "AZURE", "1996-01-01 00:00:00", None, F.lit(4.0)),
    )
    return table(spark, root, "supplier").select(F.inline(windows))


def teams(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, root, "nation").select(
        text("team-", key).alias("team"), key.alias("pos"), (2 * (key % 5)).alias("quota_nodes")
    )


def members(spark: SparkSession, root: str) -> DataFrame:
    """Upper case on purpose; some customers are in two teams and the first one wins."""
    key, name = F.col("c_custkey"), F.col("c_name")
    listed = F.array(
        F.struct(
            text("team-", F.col("c_nationkey")).alias("team"),
            F.col("c_nationkey").alias("pos"),
            F.when(key % 7 != 0, F.upper(name)).otherwise(F.concat(F.lit("x"), name)).alias("member"),
        ),
        F.struct(
            F.lit("team-24").alias("team"),
            F.lit(24).alias("pos"),
            F.when(key % 10 == 1, name).otherwise(F.concat(F.lit("y"), name)).alias("member"),
        ),
    )
    return table(spark, root, "customer").select(F.inline(listed))


def use_cases(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nation").select(
        text("team-", F.col("n_nationkey")).alias("team"),
        F.col("n_regionkey").alias("pos"),
        text("uc-", F.col("n_regionkey") % 3).alias("use_case"),
    )


def shape_of(key: Column) -> Column:
    return F.when(key % 3 == 0, "GPU_8xH100").when(key % 3 == 1, "GPU_1xH100").otherwise("GPU_1xA10")


def workloads(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, root, "part").select(
        key.alias("id"),
        text("wl-", key).alias("name"),
        text("team-", key % 26).alias("team"),
        text("uc-", key % 3).alias("use_case"),
        F.lit("yaml").alias("kind"),
        F.concat(text("workloads/wl-", key), F.lit(".yaml")).alias("ref"),
        shape_of(key).alias("shape"),
        (1 + F.col("p_size") % 2).alias("nodes"),
        F.col("p_size").alias("num_accelerators"),
        (key % 2).alias("needs_torch"),
        F.when(key % 5 == 0, "hand").otherwise("repo-sync").alias("created_by"),
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, root, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("workload_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("requested_by"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 3000 == 0, "RUNNING")
        .when(key % 3000 == 1, "SUBMITTED")
        .when(key % 100 == 2, "QUEUED")
        .when(status == "F", "FAILED")
        .when(status == "P", "CANCELED")
        .otherwise("SUCCESS")
        .alias("state"),
        F.when((status == "F") & (key % 3 == 0), "Workspace has exceeded its GPU quota")
        .when(status == "F", "user code failed")
        .otherwise("")
        .alias("detail"),
    )


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return ledger_ops.runs_with_workloads(runs(spark, root), workloads(spark, root))


def run_polls(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    source = table(spark, root, "events") if events is None else events
    return source.select(
        key.alias("seq"),
        "ts",
        F.col("user_id").alias("run_id"),
        F.when(kind == "signup", "PENDING")
        .when(kind == "error", "INTERNAL_ERROR")
        .when(kind == "purchase", "TERMINATED")
        .otherwise("RUNNING")
        .alias("life"),
        F.when((kind == "purchase") & (key % 3 == 0), "SUCCESS")
        .when((kind == "purchase") & (key % 3 == 1), "CANCELED")
        .alias("result"),
        F.repeat(F.concat("props", F.lit(" ")), 60).alias("message"),
        F.when(key % 2 == 0, "SUBMITTED").otherwise("RUNNING").alias("state"),
    )


def otel_logs(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    """Telemetry log records with variant attributes, in the declared table shape."""
    source = table(spark, root, "events") if events is None else events
    user, kind = F.col("user_id"), F.col("event_type")
    none = F.lit(None).cast("string")
    resource = F.to_json(
        F.struct(
            F.when(user % 3 != 0, text("user", user)).alias(telemetry_ops.REQUESTER_KEY),
            user.cast("string").alias(telemetry_ops.RUN_KEY),
        )
    )
    number = F.when(kind == "error", "17").when(kind == "signup", "13").otherwise("9")
    return source.select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("ts").alias("time"),
        F.col("ts").cast("date").alias("date"),
        kind.alias("service_name"),
        none.alias("event_name"),
        number.alias("severity_number"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity_text"),
        F.parse_json(F.concat(F.lit('"value '), kind, F.lit('"'))).alias("body"),
        F.parse_json("props").alias("attributes"),
        F.struct(F.parse_json(resource).alias("attributes"), F.lit(0).alias("dropped_attributes_count")).alias("resource"),
    )


def timeline(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    value = (key % 150).cast("string")
    return table(spark, root, "customer").select(
        key.alias("run_id"),
        F.create_map(F.lit("a"), value, F.lit("b"), F.when(key % 4 == 0, value).otherwise("x")).alias("job_parameters"),
        F.struct(F.col("c_name").alias("run_as")).alias("identity_metadata"),
        ntz("2024-01-01 00:00:00").alias("period_start_time"),
        F.when(F.col("c_nationkey") % 2 == 0, "SUCCESS").otherwise("FAILED").alias("result_state"),
    )


def gpu_samples(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    source = table(spark, root, "events") if events is None else events
    key, user = F.col("event_id"), F.col("user_id")
    node, gpu = user % 20, key % 8
    return source.select(
        key.alias("sample_id"),
        "ts",
        node.alias("node"),
        gpu.alias("gpu"),
        F.concat(F.lit("GPU-"), node.cast("string"), F.lit("-"), gpu.cast("string")).alias("gpu_uuid"),
        (F.floor("value") % 90).alias("temp_c"),
        F.col("value").alias("power_w"),
        F.when(user % 4 == 0, F.lit(4).cast("bigint")).otherwise(key % 256).alias("throttle"),
        F.when(user % 5 == 0, F.lit(None).cast("bigint"))
        .when(user % 5 == 1, F.lit(7).cast("bigint"))
        .otherwise(F.floor(key / 4000.0))
        .alias("ecc"),
        (25 + key % 50).alias("iters"),
    )


GAUGES = ("gpu.utilization.percent", "gpu.memory.used.bytes", "gpu.memory.total.bytes", "gpu.power.watts", "gpu.temperature.celsius", "train.loss", "train.steps")


def otel_metrics(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    """Seven readings of every event in the declared layout of the metric table."""
    source = table(spark, root, "events") if events is None else events
    key, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    readings = [F.floor(value) % 101, key % 1000, F.lit(1000), value, F.floor(value) % 90, value / 50, key]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), x.cast("double").alias("value"))
            for i, (name, x) in enumerate(zip(GAUGES, readings, strict=True))
        ]
    )
    on_gpu = F.col("m.i") < 5
    gpu = F.concat(F.lit('{"gpu": "'), (key % 8).cast("string"), F.lit('"}'))
    run = F.concat(F.lit('{"workload.run_id": "run-'), (user % 20).cast("string"), F.lit('"}'))
    return source.withColumn("m", F.explode(rows)).select(
        F.concat(key.cast("string"), F.lit("-"), F.col("m.i").cast("string")).alias("record_id"),
        F.col("ts").cast("timestamp_ntz").alias("time"),
        F.to_date("ts").alias("date"),
        text("svc-", user % 20).alias("service_name"),
        F.col("m.name").alias("name"),
        F.when(F.col("m.i") == 6, "counter").otherwise("gauge").alias("kind"),
        F.col("m.value").alias("value"),
        F.parse_json(F.when(on_gpu, gpu).otherwise("{}")).alias("attributes"),
        F.struct(F.parse_json(run).alias("attributes")).alias("resource"),
    )


COLLECTIVES = (
    "all_reduce", "all_gather", "reduce_scatter", "alltoall", "broadcast", "reduce", "gather", "scatter",
    "sendrecv", "hypercube",
)


def collective_bench(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in COLLECTIVES])
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("run"),
        F.get(names, (F.col("l_partkey") % 10).cast("int")).alias("collective"),
        (8 * (1 + F.col("l_suppkey") % 4)).alias("nranks"),
        (F.col("l_partkey") * 1048576).alias("cnt"),
        F.lit(4).alias("type_size"),
        ((F.col("l_quantity") + 1) / 1000.0).alias("sec"),
        (F.col("l_linenumber") - 1).alias("rank"),
    )


def probes(spark: SparkSession, root: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    held = F.make_dt_interval(secs=(F.floor("value") * 10).cast("decimal(18,6)"))
    return table(spark, root, "events").select(
        key.alias("probe_id"),
        text("boot-", user % 20).alias("boot_id"),
        F.col("ts").alias("hold_start"),
        (F.col("ts") + held).alias("hold_end"),
        F.array(key % 8, (key + user) % 8).alias("gpu_uuids"),
    )


def loss_curve(spark: SparkSession, root: str) -> DataFrame:
    user, key = F.col("user_id"), F.col("event_id")
    return table(spark, root, "events").select(
        user.alias("run"),
        key.alias("step"),
        "ts",
        F.when((user % 50 == 7) & (key % 3 == 0), F.lit(float("nan"))).otherwise(F.col("value") / 50.0).alias("loss"),
    )


PROBES = ("pypi_egress", "root_storage_tcp443", "burn_runs_terminal", "catalog_bucket_read", "root_storage_tcp443", "cli_ready")


def check_results(spark: SparkSession, root: str) -> DataFrame:
    user, key = F.col("user_id"), F.col("event_id")
    names = F.array(*[F.lit(p) for p in PROBES])
    ok = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    return table(spark, root, "events").select(
        key.alias("id"),
        user.alias("run"),
        F.col("event_type").alias("check_name"),
        F.when(user % 2 == 0, "CPU").otherwise("GPU_1xA10").alias("shape"),
        F.get(names, (user % 6).cast("int")).alias("probe"),
        F.when(user % 10 == 3, True).otherwise(ok).alias("ok"),
        F.col("props").alias("detail"),
    )


def checks(spark: SparkSession, root: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    return table(spark, root, "events").select(
        user.alias("run"),
        F.when((user % 3 == 0) & (kind == "error"), "FAIL")
        .when((user % 3 == 1) & (kind == "view"), "SKIPPED")
        .otherwise("PASS")
        .alias("status"),
        F.when(user % 11 == 2, "smoke").otherwise("full").alias("scope"),
    )


def registry(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(text("workloads/w", key), F.when(key % 4 == 0, ".example.yaml").otherwise(".yaml"))
    return table(spark, root, "part").select(
        text("test-", F.when(key % 40 == 39, key - 1).otherwise(key)).alias("id"),
        F.when(key % 9 != 0, path).alias("asset"),
        F.col("p_name").alias("test"),
        F.when(key % 4 == 0, "PASS").when(key % 4 == 1, "FAIL").when(key % 4 == 2, "BLOCKED").otherwise("NOT RUN").alias("verdict"),
        F.col("p_brand").alias("hardware"),
        F.concat(F.lit("a|b\n"), "p_type").alias("result_note"),
        F.when(key % 3 != 0, F.col("p_type")).alias("evidence"),
        F.when(key % 7 != 0, F.array(F.lit("RESULT burn=PASS"), F.lit("torchrun"))).alias("sentinels"),
        F.when(key % 8 == 1, "waiting for a node").alias("sentinels_pending"),
    )


def assets(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    moved = key + 5
    part = table(spark, root, "part")
    main = part.select(
        F.concat(text("workloads/w", moved), F.when(key % 4 == 3, ".example.yaml").otherwise(".yaml")).alias("path"),
        F.concat(
            text("torchrun $CODE_SOURCE_PATH/scripts/s", moved % 50), F.lit(".py && echo started")
        ).alias("text"),
    )
    live = part.filter(key % 4 == 3).select(
        F.concat(text("workloads/w", moved), F.lit(".yaml")).alias("path"), F.lit("live copy").alias("text")
    )
    probe_files = part.select(
        F.concat(text("workloads/probes/w", key), F.lit(".yaml")).alias("path"), F.lit("probe").alias("text")
    )
    scripts = table(spark, root, "nation").select(
        F.concat(text("scripts/s", F.col("n_nationkey")), F.lit(".py")).alias("path"),
        F.lit('print("RESULT burn=PASS")').alias("text"),
    )
    return main.unionByName(live).unionByName(probe_files).unionByName(scripts)


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    esc = "\x1b"
    clicks = (
        F.when(key % 7 == 0, "Killed with exit 137")
        .when(key % 7 == 1, "Traceback: exit 137")
        .when(key % 7 == 2, "RuntimeError: CUDA error: out of memory")
        .when(key % 7 == 3, "export OK grpc-status: 0")
        .when(key % 7 == 4, "Unknown field env_variables")
        .when(key % 7 == 5, F.concat(text('{"run_id": ', 10000000 + key), F.lit("}")))
        .otherwise("PERMISSION_DENIED")
    )
    line = (
        F.when(
            kind == "error",
            F.concat(text(f"{esc}[31mSubmitted workload with Job Run ID: ", 968264353316767 + key), F.lit(f"{esc}[0m")),
        )
        .when(
            kind == "purchase",
            F.concat(
                text("RESULT gpu=", key % 8), text(" name='GPU model ", user), text("' tflops=", key % 700)
            ),
        )
        .when(kind == "view", F.concat(text("Hyperparameters path: /Workspace/Users/u", user), F.lit("@example.com/x")))
        .when(kind == "click", clicks)
        .otherwise("noise")
    )
    return table(spark, root, "events").select(key.alias("event_id"), user.alias("run"), line.alias("line"))


def receipts(spark: SparkSession, root: str) -> DataFrame:
    host = text("GPU-", F.col("o_custkey") % 400)
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("receipt_id"),
        F.col("o_custkey").alias("job_run_id"),
        F.col("o_orderdate").alias("logged_at"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("burn"),
        F.when(F.col("o_orderkey") % 9 == 0, "4").otherwise("8").alias("gpus_visible"),
        F.concat_ws(",", *[F.concat(host, F.lit(f"-{i}")) for i in range(4)]).alias("gpu_uuids"),
    )


def job_runs(spark: SparkSession, root: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, root, "orders").select(
        key.alias("job_run_id"),
        F.when(key % 3000 == 0, F.lit(None).cast("string"))
        .when(status == "F", "FAILED")
        .when(status == "P", "CANCELED")
        .otherwise("SUCCESS")
        .alias("result"),
        F.when((status == "F") & (key % 3 == 0), "Workspace has exceeded its GPU quota")
        .when(status == "F", "user code failed")
        .alias("message"),
    )


FAMILIES = ("probes", "tabicl", "plain", "rdma-stress", "xgboost", "misc")
INCLUDES = (
    "experiments/multinode/", "experiments/foundation-models/lora/", "experiments/other/",
    "experiments/env-flexibility/", "data/",
)


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """One YAML document per part: path and text. Some are malformed, some have no command."""
    key = F.col("p_partkey")
    family = F.get(F.array(*[F.lit(f) for f in FAMILIES]), (key % 6).cast("int"))
    include = F.get(F.array(*[F.lit(i) for i in INCLUDES]), (key % 5).cast("int"))
    path = F.concat(
        text("fam", key % 40), F.lit("/"), family, text("-", F.floor(key / 2)),
        F.when(key % 3 == 0, ".example.yaml").otherwise(".yaml"),
    )
    shape = F.when(key % 3 == 0, "  accelerator_type: GPU_8xH100\n").when(key % 3 == 1, "  accelerator_type: GPU_1xA10\n")
    command = F.when(
        key % 2 == 0, F.concat(text("command: torchrun $CODE_SOURCE_PATH/run", key), F.lit(".py\n"))
    ).otherwise(F.concat(F.lit('command: "bash $CODE_SOURCE_PATH/a.sh '), F.col("p_brand"), F.lit('"\n')))
    body = F.concat(
        text("experiment_name: exp-", key), F.lit("\ncompute:\n"), text("  num_accelerators: ", F.col("p_size")),
        F.lit("\n"), F.coalesce(shape, F.lit("")),
        F.lit("code_source:\n  type: snapshot\n  snapshot:\n    root_path: ..\n    include_paths:\n      - "),
        include, F.lit("\n"), F.when(key % 13 == 5, "").otherwise(command), F.lit("max_retries: 0\n"),
        F.when(key % 17 == 3, "broken: [unclosed\n").otherwise(""),
    )
    return table(spark, root, "part").select(path.alias("path"), body.alias("text"))


def pred_bin(spark: SparkSession, root: str) -> DataFrame:
    d, labels = table(spark, root, "documents"), table(spark, root, "labels")
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 97).cast("double") / F.lit(97.0)).alias("score"),
    )


def pred_multi(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("lang").alias("y"),
        F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("yhat"),
    )


def pred_reg(spark: SparkSession, root: str) -> DataFrame:
    y = F.col("o_totalprice")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("dataset"),
        y.alias("y"),
        (y * (90 + F.col("o_orderkey") % 20).cast("double") / F.lit(100.0)).alias("yhat"),
    )


def features(spark: SparkSession, root: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o, c = table(spark, root, "orders"), table(spark, root, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.when(key % 11 == 0, "n/a")
        .when(key % 11 == 1, "")
        .when(key % 11 == 2, F.concat(cust.cast("string"), F.lit("e2")))
        .otherwise(cust.cast("string"))
        .alias("target"),
        F.col("o_totalprice").alias("price"),
        F.when(key % 5 == 0, "test").otherwise("train").alias("part"),
    )
