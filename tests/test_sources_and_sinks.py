"""Readers and writers on files in fresh folders."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from poolsight.operators import ledger as ops
from poolsight.operators import logs
from poolsight.sources import files, schemas, sinks, workspace


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-"))


def put(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


MANIFEST = """experiment_name: e
compute:
  num_accelerators: 16
  accelerator_type: GPU_8xH100
code_source:
  snapshot:
    include_paths:
      - experiments/foundation-models/fsdp/
command: >-
  torchrun $CODE_SOURCE_PATH/a.py
  --steps 3
"""


def test_manifests_to_catalog(spark, folder):
    root = folder / "workloads"
    put(root / "train.example.yaml", MANIFEST)
    put(root / "train.yaml", MANIFEST.replace("16", "8"))
    put(root / "probes" / "net.example.yaml", "command: echo hi\n")
    put(root / "broken.yaml", "a: [1\n")
    put(root / "nocommand.yaml", "compute: {}\n")
    put(root / "list.yaml", "- 1\n")
    put(root / "notes.txt", "not a manifest")
    put(root / "deep" / "workloads" / "y.yaml", "compute: {}\n")
    found = files.manifest_files(spark, str(root))
    parsed = files.parse_manifests(found).cache()
    problems = {r.path: r.problem for r in parsed.collect()}
    assert problems == {
        "train.example.yaml": None, "train.yaml": None, "probes/net.example.yaml": None, "broken.yaml": "unparsable",
        "nocommand.yaml": "no command", "list.yaml": "not a mapping", "deep/workloads/y.yaml": "no command",
    }
    live = files.parse_manifests(ops.live_manifests(found))
    assert live._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    catalog = {r.name: r for r in ops.catalog_entries(live, "t").collect()}
    assert set(catalog) == {"train", "probes/net"}
    train, net = catalog["train"], catalog["probes/net"]
    assert (train.ref, train.nodes, train["shape"], train.use_case, train.needs_torch) == ("train.yaml", 1, "GPU_8xH100", "foundation-models", 1)
    assert (net.nodes, net["shape"], net.use_case, net.needs_torch) == (1, "GPU_1xA10", "env-diagnostics", 0)


def test_live_but_broken_still_shadows_example(spark, folder):
    root = folder / "workloads"
    put(root / "x.example.yaml", MANIFEST)
    put(root / "x.yaml", "a: [1\n")
    live = files.parse_manifests(ops.live_manifests(files.manifest_files(spark, str(root))))
    assert ops.catalog_entries(live, "t").count() == 0


def test_odd_values_do_not_fail_the_scan(spark, folder):
    root = folder / "workloads"
    put(root / "odd.yaml", "compute: [1]\ncode_source: none\ncommand: 5\nmax_retries: many\nexperiment_name: 7\n")
    put(root / "text.yaml", 'compute:\n  num_accelerators: "16"\n  accelerator_type: GPU_8xH100\ncommand:\n')
    got = {r.path: r for r in files.parse_manifests(files.manifest_files(spark, str(root))).collect()}
    assert (got["odd.yaml"].command, got["odd.yaml"].max_retries, got["odd.yaml"].experiment_name) == ("5", None, "7")
    assert (got["text.yaml"].num_accelerators, got["text.yaml"].command, got["text.yaml"].problem) == (16, "", None)


def test_config_document(spark, folder):
    put(folder / "config.json", json.dumps({
        "reservation": {"total_nodes": 20, "gpus_per_node": 8, "accelerator_type": "GPU_8xH100"},
        "platform_quotas": {"GPU_8xH100": 4}, "catalog_team": "one",
        "teams": [
            {"name": "one", "quota_nodes": 8, "members": ["a", "b"], "use_cases": ["plain", {"name": "rich", "description": "d"}]},
            {"name": "two", "members": [], "use_cases": []},
        ],
    }))
    config = files.config_document(spark, str(folder / "config.json"))
    assert [tuple(r) for r in files.config_teams(config).collect()] == [(0, "one", 8), (1, "two", 0)]
    assert [r.member for r in files.config_members(config).collect()] == ["a", "b"]
    assert [tuple(r) for r in files.config_use_cases(config).collect()] == [("one", 0, "plain", ""), ("one", 1, "rich", "d")]


def test_catalog_json_overrides_team(spark, folder):
    put(folder / "catalog.json", json.dumps([{"name": "n", "team": "old", "nodes": 2}]))
    got = files.catalog_json(spark, str(folder / "catalog.json"), "new").first()
    assert (got.name, got.team, got.nodes, got.ref) == ("n", "new", 2, None)


def test_log_chunks_carry_their_node(spark, folder):
    put(folder / "node_7" / "logs" / "node_0" / "logs-0.chunk.txt", "RESULT a=1\nRESULT b=2\n")
    put(folder / "node_7" / "logs" / "node_12" / "logs-3.chunk.txt", "RESULT a=3\n")
    put(folder / "node_7" / "logs" / "node_12" / "launcher.log-0.chunk.txt", "x\n")
    put(folder / "node_70000000001" / "logs-1.chunk.txt", "y\n")
    put(folder / f"node_{'9' * 30}" / "logs-1.chunk.txt", "z\n")
    lines = files.log_text(spark, str(folder))
    places = {(r.node, r.chunk, r.kind) for r in lines.collect()}
    assert places == {(0, 0, "user"), (12, 3, "user"), (12, 0, "launcher"), (70000000001, 1, "user"), (None, 1, "user")}
    got = {(r.node, r.key, r.value) for r in logs.result_line_kv(lines).collect()}
    assert got == {(0, "a", "1"), (0, "b", "2"), (12, "a", "3")}


def test_results_sheet(spark, folder):
    df = spark.createDataFrame([("t", None, "a|b\nc")], "test string, verdict string, what string")
    sinks.write_results_md(df, str(folder / "md"))
    sheet = "".join(p.read_text() for p in sorted((folder / "md").glob("part-*"))).splitlines()
    assert sheet[0].startswith("| Test | Verdict |") and set(sheet[1].split()) == {"|", "---"} and sheet[1].count("---") == 12
    assert sheet[2:] == ["| t |  |  |  |  | a\\|b c |  |  |  |  |  |  |"]
    sinks.write_results_csv(df, str(folder / "csv"))
    heads = {path.read_text().splitlines()[0] for path in (folder / "csv").glob("*.csv")}
    assert heads == {",".join(h for _, h in sinks.RESULT_COLUMNS)}


def test_variant_table_round_trip(spark, folder):
    one = spark.range(3).select(
        F.lit("r").alias("record_id"), F.current_timestamp().cast("timestamp_ntz").alias("time"), F.current_date().alias("date"),
        F.lit("s").alias("service_name"), F.parse_json(F.lit('{"a.b": 1}')).alias("attributes"),
    )
    sinks.write_telemetry(one, str(folder / "t"))
    got = spark.read.parquet(str(folder / "t")).select(F.try_variant_get("attributes", '$["a.b"]', "int").alias("v")).collect()
    assert [r.v for r in got] == [1, 1, 1]


def test_declared_telemetry_schema_is_valid(spark):
    assert spark.createDataFrame([], schemas.TELEMETRY_LOGS).columns[0] == "record_id"


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    path = workspace.fresh_path(spark, "x")
    assert path.startswith(root) and path != workspace.fresh_path(spark, "x")


def test_workspace_is_cleared_and_needs_a_folder_on_a_cluster(spark, folder, monkeypatch):
    monkeypatch.setattr(workspace, "session_path", lambda session: str(folder / "mine"))
    kept = workspace.materialise(spark.range(5), "x")
    assert kept.count() == 5 and (folder / "mine").exists()
    workspace.clear(spark)
    assert not (folder / "mine").exists()

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="all executors share"):
        workspace.shared_root(Session())
    Context.master = "local[2]"
    assert "poolsight" in workspace.shared_root(Session())


def test_manifests_are_listed_and_read_in_tasks(spark, tmp_path):
    """Files of many folders and depths; the driver gets no list of them, so no scan of Spark's names them."""
    want = {}
    for i in range(60):
        path = f"fam{i % 7}/{'deep/er/' if i % 5 == 0 else ''}w-{i}{'.example' if i % 3 == 0 else ''}.yaml"
        want[path] = f"command: é{i}\n"
    want["top.yaml"] = "a: 1"
    for path, text in {**want, "fam1/_hidden.yaml": "x", ".dot/a.yaml": "x", "fam1/other.txt": "x", "fam1/empty.yaml": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        found = files.manifest_files(spark, root)
        assert sorted((r.path, r.text) for r in found.collect()) == sorted(want.items())
        assert str(tmp_path) not in "".join(found.inputFiles())
