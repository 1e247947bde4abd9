"""File readers: logs, manifests, team config and the generated catalog."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolsight.sources import schemas, workspace
from poolsight.sources.sinks import filesystem

# Log chunks lie in a folder per node and are numbered in their names.
NODE_PATTERN = r"^node[_=]([0-9]+)$"
CHUNK_PATTERN = r"-([0-9]+)\.chunk\.txt$"


def log_text(spark: SparkSession, root: str) -> DataFrame:
    """Chunked log lines; node, chunk and kind come from the path, and files split freely.

    The path is cut at its last slashes first, so the patterns only see the two short names.
    """
    path = F.col("_metadata.file_path")
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.col("value").alias("line"),
        path.alias("file"),
        _number_in(folder, NODE_PATTERN).alias("node"),
        _number_in(name, CHUNK_PATTERN).alias("chunk"),
        F.when(name.contains("launcher"), "launcher").otherwise("user").alias("kind"),
    )


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Whole log lines in their order: (folder, log, kind, node, chunk, number, offset, line).

    A log is the chunks of one folder whose names differ in the chunk number alone, in the order of that number;
    any other file is a log of its own. A line that chunk ends cut comes back whole, with the chunk it begins in.
    `number` counts a log's lines from 1 and `offset` its bytes from 0. Lines end at a newline; a carriage return
    before it is dropped. A file of no bytes holds no line. Files are plain text, not compressed.

    Files still split freely. The reader does not say where a line lies, but rows of one split come in order, so
    places inside a split are running sums over it, and what lies before it comes from a prefix scan over a
    table of one row a split. A chunk ends inside a line if its lines with their ends need a byte more than it
    has (a mark of byte order, three bytes, is not among its lines). Only the first and last lines of such
    chunks are grouped.
    """
    pieces = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        F.col("value").alias("line"),
    )
    in_file, name = Window.partitionBy("file"), F.substring_index("file", "/", -1)
    splits = pieces.groupBy("file", "size", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(
        F.col("file").alias("_file"), F.col("start").alias("_start"), "n", "bytes",
        F.regexp_replace("file", "/[^/]+$", "").alias("folder"),
        F.regexp_replace(name, CHUNK_PATTERN, "").alias("log"),
        F.when(name.contains("launcher"), "launcher").otherwise("user").alias("kind"),
        _number_in(name, CHUNK_PATTERN).alias("chunk"),
        (F.pmod(F.sum("bytes").over(in_file) - F.col("size"), F.lit(3)) == 1).alias("open"),
        (F.min("start").over(in_file) == F.col("start")).alias("first"),
        (F.max("start").over(in_file) == F.col("start")).alias("last"),
    )
    order = Window.partitionBy("folder", "log").orderBy("chunk", "_start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("open") & F.col("last"), 1).otherwise(0)
    splits = splits.select(
        *[c for c in splits.columns if c != "bytes"],
        F.coalesce(F.sum(F.col("n") - cut).over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum(F.col("bytes") - cut).over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.lag("open").over(order), F.lit(False)).alias("after_open"),
    )

    # no larger than the reader's split
    in_split = Window.partitionBy("file", "start").orderBy("seq")
    placed = pieces.select(
        "file", "start", "line", F.row_number().over(in_split).alias("at"), (F.sum("bytes").over(in_split) - F.col("bytes")).alias("into")
    ).join(splits, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    begins_cut = F.col("first") & F.col("after_open") & (F.col("at") == 1)
    ends_cut = F.col("last") & F.col("open") & (F.col("at") == F.col("n"))
    place = [(F.col("lines_before") + F.col("at")).alias("number"), (F.col("bytes_before") + F.col("into")).alias("offset")]
    placed = placed.select("folder", "log", "kind", "chunk", *place, "line", (begins_cut | ends_cut).alias("cut"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "chunk", "line"))).alias("parts")
    stitched = placed.filter("cut").groupBy("folder", "log", "kind", "number").agg(parts).select(
        "folder", "log", "kind", F.col("parts")[0]["chunk"].alias("chunk"), "number",
        F.col("parts")[0]["offset"].alias("offset"), F.array_join("parts.line", "").alias("line"),
    )
    node = _number_in(F.substring_index("folder", "/", -1), NODE_PATTERN).alias("node")
    return placed.filter("NOT cut").drop("cut").unionByName(stitched).select(
        "folder", "log", "kind", node, "chunk", "number", "offset", F.regexp_replace("line", r"\r\z", "").alias("line")
    )


def _number_in(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """Every YAML file below `root` as (path relative to root, text), found when called; empty files are left out.

    Folders are listed in tasks, one level after the other, and files are read in tasks. Spark's own reader would bring the
    name of every file to the driver. As there, names that begin with a dot or an underscore are hidden.
    """
    folders, found = spark.createDataFrame([("",)], "path string"), []
    while not found or not folders.isEmpty():
        entries = workspace.materialise(_spread(folders).mapInArrow(partial(_listed, root), "path string, folder boolean"), "listing")
        found.append(entries.filter("NOT folder").select("path"))
        folders = entries.filter("folder").select("path")
    names = reduce(DataFrame.union, found)
    return _spread(names).mapInArrow(partial(_contents, root), "path string, text binary").select("path", F.col("text").cast("string"))


#: Names, and bytes of files, that a task hands on together.
NAMES_AT_ONCE, BYTES_AT_ONCE = 10_000, 1 << 23


def _spread(paths: DataFrame) -> DataFrame:
    return paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _listed(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder: YAML files and folders."""
    fs, base = filesystem(root)
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = []
            for info in fs.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/"))):
                name, inner = info.base_name, info.type == FileType.Directory
                hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
                if not hidden and (inner or name.endswith(".yaml")):
                    rows.append((f"{folder}/{name}".lstrip("/"), inner))
            for at in range(0, len(rows), NAMES_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + NAMES_AT_ONCE], strict=True)], names=["path", "folder"])


def _contents(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = filesystem(root)

    def packed(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "text"])

    for batch in batches:
        rows, held = [], 0
        for path in batch.column(0).to_pylist():
            with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                text = stream.read()
            if text:
                rows.append((path, text))
                held += len(text)
            if held > BYTES_AT_ONCE:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)


def parse_manifests(files: DataFrame) -> DataFrame:
    """Parse (path, text) into declared columns; an unreadable document keeps its path and a problem.

    YAML has no Spark reader, so this is one Arrow-batched map. Parsing costs far more than moving
    the text, so documents are spread first: many tiny files would else pack into few tasks.
    """
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "text").repartition(spread, "path").mapInPandas(_manifest_batches, schemas.MANIFEST)


def _manifest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_manifest_row(path, text) for path, text in zip(batch["path"], batch["text"])]
        yield pd.DataFrame(rows, columns=_MANIFEST_FIELDS)


_MANIFEST_FIELDS = [
    "path", "experiment_name", "accelerator_type", "num_accelerators", "include_paths", "command",
    "max_retries", "timeout_minutes", "problem",
]


def _manifest_row(path: str, text: str) -> tuple:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        doc = yaml.load(text, Loader=loader) or {}
    except yaml.YAMLError:
        return (path, *[None] * 7, "unparsable")
    if not isinstance(doc, dict):
        return (path, *[None] * 7, "not a mapping")
    compute = _mapping(doc.get("compute"))
    included = _mapping(_mapping(doc.get("code_source")).get("snapshot")).get("include_paths") or []
    return (
        path,
        _text(doc.get("experiment_name")),
        _text(compute.get("accelerator_type")),
        _whole(compute.get("num_accelerators")),
        [str(p) for p in included] if isinstance(included, list) else [str(included)],
        _text(doc.get("command")) or ("" if "command" in doc else None),
        _whole(doc.get("max_retries")),
        _whole(doc.get("timeout_minutes")),
        None if "command" in doc else "no command",
    )


def _mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def _text(value) -> str | None:
    return None if value is None else str(value)


def _whole(value) -> int | None:
    try:
        return None if value is None else int(value)
    except (TypeError, ValueError):
        return None


def config_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Config documents, one a file or (with `lines`) one a line."""
    return spark.read.schema(schemas.CONFIG).option("multiLine", str(not lines)).json(path)


def parse_config(text: Column) -> Column:
    return F.from_json(text, schemas.CONFIG)


def config_teams(config: DataFrame) -> DataFrame:
    return _teams(config).select(
        "pos", F.col("t.name").alias("team"), F.coalesce("t.quota_nodes", F.lit(0)).alias("quota_nodes")
    )


def config_members(config: DataFrame) -> DataFrame:
    return _teams(config).select("pos", F.col("t.name").alias("team"), F.explode("t.members").alias("member"))


def config_use_cases(config: DataFrame) -> DataFrame:
    """Use cases with their order; a plain string stands for an object with just a name."""
    listed = _teams(config).select(F.col("t.name").alias("team"), F.posexplode("t.use_cases").alias("pos", "raw"))
    is_object = F.col("raw").startswith("{")
    return listed.select(
        "team",
        "pos",
        F.when(is_object, F.get_json_object("raw", "$.name")).otherwise(F.col("raw")).alias("use_case"),
        F.coalesce(F.when(is_object, F.get_json_object("raw", "$.description")), F.lit("")).alias("description"),
    )


def _teams(config: DataFrame) -> DataFrame:
    return config.select(F.posexplode("teams").alias("pos", "t"))


def catalog_json(spark: SparkSession, path: str, team: str, lines: bool = False) -> DataFrame:
    """The generated catalog, an array a file or an entry a line, owned by `team` whatever it says."""
    catalog = spark.read.schema(schemas.CATALOG).option("multiLine", str(not lines)).json(path)
    return catalog.withColumn("team", F.lit(team))
