"""Token counts by scanning flat token files for end-of-document identifiers.

A token file is nothing but fixed-width token ids, each document closed by an end identifier. The scan
knows no index: it cuts files into blocks, finds the separators of a block in one vectorised compare,
and stitches the blocks with a prefix scan: how many documents ended before a block (a running sum)
and where the last of them did (a running maximum). The scan runs in two levels, inside runs of blocks
and over the runs, so that one huge file is no single task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsight.llm.byte_bpe import ByteBpe
from poolsight.llm.catalog import query, table
from poolsight.llm.storage import arrow_batches, filesystem, fresh_path, materialise, move_staged
from poolsight.llm.text import small_batches
from poolsight.llm.warc import STAGING

#: Where the ranks of a public byte-level BPE lie on every machine, and a free id of it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
WIDTH = "uint16"
#: Texts that cross to Python together.
TEXTS_AT_ONCE = 1000
#: Tokens to a block, blocks to a run, and bytes that end a token file.
BLOCK, RUN, ROLL_BYTES = 1 << 20, 1024, 64 << 20

_ENCODERS: dict[str, ByteBpe] = {}


def encoder(ranks: str) -> ByteBpe:
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = ByteBpe.from_ranks(ranks)
    return _ENCODERS[ranks]


WRITTEN = pa.schema([("file", pa.string()), ("staged", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def write_token_files(
    docs: DataFrame, folder: str, ranks: str = RANKS, end: int = END, width: str = WIDTH,
    ident: str = "doc_id", text: str = "text", roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write every text's tokens and an end identifier; returns (file, ordinal, doc_id).

    Tasks write under names of their own attempt; once all are done, the files of the attempts that
    succeeded get their final names. Null and empty texts are just an end identifier; strings of special
    tokens in a text are ordinary text. Texts of any length and kind are encoded whole, a million blanks too. `end` has to be no rank of the vocabulary.
    """

    def run(batches):
        fs, base = filesystem(folder)
        part, kind, number, out = TaskContext.get().partitionId(), np.dtype(width), 0, None
        code = encoder(ranks)
        for batch in small_batches(batches, 256):
            rows = []
            for ident_, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, ordinal, size = f"tokens-{part:06d}-{number:05d}.bin", 0, 0
                    staged, number = f"{name}.{uuid.uuid4().hex}", number + 1
                    fs.create_dir(f"{base}/{STAGING}", recursive=True)
                    out = fs.open_output_stream(f"{base}/{STAGING}/{staged}", compression=None)
                data = np.array([*code.encode(words or ""), end], dtype=kind).tobytes()
                out.write(data)
                rows.append((name, staged, ordinal, ident_))
                ordinal, size = ordinal + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), WRITTEN, strict=True)], schema=WRITTEN)
        if out is not None:
            out.close()

    if end < encoder(ranks).n_vocab or end > np.iinfo(width).max:
        raise ValueError(f"{end} is a rank of the vocabulary or no {width}")
    chosen = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        written = materialise(chosen.mapInArrow(run, "file string, staged string, ordinal long, doc_id long"), "token-rows")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    move_staged(written.select("staged", F.col("file").alias("name")).distinct(), folder, STAGING)
    fs.create_dir(f"{base}/{STAGING}")
    fs.delete_dir(f"{base}/{STAGING}")
    return written.drop("staged")


SEPARATORS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seps", pa.list_(pa.int64()))])


def block_separators(files: DataFrame, folder: str, ends: tuple[int, ...], width: str, block: int) -> DataFrame:
    """(file, block, seps): the places of end identifiers, counted from the file's start."""
    wide = np.dtype(width).itemsize

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name, number, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(min(block * wide, size - number * block * wide), number * block * wide)
                tokens = np.frombuffer(data, dtype=width)
                hit = tokens == ends[0]
                for other in ends[1:]:
                    hit |= tokens == other
                seps = np.flatnonzero(hit) + number * block
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([seps], pa.list_(pa.int64()))], schema=SEPARATORS)

    last = F.ceil(F.col("bytes") / (block * wide)) - 1
    blocks = files.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "bytes")
    return blocks.repartition("file", "block").mapInArrow(run, "file string, block long, seps array<long>")


def separator_scan(
    spark: SparkSession, folder: str, ends: tuple[int, ...] = (END,), width: str = WIDTH, block: int = BLOCK, run: int = RUN
) -> DataFrame:
    """(file, ordinal, begin, n_tokens, ended) of each document in the folder's token files (*.bin).

    Documents may lie across any number of blocks. Two separators in a row enclose an empty document.
    Tokens after a file's last separator are a document that has not ended; a file without separators is
    one such document, an empty file has none. A file that is no whole number of tokens is an error.
    """
    from pyarrow.fs import FileSelector

    fs, base = filesystem(folder)
    found = [(f.base_name, f.size) for f in fs.get_file_info(FileSelector(base)) if f.is_file and f.base_name.endswith(".bin")]
    if broken := [name for name, size in found if size % np.dtype(width).itemsize]:
        raise ValueError(f"no whole number of {width} tokens: {broken[:3]}")
    files = spark.createDataFrame(found, "file string, bytes long")
    blocks = materialise(block_separators(files, folder, ends, width, block), "separators")
    none = F.lit(-1).cast("long")
    local = blocks.select(
        "file", "block", (F.col("block") / run).cast("long").alias("run"), "seps",
        F.size("seps").cast("long").alias("n"), F.coalesce(F.array_max("seps"), none).alias("last"),
    )
    over_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    runs = runs.select(
        "file", "run", F.coalesce(F.sum("n").over(over_runs), F.lit(0)).alias("run_n"), F.coalesce(F.max("last").over(over_runs), none).alias("run_last")
    )
    over_blocks = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        local.withColumn("own_n", F.coalesce(F.sum("n").over(over_blocks), F.lit(0)))
        .withColumn("own_last", F.coalesce(F.max("last").over(over_blocks), none))
        .join(runs, ["file", "run"])
        .select("file", (F.col("run_n") + F.col("own_n")).alias("base"), F.greatest("run_last", "own_last").alias("before"), "seps")
    )
    ended = stitched.select("file", "base", "before", "seps", F.posexplode("seps").alias("i", "sep"))
    begin = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("seps", F.col("i") - 1)) + 1
    ended = ended.select("file", (F.col("base") + F.col("i")).alias("ordinal"), begin.alias("begin"), (F.col("sep") - begin).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = files.join(local.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "file")
    rest = F.col("bytes") / np.dtype(width).itemsize - F.col("last") - 1
    tails = tails.select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("begin"), rest.cast("long").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(tails.filter("n_tokens > 0"))


@query("op3_separator_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    named = write_token_files(table(spark, sf_dir, "documents"), folder)
    counted = separator_scan(spark, folder)
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "begin", "n_tokens", "ended")
