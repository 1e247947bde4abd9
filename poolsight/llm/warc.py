"""A deterministic sharded WARC writer, and the reader of what it commits.

Records are ordered by (key, payload digest). Size-weighted splitters cut the order into shards, a
task streams one sorted shard into gzip members, one a record, and rolls to a new file when enough
compressed bytes are written. File names, headers, digests and bytes follow from the rows alone.
Tasks write under temporary names of their own attempt; when all have ended, the files that the
successful attempts named are renamed and a manifest, itself renamed into place, makes them the
archive. A lost executor's half files are never named. Which record of equal payloads is written
whole is decided on digests; the decision reaches the writer as a row sorted in front of its page,
so payloads are shuffled once.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.llm.catalog import query, table
from poolsight.llm.sharding import LOWEST, range_of, sampled_splitters
from poolsight.llm.storage import arrow_batches, filesystem, fresh_path, materialise, move_staged

#: Payload bytes to a shard, compressed bytes that end a file, payload bytes from which equal payloads are told once.
SHARD_BYTES, ROLL_BYTES, LEAST_SHARED = 48 << 20, 8 << 20, 100
#: Pages that cross to the writer together.
PAGES_AT_ONCE = 1000
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the WARC 1.1 standard.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, STAGING = "manifest.json", "_temporary"
FILE_DDL = "name string, staged string, shard int, records long, bytes long, sha256 string"
FILES = pa.schema([("name", pa.string()), ("staged", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without time or name."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record_id(key: int | None, digest: str, nth: int) -> str:
    return f"<urn:x-record:{'-' if key is None else key}:{digest}:{nth}>"


def page_record(key: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers_to: int | None) -> bytes:
    """A response, or a revisit of the first record of `refers_to`, with all headers made anew."""
    headers = [("WARC-Record-ID", record_id(key, digest, nth)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    return record("revisit", headers, http)


class Roller:
    """Writes one shard's members to files that end at the first member past the size."""

    def __init__(self, folder: str, prefix: str, roll_bytes: int) -> None:
        self.fs, self.folder = filesystem(folder)
        self.uri, self.prefix, self.roll = folder, prefix, roll_bytes
        self.shard, self.out, self.number = None, None, 0

    def open(self) -> None:
        self.name = f"{self.prefix}-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.staged = f"{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.folder}/{STAGING}", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.folder}/{STAGING}/{self.staged}", compression=None)
        self.records, self.bytes, self.digest = 0, 0, hashlib.sha256()
        about = b"software: poolsight\r\nformat: WARC File Format 1.1\r\n"
        ident = f"<urn:x-file:{self.name}>"
        self.put(member(record("warcinfo", [("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about)))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        self.number += 1
        return [(self.name, self.staged, self.shard, self.records - 1, self.bytes, self.digest.hexdigest())]

    def write(self, shard: int, data: bytes) -> list[tuple]:
        done = []
        if shard != self.shard:
            done += self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.open()
        self.put(member(data))
        return done + (self.close() if self.bytes >= self.roll else [])


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FILES, strict=True)], schema=FILES)


def write_warc(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    prefix: str = "part",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> list[dict]:
    """Write one record a row under `folder` and commit; returns the manifest's files.

    Of equal payloads of at least LEAST_SHARED bytes the row of the least key is a response and all
    others revisit it; of repeated rows of that key the first is the response. A null payload is
    empty. Null keys sort first and never count as least: they revisit a keyed row of equal payload,
    and are responses where there is none. A null url has no target header. An empty table commits a
    manifest without files. Other columns are not read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("k"), F.col(url).alias("url"), body.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    keys = materialise(rows.select("k", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    shared = (
        keys.filter(F.col("size") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
    )
    # by (key, digest); the digest's head decides among repeated keys
    order = [F.coalesce("k", F.lit(LOWEST)).alias("__h"), F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("__id")]
    weighed = keys.select((F.col("size") + 400).alias("__size"), *order)
    total = weighed.agg(F.sum("__size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    splitters, _ = sampled_splitters(weighed, shards) if shards > 1 else ([], [])
    place = range_of(splitters)(*order)
    decisions = keys.join(shared, "digest").select("k", "digest", F.col("first")).distinct()
    decisions = decisions.select(
        place.alias("shard"), "k", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")
    )
    whole = rows.select(place.alias("shard"), "k", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload")
    n = len(splitters) + 1
    sorted_rows = whole.unionByName(decisions).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "k", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, nth, told = Roller(folder, prefix, roll_bytes), None, 0, None
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            shards_, ks, digests, kinds, firsts, urls = (c.to_pylist() for c in columns[:6])
            done = []
            for i, kind in enumerate(kinds):
                if at != (ks[i], digests[i]):
                    at, nth, told = (ks[i], digests[i]), 0, None
                if kind == 0:
                    told = firsts[i]
                    continue
                refers = told if told is not None and (ks[i] != told or nth) else None
                done += roller.write(shards_[i], page_record(ks[i], urls[i], columns[6][i].as_py(), digests[i], nth, refers))
                nth += 1
            if done:
                yield _file_rows(done)
        if done := roller.close():
            yield _file_rows(done)

    with arrow_batches(spark, PAGES_AT_ONCE):
        written = materialise(sorted_rows.mapInArrow(write, FILE_DDL), "warc-files")
    return commit(written, folder)


def commit(written: DataFrame, folder: str) -> list[dict]:
    """Rename in tasks what the successful attempts wrote, then put the manifest in place: a row a file."""
    move_staged(written, folder, STAGING)
    files = [row.asDict() for row in written.drop("staged").orderBy("name").collect()]
    fs, base = filesystem(folder)
    fs.create_dir(f"{base}/{STAGING}", recursive=True)
    with fs.open_output_stream(f"{base}/{STAGING}/{MANIFEST}") as out:
        out.write(json.dumps({"files": files}, indent=1, sort_keys=True).encode())
    fs.move(f"{base}/{STAGING}/{MANIFEST}", f"{base}/{MANIFEST}")
    fs.delete_dir(f"{base}/{STAGING}")
    return files


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream; one member is held at a time."""
    offset, start, inflate, parts, data = 0, 0, zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(inflate.decompress(data))
        offset += len(data) - len(inflate.unused_data)
        if inflate.eof:
            yield start, b"".join(parts)
            data, start, inflate, parts = inflate.unused_data, offset, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(chunk)
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block; a wrong length or digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    headers = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, payload binary"
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])


def _key(ident: str) -> int | None:
    key = ident.split(":")[2]
    return None if key == "-" else int(key)


def read_warc(spark: SparkSession, folder: str, payloads: bool = False, at_once: int = 4 << 20) -> DataFrame:
    """Every response and revisit that the folder's manifest names, file by file in tasks.

    Digests and lengths are checked against the bytes read: a response's payload is hashed anew, a
    revisit gives the digest and length its headers keep. `payload` is null for revisits, and for
    all unless `payloads` is set. An archive of no files gives no rows.
    """
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{MANIFEST}") as stream:
        names = [(f["name"],) for f in json.loads(stream.read())["files"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, root = filesystem(folder)
        rows, held = [], 0
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with here.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for offset, data in members(stream):
                    headers, block = parse(data)
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload of {headers['warc-record-id']}")
                    refers = _key(headers["warc-refers-to"]) if kind == "revisit" else None
                    kept = payload if payloads and kind == "response" else None
                    rows.append((_key(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, refers, name, offset, kept))
                    held += 300 + len(kept or b"")
                    if held > at_once:
                        yield pa.RecordBatch.from_pylist([dict(zip(RECORDS.names, r, strict=True)) for r in rows], schema=RECORDS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(RECORDS.names, r, strict=True)) for r in rows], schema=RECORDS)

    listed = spark.createDataFrame(names, "name string")
    return listed.repartition(max(1, min(len(names), 10_000))).mapInArrow(read, RECORD_DDL)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM f
"""


@query("op1_warc_archive", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
