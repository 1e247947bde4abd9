import gzip
import hashlib
import json
import random

import pytest
from cases import words

from poolsight.llm import warc as W

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, extra=()):
    rng = random.Random(8)
    rows = [(i, f"http://a.example/{i}?q=é x\r\nEvil: 1", f"<p>{words(rng, rng.randint(1, 300))}</p>", "theirs") for i in range(80)]
    same = "<html>" + words(rng, 60) + "</html>"
    rows += [(200 + i, None, same, None) for i in range(40)] + [(220, "http://b/", same, None), (200, "http://c/", same, None)]
    rows += [(300, "u", None, None), (301, "u", "", None), (302, "u", "short", None), (303, "u", "short", None), (304, "u", "é" * 50, None), (305, "u", "é" * 50, None)]
    rows += [(306, "u", "x" * 99, None), (307, "u", "x" * 99, None), (None, "u", same, None), (None, "u", "n" * 200, None), (None, "v", "n" * 200, None)]
    rows += [(400, "u", "z" * 2_000_000, None), rows[0], (5, "u", rows[5][2], None)]
    return spark.createDataFrame(rows + list(extra), PAGES)


def by_hand(rows):
    facts = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    least = {}
    for key, data in facts:
        if key is not None:
            least[data] = min(key, least.get(data, key))
    out, responded = [], set()
    for key, data in facts:
        first = least.get(data)
        whole = len(data) < 100 or first is None or (key == first and data not in responded)
        if key == first:
            responded.add(data)
        out.append((str(key), len(data), hashlib.sha256(data).hexdigest(), "response" if whole else "revisit", str(None if whole else first)))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    folder = str(tmp_path / "a")
    files = W.write_warc(df.repartition(3), folder, shard_bytes=20_000, roll_bytes=6_000)
    got = W.read_warc(spark, folder, payloads=True).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == by_hand(df.collect())
    assert sorted(bytes(r["payload"]) for r in got if r["payload"] is not None) == sorted(
        {i: (r["html"] or "").encode() for i, r in enumerate(df.collect())}[i] for i in whole_rows(df.collect())
    )
    assert len(files) > 5 and sum(f["records"] for f in files) == df.count()
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert names == sorted([*[f["name"] for f in files], W.MANIFEST])
    for f in files:
        data = (tmp_path / "a" / f["name"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    order = [(r["file"], r["offset"], r["page_id"] if r["page_id"] is not None else -1) for r in got]
    keys = [k for _, _, k in sorted(order)]
    assert keys == sorted(keys)
    assert not any(b"\r\nEvil" in gzip.decompress((tmp_path / "a" / f["name"]).read_bytes()) for f in files)


def whole_rows(rows):
    seen, out = set(), []
    least = {}
    for r in rows:
        data = (r["html"] or "").encode()
        if r["page_id"] is not None:
            least[data] = min(r["page_id"], least.get(data, r["page_id"]))
    for i, r in enumerate(rows):
        data = (r["html"] or "").encode()
        first = least.get(data)
        if len(data) < 100 or first is None or (r["page_id"] == first and data not in seen):
            out.append(i)
        if r["page_id"] == first:
            seen.add(data)
    return out


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = pages(spark)
    a = W.write_warc(df.repartition(2), str(tmp_path / "a"), shard_bytes=30_000, roll_bytes=8_000)
    b = W.write_warc(df.repartition(9).orderBy("html"), str(tmp_path / "b"), shard_bytes=30_000, roll_bytes=8_000)
    assert a == b


def test_only_named_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "a")
    W.write_warc(pages(spark).limit(20), folder)
    n = W.read_warc(spark, folder).count()
    (tmp_path / "a" / "part-000099-00000.warc.gz").write_bytes(b"half a file of a lost task")
    assert W.read_warc(spark, folder).count() == n == 20


def test_damage_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "a")
    (f,) = W.write_warc(pages(spark).limit(5), folder)
    path = tmp_path / "a" / f["name"]
    members = list(W.members(path.open("rb")))
    body = b"".join(W.member(d.replace(b"<p>", b"<q>")) for _, d in members)
    path.write_bytes(body)
    with pytest.raises(Exception, match="damaged"):
        W.read_warc(spark, folder).collect()
    path.write_bytes(body[:-4])
    with pytest.raises(Exception, match="inside a record"):
        list(W.members(path.open("rb")))


def test_an_empty_table_commits_an_empty_archive(spark, tmp_path):
    folder = str(tmp_path / "a")
    assert W.write_warc(pages(spark).limit(0), folder) == []
    assert W.read_warc(spark, folder).collect() == []
    assert json.loads((tmp_path / "a" / W.MANIFEST).read_text()) == {"files": []}
