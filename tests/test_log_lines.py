"""Log lines that chunk ends cut come back whole, numbered and placed, however files are split."""

import random
import tempfile
from pathlib import Path

import pytest

from poolsight.sources import files


def write(chunks, folder="node_3", log="logs"):
    root = Path(tempfile.mkdtemp(prefix="run-"))
    (root / folder).mkdir()
    for i, chunk in enumerate(chunks):
        (root / folder / f"{log}-{i}.chunk.txt").write_bytes(chunk)
    return root


def lines(spark, root):
    found = files.log_lines(spark, str(root)).orderBy("folder", "log", "number").collect()
    return [(r.number, r.offset, r.chunk, r.line) for r in found]


def by_hand(chunks):
    text, ends, want, at = b"".join(chunks), [], [], 0
    for chunk in chunks:
        ends.append((ends[-1] if ends else 0) + len(chunk))
    for number, line in enumerate(text.split(b"\n")[: -1 if text.endswith(b"\n") else None], 1):
        # the first chunk that holds the line's first byte (its newline, where it is empty)
        chunk = next((i for i, end in enumerate(ends) if at < end), len(ends) - 1)
        want.append((number, at, chunk, line.decode().removesuffix("\r")))
        at += len(line) + 1
    return want if text else []


@pytest.mark.parametrize(
    "chunks",
    [
        [b"one\ntw", b"o\nthree\n"],
        [b"one\n", b"two\n"],
        [b"a", b"b", b"c", b"d\ne"],
        [b"a\r", b"\nb\r\r\n\n", b"\n", b"c"],
        [b"x\n\n", b"", b"\ny"],
        [b"cut", b"", b"here\n"],
        ["grü".encode(), "n €\n".encode()],
        [b"only"],
        [b""],
    ],
)
def test_cut_lines_are_whole(spark, chunks):
    assert lines(spark, write(chunks)) == by_hand(chunks)


def test_chunks_are_in_order_of_their_number(spark):
    chunks = [f"{i:02d}\n{i:02d}-".encode() for i in range(12)]
    assert lines(spark, write(chunks)) == by_hand(chunks)


def test_a_mark_of_byte_order_does_not_hide_a_cut(spark):
    found = lines(spark, write([b"\xef\xbb\xbfone\ntw", b"o\n"]))
    assert [(n, line) for n, _, _, line in found] == [(1, "one"), (2, "two")]


def test_logs_do_not_run_into_each_other(spark):
    root = write([b"a\nb", b"c\n"])
    (root / "node_3" / "launcher.log-0.chunk.txt").write_bytes(b"l")
    (root / "node_3" / "other.txt").write_bytes(b"o")
    (root / "node_4").mkdir()
    (root / "node_4" / "logs-0.chunk.txt").write_bytes(b"n")
    found = files.log_lines(spark, str(root)).collect()
    assert sorted((r.node, r.log, r.kind, r.number, r.line) for r in found) == [
        (3, "launcher.log", "launcher", 1, "l"),
        (3, "logs", "user", 1, "a"),
        (3, "logs", "user", 2, "bc"),
        (3, "other.txt", "user", 1, "o"),
        (4, "logs", "user", 1, "n"),
    ]


@pytest.mark.parametrize("split_bytes", [7, 64, 1000])
def test_any_split_of_the_files_gives_the_same(spark, split_bytes):
    draw = random.Random(split_bytes)
    text = "".join(draw.choice(["a", "bc", "ü", "\n", "\n\n", "long " * 9]) for _ in range(400)).encode()
    cuts = sorted(draw.sample(range(len(text)), 6))
    chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    # a chunk may cut a character: the reader of a chunk keeps its bytes, and the whole line has them again
    root = write(chunks)
    names = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "0"}
    old = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        assert lines(spark, root) == by_hand(chunks)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
