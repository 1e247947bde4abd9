import numpy as np
import pytest
from cases import documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsight.llm import token_scan as S

END = 9


def by_hand(tokens, ends=(END,)):
    out, begin = [], 0
    for i, t in enumerate(tokens):
        if t in ends:
            out.append((begin, i - begin, True))
            begin = i + 1
    return out + ([(begin, len(tokens) - begin, False)] if begin < len(tokens) else [])


def scan(spark, folder, **kw):
    found = {}
    for r in S.separator_scan(spark, str(folder), width="uint16", **kw).collect():
        found.setdefault(r["file"], []).append((r["ordinal"], r["begin"], r["n_tokens"], r["ended"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in found.items()}


@pytest.mark.parametrize(("block", "run"), [(1, 2), (3, 1), (4, 3), (64, 1024)])
def test_stitches_documents_over_blocks(spark, tmp_path, block, run):
    rng = np.random.default_rng(block)
    files = {"a.bin": rng.integers(0, 12, 150), "b.bin": np.full(40, END), "c.bin": np.zeros(30), "d.bin": np.array([END]), "e.bin": np.array([1]), "f.bin": np.append(np.zeros(37), END)}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(tokens.astype("uint16").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"x")
    assert scan(spark, tmp_path, ends=(END,), block=block, run=run) == {k: by_hand(v.tolist()) for k, v in files.items()}
    assert scan(spark, tmp_path, ends=(END, 3), block=block, run=run)["a.bin"] == by_hand(files["a.bin"].tolist(), (END, 3))


def test_broken_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="no whole number"):
        S.separator_scan(spark, str(tmp_path))


def test_every_document_gets_its_own_count(spark, tmp_path):
    special = [(6000, "<|endoftext|> twice <|endoftext|>", "en", "a", 1)]
    docs = documents(spark, extra=special).withColumn("file", F.lit("theirs"))
    named = S.write_token_files(docs.repartition(3), str(tmp_path / "t"), roll_bytes=20_000)
    counted = S.separator_scan(spark, str(tmp_path / "t"), block=500, run=3)
    rows = named.join(counted, ["file", "ordinal"]).collect()
    code = S.encoder(S.RANKS)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(r["doc_id"]), len(code.encode(r["text"] or ""))) for r in docs.collect())
    assert counted.count() == docs.count() and all(r["ended"] for r in rows)
    assert len({r["file"] for r in rows}) > 3


def test_nothing_and_bad_ends(spark, tmp_path):
    named = S.write_token_files(nothing(spark), str(tmp_path / "t"))
    assert named.collect() == [] and S.separator_scan(spark, str(tmp_path / "t")).collect() == []
    with pytest.raises(ValueError, match="rank"):
        S.write_token_files(nothing(spark), str(tmp_path / "u"), end=17)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(7, 11), max_size=40), st.integers(1, 9))
def test_any_tokens(tmp_path_factory, tokens, block):
    from poolsight.session import local_session

    folder = tmp_path_factory.mktemp("t")
    (folder / "a.bin").write_bytes(np.array(tokens, dtype="uint16").tobytes())
    assert scan(local_session(8, "tests"), folder, ends=(END,), block=block, run=2).get("a.bin", []) == by_hand(tokens)
