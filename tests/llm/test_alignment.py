"""Alignment against a plain walk over byte offsets and counters over all documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from poolsight.llm import alignment
from poolsight.llm.alignment import MODEL, VOCABULARY, Sides, align, coalesce, link_digest
from poolsight.llm.byte_bpe import byte_symbols
from tests.llm.cases import DOCS, documents, nothing, words


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of both sides from the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    symbols = byte_symbols()

    def sides(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own_a = [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in ids_a]
        own_b = [(i, bytes([b_byte(i)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
        want = (" " + text).encode()
        return (own_a, own_b) if b"".join(t for _, t in own_a) == want == b"".join(t for _, t in own_b) else ([], [])

    def b_byte(i):
        return int(b.id_to_piece(i)[3:5], 16)

    return sides


def grouped(a, b):
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        ids_a, ids_b = [a[i][0]], [b[j][0]]
        at_a, at_b, i, j = at_a + len(a[i][1]), at_b + len(b[j][1]), i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                ids_a.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                ids_b.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
        out.append((ids_a, ids_b))
    return out


def brute(rows, sides):
    held, counts = [], Counter()
    for doc, text in rows:
        a, b = sides(text)
        groups = grouped(a, b)
        links = Counter()
        for ids_a, ids_b in groups:
            for x, n in Counter(ids_a).items():
                for y, m in Counter(ids_b).items():
                    links[x, y] += n * m
        counts.update(links.keys())
        held.append((doc, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc, n_a, n_b, groups, links in held:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), best, total, hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""))
    return sorted(out, key=str)


EXTRA = ["it's <s> </s> <unk> <|endoftext|>", "▁ taken for a space", "é日本語 　x", "a  b   c    d", "\n\n \t tabs", "zero\x00byte", " lead", "trail ", "ﬁ ½ ①", "​﻿", "x" * 5000 + " " * 5000 + "y"]


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 50, 0])
def test_as_a_plain_walk(spark, plain, monkeypatch, bound):
    monkeypatch.setattr(alignment.link_figures, "__defaults__", (bound,))
    docs = documents(spark, rows=30, extra=[(5000 + i, t, None, None, None) for i, t in enumerate(EXTRA)]).repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted([tuple(r) for r in link_digest(docs).collect()], key=str) == brute(rows, plain)


def test_given_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in link_digest(docs).collect()], key=str) == brute(rows, plain)


def test_empty_and_clashing(spark):
    assert link_digest(nothing(spark)).collect() == []
    docs = spark.createDataFrame([(1, "one two", "r", "p", 3), (2, None, None, None, None)], DOCS)
    clash = docs.selectExpr("*", "'x' AS row", "'y' AS pairs", "7 AS n_a")
    want = sorted(tuple(r) for r in link_digest(docs).collect())
    assert sorted(tuple(r) for r in link_digest(clash).collect()) == want
    assert want[1] == (2, 0, 0, 0, 0, 0, 0, "")


def test_lists_of_the_operator(spark, plain):
    """Group sizes cover all tokens, ends rise to the text's bytes, and cutting long texts changes nothing."""
    rng = random.Random(4)
    text = words(rng, 4000) + " é" + "\n" * 600 + words(rng, 500)
    docs = spark.createDataFrame([(1, text, None, None, None), (2, "", None, None, None), (3, "one", None, None, None)], DOCS)
    rows = {r["doc_id"]: r for r in align(docs).collect()}
    a, b = plain(text)
    assert rows[1]["a_ids"] == [i for i, _ in a] and rows[1]["b_ids"] == [i for i, _ in b]
    assert sum(rows[1]["a_sizes"]) == len(a) and sum(rows[1]["b_sizes"]) == len(b)
    assert rows[1]["ends"] == sorted(set(rows[1]["ends"])) and rows[1]["ends"][-1] == len(text.encode()) + 1
    assert rows[2]["a_ids"] == rows[2]["ends"] == [] and rows[3]["ends"][-1] == 4


def test_long_texts_are_cut_where_nothing_changes(plain, monkeypatch):
    rng = random.Random(6)
    sides = Sides.shared(VOCABULARY, MODEL)
    text = "".join(rng.choice(["a b", " é ", "  ", "w1 2x", "\n", "Ab, cd"]) for _ in range(3000))
    a, b = plain(text)
    monkeypatch.setattr(alignment, "SEGMENT", 50)
    assert len(list(sides.segments(text))) > 50
    assert sides.encode(text) == ([i for i, _ in a], [i for i, _ in b])


def test_ranges_that_never_meet():
    """Tokens that share no end are one group; linked ids are expanded as distinct pairs in bounded steps."""
    in_a, in_b, ends = coalesce(np.array([1, 2, 2, 2, 1]), np.array([2, 2, 2, 2]))
    assert in_a.tolist() == [0] * 5 and in_b.tolist() == [0] * 4 and ends.tolist() == [8]
    in_a, in_b, ends = coalesce(np.array([1, 3, 2]), np.array([1, 1, 2, 2]))
    assert in_a.tolist() == [0, 1, 2] and in_b.tolist() == [0, 1, 1, 2] and ends.tolist() == [1, 4, 6]


def test_pairs_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    in_a, in_b = np.sort(rng.integers(0, 6, 300)), np.sort(rng.integers(0, 6, 200))
    doc = np.array([0, 0, 1, 2, 2, 2])
    args = (doc, in_a, rng.integers(0, 9, 300), in_b, rng.integers(0, 7, 200), (9, 7))
    whole = alignment._pairs(*args)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 5)
    assert all((x == y).all() for x, y in zip(whole, alignment._pairs(*args), strict=True))
    for values in ([], [0], [255], [256, 1], [70000, 3], [1 << 40, 5]):
        assert alignment._unpack(alignment._pack(np.array(values, dtype=np.int64))).tolist() == values


def test_pair_counts_are_handed_on_in_parts(spark, monkeypatch):
    docs = documents(spark, rows=20).coalesce(1)
    linked = alignment.digests(align(docs)).persist()
    want = {r["pair"]: r["n"] for r in alignment.pair_counts(linked).collect()}
    monkeypatch.setattr(alignment, "COUNTED_AT_ONCE", 100)
    assert {r["pair"]: r["n"] for r in alignment.pair_counts(linked).collect()} == want
    linked.unpersist()
