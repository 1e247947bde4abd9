"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from poolsight.llm import lexical
from poolsight.llm.lexical import Automaton, Best, Block, count_terms, guarded, pieces, search
from tests.llm.cases import DOCS, documents, nothing, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found, asked_terms = [], terms(text)
        for doc, c, n in held:
            m = 25 + (75 * n * n_docs) // max(length, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in asked_terms if w in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


def asked(seed, n=12):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 30))) for i in range(n)]
    rows += [(50, "W1 w1, w2! w2 w2"), (51, None), (52, ""), (53, " .,;"), (54, "é É日本 w3"), (None, "w5 w6"), (50, "x1"), (55, "y" * 300_000)]
    return [*rows, rows[0], (56, words(rng, 20_000, 5000))]


@pytest.mark.parametrize("block_bytes", [1 << 24, 40_000])
def test_as_a_plain_loop(spark, block_bytes):
    docs = documents(spark, extra=[(60 + i, t, "en", "a", 1) for i, t in enumerate(["é É日本 É", "w1w2 w-1 w1", "\x00w1\x7fw1", "w3" + "\n" * 70_000])])
    items = asked(3)
    got = search(docs, spark.createDataFrame(items, ITEMS), block_bytes=block_bytes).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_empty_tables_and_other_columns(spark):
    items = spark.createDataFrame([(1, "w1", "own", 3)], ITEMS + ", doc string, term long")
    assert search(nothing(spark), items).collect() == []
    assert search(documents(spark), spark.createDataFrame([], ITEMS)).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None), (2, "--", None, None, None)], DOCS)
    assert search(none, items).collect() == []
    clash = documents(spark).selectExpr("*", "1 AS doc", "'i' AS item_id", "2 AS score", "3 AS part")
    assert [tuple(r) for r in search(clash, items).collect()] == [tuple(r) for r in search(documents(spark), items).collect()]


def test_ties_go_by_id_and_null_last(spark):
    rows = [(i, "tie", None, None, None) for i in (7, 5, 9, -3, None, 5)] + [(100 + i, f"z{i}", None, None, None) for i in range(30)]
    got = search(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame([(1, "tie")], ITEMS)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [-3, 5, 5, 7, 9, None] and [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6]


def test_guards_and_pieces(monkeypatch):
    """Touching terms share a guard; pieces cut long texts without losing or doubling a term."""
    automaton = Automaton([b"a", b"ab", b"b"])
    assert automaton.counts(guarded("a a ab,B b abb")) == {0: 2, 1: 1, 2: 2}
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "ab", "b", "c" * rng.randint(1, 40)]) for _ in range(3000))
    whole = automaton.counts(guarded(text))
    monkeypatch.setattr(lexical, "SCAN_BYTES", 16)
    assert automaton.counts(guarded(text)) == whole
    assert sum(count_terms(p) for p in pieces(guarded(text))) == count_terms(guarded(text)) == 3000


def test_scores_beyond_doubles_are_whole_numbers():
    rows = [{"item": i, "ident": i, "term": t, "repeats": n} for i, t, n in [(0, b"a", 3), (0, b"b", 1), (1, b"b", 2)]]
    block = Block(rows)
    block.weigh(10, 50, {0: 1, 1: 4})
    args = (np.array([3, 9]), np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2, 1, 5]))
    quick, block.exact = block.scores(*args), False
    assert block.exact is False and (block.scores(*args) == quick).all()


def test_best_is_kept_over_batches():
    rng = np.random.default_rng(1)
    scores, best = rng.integers(0, 6, (200, 3)), Best(3, 4)
    for at in range(0, 200, 30):
        best.add(scores[at : at + 30], np.arange(200)[at : at + 30], np.zeros(len(scores[at : at + 30]), bool))
    for item in range(3):
        want = sorted((-s, i) for i, s in enumerate(scores[:, item]) if s > 0)[:4]
        assert sorted(zip(-best.score[best.item == item], best.ident[best.item == item])) == want
