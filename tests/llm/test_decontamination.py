import hashlib
import random
import re

import pytest
from cases import documents, nothing, words

from poolsight.llm.decontamination import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(text, items, window=13, percent=5):
    w, hit, found = tokens(text), set(), set()
    for item, item_text in items:
        q = tokens(item_text)
        size = min(window, len(q))
        grams = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)} if q else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    names = sorted(str(x) for x in found if x is not None)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit) and 100 * len(hit) >= percent * len(w)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_as_by_hand(spark, broadcast):
    rng = random.Random(5)
    items = [(i, words(rng, rng.choice([13, 14, 25, 40]), 30)) for i in range(12)]
    items += [(100, None), (101, "..."), (102, "one"), (103, "two words"), (104, "w1 w2 w3"), (105, items[0][1]), (None, items[1][1]), (7, items[2][1]), (7, "w3 w4 w5 w6")]
    planted = []
    for i, (_, text) in enumerate(items[:12]):
        w = text.split()
        planted.append((5000 + i, words(rng, 40) + " " + text.upper() + ". " + words(rng, 60), "en", "a", 1))
        planted.append((5100 + i, words(rng, 900) + " " + " ".join(w[:13]) + " " + words(rng, 5), "en", "a", 1))
        planted.append((5200 + i, " ".join(w[:12]) + " gap " + " ".join(w[-12:]), "en", "a", 1))
        planted.append((5300 + i, " ".join(w + w[1:] + w), "en", "a", 1))
    docs = documents(spark, extra=planted)
    got = decontaminate(docs, spark.createDataFrame(items, ITEMS), broadcast_shingles=broadcast).collect()
    expected = sorted((str(r["doc_id"]), *by_hand(r["text"], items)) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expected
    assert any(e[-1] for e in expected) and any(e[2] and not e[-1] for e in expected)


def test_contaminated_rows_go(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, item), (1, "clean"), (2, "x " * 500 + item), (None, item), (None, None)], ITEMS.replace("item_id", "doc_id"))
    kept = drop_contaminated(docs, decontaminate(docs, spark.createDataFrame([(1, item)], ITEMS)))
    assert sorted(kept.collect(), key=str) == sorted([r for r in docs.collect() if r["text"] != item], key=str)


def test_nothing(spark):
    items = spark.createDataFrame([(1, "a b c")], ITEMS)
    assert decontaminate(nothing(spark), items).collect() == []
    rows = decontaminate(documents(spark), spark.createDataFrame([], ITEMS)).collect()
    assert rows and not any(r["n_hit"] or r["contaminated"] for r in rows)


def test_a_very_long_item_and_clashing_columns(spark):
    """An item of 100,000 words has as many windows and a few shingles each; columns named like ours do not matter."""
    rng = random.Random(8)
    long_item = words(rng, 100_000, 50_000)
    part = " ".join(long_item.split()[70_000:70_040])
    rows = [(1, "before " + part + " after"), (2, "nothing of it"), (3, long_item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS w", "1 AS pos", "2 AS size", "3 AS shingle", "'y' AS words", "4 AS n_words", "5 AS items")
    items = spark.createDataFrame([(9, long_item, "z", 7)], "item_id long, text string, w string, window int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate(docs, items).collect()}
    assert got == {1: (42, 40, 1), 2: (3, 0, 0), 3: (100_000, 100_000, 1)}
