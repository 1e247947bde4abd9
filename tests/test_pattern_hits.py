"""Many literal patterns at once against a plain search."""

import random

import pytest

from poolsight.operators import logs as ops


def hits(spark, texts, patterns):
    have = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return sorted((r.id, r.pattern) for r in ops.pattern_hits(have, asked).collect())


def plain(texts, patterns):
    return sorted({(i, p) for i, text in enumerate(texts) if text is not None for p in patterns if p and p in text})


def test_random_texts(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices("abü€ \n", k=draw.randrange(40))) for _ in range(80)]
    patterns = ["".join(draw.choices("abü€ \n", k=draw.randrange(1, 6))) for _ in range(120)]
    want = plain(texts, patterns)
    assert len(want) > 100 and hits(spark, texts, patterns) == want


@pytest.mark.parametrize("texts,patterns", [
    ([], ["a"]), (["a"], []), ([], []),
    ([None, "", "abc"], [None, "", "abc", "abc", "abcd"]),
    (["AbC"], ["abc", "AbC", "bC", "b"]),
    (["a.c a*c \\ $^"], ["a.c", "abc", "a*c", "\\", "$^"]),
    (["😀😀x", "x😀"], ["😀😀", "😀x", "x😀", "😀😀x"]),
])
def test_edges(spark, texts, patterns):
    assert hits(spark, texts, patterns) == plain(texts, patterns)


def test_a_pattern_over_the_end_of_a_piece(spark, monkeypatch):
    monkeypatch.setattr(ops, "PIECE", 8)
    texts = ["0123456789abcdefghijklmnop", "xxxxxxxabcxxxx"]
    patterns = ["789", "6789ab", "89a", "abc", "ghi", "hij", "op", "p", "fgh", "0123456789abcdefghijklmnop"]
    assert hits(spark, texts, patterns) == plain(texts, patterns)


def test_a_very_long_text(spark):
    texts = ["ab" * 400_000 + "needle" + "ab" * 400_000, "need le"]
    assert hits(spark, texts, ["needle", "baab", "bne"]) == plain(texts, ["needle", "baab", "bne"])


def test_patterns_that_share_every_gram_cost_no_more_rows(spark, monkeypatch):
    """Numbers of five digits have a thousand grams in all: joined by a gram alone, each line meets hundreds of patterns."""
    monkeypatch.setattr(ops, "BROADCAST_PATTERNS", 1 << 20)
    texts = spark.range(2_000).selectExpr("id", "concat('name=GPU model ', 10000 + 17 * id, '; tflops=', id % 700) AS text")
    patterns = spark.range(10_000, 50_000).selectExpr("concat('GPU model ', id, ';') AS pattern")
    found = ops.pattern_hits(texts, patterns)
    assert sorted((r.id, r.pattern) for r in found.collect()) == [(i, f"GPU model {10_000 + 17 * i};") for i in range(2_000)]
    # windows join whole patterns: no text is searched for a pattern
    assert "contains(" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_repeated_ids_and_null_ids(spark):
    have = spark.createDataFrame([(1, "xabcx"), (1, "abc abc"), (2, "ab"), (None, "abc")], "id long, text string")
    asked = spark.createDataFrame([("abc",), ("ab",)], "pattern string")
    assert sorted(tuple(r) for r in ops.pattern_hits(have, asked).collect()) == [(1, "ab"), (1, "ab"), (1, "abc"), (1, "abc"), (2, "ab")]
