import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolsight.llm import text as X
from poolsight.llm.quality import CLASSES, _CLASS, class_counts

SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def by_hand(t):
    return SPLIT.findall((t or "").encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té日", max_size=40)), max_size=8))
def test_equal_words_and_only_they_hash_alike(texts):
    words = X.Words(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
    seen, rows = {}, 0
    for first, n, h, bounds in X.word_hashes(pa.array(texts, pa.string()), words):
        assert first == rows
        rows += n
        for i in range(n):
            hashes = h[bounds[i] : bounds[i + 1]].tolist()
            expected = [bytes(w).lower() for w in by_hand(texts[first + i])]
            assert len(hashes) == len(expected)
            for a, b in zip(hashes, expected, strict=True):
                assert seen.setdefault(a, b) == b
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("segment", [7, 64])
def test_segments_change_nothing(monkeypatch, segment):
    words = X.Words(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
    texts = pa.array(["a bb ccc dddd eeeee", None, "x" * 50 + " y", "", "p q r s t u v w x y z " * 9])

    def run():
        return [h[b[i] : b[i + 1]].tolist() for _, n, h, b in X.word_hashes(texts, words) for i in range(n)]

    whole = run()
    monkeypatch.setattr(X, "SEGMENT", segment)
    assert run() == whole


def test_byte_classes_add_up():
    texts = ["aB1 .\n!|#é\x01", None, "", "z" * 3_000_000]
    got = class_counts(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        expected = np.bincount(_CLASS[np.frombuffer((t or "").encode(), np.uint8)], minlength=CLASSES)
        assert (row == expected).all()
