"""Ids of texts with very long runs, against another implementation of the same vocabulary."""

import random

import pytest

from poolsight.llm import byte_bpe, token_scan
from poolsight.llm.alignment import VOCABULARY
from poolsight.llm.byte_bpe import ByteBpe

BLANKS = [" ", "\n", " \n", "\t", "\u00a0", "\u3000 ", "\u2003", "\x1c ", "\u200b", "\x85"]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return ByteBpe.from_vocabulary(VOCABULARY)


def test_both_files_are_one_vocabulary(own):
    assert own.ranks == token_scan.encoder(token_scan.RANKS).ranks


@pytest.mark.parametrize("text", ["", "<|endoftext|> it's 'll 12 é日本 \n\n x", "a" * 9000, " " * 5000, "\n" * 5000 + "z", "x" + " \n" * 4000 + "y's"])
def test_as_the_other(own, other, text):
    assert own.encode(text) == other(text)


def test_runs_between_all_kinds_of_text(own, other, monkeypatch):
    """With short runs cut out as well, a random mixture gives the same ids."""
    import re

    monkeypatch.setattr(byte_bpe, "LONG_RUN", 2)
    monkeypatch.setattr(byte_bpe, "_RUNS", re.compile(byte_bpe._RUNS.pattern.replace("4096", "2")))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(BLANKS) * rng.randint(1, 5), rng.choice(["a", "é", "12", "--", "'s", "日", "w's ", "."])]) for _ in range(30))
        assert own.encode(text) == other(text)


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\u3000", "y", "1"])
def test_two_million(own, run):
    text = run * 2_000_000
    ids = own.encode(text + "x")
    spelled = {i: t for t, i in own.ranks.items()}
    assert b"".join(map(spelled.__getitem__, ids)) == (text + "x").encode()
