"""Byte-level BPE of any text, long runs of white space included.

The splitting pattern backtracks over a run of white space character by character and runs out of stack
on very long ones. What the pattern makes of a run is known: before other text all but its last character
are one piece, at the end of the text all of it. Long runs are cut out by that rule and encoded as the
one piece they are; the ids are the same.
"""

from __future__ import annotations

import base64
import json
import re

from poolsight.llm.storage import filesystem

#: How the public vocabularies split text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are cut out.
LONG_RUN = 4096
_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import tiktoken

        self.ranks = ranks
        self._split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = self._split.n_vocab

    @classmethod
    def from_ranks(cls, path: str) -> ByteBpe:
        """From a file of base64 tokens with their ranks."""
        pairs = [line.split() for line in _read(path).splitlines() if line]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    @classmethod
    def from_vocabulary(cls, path: str) -> ByteBpe:
        """From a JSON vocabulary whose ids follow its merges; special tokens are left out, so they are plain text."""
        read = json.loads(_read(path))
        special = {t["content"] for t in read["added_tokens"]}
        vocabulary, symbols = read["model"]["vocab"], byte_symbols()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in read["model"]["merges"]]
        ids = [vocabulary[m] for m in merged]
        if ids != sorted(ids) or (ids and ids[0] != 256):
            raise ValueError("ids do not follow the order of the merges")
        return cls({bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in special})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self._split.encode_ordinary(text)
        out, at = [], 0
        for run in _RUNS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self._split.encode_ordinary(text[at : run.start()])
            out += self._piece.encode_ordinary(text[run.start() : stop])
            at = stop
        return out + self._split.encode_ordinary(text[at:])


def _read(path: str) -> bytes:
    fs, place = filesystem(path)
    with fs.open_input_stream(place) as stream:
        return stream.read()
