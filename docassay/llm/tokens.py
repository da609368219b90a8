"""Token ids of a byte-level BPE file of the `tokenizers` library, word by word.

In this pre-tokenizer no token crosses the place between a non-space and a
single space followed by a non-space, so texts are cut there and the ids of
frequent pieces are remembered. Pieces not yet seen are encoded by tiktoken with
the same vocabulary, read from the same file; tests hold the ids against the
`tokenizers` library. Added tokens found in a text have their own ids, as there;
`ids` is for text between them.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from pathlib import Path

import tiktoken

#: The pre-tokenizer's pattern (fixed: ByteLevel with use_regex).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD_SPACE = re.compile(r" \s|\s ")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Remembered(dict):
    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(self.prefix + piece)).tobytes()
        if len(self) < REMEMBERED and len(piece) <= 40:
            self[piece] = ids
        return ids


class ByteBpe:
    """`all_ids(text)`: the text's ids as little-endian unsigned 32-bit integers; `ids` takes added tokens as ordinary text."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.vocabulary = 1 + max(*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), 0)
        special = {x["content"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or not x["content"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        byte = _byte_of_char()
        ranks = {
            bytes(map(byte.__getitem__, token)): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in special
        }
        self.encode = tiktoken.Encoding(
            "byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.after_space = _Remembered(self.encode, " ")

    def all_ids(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self.ids(text)
        parts = self._added.split(text)  # every other one is an added token
        return b"".join(self.added[x] if k % 2 else self.ids(x) for k, x in enumerate(parts))

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            first, *rest = _SAFE_CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
            if rest and not rest[-1]:
                rest[-1:] = []
                if not rest:
                    return array("I", self.encode(text)).tobytes()
                rest[-1] += " "
        head = array("I", self.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.after_space.__getitem__, rest))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
