"""A byte-level BPE vocabulary in tiktoken's rank format, applied through chunks.

The pre-tokeniser never lets a piece cross from a non-space to a white space, and
a single space joins the run that follows it. So a text can first be cut into
chunks (an optional space and a run of non-spaces, or white space) with the
standard library's fast ``re``; pre-tokenising a chunk by itself gives the pieces
it has in the text. What a chunk encodes to is remembered in the task.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import regex
import tiktoken

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's White_Space, which the pattern's \s means.
SPACES = " \t\n\r\x0b\x0c\x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A task forgets its chunks beyond so many; results don't depend on it.
REMEMBERED = 1_000_000
#: Longer chunks, as of texts without spaces, aren't remembered.
LONG = 64


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._merge = self.encoding._core_bpe.encode_single_piece
        self.pieces = regex.compile(PATTERN)

    def whole(self) -> dict[str, int]:
        """The proof: every vocabulary string that, given to the merges as one
        pre-token, comes out as its own single id. A string that isn't UTF-8
        can't be a pre-token, and one whose merges stop earlier is left out."""
        found = {}
        for token, rank in self.ranks.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue
            if self.pieces.findall(text) == [text] and self.merge(text) == [rank]:
                found[text] = rank
        return found

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token by BPE merges."""
        return self._merge(piece.encode())


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def whole_tokens(path: str) -> dict[str, int]:
    return vocabulary(path).whole()


class Chunks(dict):
    """chunk -> value; a missing chunk's value is made by ``make``."""

    def __init__(self, base: dict, make):
        super().__init__(base)
        self.base, self.make = base, make

    def __missing__(self, chunk: str):
        if len(chunk) > LONG:
            return self.make(chunk)
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.base)
        value = self[chunk] = self.make(chunk)
        return value
