"""Token counts: the estimate as expressions, and tokenizers for the chunk packer."""

from __future__ import annotations

import base64
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import utf16_length

#: Characters of one estimated token.
CHARS = 4


def count(c: Column) -> Column:
    return F.ceil(utf16_length(c) / CHARS).cast("long")


def _cut(c: Column, lo: Column, hi: Column) -> Column:
    """The UTF-16 units from lo (0 is the first) up to hi; an end inside a pair moves before it."""
    raw = F.encode(c, "UTF-16BE")
    n = utf16_length(c)
    inside = lambda at: (at > 0) & (at < n) & F.substring(F.hex(F.substring(raw, 2 * at + 1, F.lit(1))), 1, 2).between("DC", "DF")
    whole = lambda at: F.when(inside(at), at - 1).otherwise(at)
    return F.decode(F.substring(raw, 2 * whole(lo) + 1, 2 * (whole(hi) - whole(lo))), "UTF-16BE")


def _plain(c: Column) -> Column:
    return utf16_length(c) == F.length(c)


def truncate(c: Column, n: int) -> Column:
    return F.when(_plain(c), F.substring(c, 1, CHARS * n)).otherwise(_cut(c, F.lit(0), F.least(F.lit(CHARS * n), utf16_length(c))))


def tail(c: Column, n: int) -> Column:
    size = utf16_length(c)
    return F.when(size <= CHARS * n, c).when(_plain(c), F.substring(c, -CHARS * n, CHARS * n)).otherwise(_cut(c, size - CHARS * n, size))


def split(c: Column, n: int) -> Column:
    """Fixed slices of n tokens; an empty text has none."""
    w = CHARS * n
    size = utf16_length(c)
    cuts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(w))).otherwise(F.array().cast("array<int>"))
    return F.when(_plain(c), F.transform(cuts, lambda i: F.substring(c, i + 1, F.lit(w)))).otherwise(F.transform(cuts, lambda i: _cut(c, i, F.least(i + w, size))))


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...
    def truncate(self, text: str, n: int) -> str: ...
    def tail(self, text: str, n: int) -> str: ...
    def split(self, text: str, n: int) -> list[str]: ...


def units(text: str) -> int:
    return len(text) if text.isascii() or ord(max(text)) < 0x10000 else len(text.encode("utf-16-le")) // 2


def cut(text: str, at: list[int]) -> list[str]:
    """text in pieces that end at these UTF-16 units; an end inside a pair moves before it."""
    if units(text) == len(text):
        return [text[a:b] for a, b in zip([0, *at], at, strict=False)]
    raw = text.encode("utf-16-le")
    ends = [a - 1 if 0 < a < len(raw) // 2 and 0xDC <= raw[2 * a + 1] <= 0xDF else min(a, len(raw) // 2) for a in at]
    return [raw[2 * a : 2 * b].decode("utf-16-le") for a, b in zip([0, *ends], ends, strict=False)]


class Estimate:
    """A quarter of the length in UTF-16 units; needs no table. Cuts never part a pair."""

    def count(self, text: str) -> int:
        return -(-units(text) // CHARS) if text else 0

    def truncate(self, text: str, n: int) -> str:
        return cut(text, [min(CHARS * n, units(text))])[0]

    def tail(self, text: str, n: int) -> str:
        size = units(text)
        return cut(text, [max(0, size - CHARS * n), size])[1] if n else ""

    def split(self, text: str, n: int) -> list[str]:
        size = units(text)
        return cut(text, [*range(CHARS * n, size, CHARS * n), size]) if text else []


class Bpe:
    """A byte-level BPE from a file of ranks, loaded once a process."""

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _loaded: dict[str, object] = {}

    def __init__(self, path: str) -> None:
        self.path = path

    @property
    def encoding(self):
        if self.path not in self._loaded:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._loaded[self.path] = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._loaded[self.path]

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def truncate(self, text: str, n: int) -> str:
        return self.encoding.decode(self.encoding.encode_ordinary(text)[:n])

    def tail(self, text: str, n: int) -> str:
        return self.encoding.decode(self.encoding.encode_ordinary(text)[-n:]) if n else ""

    def split(self, text: str, n: int) -> list[str]:
        ids = self.encoding.encode_ordinary(text)
        return [self.encoding.decode(ids[i : i + n]) for i in range(0, len(ids), n)]
