"""Cutting texts into the pieces that byte-level tokenizers encode one by one.

A text is first cut at each single space between two visible characters: no piece of the
pattern spans such a place, so the parts can be looked up in a dictionary, and the slow regular
expression only sees each different part once. Texts with other white space at a cut (double
spaces, a space beside a line break or at an end) are cut by ``CHUNK`` instead, which ends a part
only between a visible character and white space. Both cuts give the same pieces.
"""

from __future__ import annotations

import re
from functools import cache

#: Unicode White_Space, as the tokenizer libraries understand \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Below this code point all Unicode versions agree what a letter or number is.
AGREED = 0x500


class PartCache(dict):
    """Value of each part, worked out by ``make(piece)`` when first asked for.

    A key stands for a space and the key's text. Parts that cannot be cut at their spaces get
    ``bad``. Holds ``limit`` parts at most: when full it starts again, which costs time only.
    """

    def __init__(self, make, bad, limit: int = 1_000_000):
        super().__init__()
        self.make, self.bad, self.limit, self.firsts = make, bad, limit, {}

    def __missing__(self, part: str):
        if len(self) >= self.limit:
            self.clear()
        value = self.bad if unsafe(part) else self.make(" " + part)
        self[part] = value
        return value

    def put(self, found) -> None:
        """Take values that were worked out elsewhere, as pairs of key and value."""
        if len(self) >= self.limit:
            self.clear()
        self.update(found)

    def first(self, part: str):
        """The value of a part at the start of a text or after white space of its own."""
        if part not in self.firsts:
            if len(self.firsts) >= self.limit:
                self.firsts.clear()
            self.firsts[part] = self.make(part)
        return self.firsts[part]

    def values_of(self, text: str) -> list:
        """The values of all parts of a text, in order."""
        if not text:
            return []
        head, *rest = text.split(" ")
        if not unsafe(head):
            got = [self.first(head), *map(self.__getitem__, rest)]
            if self.bad not in got:
                return got
        return [self.first(c) for c in CHUNK.findall(text)]


def unsafe(part: str) -> bool:
    return not part or part.strip() != part


@cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def pieces(part: str, pattern: str) -> list[str] | None:
    """The pattern's matches in a part; None if Unicode versions may differ on its characters."""
    if not part.isascii() and max(map(ord, part)) >= AGREED:
        return None
    return _pattern(pattern).findall(part)
