"""Exact folding of one text with the way back: which character of the text each folded one comes from.

Folding takes diacritics and case away character by character, so a sharp s becomes two characters and a bare combining
mark none. Most texts fold one to one; then no table of places is kept.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from itertools import chain, repeat


class _Plain(dict):
    """Each character's folded form, found when first asked for."""

    def __missing__(self, ch: str) -> str:
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        self[ch] = out = bare.casefold().replace("đ", "d")
        return out


_PLAIN = _Plain()
#: A character and the marks or vowels that normalisation may join to it.
_CLUSTER = re.compile("[^\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u1160-\u11ff]?[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u1160-\u11ff]*", re.S)


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_PLAIN.__getitem__, text))


class Folded:
    """text, its folded form, and the places of each in the other."""

    __slots__ = ("text", "folded", "origin")

    def __init__(self, text: str) -> None:
        self.text, self.origin = text, None
        if text.isascii():
            self.folded = text.lower()
            return
        pieces = list(map(_PLAIN.__getitem__, text))
        self.folded = "".join(pieces)
        if len(self.folded) != len(text) or "" in pieces:
            self.origin = list(chain.from_iterable(repeat(i, len(x)) for i, x in enumerate(pieces)))

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text that folded[start:end] comes from; (0, 0) for an empty one."""
        if end <= start:
            return 0, 0
        return (start, end) if self.origin is None else (self.origin[start], self.origin[end - 1] + 1)

    def ahead(self, place: int) -> int:
        """The first folded character that comes from `place` in the text or behind it."""
        return place if self.origin is None else bisect_left(self.origin, place)


class Composed:
    """A text in NFC, and spans of it as spans of the text that was given."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, given: str) -> None:
        self.starts = self.ends = None
        self.text = given
        if unicodedata.is_normalized("NFC", given):
            return
        pieces, self.starts, self.ends = [], [], []
        for m in _CLUSTER.finditer(given):
            if m.end() > m.start():
                piece = unicodedata.normalize("NFC", m.group())
                pieces.append(piece)
                self.starts += [m.start()] * len(piece)
                self.ends += [m.end()] * len(piece)
        self.text = "".join(pieces)

    def given(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None or end <= start else (self.starts[start], self.ends[end - 1])
