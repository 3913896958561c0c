"""Headings, the sections they open, and what whole sections and contact lines reveal, within one part of text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from inkveil.functions import catalogue as c
from inkveil.functions.folding import Folded, fold
from inkveil.functions.text import any_of
from inkveil.operators.fields import Hit

_BULLET = r"[\s\-*•·\d.)]*"
_TAIL = rf"(?:\s*(?:[/|&]|\band\b)\s*(?:{any_of(c.REFERENCE_HEADINGS + c.FAMILY_HEADINGS + c.OTHER_HEADINGS)}))*"
KINDS = (("reference", c.REFERENCE_HEADINGS), ("family", c.FAMILY_HEADINGS), ("other", c.OTHER_HEADINGS))
_WHOLE = tuple((kind, re.compile(rf"^{_BULLET}(?:{any_of(words)}){_TAIL}\s*[:：]?\s*$")) for kind, words in KINDS)
_INLINE = tuple((kind, re.compile(rf"^{_BULLET}(?:{any_of(words)}){_TAIL}\s*[:：]\s*(?=\S)")) for kind, words in KINDS[:2])
_BREAK = re.compile(r"\||•|·|;|\s[-–—]\s|\t")
_PHONE_LIKE, _CUE_WORD = re.compile(r"(?:\d[\s.\-]?){9,}"), re.compile(r"[a-z]+\.?")
_SITE, _YEARS = re.compile(c.NUMBERED_SITE), re.compile(r"\b\d{1,2}\s+years?\b|\b(?:19|20)\d{2}\b", re.I)
_CUES, _SHORT_CUES = frozenset(c.ADDRESS_CUES), frozenset(c.SHORT_ADDRESS_CUES)


class Line(NamedTuple):
    start: int
    end: int
    folded: str
    shift: int


class Section(NamedTuple):
    kind: str
    heading_line: int
    start: int
    end: int


def is_heading(folded: str) -> bool:
    return len(folded) <= c.MAX_HEADING_CHARS and any(p.match(folded) for _, p in _WHOLE)


class Layout:
    """A part's lines, headings and sections: a heading opens a section, the next one closes it.

    The heading patterns backtrack on long runs of blanks, so they meet lines of bounded length only.
    """

    def __init__(self, view: Folded, page_number: int | None = None, part_name: str | None = None) -> None:
        self.view, self.text, self.lines = view, view.text, []
        self.contact = page_number == 1 or part_name == "word/document.xml" or (part_name or "").startswith("word/header")
        at = 0
        for raw in view.text.split("\n"):
            end = at + len(raw)
            shift = view.ahead(at)
            self.lines.append(Line(at, end, view.folded[shift : view.ahead(end)], shift))
            at = end + 1
        opened = []
        for i, line in enumerate(self.lines):
            if line.folded and len(line.folded) <= c.MAX_HEADING_CHARS and (found := self._opens(line)) is not None:
                opened.append((i, *found))
        closes = [*(self.lines[i].start for i, _, _ in opened[1:]), len(view.text)][: len(opened)]
        self.sections = [Section(kind, i, start, end) for (i, kind, start), end in zip(opened, closes, strict=True)]
        self.first_heading = opened[0][0] if opened else len(self.lines)

    def _opens(self, line: Line) -> tuple[str, int] | None:
        """(kind, where its section begins) of a heading: on the next line, or behind the colon of an inline one."""
        for kind, pattern in _WHOLE:
            if pattern.match(line.folded):
                return kind, min(line.end + 1, len(self.text))
        for kind, pattern in _INLINE:
            if (m := pattern.match(line.folded)) is not None:
                return kind, self.place(line, m.end())
        return None

    def place(self, line: Line, folded_at: int) -> int:
        """The place in the text of a character of the folded line."""
        return self.view.back(line.shift + folded_at, line.shift + folded_at + 1)[0]

    def ranges(self, kind: str) -> list[tuple[int, int]]:
        return [(s.start, s.end) for s in self.sections if s.kind == kind]

    def family(self) -> Iterator[Hit]:
        """One hit for each family section: all of it but the white space around."""
        for start, end in self.ranges("family"):
            body = self.text[start:end]
            lead = len(body) - len(body.lstrip())
            if lead < len(body):
                yield Hit("family_details", start + lead, start + len(body.rstrip()), 0.90, "family.section", ("section_heading",))

    def addresses(self) -> Iterator[Hit]:
        """Address-like segments of a contact part's first lines, before any heading, by cues and house numbers."""
        if not self.contact:
            return
        for line in self.lines[: min(self.first_heading, c.CONTACT_LINES)]:
            at = line.start
            for m in [*_BREAK.finditer(self.text, line.start, line.end), None]:
                stop = m.start() if m else line.end
                found = _address(self.text[at:stop])
                if found is not None:
                    lead, size, score, signals = found
                    yield Hit("postal_address", at + lead, at + lead + size, score, "address.contact_block", signals)
                at = m.end() if m else stop


def _address(segment: str) -> tuple[int, int, float, tuple[str, ...]] | None:
    """(lead, size, score, signals) of a segment that names a place."""
    bare = segment.strip()
    if not bare or ":" in bare or "@" in bare or _PHONE_LIKE.search(bare):
        return None
    words = set(_CUE_WORD.findall(fold(bare)))
    cues = len({w.rstrip(".") for w in words} & _CUES) + len(words & _SHORT_CUES) + (_SITE.search(bare) is not None)
    if not cues:
        return None
    number = any(x.isdigit() for x in _YEARS.sub(" ", bare))
    score = (0.88 if number else 0.75) if cues > 1 else 0.70 if number else None
    signals = ("contact_block", "address_cues", "house_number") if number else ("contact_block", "address_cues")
    return None if score is None else (len(segment) - len(segment.lstrip()), len(bare), score, signals)


def tagged(hit: Hit, references: list[tuple[int, int]]) -> Hit:
    """An e-mail or telephone hit inside a reference section gets that as part of its detector and signals."""
    if hit.entity in ("email", "phone") and any(a <= hit.start < b for a, b in references):
        return hit._replace(detector=f"{hit.entity}.reference", signals=(*hit.signals, "reference_section"))
    return hit
