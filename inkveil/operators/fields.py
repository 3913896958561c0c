"""Value shapes and labelled fields of one part of text: what stands anywhere, what a label announces, what follows one.

Rules are rows of tables, each a linear search. What a value's end depends on (line ends, bars, replacement labels, other
labels) is found once for a part and looked up by bisection, so a line that repeats a label a thousand times costs no more
than its hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

from inkveil.functions import catalogue as c
from inkveil.functions.folding import Folded


class Hit(NamedTuple):
    entity: str
    start: int
    end: int
    confidence: float
    detector: str
    signals: tuple[str, ...] = ()


def python_pattern(java: str) -> re.Pattern[str]:
    """A pattern of the catalogue for Python, whose classes are Unicode's from the start."""
    flags = re.match(r"\(\?([Uiu]+)\)", java)
    body = java[flags.end() :] if flags else java
    return re.compile(body, re.IGNORECASE if flags and "i" in flags.group(1) else 0)


_ANYWHERE = tuple((e, python_pattern(p), score) for e, p, score in (("email", c.EMAIL, c.SCORE_HIGH), ("phone", c.PHONE, c.SCORE_HIGH), ("national_id", c.CITIZEN_ID, c.SCORE_VALUE)))
_NUMBERED = (("national_id", python_pattern(c.OLD_ID), c.ID_LABELS), ("passport", python_pattern(c.PASSPORT), c.PASSPORT_LABELS))
_SALARY, _DATE, _AGE, _YEAR = (python_pattern(p) for p in (c.SALARY, c.DATE, c.AGE_IN_VALUE, c.LEADING_YEAR.replace("^", "")))
#: The number of years, possessive where blanks may run long.
_YEARS = (re.compile(r"(?:tu[oôố]i|\bage)\b\s*+(?:[:\-]\s*+)?(\d{1,2})\b", re.I), re.compile(r"(?<!\d)(\d{1,2})\s*+tu[oôố]i\b", re.I))
_KNOWN = re.compile("|".join(re.escape(x) for x in c.REPLACEMENTS))
_SEPARATORS, _VISIBLE = re.compile(r"[ \t:\-]*"), re.compile(r"\S")
_FIELDS = tuple((entity, way, label, re.compile(rf"(?<![\w\[]){re.escape(label)}(?!\w)\s*[:\-]?")) for entity, way, labels in c.FIELD_LABELS if way != "stop" for label in labels)
_STOPS = tuple((label, re.compile(rf"\s{re.escape(label)}(?=(\s*+[:\-]))"), re.compile(rf"{re.escape(label)}\s*+[:\-]")) for label in c.STOP_LABELS)


def _whole_words(labels: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in sorted(labels, key=len, reverse=True))})(?!\w)")


_LABEL_WORDS = {labels: _whole_words(labels) for labels in (c.ID_LABELS, c.PASSPORT_LABELS, c.SALARY_LABELS)}


class Fields:
    """The field rules over one part's text."""

    def __init__(self, view: Folded) -> None:
        self.view, self.text, self.folded = view, view.text, view.folded
        self._seen: dict[tuple[re.Pattern[str], int], tuple[int, list[tuple[int, int]]]] = {}

    @cached_property
    def line_ends(self) -> list[int]:
        return [*(m.start() for m in re.finditer("\n", self.text)), len(self.text)]

    @cached_property
    def bars(self) -> list[int]:
        return [m.start() for m in re.finditer(r"\|", self.text)]

    @cached_property
    def known(self) -> list[tuple[int, int]]:
        """Where replacement labels stand."""
        return [m.span() for m in _KNOWN.finditer(self.text)]

    @cached_property
    def stops(self) -> list[tuple[re.Pattern[str], list[int], list[int]]]:
        """For each label of a field that the text holds: its place after white space, and where its separator ends."""
        out = []
        for label, after_blank, here in _STOPS:
            if label in self.folded:
                found = [(m.start(), m.end(1)) for m in after_blank.finditer(self.folded)]
                out.append((here, [a for a, _ in found], [b for _, b in found]))
        return out

    def announced(self, start: int, labels: tuple[str, ...]) -> bool:
        """A label stands, as a whole word, in the window of folded characters before start; it may cross lines."""
        at = self.view.ahead(start)
        return _LABEL_WORDS[labels].search(self.folded[max(0, at - c.CONTEXT_WINDOW) : at]) is not None

    def held(self, labels: tuple[str, ...]) -> bool:
        return any(x in self.folded for x in labels)

    def value_end(self, start: int) -> int:
        """Where the value that begins at start ends: at its line's end, right behind a replacement label it begins with,
        before a later one, a bar or another field's label; blanks, commas and semicolons at its end do not count."""
        end = self.line_ends[bisect_left(self.line_ends, start)]
        if _VISIBLE.search(self.text, start, end) is None:
            return start
        at = bisect_left(self.known, (start, 0))
        if at < len(self.known) and self.known[at][0] < end:
            if self.known[at][0] == start:
                return self.known[at][1]
            end = self.known[at][0]
        at = bisect_left(self.bars, start)
        if at < len(self.bars):
            end = min(end, self.bars[at])
        first, last = self.view.ahead(start), self.view.ahead(end)
        cut = last
        for here, places, ends in self.stops:
            at = bisect_left(places, first)
            if at < len(places) and first < places[at] < cut and ends[at] <= last and here.match(self.folded, first, last) is None:
                cut = places[at]
        if cut < last:
            end = self.view.back(cut, cut + 1)[0]
        while end > start and self.text[end - 1] in " \t,;":
            end -= 1
        return end

    def _within(self, pattern: re.Pattern[str], first: int, last: int) -> tuple[list[tuple[int, int]], bool]:
        """Matches in folded[first:last], and whether they are news. Values that end alike share them: what a later start
        leaves out does not change the rest, unless it stands inside a match."""
        known = self._seen.get((pattern, last))
        if known is not None and first >= known[0]:
            at = bisect_left(known[1], (first, 0))
            if not at or known[1][at - 1][1] <= first:
                return known[1][at:at + 1], False
        found = [m.span() for m in pattern.finditer(self.folded, first, last)]
        self._seen[pattern, last] = (first, found)
        return found, True

    def birth(self, start: int, end: int) -> Iterator[Hit]:
        """All dates in the value, else all ages, else nothing beside a replacement label, else a leading year, else all of it."""
        first, last = self.view.ahead(start), self.view.ahead(end)
        for pattern in (_DATE, _AGE):
            spans, news = self._within(pattern, first, last)
            if spans:
                if news:
                    yield from (Hit("date_of_birth", *self.view.back(a, b), c.SCORE_VALUE, "date_of_birth") for a, b in spans)
                return
        at = bisect_left(self.known, (start, 0))
        if at < len(self.known) and self.known[at][1] <= end:
            return
        if (year := _YEAR.match(self.folded, first, last)) is not None:
            start, end = self.view.back(year.end() - 4, year.end())
        if _VISIBLE.search(self.text, start, end):
            yield Hit("date_of_birth", start, end, c.SCORE_VALUE, "date_of_birth")

    def labelled(self) -> Iterator[Hit]:
        """Values behind the labels of fields, label by label: some begin others, so one alternation would hide matches."""
        for entity, way, label, pattern in _FIELDS:
            if label not in self.folded:
                continue
            for m in pattern.finditer(self.folded):
                start = _SEPARATORS.match(self.text, self.view.back(m.start(), m.end())[1]).end()
                end = self.value_end(start)
                if end <= start:
                    continue
                if way == "birth":
                    yield from self.birth(start, end)
                elif way == "salary":
                    yield from (Hit("salary", x.start(), x.end(), c.SCORE_VALUE, "salary") for x in _SALARY.finditer(self.text, start, end))
                else:
                    yield Hit(entity, start, end, c.SCORE_HIGH, entity)

    def hits(self) -> Iterator[Hit]:
        """All field hits in the order of the rules, which decides ties."""
        digits = re.search(r"\d", self.text) is not None
        for entity, pattern, score in _ANYWHERE:
            if "@" in self.text if entity == "email" else digits:
                yield from (Hit(entity, m.start(), m.end(), score, entity) for m in pattern.finditer(self.text))
        for entity, pattern, labels in _NUMBERED:
            if digits and self.held(labels):
                yield from (Hit(entity, m.start(), m.end(), c.SCORE_CONTEXT, entity) for m in pattern.finditer(self.text) if self.announced(m.start(), labels))
        yield from self.labelled()
        if digits and ("tu" in self.folded or "age" in self.folded):
            for pattern in _YEARS:
                yield from (Hit("date_of_birth", *m.span(1), c.SCORE_VALUE, "date_of_birth") for m in pattern.finditer(self.text))
        if self.held(c.SALARY_LABELS):
            yield from (Hit("salary", m.start(), m.end(), c.SCORE_VALUE, "salary") for m in _SALARY.finditer(self.text) if self.announced(m.start(), c.SALARY_LABELS))
