"""One document at a time: its parts are searched by all rules, resolved, judged, redacted and verified where its row is.

A rule needs at most its document: names are searched in all parts, everything else stays within one. So a document is
one row with its parts, and all of this is one pass over the rows with no shuffle. Operators.resolve holds the same
resolution for tables of hits. Parts are brought to NFC for the search; places are those of the text as given.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from typing import NamedTuple

from inkveil.functions import catalogue as c
from inkveil.functions.folding import Composed, Folded, fold
from inkveil.operators.fields import Fields, Hit
from inkveil.operators.names import Anchor, Names, best_header, mail_words, repeats
from inkveil.operators.sections import Layout, tagged

_LABELS = re.compile("|".join(re.escape(x) for x in c.REPLACEMENTS))
_KEPT_URL = re.compile(c.KEPT_URL)
_TOKENS = re.compile("[a-z0-9]+")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
PRIORITY = {e: p for e, (_, p) in c.ENTITIES.items()}


class Part(NamedTuple):
    part_seq: int
    page_number: int | None
    part_name: str | None
    text: str
    heights: dict[int, float] | None = None


class Finding(NamedTuple):
    hit: Hit
    action: str


def field_hits(text: str) -> list[Hit]:
    """Hits of value shapes and labelled fields alone, by their places in the text as given."""
    if not text:
        return []
    composed = Composed(text)
    hits = list(Fields(Folded(composed.text)).hits())
    return hits if composed.starts is None else [_given(composed, h) for h in hits]


def _given(composed: Composed, hit: Hit) -> Hit:
    start, end = composed.given(hit.start, hit.end)
    return hit._replace(start=start, end=end)


def document_hits(parts: list[Part]) -> tuple[list[list[Hit]], list[list[tuple[int, int]]]]:
    """For each part the hits of all rules in the order that decides ties, and its reference sections."""
    composed = [Composed(p.text or "") for p in parts]
    views = [Folded(x.text) for x in composed]
    layouts = [Layout(v, p.page_number, p.part_name) for v, p in zip(views, parts, strict=True)]
    named = [Names(x, i, p.heights) for i, (x, p) in enumerate(zip(layouts, parts, strict=True))]
    found: list[list[Hit]] = []
    anchors: list[Anchor] = []
    for view, layout, names in zip(views, layouts, named, strict=True):
        told = list(names.labelled())
        anchors += [x for x in told if isinstance(x, Anchor)]
        found.append([*Fields(view).hits(), *(x for x in told if isinstance(x, Hit)), *names.referees(), *layout.family(), *layout.addresses()])
    if (header := best_header(named, mail_words(v.text for v in views), anchors)) is not None:
        anchors.append(header)
    for a in anchors:
        found[a.part].append(a.hit)
    if anchors:
        for i, view in enumerate(views):
            found[i] += repeats(view, i, anchors)
    for i, x in enumerate(composed):
        if x.starts is not None:
            found[i] = [_given(x, h) for h in found[i]]
            layouts[i].sections = [s._replace(start=x.given(s.start, s.start + 1)[0] if s.start < len(x.text) else len(parts[i].text), end=x.ends[s.end - 1] if s.end else 0) for s in layouts[i].sections]
    return found, [x.ranges("reference") for x in layouts]


def merged(hits: list[Hit]) -> list[tuple[Hit, int]]:
    """Hits of one entity that overlap strictly as one (the union, the best confidence, the first strongest detector, all
    signals in order), each with the number of its entity's first hit."""
    by_entity: dict[str, list[tuple[int, int, int, Hit]]] = {}
    for seq, h in enumerate(hits):
        by_entity.setdefault(h.entity, []).append((h.start, h.end, seq, h))
    out = []
    for rows in by_entity.values():
        first = rows[0][2]
        rows.sort(key=lambda x: x[:3])
        group: list[Hit] = []
        reach = -1
        for start, end, _, h in rows:
            if group and start >= reach:
                out.append((_joined(group, reach), first))
                group = []
            reach = max(reach, end) if group else end
            group.append(h)
        out.append((_joined(group, reach), first))
    return out


def _joined(group: list[Hit], end: int) -> Hit:
    if len(group) == 1:
        return group[0]
    best = max(group, key=lambda h: h.confidence)
    return best._replace(start=group[0].start, end=end, signals=tuple(dict.fromkeys(s for h in group for s in h.signals)))


def uncovered(rows: list[tuple[Hit, int]]) -> list[Hit]:
    """Merged hits, by place, without those that a longer (or equal, but higher or earlier) hit of another entity covers.

    Hits of one entity are disjoint, so only the last that begins no later can cover a span.
    """
    place = lambda x: (x[0].start - x[0].end, -PRIORITY[x[0].entity], x[1])
    lines: dict[str, list[tuple[Hit, int]]] = {}
    for x in sorted(rows, key=lambda x: x[0].start):
        lines.setdefault(x[0].entity, []).append(x)
    starts = {e: [x[0].start for x in line] for e, line in lines.items()}
    kept = []
    for x in rows:
        h = x[0]
        for entity, line in lines.items():
            if entity != h.entity and (at := bisect_right(starts[entity], h.start)):
                other = line[at - 1]
                if h.end <= other[0].end and place(other) < place(x):
                    break
        else:
            kept.append(h)
    return sorted(kept, key=lambda h: (h.start, h.end, h.entity))


def resolved(hits: list[Hit]) -> list[Hit]:
    return uncovered(merged(hits)) if len(hits) > 1 else list(hits)


def action(hit: Hit, mask_salary: bool) -> str:
    if hit.confidence < c.DISCARD_BELOW:
        return "discard"
    if hit.entity in c.UNHANDLED or (hit.entity in c.OPTIONAL and not mask_salary):
        return "detected_not_redacted"
    return "redact" if hit.confidence >= c.REDACT_AT else "redact_and_review"


def ranges(found: Iterable[Hit]) -> list[tuple[int, int, str]]:
    """Spans that overlap strictly, whatever their entity, as one (start, end, label of the highest priority)."""
    out: list[list] = []
    for h in sorted(found, key=lambda h: (h.start, h.end)):
        if out and h.start < out[-1][1]:
            out[-1][1] = max(out[-1][1], h.end)
            out[-1][2].append(h.entity)
        else:
            out.append([h.start, h.end, [h.entity]])
    return [(s, e, c.ENTITIES[max(es, key=lambda x: (PRIORITY[x], -c.ORDINAL[x]))][0]) for s, e, es in out]


def redacted(text: str, cuts: list[tuple[int, int, str]]) -> str:
    pieces, at = [], 0
    for start, end, label in cuts:
        pieces += [text[at:start], label]
        at = end
    return "".join([*pieces, text[at:]])


def value_pattern(entity: str, value: str) -> list[str] | None:
    """The tokens by which folded text is searched for a value, or None where the value is too plain."""
    tokens = _TOKENS.findall(fold(value))
    if sum(map(len, tokens)) < c.MIN_SEARCHED_CHARS:
        return None
    if entity in ("email", "phone", "national_id", "passport"):
        return tokens
    if entity in ("candidate_name", "reference_name"):
        return tokens if len(tokens) > 1 else None
    digit = entity in ("date_of_birth", "postal_address") and any(x.isdigit() for x in value)
    return tokens if digit and (entity == "date_of_birth" or len(tokens) > 2) else None


def holds(plain: str, tokens: list[str]) -> bool:
    """Whether folded text holds the tokens as whole words, with up to three other characters between them. Each document
    has its own values, so none is worth a compiled pattern: what stands between two tokens can be read in one way only."""
    first, rest = tokens[0], tokens[1:]
    at = plain.find(first)
    if at < 0 or not all(x in plain for x in rest):
        return False
    while at >= 0:
        end = at + len(first)
        if not at or plain[at - 1] not in _LETTERS:
            for token in rest:
                gap = end
                while gap < len(plain) and gap <= end + 3 and plain[gap] not in _LETTERS:
                    gap += 1
                if gap > end + 3 or not plain.startswith(token, gap):
                    break
                end = gap + len(token)
            else:
                if end == len(plain) or plain[end] not in _LETTERS:
                    return True
        at = plain.find(first, at + 1)
    return False


def still_held(values: Iterable[tuple[str, str]], outputs: list[str], raw: list[str] = ()) -> list[tuple[str, int | None]]:
    """(entity, number of the output part) of each source value that an output part still holds; (entity, None) of those
    that only raw objects of the file do. Kept profile addresses do not count for names."""
    hay = [(fold(t), None) for t in (*outputs, *raw)]
    found = []
    for entity, value in values:
        tokens = value_pattern(entity, value)
        if tokens is None:
            continue
        met = []
        for i, (plain, bare) in enumerate(hay):
            if entity in ("candidate_name", "reference_name"):
                if bare is None:
                    bare = _KEPT_URL.sub(lambda m: " " * len(m.group()), plain)
                    hay[i] = (plain, bare)
                plain = bare
            if holds(plain, tokens):
                met.append(i)
        inside = [i for i in met if i < len(outputs)]
        found += [(entity, i) for i in inside] if inside else [(entity, None)] if met else []
    return found


def label_only(text: str) -> bool:
    return not any(x.isalnum() for x in _LABELS.sub("", text))


def found_again(text: str, mask_salary: bool = True) -> tuple[int, int]:
    """(certain, uncertain) hits of the field rules in redacted text, of the entities that the policy redacts."""
    live = [h for h in resolved(field_hits(text)) if action(h, mask_salary).startswith("redact") and not label_only(text[h.start : h.end])]
    sure = sum(h.confidence >= c.REDACT_AT for h in live)
    return sure, len(live) - sure


def judged(parts: list[Part], mask_salary: bool = True) -> tuple[list[list[Finding]], int]:
    """For each part its findings with what the policy does, and how many hits are too weak to count."""
    found, references = document_hits(parts)
    out = [[Finding(tagged(h, r), action(h, mask_salary)) for h in resolved(hits)] for hits, r in zip(found, references, strict=True)]
    weak = sum(f.action == "discard" for x in out for f in x)
    return [[f for f in x if f.action != "discard"] for x in out], weak


class Verdict(NamedTuple):
    residual: int
    uncertain: int
    leaks: int
    codes: tuple[str, ...]
    outcome: str


def verdict(parts: list[Part], found: list[list[Finding]], outputs: list[str], mask_salary: bool = True) -> Verdict:
    """What the output alone says: source values and field hits that are left."""
    values = dict.fromkeys((f.hit.entity, p.text[f.hit.start : f.hit.end]) for p, x in zip(parts, found, strict=True) for f in x if f.action.startswith("redact"))
    leaks = len(still_held(values, outputs))
    again = [found_again(t, mask_salary) for t in outputs]
    sure, unsure = sum(a for a, _ in again), sum(b for _, b in again)
    codes = tuple(code for code, n in (("VERIFY_RESIDUAL_FINDING", leaks), ("VERIFY_RESIDUAL_DETECTION", sure)) if n)
    return Verdict(sure, unsure, leaks, codes, "failed" if codes else "review_required" if unsure else "passed")
