"""What a PDF's reading and writing decide apart from the file's bytes: what is seen, which layers show, what a stream paints.

No library reads the files here, so sources of this module are tables that a reader gives: one row for each file, glyph run,
object or word. Rules over them are expressions; a content stream and a dictionary need a scan of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c

#: Limits, the least size and the whiteness of text that is seen, and how a label is set.
MAX_XREFS, MAX_PAGES, LEAST_POINTS, WHITE = 50_000, 30, 2.0, 0.98
LABEL_MOST, LABEL_LEAST, LABEL_PADDING, LABEL_LINE, TRIM_GAP, SAME_LINE = 10.0, 6.0, 1.0, 1.25, 0.25, 0.5
MAX_NESTING, MAX_STRING_NESTING = 8, 64
#: Widths of the labels' letters in thousandths of the font's size (the standard sans serif font's metrics).
WIDTHS = {"[": 278, "]": 278, "A": 667, "B": 667, "C": 722, "D": 722, "E": 667, "H": 722, "I": 278, "L": 556, "M": 833, "N": 722, "O": 778, "P": 667, "R": 722, "S": 667, "T": 611, "U": 722, "Y": 667}
#: Kinds of objects that hide content, and what each counts as.
HIDING = {"EmbeddedFile": "embedded_files", "FileAttachment": "embedded_files", "Widget": "forms", "XFA": "forms", "JavaScript": "javascript", "JS": "javascript", "Annotation": "annotations", "OCG": "optional_content"}


def classified(files: DataFrame) -> DataFrame:
    """files (document_id, encrypted, xrefs, pages, blocking array of page codes) with outcome and codes: encrypted, too long
    and unreadable ones wait for a person; too many objects and none at all fail."""
    blocked = F.array_sort(F.array_distinct("blocking"))
    one = lambda x: F.array(F.lit(x))
    code = F.when(F.col("encrypted"), one("PDF_ENCRYPTED")).when(F.col("xrefs") > MAX_XREFS, one("PDF_RESOURCE_LIMIT")).when(F.col("pages") == 0, one("PDF_NO_PAGES")).when(F.col("pages") > MAX_PAGES, one("PDF_TOO_MANY_PAGES")).otherwise(blocked)
    failed = F.arrays_overlap("codes", F.array(F.lit("PDF_RESOURCE_LIMIT"), F.lit("PDF_NO_PAGES")))
    return files.withColumn("codes", code).withColumn("outcome", F.when(failed, "failed").when(F.size("codes") > 0, "review_required").otherwise("text"))


def invisible(run: Column, crop: Column) -> Column:
    """True for a run of glyphs (render_mode, opacity, size, color array of shares, box) that nobody sees on a page: set
    without paint, transparent, tiny, white, or outside the page's crop box."""
    b = run["box"]
    white = (F.size(run["color"]) > 0) & F.forall(run["color"], lambda x: F.coalesce(x >= WHITE, F.lit(False)))
    outside = (b[2] < crop[0]) | (b[0] > crop[2]) | (b[3] < crop[1]) | (b[1] > crop[3])
    tests = (run["render_mode"] == 3, run["opacity"] <= 0, F.coalesce(run["size"], F.lit(0.0)) < LEAST_POINTS, white, outside)
    return F.reduce(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False), lambda a, x: a | x)


def visible_words(words: DataFrame, hidden: DataFrame) -> DataFrame:
    """words (document_id, page_number, word_seq, word, x0, y0, x1, y1) but those that overlap a box of `hidden`
    (document_id, page_number, box). One join by page."""
    boxes = hidden.groupBy("document_id", "page_number").agg(F.collect_list("box").alias("__b"))
    met = F.exists("__b", lambda b: (F.col("x0") < b[2]) & (b[0] < F.col("x1")) & (F.col("y0") < b[3]) & (b[1] < F.col("y1")))
    return words.join(boxes, ["document_id", "page_number"], "left").where(~F.coalesce(met, F.lit(False))).drop("__b")


def rounded(box: Column) -> Column:
    """A box to three places, or null where nothing is left of it."""
    r = F.transform(box, lambda x: F.round(x, 3))
    return F.when((r[2] > r[0]) & (r[3] > r[1]), r)


def hidden_counts(objects: DataFrame) -> DataFrame:
    """document_id, category, n, pages of objects (document_id, kind, page_number) that hold hidden content."""
    names = F.create_map(*[F.lit(x) for kv in HIDING.items() for x in kv])
    found = objects.withColumn("category", F.try_element_at(names, F.col("kind"))).where("category is not null")
    return found.groupBy("document_id", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page_number")).alias("pages"))


def trimmed(box: Column, words: Column) -> Column:
    """A box cut above and below so that it no longer touches words of neighbouring lines (arrays of boxes); whole where
    nothing would be left."""
    def near(w: Column) -> Column:
        share = F.least(w[3], box[3]) - F.greatest(w[1], box[1])
        return (w[2] > box[0]) & (w[0] < box[2]) & (w[3] > box[1]) & (w[1] < box[3]) & (share < SAME_LINE * F.least(w[3] - w[1], box[3] - box[1]))

    others = F.filter(words, near)
    above = lambda w: w[1] + w[3] < box[1] + box[3]
    top = F.greatest(box[1], F.array_max(F.transform(F.filter(others, above), lambda w: w[3] + TRIM_GAP)))
    bottom = F.least(box[3], F.array_min(F.transform(F.filter(others, lambda w: ~above(w)), lambda w: w[1] - TRIM_GAP)))
    return F.when(bottom <= top, box).otherwise(F.array(box[0], top, box[2], bottom))


def label_size(label: Column, box: Column) -> Column:
    """The size in half points that a label fits a box at, or null where it would be too small to read."""
    unit = F.create_map(*[F.lit(x) for name, _ in {v[0]: 0 for v in c.ENTITIES.values()}.items() for x in (name, sum(WIDTHS[ch] for ch in name) / 1000)])[label]
    width = box[2] - box[0] - 2 * LABEL_PADDING
    size = F.floor(F.least(F.lit(LABEL_MOST), width / unit, (box[3] - box[1]) / LABEL_LINE) * 2) / 2
    return F.when((width > 0) & (size >= LABEL_LEAST), size)


def strayed(changes: DataFrame, vanished: DataFrame, margin: float = 3.0) -> DataFrame:
    """changes (document_id, page_number, box) of a rendered page that lie beyond every box that was meant to vanish
    (document_id, page_number, box), the margin around each counted in."""
    meant = vanished.groupBy("document_id", "page_number").agg(F.collect_list("box").alias("__b"))
    inside = F.exists("__b", lambda b: (F.col("box")[0] >= b[0] - margin) & (F.col("box")[1] >= b[1] - margin) & (F.col("box")[2] <= b[2] + margin) & (F.col("box")[3] <= b[3] + margin))
    return changes.join(meant, ["document_id", "page_number"], "left").where(~F.coalesce(inside, F.lit(False))).drop("__b")


class Unsafe(Exception):
    """Syntax that cannot be read for certain; whatever it governs counts as hidden, and a stream with it is refused."""


_SPACE = rb"\x00\t\n\x0c\r "
_PLAIN = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
_LEXER = re.compile(rb"(?P<skip>[" + _SPACE + rb"]+|%[^\r\n]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[^<>]*>)|(?P<name>/" + _PLAIN + rb"*)|(?P<string>\()|(?P<word>" + _PLAIN + rb"+)")
_IN_STRING = re.compile(rb"\\.|[()]", re.S)
_IMAGE = re.compile(rb"(?<=[" + _SPACE + rb"])ID[" + _SPACE + rb"].*?[" + _SPACE + rb"]EI(?=[" + _SPACE + rb"]|$)", re.S)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")


def tokens(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): open, close, hex, name, string, number, or word."""
    at = 0
    while at < len(data):
        m = _LEXER.match(data, at)
        if m is None:
            raise Unsafe("delimiter")
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "string":
            depth = 1
            for x in _IN_STRING.finditer(data, at):
                depth += {b"(": 1, b")": -1}.get(x.group(), 0)
                if depth > MAX_STRING_NESTING:
                    raise Unsafe("strings within strings")
                if not depth:
                    at = x.end()
                    break
            else:
                raise Unsafe("open string")
        elif kind == "word":
            if m.group() == b"BI":
                image = _IMAGE.search(data, at)
                if image is None:
                    raise Unsafe("inline image")
                at = image.end()
            elif _NUMBER.match(m.group()):
                kind = "number"
        if kind != "skip":
            yield kind, start, at


def name_of(raw: bytes) -> bytes:
    """A name without its slash, escapes resolved."""
    return _ESCAPED.sub(lambda m: bytes([int(m.group(1), 16)]), raw[1:])


def parsed(data: bytes) -> object:
    """One object: dict (by name), list, bytes of a string, a name as str with its slash, a number, or ("R", n) for a reference."""
    stack: list[list] = [[]]
    kinds = [b""]
    for kind, start, end in tokens(data):
        raw = data[start:end]
        if kind == "open":
            stack.append([])
            kinds.append(raw)
        elif kind == "close":
            items, opened = stack.pop(), kinds.pop()
            if not stack or {b"<<": b">>", b"[": b"]"}.get(opened) != raw:
                raise Unsafe("unbalanced")
            if raw == b">>":
                if len(items) % 2 or not all(isinstance(k, str) for k in items[::2]):
                    raise Unsafe("dictionary")
                items = dict(zip((k[1:] for k in items[::2]), items[1::2], strict=True))
            stack[-1].append(items)
        elif raw == b"R":
            if len(stack[-1]) < 2:
                raise Unsafe("reference")
            stack[-1][-2:] = [("R", int(stack[-1][-2]))]
        elif kind == "number":
            stack[-1].append(float(raw))
        elif kind == "name":
            stack[-1].append("/" + name_of(raw).decode("latin-1"))
        else:
            stack[-1].append({b"true": True, b"false": False, b"null": None}.get(raw, raw[1:-1] if kind in ("string", "hex") else raw))
    if len(stack) != 1 or len(stack[0]) != 1:
        raise Unsafe("not one object")
    return stack[0][0]


class Layers:
    """Which content the file's layers hide. objects: raw dictionaries by number; off: numbers of the groups not shown."""

    def __init__(self, objects: dict[int, bytes], off: set[int]) -> None:
        self.objects, self.off = objects, off

    def hides(self, membership: object, walked: frozenset[int] = frozenset()) -> bool:
        """Whether a membership (a reference, a dictionary, or raw bytes of one) hides its content; so does one that
        cannot be decided: unknown, in a circle, or nested too deep."""
        try:
            return self._hidden(parsed(membership) if isinstance(membership, bytes) else membership, walked)
        except (Unsafe, ValueError):
            return True

    def _object(self, number: int) -> dict:
        found = parsed(self.objects[number]) if number in self.objects else {}
        return found if isinstance(found, dict) else {}

    def _hidden(self, it: object, walked: frozenset[int]) -> bool:
        number = it[1] if isinstance(it, tuple) else None
        if number is not None:
            if number in walked:
                raise Unsafe("circle")
            walked, it = walked | {number}, self._object(number)
        if not isinstance(it, dict):
            raise Unsafe("membership")
        kind = it.get("Type")
        if kind == "/OCMD" or it.get("VE") is not None:
            return not self._member(it, walked)
        if kind not in (None, "/OCG"):
            raise Unsafe("type")
        if number is not None:
            return number in self.off
        same = [n for n in self.objects if self._object(n).get("Type") == "/OCG" and self._object(n).get("Name") == it.get("Name")]
        if it.get("Name") is None or len(same) != 1:
            raise Unsafe("name")
        return same[0] in self.off

    def _member(self, it: dict, walked: frozenset[int]) -> bool:
        rule = it.get("VE")
        if isinstance(rule, tuple):
            rule = parsed(self.objects.get(rule[1], b""))
        if rule is not None:
            return self._shown(rule, walked, 0)
        groups = it.get("OCGs")
        if isinstance(groups, tuple) and b"[" == self.objects.get(groups[1], b"").lstrip()[:1]:
            groups = parsed(self.objects[groups[1]])
        groups = [g for g in (groups if isinstance(groups, list) else [groups]) if isinstance(g, tuple)]
        if not groups:
            return True
        on = [not self.hides(g, walked) for g in groups]
        return {"/AllOn": all(on), "/AnyOff": not all(on), "/AllOff": not any(on)}.get(it.get("P"), any(on))

    def _shown(self, rule: object, walked: frozenset[int], depth: int) -> bool:
        if depth > MAX_NESTING:
            raise Unsafe("depth")
        if isinstance(rule, tuple):
            return not self._hidden(rule, walked)
        if not isinstance(rule, list) or len(rule) < 2 or rule[0] not in ("/And", "/Or", "/Not") or (rule[0] == "/Not" and len(rule) != 2):
            raise Unsafe("expression")
        parts = [self._shown(x, walked, depth + 1) for x in rule[1:]]
        return not parts[0] if rule[0] == "/Not" else all(parts) if rule[0] == "/And" else any(parts)


def without_hidden(stream: bytes, hides_property: Callable[[bytes], bool], hides_object: Callable[[bytes], bool], hides_inline: Callable[[bytes], bool] = lambda raw: True) -> tuple[bytes, int]:
    """(stream, cuts) without what hidden marked content paints: text, shadings, inline images and objects go, paths end
    unpainted, and what moves the text position still does. Optional-content marks themselves go everywhere."""
    cuts: list[tuple[int, int, bytes]] = []
    marks: list[tuple[bool, bool]] = []
    operands: list[tuple[str, int, int]] = []
    nested: list[int] = []
    for kind, start, end in tokens(stream):
        raw = stream[start:end]
        if kind == "open":
            nested.append(start)
        elif kind == "close":
            if not nested:
                raise Unsafe("unbalanced")
            begin = nested.pop()
            if not nested:
                operands.append(("group", begin, end))
        elif nested:
            if kind == "word" and raw not in (b"R", b"true", b"false", b"null"):
                raise Unsafe("operator in a group")
        elif kind != "word" or raw in (b"R", b"true", b"false", b"null"):
            operands.append((kind, start, end))
        else:
            given = [stream[a:b] for _, a, b in operands]
            begin, dark = operands[0][1] if operands else start, bool(marks) and marks[-1][0]
            operands, new = [], None
            if raw == b"BDC":
                if len(given) != 2 or given[0][:1] != b"/":
                    raise Unsafe("marked content")
                layer = given[0] == b"/OC"
                marks.append((dark or (layer and (hides_inline(given[1]) if given[1][:2] == b"<<" else hides_property(name_of(given[1])))), layer))
                new = b" " if layer else None
            elif raw == b"BMC":
                marks.append((dark, False))
            elif raw == b"EMC":
                if not marks:
                    raise Unsafe("unbalanced marks")
                new = b" " if marks.pop()[1] else None
            elif raw == b"Do":
                if len(given) != 1 or given[0][:1] != b"/":
                    raise Unsafe("object without a name")
                new = b" " if dark or hides_object(name_of(given[0])) else None
            elif dark:
                if raw in (b"Tj", b"TJ", b"sh") or raw[:2] == b"BI":
                    new = b" "
                elif raw == b"'":
                    new = b" T* "
                elif raw == b'"':
                    if len(given) != 3:
                        raise Unsafe("operands")
                    new = b" " + given[0] + b" Tw " + given[1] + b" Tc T* "
                elif raw in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                    new = b" n "
            if new is not None:
                cuts.append((begin, end, new))
    if marks or nested or operands:
        raise Unsafe("unfinished")
    pieces, at = [], 0
    for start, end, new in cuts:
        pieces += [stream[at:start], new]
        at = end
    return b"".join([*pieces, stream[at:]]), len(cuts)


def filtered(streams: DataFrame) -> DataFrame:
    """streams (stream, objects map of number to raw dictionary, off array, properties map of name to number, forms map of
    name to number) with `filtered`: code, content, cuts. A stream that cannot be read for certain is refused."""

    def one(stream: bytes, objects: dict, off: list, properties: dict, forms: dict) -> tuple:
        layers = Layers({int(k): bytes(v) for k, v in objects.items()}, set(off))
        shown = lambda name: name in properties and not layers.hides(("R", properties[name]))
        gate = lambda name: name in forms and (of := layers._object(forms[name]).get("OC")) is not None and layers.hides(of)
        try:
            done, cuts = without_hidden(bytes(stream), lambda n: not shown(n.decode("latin-1")), lambda n: gate(n.decode("latin-1")), layers.hides)
        except Unsafe:
            return "REDACT_SANITIZE_FAILED", None, 0
        return None, done, cuts

    def run(stream: pd.Series, objects: pd.Series, off: pd.Series, properties: pd.Series, forms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(stream, objects, off, properties, forms, strict=True)], columns=["code", "content", "cuts"])

    run.__annotations__ = dict.fromkeys(("stream", "objects", "off", "properties", "forms"), pd.Series) | {"return": pd.DataFrame}
    return streams.withColumn("filtered", F.pandas_udf(run, "struct<code:string,content:binary,cuts:int>")("stream", "objects", "off", "properties", "forms"))


#: Answers that a worker keeps; a file's memberships ask the same of the same objects over and over.
KEPT_ANSWERS = 4096


def layer_hidden(rows: DataFrame) -> DataFrame:
    """rows (membership binary, objects map of number to raw dictionary, off array) with `hidden`."""

    def run(membership: pd.Series, objects: pd.Series, off: pd.Series) -> pd.Series:
        known: dict[tuple, bool] = {}
        out = []
        for m, o, x in zip(membership, objects, off, strict=True):
            asked = (bytes(m), tuple((int(k), bytes(v)) for k, v in o.items()), frozenset(x))
            found = known.get(asked)
            if found is None:
                if len(known) >= KEPT_ANSWERS:
                    known.clear()
                known[asked] = found = Layers(dict(asked[1]), set(asked[2])).hides(asked[0])
            out.append(found)
        return pd.Series(out)

    run.__annotations__ = dict.fromkeys(("membership", "objects", "off"), pd.Series) | {"return": pd.Series}
    return rows.withColumn("hidden", F.pandas_udf(run, "boolean")("membership", "objects", "off"))
