"""Pages as words with boxes: their text, heights of lines, the boxes of a span, and regions to black out.

A box is [x0, y0, x1, y1]. Text, coverage and heights are expressions; the two steps that follow words along a line, or
merge boxes until none overlap, are Arrow functions over one page's rows. A page's words are bounded by the limits of
admission, so no group grows with the corpus. Null or empty lists give no boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.resolve import entity_number, label_of

PART = ["document_id", "part_seq"]
#: What share of heights makes one line and of areas a twin, the widest gap of words, what counts as nothing.
SAME_LINE, TWIN, WORD_GAP, NOTHING, NEW_LINE, LEAST_VISIBLE = 0.5, 0.5, 1.0, 0.01, 4.0, 8
BOXES = "array<array<double>>"
PLACED = f"struct<boxes:{BOXES},ambiguous:boolean,partial_words:int>"


def page_parts(words: DataFrame) -> DataFrame:
    """Parts with `spans` from words (document_id, page_number, word_seq, word, x0, y0, x1, y1): a word that begins well
    below the last one opens a line, others follow a blank. Words are brought to NFC by what reads the pages."""
    page = Window.partitionBy("document_id", "page_number").orderBy("word_seq")
    gap = F.when(F.lag("y1").over(page).isNull(), "").when(F.col("y0") > F.lag("y1").over(page) + NEW_LINE, "\n").otherwise(" ")
    rows = words.withColumn("__g", gap).withColumn("end", F.sum(F.length("__g") + F.length("word")).over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    one = F.struct("word_seq", F.concat("__g", "word").alias("piece"), F.struct((F.col("end") - F.length("word")).alias("start"), "end", F.array(F.array("x0", "y0", "x1", "y1")).alias("boxes")).alias("span"))
    lists = rows.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(one)).alias("w"))
    return lists.select("document_id", (F.col("page_number") - 1).alias("part_seq"), "page_number", F.lit(None).cast("string").alias("part_name"), F.array_join("w.piece", "").alias("text"), F.col("w.span").alias("spans"))


def unreadable(text: Column) -> Column:
    """True for a page with too few visible characters to be a page of text."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")) < LEAST_VISIBLE


def page_code(text: Column, unmapped_glyphs: Column) -> Column:
    """Why a page's text cannot be trusted, or null: too little of it, with glyphs that map to no character or without."""
    return F.when(unreadable(text), F.when(unmapped_glyphs, "PDF_TEXT_UNRELIABLE").otherwise("PDF_NO_TEXT_LAYER"))


def line_heights(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, part_seq, line_no, height: the tallest box that touches each line (rows of functions.text.lines)."""
    boxes = parts.select(*PART, F.explode("spans").alias("s")).select(*PART, F.col("s.start").alias("__a"), F.col("s.end").alias("__b"), F.array_max(F.transform("s.boxes", lambda b: b[3] - b[1])).alias("h"))
    met = rows.join(boxes, PART).where((F.col("__a") < F.col("end")) & (F.col("__b") > F.col("start")))
    return met.groupBy(*PART, "line_no").agg(F.max("h").alias("height")).where("height > 0")


def _share(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
    """How far boxes a and b (broadcast) overlap along an axis; negative where they are apart."""
    return np.minimum(a[..., axis + 2], b[..., axis + 2]) - np.maximum(a[..., axis], b[..., axis])


def same_line(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _share(a, b, 1) >= SAME_LINE * np.minimum(a[..., 3] - a[..., 1], b[..., 3] - b[..., 1])


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On one line, and beside each other by more than nothing; lines that touch do not count."""
    return same_line(a, b) & (_share(a, b, 0) > NOTHING)


def twins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One drawn over the other."""
    w, h = _share(a, b, 0), _share(a, b, 1)
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return (w > 0) & (h > 0) & (w * h >= TWIN * np.minimum(area(a), area(b)))


def around(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(a[:2], b[:2]), np.maximum(a[2:], b[2:])])


def _distinct(boxes: np.ndarray) -> np.ndarray:
    return np.array(list(dict.fromkeys(map(tuple, boxes))), dtype=float).reshape(-1, 4)


def place(text: str, start: int, end: int, span_ends: np.ndarray, owner: np.ndarray, boxes: np.ndarray) -> dict | None:
    """Boxes over text[start:end]: words joined along their line, with whatever is drawn over them (then ambiguous).

    None where a visible character has no box. span_ends: (start, end) of each word; owner: the word of each box.
    """
    if not 0 <= start < end <= len(text) or not len(boxes):
        return None
    met = (span_ends[:, 0] < end) & (span_ends[:, 1] > start)
    met &= np.isin(np.arange(len(met)), owner)
    bare = np.array([not ch.isspace() for ch in text[start:end]])
    for a, b in span_ends[met]:
        bare[max(a - start, 0) : b - start] = False
    if bare.any() or not met.any():
        return None
    own, other = boxes[met[owner]], boxes[~met[owner]]
    over = twins(own[:, None], other[None]).any(axis=0)
    beside, runs = other[~over], [own[0]]
    for box in own[1:]:
        line = runs[-1]
        wide = around(line, box)
        height = min(line[3] - line[1], box[3] - box[1])
        follows = same_line(line, box) and line[0] - NOTHING <= box[0] <= line[2] + height * WORD_GAP
        if follows and not overlap(wide, beside).any():
            runs[-1] = wide
        else:
            runs.append(box)
    found = _distinct(np.vstack([np.array(runs), other[over]]))
    inside = (found[:, None, :2] >= found[None, :, :2]).all(-1) & (found[:, None, 2:] <= found[None, :, 2:]).all(-1)
    np.fill_diagonal(inside, False)
    partial = int(((span_ends[met][:, 0] < start) | (span_ends[met][:, 1] > end)).sum())
    return {"boxes": found[~inside.any(axis=1)].tolist(), "ambiguous": bool(over.any()), "partial_words": partial}


def _place_page(texts: pd.Series, spans: pd.Series, asked: pd.Series) -> pd.Series:
    out = []
    for text, words, hits in zip(texts, spans, asked, strict=True):
        ends = np.array([(w["start"], w["end"]) for w in words], dtype=int).reshape(-1, 2)
        flat = [(i, list(b)) for i, w in enumerate(words) for b in (w["boxes"] if w["boxes"] is not None else [])]
        owner, boxes = np.array([i for i, _ in flat], dtype=int), np.array([b for _, b in flat], dtype=float).reshape(-1, 4)
        out.append([place(text, h["start"], h["end"], ends, owner, boxes) for h in hits])
    return pd.Series(out)


def placed(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with `boxes`, `ambiguous` and `partial_words`; null boxes where a hit cannot be placed, which fails its
    document. One join by page."""
    columns = [x for x in hits.columns if x not in PART]
    lists = hits.groupBy(*PART).agg(F.collect_list(F.struct(*columns)).alias("__h"))
    run = F.pandas_udf(_place_page, f"array<{PLACED}>")
    rows = parts.join(lists, PART).withColumn("__p", run("text", "spans", "__h"))
    each = rows.select(*PART, "page_number", F.explode(F.arrays_zip("__h", "__p")).alias("x"))
    return each.select(*PART, "page_number", *[F.col(f"x.__h.{k}").alias(k) for k in columns], "x.__p.*")


def unplaceable(found: DataFrame) -> DataFrame:
    """document_id, map_failed, ambiguous: a hit without boxes fails its whole document."""
    return found.groupBy("document_id").agg(F.bool_or(F.col("boxes").isNull()).alias("map_failed"), F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))


def merged(boxes: np.ndarray) -> list[list[float]]:
    """Boxes joined, the first overlapping pair at a time, until none overlap; from the top, then from the left."""
    rest = [np.array(b) for b in _distinct(boxes)]
    while True:
        table = np.array(rest)
        pairs = np.argwhere(np.triu(overlap(table[:, None], table[None]), 1))
        if not len(pairs):
            return sorted(table.tolist(), key=lambda b: (b[1], b[0]))
        i, j = pairs[0]
        rest[i] = around(rest[i], rest.pop(j))


def groups(lists: list[list[list[float]]]) -> np.ndarray:
    """For each finding's boxes the number of the first finding that it reaches by overlaps."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    boxes = np.array([b for x in lists for b in x], dtype=float).reshape(-1, 4)
    near = overlap(boxes[:, None], boxes[None])
    root, before = np.arange(len(lists)), None
    a, b = owner[np.nonzero(near)[0]], owner[np.nonzero(near)[1]]
    while before is None or (before != root).any():
        before = root.copy()
        np.minimum.at(root, a, before[b])
        root = root[root]
    return root


def _region_page(found: pd.Series) -> pd.Series:
    out = []
    for rows in found:
        lists = [[list(b) for b in r["boxes"]] for r in rows]
        root = groups(lists)
        out.append([{"members": np.nonzero(root == g)[0].tolist(), "boxes": merged(np.array([b for i in np.nonzero(root == g)[0] for b in lists[i]]))} for g in dict.fromkeys(root)])
    return pd.Series(out)


def regions(found: DataFrame) -> DataFrame:
    """document_id, page_number, boxes, entity_type, replacement_label, finding_ids: findings whose boxes overlap on a line
    are one region, labelled by the highest priority. found: document_id, page_number, finding_id, entity_type, boxes."""
    one = F.struct("finding_id", "entity_type", "boxes")
    lists = found.where("size(boxes) > 0").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["finding_id"] < b["finding_id"], -1).when(a["finding_id"] > b["finding_id"], 1).otherwise(0)).alias("f"))
    run = F.pandas_udf(_region_page, f"array<struct<members:array<int>,boxes:{BOXES}>>")
    each = lists.withColumn("r", F.explode(run("f"))).withColumn("m", F.transform("r.members", lambda i: F.get("f", i)))
    rank = F.transform("m", lambda x: F.struct(entity_number(x["entity_type"], 1).alias("p"), (-entity_number(x["entity_type"], 0)).alias("o"), x["entity_type"].alias("e")))
    return each.select("document_id", "page_number", F.col("r.boxes").alias("boxes"), F.array_max(rank)["e"].alias("entity_type"), label_of(F.array_max(rank)["e"]).alias("replacement_label"), F.col("m.finding_id").alias("finding_ids"))


def box_residues(redacted: DataFrame, words: DataFrame, labels: list[str]) -> DataFrame:
    """document_id, page_number, finding_id of redacted findings (with boxes) over which the output (words of pages) still
    has a word that is no label: its centre lies in a box. An equi join by page."""
    centre = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    held = words.where(~F.col("word").isin(*labels)).groupBy("document_id", "page_number").agg(F.collect_list(centre).alias("__w"))
    inside = F.exists("boxes", lambda b: F.exists("__w", lambda w: w["x"].between(b[0], b[2]) & w["y"].between(b[1], b[3])))
    return redacted.join(held, ["document_id", "page_number"]).where(inside).select("document_id", "page_number", "finding_id")
