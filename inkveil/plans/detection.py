"""Documents to findings, redacted text and verdicts: one pass over rows that each hold a document with its parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import resolve, scan
from inkveil.functions.folding import Composed, Folded
from inkveil.operators.sections import Layout
from inkveil.plans.storage import in_slices, spread_out

MAIN_PART = "word/document.xml"
PARTS = "array<struct<part_seq:int,page_number:int,part_name:string,text:string,heights:array<struct<line_no:int,height:double>>>>"
HIT = "part_seq int, seq int, entity_type string, start int, end int, confidence double, detector_id string, signals array<string>"
_HIT = pa.struct([("part_seq", pa.int32()), ("seq", pa.int32()), ("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("detector_id", pa.string()), ("signals", pa.list_(pa.string()))])
_FOUND = pa.struct([*_HIT, ("action", pa.string())])
_OUT = pa.struct([("part_seq", pa.int32()), ("page_number", pa.int32()), ("part_name", pa.string()), ("redacted", pa.string())])
_VERDICT = pa.struct([("residual", pa.int64()), ("uncertain", pa.int64()), ("leaks", pa.int64()), ("codes", pa.list_(pa.string())), ("outcome", pa.string())])
FOUND = "array<struct<" + HIT.replace(" ", ":").replace(",:", ",") + ",action:string>>"
JUDGED = f"findings {FOUND}, suppressed int, outputs array<struct<part_seq:int,page_number:int,part_name:string,redacted:string>>, verdict struct<residual:bigint,uncertain:bigint,leaks:bigint,codes:array<string>,outcome:string>"


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One part for each document of a text table."""
    return docs.select(F.col(id_col).alias("document_id"), F.lit(0).alias("part_seq"), F.lit(None).cast("int").alias("page_number"), F.lit(MAIN_PART).alias("part_name"), F.col(text_col).alias("text"))


def one_part(text: Column, part_name: str = MAIN_PART) -> Column:
    """A document's parts where its text is one part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit(0).alias("part_seq"), none.cast("int").alias("page_number"), F.lit(part_name).alias("part_name"), text.alias("text"), none.cast("array<struct<line_no:int,height:double>>").alias("heights"))).cast(PARTS)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_id, parts of a text table: no shuffle."""
    return docs.select(F.col(id_col).alias("document_id"), one_part(F.col(text_col)).alias("parts"))


def gathered(parts: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """document_id, parts of a table of parts: one shuffle by document. heights: document_id, part_seq, line_no, height."""
    rows = parts
    if heights is not None:
        tall = heights.groupBy("document_id", "part_seq").agg(F.collect_list(F.struct("line_no", "height")).alias("heights"))
        rows = parts.drop("heights").join(tall, ["document_id", "part_seq"], "left")
    elif "heights" not in parts.columns:
        rows = parts.withColumn("heights", F.lit(None).cast("array<struct<line_no:int,height:double>>"))
    one = F.struct("part_seq", "page_number", "part_name", "text", "heights")
    lists = rows.groupBy("document_id").agg(F.collect_list(one).alias("parts"))
    ordered = F.array_sort("parts", lambda a, b: a["part_seq"] - b["part_seq"])
    return lists.select("document_id", ordered.cast(PARTS).alias("parts"))


def _parts(column: pa.ListArray) -> Iterator[list[scan.Part]]:
    """The parts of each row, read column by column."""
    flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_pylist()
    seq, page = flat.field("part_seq").to_pylist(), flat.field("page_number").to_pylist()
    name, text = (flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("part_name", "text"))
    heights = flat.field("heights")
    heights = [None] * len(flat) if heights.null_count == len(flat) else [x and {r["line_no"]: r["height"] for r in x if r["height"] > 0} for x in heights.to_pylist()]
    rows = iter(zip(seq, page, name, text, heights, strict=True))
    for n in sizes:
        yield [scan.Part(s, p, k, t or "", h) for s, p, k, t, h in (next(rows) for _ in range(n))]


def _row(part: scan.Part, seq: int, h: scan.Hit, *more: str) -> tuple:
    """A hit's fields in the order of _HIT, or of _FOUND with its action."""
    return (part.part_seq, seq, h.entity, h.start, h.end, h.confidence, h.detector, h.signals, *more)


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Each row's tuples as structs, made column by column: far faster than from dictionaries."""
    flat = [x for row in rows for x in row]
    columns = zip(*flat, strict=True) if flat else [()] * kind.num_fields
    made = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), made)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return _lists(values, kind.value_type) if pa.types.is_list(kind) else pa.array(values, kind)


def _mapped(documents: DataFrame, each: Callable[[list[scan.Part]], tuple], columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """documents (document_id, parts) with what `each` makes of a document's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            made = [each(x) for x in _parts(b.column("parts"))]
            arrays = [_column([m[i] for m in made], kind) for i, (_, kind) in enumerate(columns)]
            yield pa.record_batch([b.column("document_id"), *arrays], ["document_id", *[k for k, _ in columns]])

    rows = spread_out(documents.select("document_id", "parts"))
    return rows.mapInArrow(run, f"document_id {dict(documents.dtypes)['document_id']}, {schema}")


def document_hits(documents: DataFrame) -> DataFrame:
    """document_id and the columns of hits of all rules, unresolved; seq in the order of the rules. No hit carries text."""

    def each(parts: list[scan.Part]) -> tuple:
        return ([_row(p, i, h) for p, hits in zip(parts, scan.document_hits(parts)[0], strict=True) for i, h in enumerate(hits)],)

    found = _mapped(documents, each, [("hits", pa.list_(_HIT))], f"hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    return found.select("document_id", F.explode("hits").alias("h")).select("document_id", "h.*")


def all_hits(parts: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """As document_hits(), from a table of parts."""
    return document_hits(gathered(parts, heights))


def field_hits(parts: DataFrame) -> DataFrame:
    """Hits of value shapes and labelled fields alone, from a table of parts (document_id, part_seq, text), within its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column("text").to_numpy(zero_copy_only=False).tolist()
            seqs = b.column("part_seq").to_pylist()
            made = [[_row(scan.Part(s, None, None, t), i, h) for i, h in enumerate(scan.field_hits(t or ""))] for s, t in zip(seqs, texts, strict=True)]
            yield pa.record_batch([b.column("document_id"), _lists(made, _HIT)], ["document_id", "hits"])

    kind = dict(parts.dtypes)["document_id"]
    found = spread_out(parts.select("document_id", "part_seq", "text")).mapInArrow(run, f"document_id {kind}, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    return found.select("document_id", F.explode("hits").alias("h")).select("document_id", "h.*")


def sections(parts: DataFrame) -> DataFrame:
    """document_id, part_seq, kind, heading_line, start, end of the sections of a table of parts, within its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("heading_line", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in in_slices(batches):
            made = []
            for given in b.column("text").to_numpy(zero_copy_only=False).tolist():
                x = Composed(given or "")
                made.append([{"kind": s.kind, "heading_line": s.heading_line, "start": x.given(s.start, s.start + 1)[0] if s.start < len(x.text) else len(given), "end": s.end if x.ends is None else x.ends[s.end - 1]} for s in Layout(Folded(x.text)).sections])
            yield pa.record_batch([b.column("document_id"), b.column("part_seq"), pa.array(made, kind)], ["document_id", "part_seq", "s"])

    kind = dict(parts.dtypes)["document_id"]
    found = spread_out(parts.select("document_id", "part_seq", "text")).mapInArrow(run, f"document_id {kind}, part_seq int, s array<struct<kind:string,heading_line:int,start:int,end:int>>")
    return found.select("document_id", "part_seq", F.explode("s").alias("s")).select("document_id", "part_seq", "s.*")


def judged(documents: DataFrame, mask_salary: bool = True) -> DataFrame:
    """document_id, findings, suppressed (hits too weak to count), outputs (the parts redacted), verdict of each document."""

    def each(parts: list[scan.Part]) -> tuple:
        found, weak = scan.judged(parts, mask_salary)
        texts = [scan.redacted(p.text, scan.ranges(f.hit for f in x if f.action.startswith("redact"))) for p, x in zip(parts, found, strict=True)]
        rows = [_row(p, i, f.hit, f.action) for p, x in zip(parts, found, strict=True) for i, f in enumerate(x)]
        outputs = [(p.part_seq, p.page_number, p.part_name, t) for p, t in zip(parts, texts, strict=True)]
        v = scan.verdict(parts, found, texts, mask_salary)
        return rows, weak, outputs, v._asdict() | {"codes": list(v.codes)}

    return _mapped(documents, each, [("findings", pa.list_(_FOUND)), ("suppressed", pa.int32()), ("outputs", pa.list_(_OUT)), ("verdict", _VERDICT)], JUDGED)


def findings(documents: DataFrame, mask_salary: bool = True) -> DataFrame:
    """The findings of all documents as rows: places, action, label, id; nothing of the text."""

    def each(parts: list[scan.Part]) -> tuple:
        found, _ = scan.judged(parts, mask_salary)
        return ([_row(p, i, f.hit, f.action) for p, x in zip(parts, found, strict=True) for i, f in enumerate(x)],)

    rows = _mapped(documents, each, [("findings", pa.list_(_FOUND))], f"findings {FOUND}")
    return resolve.described(rows.select("document_id", F.explode("findings").alias("f")).select("document_id", "f.*"))


def redacted(parts: DataFrame, mask_salary: bool = True) -> DataFrame:
    """document_id, part_seq, page_number, part_name, redacted of a table of parts."""
    return judged(gathered(parts), mask_salary).select("document_id", F.explode("outputs").alias("o")).select("document_id", "o.*")


def verdicts(documents: DataFrame, mask_salary: bool = True) -> DataFrame:
    """document_id, residual, uncertain, leaks, codes, outcome: redacted text searched again for fields and for its values."""
    return judged(documents, mask_salary).select("document_id", "verdict.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
