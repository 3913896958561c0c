"""Queries over documents made of the customers' numbers, where every span is known, and over single rules; and their SQL."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.functions.text import exactly_folded
from inkveil.operators import geometry, jobs, reports, resolve, verify
from inkveil.plans import detection
from inkveil.plans.job_queries import one_of, sql_of, table
from inkveil.sources import admission, docx, export


class Piece(NamedTuple):
    """A piece of a document: SQL for its text, and if it is to be found, as what."""

    text: str
    entity: str | None = None
    confidence: float = 0.0
    detector: str = ""


N = "c_custkey"
#: A curriculum vitae in SQL that Spark and DuckDB read alike; every hit of its text is named.
CV = (
    Piece("'Nguyễn Văn Mẫu'", "candidate_name", 0.85, "name.header"), Piece("chr(10)"),
    Piece(f"'Số ' || ({N} % 90 + 1) || ' đường Ví Dụ, phường Mẫu, quận Thử'", "postal_address", 0.88, "address.contact_block"), Piece("' | '"),
    Piece(f"'0912345' || (100 + {N} % 900)", "phone", 0.92, "phone"), Piece("chr(10) || 'Email: '"),
    Piece(f"'mau.nguyen' || {N} || '@example.test'", "email", 0.92, "email"), Piece("chr(10) || 'CMND: '"),
    Piece(f"'' || (100000000 + {N})", "national_id", 0.88, "national_id"), Piece("chr(10) || 'Hộ chiếu: '"),
    Piece(f"'B' || (1000000 + {N})", "passport", 0.88, "passport"), Piece("chr(10) || 'Giới tính: '"),
    Piece("'Nam'", "gender", 0.92, "gender"), Piece("' | Quốc tịch: '"), Piece("'Việt Nam'", "nationality", 0.92, "nationality"), Piece("chr(10) || 'Ngày sinh: '"),
    Piece(f"'0' || ({N} % 9 + 1) || '/1' || ({N} % 3) || '/19' || ({N} % 50 + 50)", "date_of_birth", 0.90, "date_of_birth"), Piece("chr(10) || 'Mức lương: '"),
    Piece(f"'' || ({N} % 90 + 10) || '.000.000 VND'", "salary", 0.90, "salary"), Piece("chr(10) || 'Age '"),
    Piece(f"'' || ({N} % 50 + 20)", "date_of_birth", 0.90, "date_of_birth"), Piece("chr(10) || 'Thông tin gia đình' || chr(10)"),
    Piece(f"'Bố: Trần Thị Thử - 19' || ({N} % 90 + 10)", "family_details", 0.90, "family.section"), Piece("chr(10) || 'Người tham chiếu / References' || chr(10) || 'Ông '"),
    Piece("'John Sample'", "reference_name", 0.90, "reference_name.honorific"), Piece("', '"), Piece(f"'ref' || {N} || '@example.invalid'", "email", 0.92, "email.reference"),
    Piece("chr(10) || 'Kỹ năng' || chr(10) || 'Cam đoan: '"), Piece("'Nguyen Van Mau'", "candidate_name", 0.85, "name.repeat"), Piece(f"chr(10) || 'No ' || {N}"),
)


def pieces(decomposed: bool = False) -> list[Piece]:
    return [p._replace(text=unicodedata.normalize("NFD", p.text)) for p in CV] if decomposed else list(CV)


def whole(of: list[Piece]) -> str:
    return " || ".join(f"({p.text})" for p in of)


def cvs(spark: SparkSession, sf_dir: str, decomposed: bool = False) -> DataFrame:
    """document_id, parts."""
    docs = table(spark, sf_dir, "customer").select(F.col(N).alias("doc_id"), F.expr(whole(pieces(decomposed))).alias("text"))
    return detection.documents_of(docs)


def _found(documents: DataFrame) -> DataFrame:
    found = detection.findings(documents)
    return found.select("document_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.round("confidence", 2).alias("confidence"), "detector_id", "action", "replacement_label", "requires_review")


def _found_sql(decomposed: bool = False) -> str:
    rows, of = [], pieces(decomposed)
    for i, p in enumerate(of):
        if p.entity:
            before = f"length({whole(of[:i])})" if i else "0"
            rows.append(f"SELECT {N} AS document_id, '{p.entity}' AS entity_type, {before} AS span_start, {before} + length({p.text}) AS span_end, CAST({p.confidence} AS DOUBLE) AS confidence, '{p.detector}' AS detector_id, 'redact' AS action, '{c.ENTITIES[p.entity][0]}' AS replacement_label, false AS requires_review FROM customer")
    return " UNION ALL ".join(rows)


def cv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of documents that hold one of nearly every kind."""
    return _found(cvs(spark, sf_dir))


def cv_findings_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where letters and marks are characters of their own: places are those of the text as given."""
    return _found(cvs(spark, sf_dir, True))


def cv_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = detection.judged(cvs(spark, sf_dir)).select("document_id", F.col("outputs")[0]["redacted"].alias("text"), "verdict", "suppressed")
    return done.select("document_id", F.sha2("text", 256).alias("text_sha256"), F.col("verdict.outcome").alias("outcome"), F.col("verdict.leaks").alias("leaks"), F.col("verdict.residual").alias("residual"), "suppressed")


def cv_salary_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the salary toggle its text stays, is told as found, and does not fail verification."""
    done = detection.judged(cvs(spark, sf_dir), mask_salary=False)
    kept = F.filter("findings", lambda f: f["action"] == "detected_not_redacted")
    return done.select("document_id", F.sha2(F.col("outputs")[0]["redacted"], 256).alias("text_sha256"), F.col("verdict.outcome").alias("outcome"), F.array_join(F.transform(kept, lambda f: f["entity_type"]), ",").alias("kept"))


def _redacted_sql(kept: tuple[str, ...] = ()) -> str:
    return " || ".join(f"'{c.ENTITIES[p.entity][0]}'" if p.entity and p.entity not in kept else f"({p.text})" for p in CV)


def cv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = detection.parts_of(table(spark, sf_dir, "customer").select(F.col(N).alias("doc_id"), F.expr(whole(pieces())).alias("text")))
    return detection.sections(parts).select("document_id", "kind", F.col("heading_line").cast("long").alias("heading_line"), F.col("start").cast("long").alias("section_start"), F.col("end").cast("long").alias("section_end"))


def _sections_sql() -> str:
    text = whole(list(CV))
    marks = (("family", "Thông tin gia đình", "Người tham chiếu", 10), ("reference", "Người tham chiếu / References", "Kỹ năng", 12), ("other", "Kỹ năng", None, 14))
    rows = [f"SELECT {N} AS document_id, '{kind}' AS kind, CAST({line} - 1 AS BIGINT) AS heading_line, strpos(t, '{head}') + length('{head}') AS section_start, {f'''strpos(t, '{stop}') - 1''' if stop else 'length(t)'} AS section_end FROM x" for kind, head, stop, line in marks]
    return f"WITH x AS (SELECT {N}, {text} AS t FROM customer) " + " UNION ALL ".join(rows)


def cv_field_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verifier's rules alone see: fields and shapes, no names or sections, by entity."""
    hits = detection.field_hits(detection.parts_of(table(spark, sf_dir, "customer").select(F.col(N).alias("doc_id"), F.expr(whole(pieces())).alias("text"))))
    return resolve.resolve(hits).groupBy("document_id", "entity_type").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


def _fields_sql() -> str:
    plain = {"phone", "email", "national_id", "passport", "gender", "nationality", "date_of_birth", "salary"}
    return f"SELECT document_id, entity_type, count(*) AS n, min(span_start) AS first_start FROM ({_found_sql()}) WHERE entity_type IN {tuple(sorted(plain))} GROUP BY ALL"


def cv_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source values that outputs still hold when each second one leaks: on pages, in raw objects, and not at all."""
    k = F.col(N)
    rows = table(spark, sf_dir, "customer")
    values = rows.select(k.alias("document_id"), F.explode(F.array(*[F.struct(F.lit(e).alias("entity_type"), F.expr(t).alias("value")) for e, t in (("candidate_name", "'Nguyễn Văn Mẫu'"), ("email", f"'mau.nguyen' || {N} || '@example.test'"), ("gender", "'Nam'"))])).alias("v")).select("document_id", "v.*")
    name, mail = F.lit(unicodedata.normalize("NFD", "là NGUYỄN-VĂN MẪU.")), F.expr(f"'to mau.nguyen' || {N} || '@example.test'")
    out = rows.select(k.alias("document_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("part_seq"), F.lit(i + 1).alias("page_number"), t.alias("text")) for i, t in enumerate((F.when(k % 2 == 0, name).otherwise("x"), F.when(k % 3 == 0, mail).otherwise("y"), F.when(k % 6 == 0, name).otherwise("https://linkedin.com/in/nguyen-van-mau")))])).alias("o")).select("document_id", "o.*")
    raw = rows.where(k % 5 == 0).select(k.alias("document_id"), F.concat(F.lit("/Author ("), mail, F.lit(")")).alias("text"))
    found = verify.residual_counts(verify.residues(values, out, raw))
    return found.select("document_id", "entity_type", F.col("count").alias("n"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def ordered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings numbered in the order of results."""
    found = detection.findings(cvs(spark, sf_dir))
    return resolve.ordered(found).select("document_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("position").cast("long").alias("position"))


def finding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.finding_counts(detection.findings(cvs(spark, sf_dir)))
    return counts.groupBy("entity_type", "ordinal").agg(F.sum("n").alias("n")).select("entity_type", F.col("ordinal").cast("long").alias("ordinal"), "n")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to hold a document, from findings of chosen strength; the documents without any are held too."""
    k = F.col("o_orderkey")
    documents = table(spark, sf_dir, "orders").select(k.alias("document_id"))
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(k.alias("document_id"), F.lit(0).alias("part_seq"), F.lit(0).alias("start"), F.lit(9).alias("end"), one_of(("candidate_name", "email", "salary", "personal_url"), k).alias("entity_type"), (F.col("o_custkey") % 21 / 20).alias("confidence"), (k % 3 == 0).alias("ambiguous"))
    found = resolve.findings(rows, mask_salary=False)
    return resolve.review_reasons(documents, found)


def suppressed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 21 / 20).alias("confidence"))
    return resolve.suppressed(rows)


def policy_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of entities, one left out or one too many for most customers."""
    every = F.array(*[F.lit(e) for e in c.ENTITIES if e not in c.UNHANDLED])
    out = one_of(tuple(c.ENTITIES), N)
    more = F.when(F.expr(f"{N} % 3 = 0"), F.array(F.lit("personal_url"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select(N, F.concat(F.array_remove(every, out), more).alias("entities"))
    return resolve.selection_errors(rows).select(N, F.array_join("missing", ",").alias("missing"), F.array_join("refused", ",").alias("refused"), "valid")


def kept_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), F.regexp_replace("url", "^http://", "https://"), F.lit(" or linkedin.com/in/ann-"), F.col("page_id").cast("string"), F.lit(" end"))
    return table(spark, sf_dir, "pages").select("page_id", verify.without_kept_urls(F.lower(text)).alias("bare"))


def label_only_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = one_of(("[NAME]", "[ID], [ID].", "[EMAIL] a", " - ", "[DOB", "é"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", verify.label_only(x).alias("label_only"))


def same_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ in white space alone are one."""
    d = table(spark, sf_dir, "documents")
    other = F.when(F.expr("doc_id % 3 = 0"), F.regexp_replace("text", " ", "\n ")).when(F.expr("doc_id % 3 = 1"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return d.select("doc_id", verify.same_text(F.col("text"), other).alias("same"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", verify.outcome(F.col("o_orderkey") % 4 - 2, F.col("o_custkey") % 3 - 1).alias("outcome"))


def exact_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharp s becomes two letters, bare marks none."""
    text = F.expr(f"'Straße ' || {N} || '{unicodedata.normalize('NFD', ' Mẫu Ế')} ẞ ﬁ'")
    return table(spark, sf_dir, "customer").select(N, exactly_folded(text).alias("folded"))


def leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    values = d.select("document_id", F.explode(F.array(F.substring("text", 1, 8), F.lit("zzzzzzzzz"), F.substring("text", 3, 5), F.substring("text", 1, 8))).alias("value"))
    return reports.leaked(values, d)


def upload_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("o_orderkey"), one_of(("pdf", "docx", "macro_or_template", "unsupported"), k).alias("kind"), F.expr("cast(o_custkey as bigint) % 5 * 6000000").alias("size_bytes"), F.expr("o_custkey % 3 = 0").alias("disagrees"))
    return rows.select("o_orderkey", admission.upload_code(F.col("kind"), F.col("size_bytes"), F.col("disagrees")).alias("code"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings, which files of a folder are documents, and the name of a single output."""
    k = F.col("o_orderkey")
    name = F.concat(one_of(("cv", "~$cv", ".cv", "C:\\x\\cv", "a/b/cv"), k), k.cast("string"), one_of((".PDF", ".docx", ".docx.txt", "", ".p-f", ".toolongext"), "o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", admission.extension(name).alias("extension"), admission.is_cv_file(name).alias("is_cv"), export.single_name(k, F.when(k % 2 == 0, "pdf").otherwise("docx")).alias("single_name"), docx.part_kind(one_of(("word/document.xml", "word/header2.xml", "word/footer1.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml", "word/media/x"), k)).alias("part_kind"), reports.part_key(F.when(k % 3 == 0, k % 30), F.when(k % 3 == 1, F.lit("word/x.xml"))).alias("part_key"))


def intact_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    content = F.col("text").cast("binary")
    return d.select("doc_id", admission.intact(content, F.when(F.expr("doc_id % 3 = 0"), F.sha2("lang", 256)).otherwise(F.sha2(content, 256)), F.length(content) + F.expr("if(doc_id % 5 = 0, 1, 0)")).alias("intact"))


def batch_byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 50 documents of a source, walked in order of arrival."""
    d = table(spark, sf_dir, "documents")
    uploads = d.select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("batch_id"), F.col("doc_id").alias("arrival"), F.octet_length("text").cast("long").alias("size_bytes"))
    return admission.over_byte_cap(uploads, 60_000)


def used_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the accepted files of each batch use."""
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("size_bytes"), F.expr("doc_id % 4 > 0").alias("accepted"))
    return admission.used_bytes(d.withColumnRenamed("source", "batch_id"))


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    return jobs.in_order(rows).select("batch_id", "document_id", F.col("position").cast("long").alias("position"))


def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a package that its output lacks or has beyond it."""
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("word/p"), F.col("l_linenumber").cast("string")).alias("name"), "l_partkey")
    return docx.structure_differences(names.where("l_partkey % 5 > 0").select("document_id", "name"), names.where("l_partkey % 5 < 4").select("document_id", "name"))


def page_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", geometry.page_code(F.substring("url", 1, (F.col("page_id") % 16).cast("int")), F.expr("page_id % 2 = 0")).alias("code"))
    return p


QUERIES = {f.__name__: f for f in (cv_findings, cv_findings_decomposed, cv_redacted, cv_salary_kept, cv_sections, cv_field_hits, cv_leaks, ordered_hits, finding_totals, review_flags, suppressed_hits, policy_selections, kept_urls, label_only_texts, same_texts, outcomes, exact_folding, leak_counts, upload_codes, file_names, intact_objects, batch_byte_cap, used_bytes, queue_order, missing_parts, page_reliability)}

_ORD = "list_position(" + str(list(c.ENTITIES)) + ", entity_type)"
_MUST = [e for e in c.ENTITIES if e not in (*c.UNHANDLED, *c.OPTIONAL)]

ORACLE_SQL = {
    "cv_findings": _found_sql(),
    "cv_findings_decomposed": _found_sql(True),
    "cv_redacted": f"SELECT {N} AS document_id, sha256({_redacted_sql()}) AS text_sha256, 'passed' AS outcome, 0 AS leaks, 0 AS residual, 0 AS suppressed FROM customer",
    "cv_salary_kept": f"SELECT {N} AS document_id, sha256({_redacted_sql(('salary',))}) AS text_sha256, 'passed' AS outcome, 'salary' AS kept FROM customer",
    "cv_sections": _sections_sql(),
    "cv_field_hits": _fields_sql(),
    "cv_leaks": f"""WITH x AS (SELECT {N} AS d, 'candidate_name' AS e, list_filter([CASE WHEN {N} % 2 = 0 THEN '1' END, CASE WHEN {N} % 6 = 0 THEN '3' END], lambda x: x IS NOT NULL) AS p, false AS raw FROM customer
          UNION ALL SELECT {N}, 'email', list_filter([CASE WHEN {N} % 3 = 0 THEN '2' END], lambda x: x IS NOT NULL), {N} % 5 = 0 AND {N} % 3 > 0 FROM customer)
        SELECT d AS document_id, e AS entity_type, CASE WHEN raw THEN 1 ELSE len(p) END AS n, array_to_string(p, ',') AS pages FROM x WHERE raw OR len(p) > 0""",
    "ordered_hits": f"SELECT document_id, entity_type, span_start, row_number() OVER (PARTITION BY document_id ORDER BY span_start, span_end, {_ORD}) AS position FROM ({_found_sql()})",
    "finding_totals": f"SELECT entity_type, {_ORD} - 1 AS ordinal, count(*) AS n FROM ({_found_sql()}) GROUP BY ALL",
    "review_flags": f"""WITH f AS (SELECT o_orderkey AS k, {sql_of(('candidate_name', 'email', 'salary', 'personal_url'), 'o_orderkey')} AS e, (o_custkey % 21) / 20 AS s FROM orders WHERE o_orderkey % 5 > 0)
        SELECT o_orderkey AS document_id, coalesce(e IN ('candidate_name', 'email') AND s >= 0.5 AND s < 0.85, false) AS low_confidence, NOT coalesce(e = 'candidate_name' AND s >= 0.5, false) AS no_candidate_name, coalesce(e IN ('candidate_name', 'email') AND s >= 0.5 AND o_orderkey % 3 = 0, false) AS ambiguous
        FROM orders LEFT JOIN f ON k = o_orderkey""",
    "suppressed_hits": "SELECT l_orderkey AS document_id, count(*) FILTER ((l_partkey % 21) / 20 < 0.5) AS suppressed FROM lineitem GROUP BY l_orderkey",
    "policy_selections": f"""WITH x AS (SELECT {N}, {sql_of(tuple(c.ENTITIES), N)} AS gone FROM customer) SELECT {N}, CASE WHEN gone IN {tuple(_MUST)} THEN gone ELSE '' END AS missing, CASE WHEN {N} % 3 = 0 THEN 'personal_url' ELSE '' END AS refused, gone NOT IN {tuple(_MUST)} AND {N} % 3 > 0 AS valid FROM x""",
    "kept_urls": "SELECT page_id, 'see ' || '    ' || ' or ' || '    ' || ' end' AS bare FROM pages",
    "label_only_texts": "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 3) AS label_only FROM orders",
    "same_texts": "SELECT doc_id, doc_id % 3 <> 1 AS same FROM documents",
    "outcomes": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 2 THEN 'failed' WHEN o_custkey % 3 > 1 THEN 'review_required' ELSE 'passed' END AS outcome FROM orders",
    "exact_folding": f"SELECT {N}, 'strasse ' || {N} || ' mau e ss fi' AS folded FROM customer",
    "leak_counts": """WITH v AS (SELECT doc_id, text, unnest(list_distinct([substr(text, 1, 8), 'zzzzzzzzz', substr(text, 3, 5)])) AS value FROM documents)
        SELECT doc_id AS document_id, count(*) FILTER (length(value) >= 6 AND contains(text, value)) AS leaked FROM v GROUP BY doc_id""",
    "upload_codes": f"""WITH x AS (SELECT o_orderkey, {sql_of(('pdf', 'docx', 'macro_or_template', 'unsupported'), 'o_orderkey')} AS k, o_custkey % 5 * 6000000 AS s, o_custkey % 3 = 0 AS d FROM orders)
        SELECT o_orderkey, CASE WHEN s = 0 THEN 'UPLOAD_MALFORMED_REQUEST' WHEN s > 20971520 THEN 'UPLOAD_FILE_TOO_LARGE' WHEN k = 'macro_or_template' THEN 'DOCX_MACRO_OR_TEMPLATE' WHEN k = 'unsupported' THEN 'UPLOAD_UNSUPPORTED_TYPE' WHEN d THEN 'UPLOAD_SPOOFED_TYPE' END AS code FROM x""",
    "file_names": f"""WITH x AS (SELECT o_orderkey AS k, {sql_of(('cv', '~$cv', '.cv', 'C:/x/cv', 'a/b/cv'), 'o_orderkey')} AS s, {sql_of(('.PDF', '.docx', '.docx.txt', '', '.p-f', '.toolongext'), 'o_custkey')} AS e FROM orders)
        SELECT k AS o_orderkey, CASE WHEN s = '.cv' AND e NOT IN ('.PDF', '.docx', '.docx.txt') THEN NULL WHEN s = '.cv' THEN NULL WHEN e = '.docx.txt' THEN '.txt' WHEN e IN ('.PDF', '.docx') THEN lower(e) END AS extension, e IN ('.PDF', '.docx') AND s NOT IN ('~$cv', '.cv') AS is_cv,
          'redacted-' || k || CASE WHEN k % 2 = 0 THEN '.pdf' ELSE '.docx' END AS single_name, (['document', 'header', 'footer', 'footnotes', 'endnotes', 'comments', 'other'])[CAST(k % 7 AS INTEGER) + 1] AS part_kind, CASE k % 3 WHEN 0 THEN 'page:' || (k % 30) WHEN 1 THEN 'part:word/x.xml' ELSE 'unknown' END AS part_key FROM x""",
    "intact_objects": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS intact FROM documents",
    "batch_byte_cap": """WITH RECURSIVE d AS (SELECT source || '-' || (doc_id // 50) AS b, doc_id AS a, octet_length(encode(text)) AS s FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a) AS n FROM d),
        w AS (SELECT b, 0 AS n, 0::BIGINT AS used, NULL::BIGINT AS a, false AS refused FROM (SELECT DISTINCT b FROM d) UNION ALL SELECT r.b, r.n, w.used + CASE WHEN w.used + r.s > 60000 THEN 0 ELSE r.s END, r.a, w.used + r.s > 60000 FROM w JOIN r ON r.b = w.b AND r.n = w.n + 1)
        SELECT b AS batch_id, a AS arrival, refused FROM w WHERE a IS NOT NULL""",
    "used_bytes": "SELECT source AS batch_id, CAST(coalesce(sum(octet_length(encode(text))) FILTER (doc_id % 4 > 0), 0) AS BIGINT) AS used_bytes, count(*) FILTER (doc_id % 4 > 0) AS files FROM documents GROUP BY source",
    "queue_order": "SELECT o_custkey AS batch_id, o_orderkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders",
    "missing_parts": """WITH a AS (SELECT DISTINCT l_orderkey AS d, 'word/p' || l_linenumber AS n FROM lineitem WHERE l_partkey % 5 > 0), b AS (SELECT DISTINCT l_orderkey AS d, 'word/p' || l_linenumber AS n FROM lineitem WHERE l_partkey % 5 < 4)
        SELECT d AS document_id, n AS name, 'missing' AS difference FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT d, n, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "page_reliability": "SELECT page_id, CASE WHEN length(regexp_replace(substr(url, 1, CAST(page_id % 16 AS INTEGER)), '\\s', '', 'g')) >= 8 THEN NULL WHEN page_id % 2 = 0 THEN 'PDF_TEXT_UNRELIABLE' ELSE 'PDF_NO_TEXT_LAYER' END AS code FROM pages",
}
