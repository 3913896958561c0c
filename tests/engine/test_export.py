from pyspark.sql import functions as F

from inkveil.operators import reports
from inkveil.sources import admission, docx, export


def test_names(spark):
    rows = [("0a-1", "b", 1, "C:\\x\\CV.pdf", "pdf"), ("0a-2", "b", 2, "cv.PDF", "pdf"), ("0a-3", "b", 3, "cv-2.pdf", "pdf"), ("0a-4", "b", 4, "a<b>.docx", "docx"), ("0a-5", "b", 5, None, None), ("zz", "b", 6, "...", None), ("0a-6", "c", 1, "CV.pdf", "pdf"), ("0a-7", "c", 2, "x.txt", None)]
    found = export.archive_names(spark.createDataFrame(rows, "document_id string, batch_id string, arrival int, filename string, kind string"))
    assert sorted((r.document_id, r.masked_name, r.folder) for r in found.collect()) == [
        ("0a-1", "masked_CV.pdf", "CV"), ("0a-2", "masked_cv-2.pdf", "cv 2"), ("0a-3", "masked_cv-2-2.pdf", "cv-2"), ("0a-4", "masked_a_b_.docx", "a_b_"),
        ("0a-5", "masked_0a5", "0a5"), ("0a-6", "masked_CV.pdf", "CV"), ("0a-7", "masked_x.txt", "x.txt"), ("zz", "masked_cv", "cv 3"),
    ]


def test_report_and_archive(spark):
    documents = spark.createDataFrame([("d1", "b", "completed", None), ("d2", "b", "failed", "DOCX_MALFORMED")], "document_id string, batch_id string, state string, error_code string")
    found = spark.createDataFrame([("d1", "email"), ("d1", "email"), ("d1", "phone")], "document_id string, entity_type string")
    hidden = spark.createDataFrame([("d1", "comments", 2), ("d1", "comments", 1)], "document_id string, category string, n int")
    rows = reports.batch_report(documents, found, hidden)
    assert (rows.columns[:4], rows.columns[-1], len(rows.columns)) == (["document_id", "status", "error_code", "count_candidate_name"], "hidden_external_relationships", 33)
    csv = export.csv_by_batch(rows.join(documents.select("document_id", "batch_id"), "document_id"))
    text = csv.first().report
    assert text.split("\n")[1:] == ["d1,completed,,0,0,2,1" + ",0" * 13 + ",0" * 7 + ",3" + ",0" * 5, "d2,failed,DOCX_MALFORMED" + ",0" * 30, ""]
    outputs = spark.createDataFrame([("b", "masked_x.docx", bytearray(b"xyz"))], "batch_id string, name string, content binary")
    made = export.batch_archives(outputs, csv).first()
    assert made.name == "masked-b.zip"
    assert docx.unpack(bytes(made.content)) == {"masked_x.docx": b"xyz", "report.csv": text.encode()}


def test_identified(spark):
    plain = docx.plain_package("x")
    entries = docx.unpack(plain)
    macro = docx.pack(entries | {docx.TYPES: entries[docx.TYPES] + b"macroEnabled"})
    rows = [(1, plain), (2, macro), (3, b"x%PDF-1.4"), (4, b"PK\x03\x04broken"), (5, b""), (6, docx.pack({"a": b"b"})), (7, bytes.fromhex("d0cf11e0a1b11ae1")), (8, b" " * 1020 + b"%PDF-")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, content binary").withColumn("k", admission.kind_of(F.col("content")))
    got = {r.id: r.kind for r in df.select("id", docx.identified(F.col("content"), F.col("k")).alias("kind")).collect()}
    assert got == {1: "docx", 2: "macro_or_template", 3: "pdf", 4: "unsupported", 5: "unsupported", 6: "unsupported", 7: "unsupported", 8: "unsupported"}


def test_gold_and_totals(spark):
    parts = spark.createDataFrame([(1, 2, None, "a.b ab a.b"), (1, None, "word/x.xml", r"C\E a.b")], "document_id int, page_number int, part_name string, text string")
    asked = spark.createDataFrame([(1, "email", "a.b"), (1, "phone", "b ab a"), (1, "gender", "C\\E"), (1, "gender", "b")], "document_id int, entity_type string, value string")
    got = sorted((r.part_key, r.entity_type, r.start, r.end) for r in reports.gold_spans(parts, asked).collect())
    assert got == [("page:2", "email", 0, 3), ("page:2", "email", 7, 10), ("page:2", "phone", 2, 8), ("part:word/x.xml", "email", 4, 7), ("part:word/x.xml", "gender", 0, 3)]
    rows = spark.createDataFrame([(1, "pdf", "passed", 0), (2, "pdf", "failed", None), (3, "docx", "review_required", 2), (4, "docx", "review_required", None)], "document_id int, format string, outcome string, leaked int")
    assert sorted(tuple(r) for r in reports.totals(rows).collect()) == [("docx", 2, 0, 2, 1, 2, 0.0, 1.0), ("pdf", 2, 1, 0, 1, 0, 0.5, 0.0)]


def test_a_batch_of_one_name_takes_time_in_proportion():
    import random
    import time

    import pandas as pd

    def plain(names):
        used, out = set(), []
        for whole in names:
            front, dot, back = whole.rpartition(".")
            front, dot, back = (front, dot, back) if front and back else (whole, "", "")
            n, found = 1, whole
            while found.lower() in used:
                n += 1
                found = f"{front}-{n}{dot}{back}"
            used.add(found.lower())
            out.append(found)
        return out

    r = random.Random(5)
    stems = [r.choice(["cv", "CV", "cv-2", "Cv-3", "ΑΣ", "ας", "x-2", "x"]) for _ in range(400)]
    rows = pd.DataFrame({"document_id": [str(i) for i in range(400)], "batch_id": "b", "arrival": range(400), "stem": stems, "ext": [r.choice([".pdf", ".docx", ""]) for _ in range(400)]})
    assert list(export._batch(rows)["masked_name"]) == plain([f"masked_{s}{e}" for s, e in zip(rows["stem"], rows["ext"], strict=True)])
    many = pd.DataFrame({"document_id": [str(i) for i in range(20_000)], "batch_id": "b", "arrival": range(20_000), "stem": "cv", "ext": ".pdf"})
    began = time.process_time()
    assert export._batch(many)["masked_name"].iloc[-1] == "masked_cv-20000.pdf" and time.process_time() - began < 5
