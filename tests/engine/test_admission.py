from pyspark.sql import functions as F

from inkveil.operators import jobs
from inkveil.sources import admission

HOST = "cv.example.com"


def test_source_urls(spark):
    good = {"https://cv.example.com/a/b.pdf": "b.pdf", "https://cv.example.com:443/x%20y.DOCX?v=1": "x y.docx"}
    bad = ["http://cv.example.com/a.pdf", "https://other.com/a.pdf", "https://u:p@cv.example.com/a.pdf", "https://cv.example.com:8443/a.pdf", "https://cv.example.com/a.pdf#x", "https://cv.example.com//a.pdf", "https://cv.example.com/../a.pdf", "https://cv.example.com/%2e%2e/a.pdf", "https://cv.example.com/a%2Fb.pdf", "https://cv.example.com/a.txt", "https://cv.example.com/.pdf", "https://cv.example.com/a b.pdf", "https://cv.example.com/", "", "https://cv.example.com/" + "a" * 2100 + ".pdf"]
    df = spark.createDataFrame([(u,) for u in [*good, *bad]], "u string")
    got = [r.s and r.s.filename for r in df.select(admission.source_url(F.col("u"), HOST).alias("s")).collect()]
    assert got == [*good.values(), *[None] * len(bad)]


def test_kinds_and_limits(spark):
    rows = [(b"%PDF-1.7 x", "pdf"), (b"junk %PDF-", "pdf"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "ole"), (b"PK\x03\x04zip", "zip"), (b"\x12\x55\x04\x44\x62\xd0", "unsupported"), (b"", "unsupported")]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in rows], "b binary")
    assert [r.k for r in df.select(admission.kind_of(F.col("b")).alias("k")).collect()] == [k for _, k in rows]
    up = spark.createDataFrame([("x", i, s, h) for i, (s, h) in enumerate([(60, "a"), (50, "b"), (40, "a"), (1, "c")])], "batch_id string, arrival int, size_bytes long, content_sha256 string")
    assert [r.refused for r in admission.over_byte_cap(up, 100).orderBy("arrival").collect()] == [False, True, False, True]
    assert [r.refused for r in admission.over_file_cap(up, 3).orderBy("arrival").collect()] == [False, False, False, True]
    assert [r.duplicate for r in admission.copies(up).orderBy("arrival").collect()] == [False, False, True, False]


def test_upload_codes_and_names(spark):
    rows = [("pdf", 0, False), ("pdf", 21 << 20, True), ("macro_or_template", 5, True), ("unsupported", 5, False), ("docx", 5, True), ("docx", 5, False)]
    x = spark.createDataFrame(rows, "k string, s long, d boolean").coalesce(1)
    assert [r.c for r in x.select(admission.upload_code(F.col("k"), F.col("s"), F.col("d")).alias("c")).collect()] == ["UPLOAD_MALFORMED_REQUEST", "UPLOAD_FILE_TOO_LARGE", "DOCX_MACRO_OR_TEMPLATE", "UPLOAD_UNSUPPORTED_TYPE", "UPLOAD_SPOOFED_TYPE", None]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert sorted((r.path.rpartition("/")[2], r.size_bytes) for r in admission.listing(spark, str(tmp_path)).collect()) == [("a.pdf", 8), ("b.txt", 1)]
    found = admission.files(spark, str(tmp_path), "*.pdf")
    assert found.select(admission.intact(F.col("content"), F.col("content_sha256"), F.col("size_bytes")).alias("x")).first().x is True


def test_stream_redacts_each_document_once(spark, tmp_path):
    from inkveil.streaming import queue

    schema = "doc_id long, text string"
    def add(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    def run():
        queue.start(queue.redacted_stream(queue.arrivals(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
        return sorted((r.doc_id, r.text, r.n_findings, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    add((1, "to a@b.co"), (2, "none"))
    assert run() == [(1, "to [EMAIL]", 1, "passed"), (2, "none", 0, "passed")]
    add((3, "c@d.org, e@f.net"))
    assert run() == [(1, "to [EMAIL]", 1, "passed"), (2, "none", 0, "passed"), (3, "[EMAIL], [EMAIL]", 2, "passed")]
