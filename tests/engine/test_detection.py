import pytest
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.functions.folding import Composed, Folded
from inkveil.functions.folding import fold as fold_one
from inkveil.functions.text import changes_length, exactly_folded, fold, spans
from inkveil.operators import detect, reports, resolve, scan, verify
from inkveil.operators.sections import Layout
from inkveil.plans import detection

CV = """Email: mau.nguyen@example.test
Dien thoai: 0900000000
CCCD: 000000000012
CMND: 000000003
Ho chieu: A0000001
Gioi tinh: Nam
Hon nhan: Doc than
Quoc tich: Viet Nam
Ton giao: Khong
Dan toc: Kinh
Chieu cao: 170 cm
Dia chi: 12 Pho Mau, Ha Noi
Ngay sinh: 01/01/1990
Muc luong: 20.000.000 VND
LinkedIn: https://linkedin.com/in/mau-example
Nguoi tham chieu
Lien he: jane.example@example.invalid
Kinh nghiem
Example Bank Ltd 2019-2023"""
GOLD = [("email", "mau.nguyen@example.test"), ("email", "jane.example@example.invalid"), ("phone", "0900000000"), ("national_id", "000000000012"), ("national_id", "000000003"), ("passport", "A0000001"), ("gender", "Nam"), ("marital_status", "Doc than"), ("nationality", "Viet Nam"), ("religion", "Khong"), ("ethnicity", "Kinh"), ("health", "170 cm"), ("postal_address", "12 Pho Mau, Ha Noi"), ("date_of_birth", "01/01/1990"), ("salary", "20.000.000 VND")]


def parts(spark, *texts):
    return spark.createDataFrame([(i, 0, None, "word/document.xml", t) for i, t in enumerate(texts)], "document_id int, part_seq int, page_number int, part_name string, text string")


def found(text):
    """(entity, text) of the resolved field hits of one text."""
    return [(h.entity, text[h.start : h.end]) for h in scan.resolved(scan.field_hits(text))]


def judged(text):
    return [(f.hit.entity, text[f.hit.start : f.hit.end], f.hit.detector) for f in scan.judged([scan.Part(0, None, "word/document.xml", text)])[0][0]]


def test_gold_document(spark):
    p = parts(spark, CV)
    rows = resolve.resolve(detection.all_hits(p)).collect()
    assert sorted((r.entity_type, CV[r.start : r.end]) for r in rows) == sorted(GOLD)
    gold = spark.createDataFrame([(0, "part:x", e, CV.index(v), CV.index(v) + len(v)) for e, v in GOLD], "document_id int, part_key string, entity_type string, start int, end int")
    got = resolve.resolve(detection.all_hits(p)).withColumn("part_key", F.lit("part:x"))
    assert {(r.precision, r.recall) for r in reports.scores(gold, got).collect()} == {(1.0, 1.0)}


def test_redaction_and_verdict(spark):
    p = parts(spark, CV, "nothing here", "", None)
    text = {r.document_id: r.redacted for r in detection.redacted(p).collect()}
    assert text[1] == "nothing here" and text[2] == "" == text[3]
    assert "[EMAIL]" in text[0] and "Gioi tinh: [REDACTED]" in text[0] and not any(v in text[0] for e, v in GOLD if len(v) > 5)
    documents = detection.gathered(p)
    assert {r.document_id: r.outcome for r in detection.verdicts(documents).collect()} == dict.fromkeys(range(4), "passed")
    found = detection.findings(documents)
    reasons = {r.document_id: r.no_candidate_name for r in resolve.review_reasons(p, found).collect()}
    assert reasons == dict.fromkeys(range(4), True)
    # one row for each document gives what hits as rows of their own give
    placed = resolve.ranges(resolve.findings(resolve.resolve(detection.all_hits(p))))
    assert {r.document_id: r.redacted for r in resolve.redact(p.fillna("", ["text"]), placed).collect()} == text


def test_a_kept_salary_is_no_residue(spark):
    text = "Name: Jane Example\nExpected salary: 20.000.000 VND"
    documents = detection.documents_of(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    off, on = (detection.judged(documents, mask_salary=x).first() for x in (False, True))
    assert off.outputs[0].redacted == "Name: [NAME]\nExpected salary: 20.000.000 VND" and (off.verdict.residual, off.verdict.outcome) == (0, "passed")
    assert on.outputs[0].redacted == "Name: [NAME]\nExpected salary: [SALARY]"
    left = detection.parts_of(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [verify.rerun(detection.field_hits(left), left, x).first().residual for x in (False, True)] == [0, 1]


def test_decomposed_text():
    import unicodedata

    for text in ("Giới tính: Nam", "Họ và tên: Nguyễn Văn Mẫu\nĐịa chỉ: 12 Phố Mẫu, Hà Nội | x", "Thông tin gia đình\nBố: Trần Thị Thử\nNgười tham chiếu\nÔng John Mẫu, jöhn@x.org a@b.co"):
        plain = unicodedata.normalize("NFD", text)
        assert len(plain) > len(text)
        assert [(e, unicodedata.normalize("NFC", v), d) for e, v, d in judged(plain)] == judged(text) != []
    leak = scan.still_held([("candidate_name", "Nguyễn Văn Mẫu")], [unicodedata.normalize("NFD", "là Nguyễn Văn Mẫu.")])
    assert leak == [("candidate_name", 0)]


def test_reference_contacts_are_tagged():
    text = "Email: a@b.co\nReferences\nJohn Sample, j@x.org, 0912345678\nSkills\nc@d.co"
    assert [(v, d) for e, v, d in judged(text) if e in ("email", "phone")] == [("a@b.co", "email"), ("j@x.org", "email.reference"), ("0912345678", "phone.reference"), ("c@d.co", "email")]


def test_values_that_repeat_cost_little():
    assert found("ngay sinh 1/1/1990 " * 3) == [("date_of_birth", "1/1/1990")] * 3
    assert found("ngay sinh: tuoi 30 tuoi ngay sinh x") == [("date_of_birth", "30 tuoi"), ("date_of_birth", "ngay sinh x")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ngay sinh: 01/01/1990 Kinh nghiem: 2010", [("date_of_birth", "01/01/1990")]),
        ("Ngay sinh: [DOB] | LinkedIn: [URL] | Github: [URL]", []),
        ("CMND: 123456789", [("national_id", "123456789")]),
        ("Order 123456789", []),
        ("Gender\nFemale", [("gender", "Female")]),
        ("agent: Smith", []),
        ("Giới tính - Nữ; Email: a@b.co", [("gender", "Nữ"), ("email", "a@b.co")]),
        ("expected salary: 1,000,000 vnd", [("salary", "1,000,000 vnd")]),
        ("1,000 usd for parts", []),
        ("age 30 years", [("date_of_birth", "30 years")]),
        ("tel +84 912 345 678.", [("phone", "+84 912 345 678")]),
        ("xé0912345678", [("phone", "0912345678")]),
        ("😀 mail me: x.y@z.org", [("email", "x.y@z.org")]),
        ("address: [ADDRESS] and more", [("postal_address", "[ADDRESS]")]),
        ("Nationality: Viet Nam | Religion: none", [("nationality", "Viet Nam"), ("religion", "none")]),
    ],
)
def test_rules(text, want):
    assert found(text) == want


def test_shapes_in_the_jvm_are_those_of_the_scan(spark):
    texts = [CV, "tel +84 912 345 678. xé0912345678 x.y@z.org", "1 " * 50, "\u0663" * 12, "a@b.co1x@d.fr"]
    rows = detect.shape_hits(parts(spark, *texts)).collect()
    anywhere = {"email", "phone", "national_id"}
    want = sorted((i, h.entity, h.start, h.end, h.confidence) for i, t in enumerate(texts) for h in scan.field_hits(t) if h.entity in anywhere and h.confidence != c.SCORE_CONTEXT)
    assert sorted((r.document_id, r.entity_type, r.start, r.end, r.confidence) for r in rows) == want


def test_spans_are_those_of_a_plain_search(spark):
    import re

    texts = ["a1 22 b333", "", "no", "٣٤ 5", "1" * 500, "x\n7\n\n8"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(spans(F.col("t"), r"(?U)\d+").alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in got] == [[m.span() for m in re.finditer(r"\d+", t)] for t in texts]


def test_fold(spark):
    words = ["Mức Lương ĐÀ", "Ünïcode", "plain", "straße", "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(fold(F.col("w")).alias("f"), changes_length(F.col("w")).alias("x")).collect()
    assert [r.f for r in got[:3]] == [fold_one(w) for w in words[:3]] and [r.x for r in got] == [False, False, False, True, True]
    exact = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select(exactly_folded(F.col("w")).alias("f")).collect()
    assert [r.f for r in exact] == [*map(fold_one, words), None] and fold_one("straße") == "strasse"


def test_places_of_folded_text():
    view = Folded("straße e\u0301x")
    assert view.folded == "strasse ex" and view.back(4, 6) == (4, 5) and view.back(9, 10) == (9, 10) and view.back(3, 3) == (0, 0)
    assert view.ahead(5) == 6 and view.ahead(8) == 9 and view.ahead(99) == 10
    x = Composed("ae\u0301\u0302b\u1112\u1161\u11ab")
    assert x.text == "a\u00e9\u0302b\ud55c" and x.given(1, 2) == (1, 4) and x.given(4, 5) == (5, 8)
    assert Composed("abc").given(1, 2) == (1, 2)


def test_sections_and_family(spark):
    text = "Nguyen Van Mau\nSố 1 đường Ví Dụ, phường Mẫu, quận Thử | 0900000000\nThông tin gia đình\nBố: Trần Thị Thử - 1960\n\nNgười tham chiếu / References\nÔng John, john@x.org\nKỹ năng: nấu ăn\nFamily: my mother\n"
    p = parts(spark, text)
    want = [("family", "Bố: Trần Thị Thử - 1960"), ("reference", "Ông John, john@x.org\nKỹ năng: nấu ăn"), ("family", "my mother")]
    assert [(r.kind, text[r.start : r.end].strip()) for r in detection.sections(p).orderBy("start").collect()] == want
    layout = Layout(Folded(text), part_name="word/document.xml")
    assert [text[h.start : h.end] for h in layout.family()] == ["Bố: Trần Thị Thử - 1960", "my mother"]
    assert [(text[h.start : h.end], h.confidence) for h in layout.addresses()] == [("Số 1 đường Ví Dụ, phường Mẫu, quận Thử", 0.88)]
    assert list(Layout(Folded(text), part_name="word/footer1.xml").addresses()) == [] and Layout(Folded("")).sections == []


def test_resolution_against_a_plain_model(spark):
    import random

    r, rows = random.Random(3), []
    entities = ["email", "phone", "gender", "religion", "salary", "date_of_birth"]
    for d in range(150):
        for seq in range(r.randint(1, 7)):
            s = r.randint(0, 20)
            rows.append((d, 0, seq, r.choice(entities), s, s + r.randint(1, 9), r.choice([0.5, 0.9, 0.92]), f"d{seq}", [f"s{seq}"]))
    df = spark.createDataFrame(rows, "document_id int, part_seq int, seq int, entity_type string, start int, end int, confidence double, detector_id string, signals array<string>")
    got = sorted((x.document_id, x.entity_type, x.start, x.end, x.confidence, x.detector_id, x.signals) for x in resolve.resolve(df).collect())
    want = []
    for d in range(150):
        merged = []
        mine = [x for x in rows if x[0] == d]
        for e in dict.fromkeys(x[3] for x in mine):
            first = min(x[2] for x in mine if x[3] == e)
            group = []
            for x in sorted((x for x in mine if x[3] == e), key=lambda x: (x[4], x[5], x[2])):
                if group and x[4] < group[-1][1]:
                    g = group[-1]
                    best = (g[2], g[3]) if g[2] >= x[6] else (x[6], x[7])
                    group[-1] = (g[0], max(g[1], x[5]), *best, list(dict.fromkeys(g[4] + x[8])))
                else:
                    group.append((x[4], x[5], x[6], x[7], list(x[8])))
            merged += [(e, *g, first) for g in group]
        kept = []
        for h in sorted(merged, key=lambda h: (h[1] - h[2], -c.ENTITIES[h[0]][1], h[6])):
            if not any(o[0] != h[0] and o[1] <= h[1] and h[2] <= o[2] for o in kept):
                kept.append(h)
        want += [(d, h[0], h[1], h[2], h[3], h[4], h[5]) for h in kept]
    assert got == sorted(want)
    one = []
    for d in range(150):
        hits = [scan.Hit(*x[3:8], tuple(x[8])) for x in rows if x[0] == d]
        one += [(d, h.entity, h.start, h.end, h.confidence, h.detector, list(h.signals)) for h in scan.resolved(hits)]
    assert sorted(one) == got
    order = [(r.document_id, r.start, r.end) for r in resolve.ordered(resolve.resolve(df)).orderBy("document_id", "position").collect()]
    assert order == sorted(order)


def test_policy_at_its_bounds(spark):
    import math

    cases = [("phone", math.nextafter(0.5, 0), "discard"), ("phone", 0.5, "redact_and_review"), ("phone", 0.85, "redact"), ("personal_url", 0.9, "detected_not_redacted"), ("salary", 0.9, "detected_not_redacted")]
    df = spark.createDataFrame(cases, "e string, c double, want string")
    assert [r.got for r in df.select(resolve.action(F.col("e"), F.col("c"), mask_salary=False).alias("got")).collect()] == [x[2] for x in cases]


def test_searchable_values(spark):
    cases = [("email", "a.b@cd.ef", True), ("email", "a@b.c", False), ("candidate_name", "Nguyen Mau", True), ("candidate_name", "Nguyenmau", False), ("date_of_birth", "01/01/1990", True), ("date_of_birth", "thirty one", False), ("postal_address", "12 Pho Mau", True), ("postal_address", "12 Phomau", False), ("gender", "female person", False)]
    df = spark.createDataFrame([(e, v) for e, v, _ in cases], "e string, v string")
    assert [r.p is not None for r in df.select(verify.value_pattern(F.col("e"), F.col("v")).alias("p")).collect()] == [x[2] for x in cases]
    values = spark.createDataFrame([(1, "candidate_name", "Nguyễn Văn Mẫu"), (2, "candidate_name", "Ann Example")], "document_id int, entity_type string, value string")
    outputs = spark.createDataFrame([(1, 0, "NGUYEN-VAN  MAU was here"), (2, 0, "see https://linkedin.com/in/ann-example")], "document_id int, part_seq int, text string")
    assert [r.document_id for r in verify.residues(values, outputs).collect()] == [1]
    assert [scan.value_pattern(e, v) is not None for e, v, _ in cases] == [x[2] for x in cases]
    import unicodedata

    pages = spark.createDataFrame([(1, i, i + 1, unicodedata.normalize("NFD", t)) for i, t in enumerate(["Nguyễn Văn Mẫu", "x", "nguyen van mau"])] + [(2, 0, 1, "x")], "document_id int, part_seq int, page_number int, text string")
    raw = spark.createDataFrame([(1, "Nguyen Van Mau"), (2, "/Title (Ann Example)"), (2, "Ann Example")], "document_id int, text string")
    assert sorted(tuple(r) for r in verify.residual_counts(verify.residues(values, pages, raw)).collect()) == [(1, "candidate_name", 2, [1, 3]), (2, "candidate_name", 1, [])]


N = 100_000
LONG_LINES = [" " * N + "x", "Kinh nghiệm" + " " * N + "x", "\t" * N + "x", "a" * N, "1" * N, "1." * (N // 2), "1 " * (N // 2), "a._%+-" * (N // 6), "a@" + "b" * N, "a@" + "b." * (2 * N), "a@b." * (N // 4), "1,000 " * (N // 6), "Ab " * (N // 3), "Địa chỉ: " + "ă " * (N // 2), "Tên - " * (N // 6)]
MORE_LINES = ["ngay sinh " * (N // 10), "age" + " " * N, "luong 1,000 " * (N // 12), "name: Jane Sample\n" * (N // 20), "ngay sinh 1 " * (N // 12), "|" * N, "e\u0301" * N]


@pytest.mark.parametrize("text", [*LONG_LINES, *MORE_LINES], ids=range(len(LONG_LINES) + len(MORE_LINES)))
def test_long_lines(text):
    import time

    began = time.time()
    document = [scan.Part(0, None, "word/document.xml", text + "\nKỹ năng")]
    found, _ = scan.judged(document)
    scan.verdict(document, found, [scan.redacted(document[0].text, scan.ranges(f.hit for f in found[0]))])
    assert time.time() - began < 5
