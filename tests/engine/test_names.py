import pytest

from inkveil.operators import names, resolve
from inkveil.plans import detection

BILINGUAL = """Nguyễn Văn Mẫu
Số 1 đường Ví Dụ, phường Mẫu, quận Thử | 0900000000
Email: mau.nguyen@example.test
Kinh nghiệm làm việc / Work experience
Example Bank Ltd - Senior Analyst
CÔNG TY TNHH VÍ DỤ
Học vấn / Education
Example University
Thông tin gia đình
Bố: Trần Thị Thử - 1960 - Hưu trí
Người tham chiếu / References
Ông John Sample - Example Bank Ltd
Kỹ năng
Cam đoan: Nguyen Van Mau"""

#: text: [(entity, value, confidence, detector)] of its names.
CASES = {
    "Họ và tên: Nguyễn Văn Mẫu\nĐiện thoại: 0900000000": [("candidate_name", "Nguyễn Văn Mẫu", 0.95, "name.label")],
    "Full name: Jane Example | Email: jane@example.test": [("candidate_name", "Jane Example", 0.95, "name.label")],
    "Họ tên: nguyễn văn mẫu": [("candidate_name", "nguyễn văn mẫu", 0.75, "name.label")],
    "Name: Jane 2 Example": [],
    "Name: Example Bank": [],
    "Nguyễn Văn Mẫu\nEmail: zzz.qqq@example.test\nKỹ năng\nPython": [("candidate_name", "Nguyễn Văn Mẫu", 0.70, "name.header")],
    "Nguyễn Văn Mẫu\nEmail: mau.nguyen@example.test\nKỹ năng": [("candidate_name", "Nguyễn Văn Mẫu", 0.85, "name.header")],
    "Jane Example\nEmail: zzz.qqq@example.test\nSkills": [("candidate_name", "Jane Example", 0.60, "name.header")],
    "Jane Example 0900000000 • jane.example@example.test": [("candidate_name", "Jane Example", 0.75, "name.header")],
    "Programming Languages: Java\nEnglish Spoken: Good\nJane Example\nSkills\nJohn Sample": [("candidate_name", "Jane Example", 0.55, "name.header")],
    "NGUYỄN VĂN A\nSoftware Developer": [("candidate_name", "NGUYỄN VĂN A", 0.70, "name.header")],
    "NGUYỄN THỊ VÍ DỤ Software Developer\nHo Chi Minh City": [("candidate_name", "NGUYỄN THỊ VÍ DỤ", 0.70, "name.header")],
    "  - Jane Example\n\nSkills\nExample Jane, example   jane": [("candidate_name", "Jane Example", 0.60, "name.header"), ("candidate_name", "Example Jane", 0.60, "name.repeat"), ("candidate_name", "example   jane", 0.60, "name.repeat")],
    "References\nMr. John Sample - Director\nMary Sample, 0900000000\nName: Ann Other\nName: ann other\nSkills\nPaul Other": [
        ("reference_name", "John Sample", 0.90, "reference_name.honorific"), ("reference_name", "Mary Sample", 0.75, "reference_name.line"),
        ("reference_name", "Ann Other", 0.95, "reference_name.label"), ("reference_name", "ann other", 0.75, "reference_name.label")],
    "Name: Jane Example\nName: JANE EXAMPLE": [("candidate_name", "Jane Example", 0.95, "name.label"), ("candidate_name", "JANE EXAMPLE", 0.95, "name.label")],
    "": [],
    "\n\n \n": [],
}
CONFOUNDERS = ["CÔNG TY TNHH VÍ DỤ", "Example Bank Ltd", "Trường Đại Học Ví Dụ", "Example University", "Ngân Hàng Ví Dụ", "Senior Software Engineer", "Chuyên Viên Phân Tích", "Thành Phố Hồ Chí Minh", "CURRICULUM VITAE", "Sơ Yếu Lý Lịch", "Kinh Nghiệm Làm Việc", "Personal Information", "Programming Languages", "jane example", "Jane", "A B", "Jane Example: Sample"]


def parts(spark, rows):
    return spark.createDataFrame(rows, "document_id int, part_seq int, page_number int, part_name string, text string")


def named(hits):
    return hits.where("entity_type in ('candidate_name', 'reference_name')")


def test_cases(spark):
    texts = [*CASES, *CONFOUNDERS]
    frame = parts(spark, [(i, 0, None, "word/document.xml", t) for i, t in enumerate(texts)] + [(-1, 0, None, "word/document.xml", None)])
    found = {}
    for r in resolve.merge_same_type(named(detection.all_hits(frame))).orderBy("start").collect():
        found.setdefault(r.document_id, []).append((r.entity_type, texts[r.document_id][r.start : r.end], round(r.confidence, 2), r.detector_id))
    for i, t in enumerate(texts):
        assert found.get(i, []) == CASES.get(t, []), t
    assert -1 not in found


def test_bilingual_document(spark):
    frame = parts(spark, [(1, 0, None, "word/document.xml", BILINGUAL)])
    got = {(r.entity_type, BILINGUAL[r.start : r.end]) for r in resolve.resolve(detection.all_hits(frame)).collect()}
    assert got == {
        ("candidate_name", "Nguyễn Văn Mẫu"), ("candidate_name", "Nguyen Van Mau"), ("postal_address", "Số 1 đường Ví Dụ, phường Mẫu, quận Thử"), ("phone", "0900000000"),
        ("email", "mau.nguyen@example.test"), ("family_details", "Bố: Trần Thị Thử - 1960 - Hưu trí"), ("reference_name", "John Sample"),
    }


def test_parts_and_layout(spark):
    """The best header of several contact parts repeats into the body; the largest line scores higher."""
    rows = [(1, 0, None, "word/header1.xml", "NGUYỄN VĂN MẪU"), (1, 1, None, "word/document.xml", "Email: mau.nguyen@example.test\nMục tiêu\nTôi là Nguyễn Văn Mẫu."), (2, 0, 1, None, "Nguyễn Thị Mẫu\nx y\nz w"), (2, 1, 2, None, "Other Person\nMẫu Nguyễn")]
    heights = spark.createDataFrame([(2, 0, 0, 20.0), (2, 0, 1, 10.0), (2, 0, 2, 10.0)], "document_id int, part_seq int, line_no int, height double")
    got = [(r.document_id, r.part_seq, r.start, r.end, round(r.confidence, 2), r.detector_id) for r in named(detection.all_hits(parts(spark, rows), heights)).orderBy("document_id", "part_seq", "start").collect()]
    assert got == [(1, 0, 0, 14, 0.85, "name.header"), (1, 1, 47, 61, 0.85, "name.repeat"), (2, 0, 0, 14, 0.9, "name.header"), (2, 1, 13, 23, 0.9, "name.repeat")]


@pytest.mark.parametrize("tokens, mail, agrees", [(["nguyen", "mau"], ["mau", "nguyen"], True), (["nguyen", "mau"], ["mau"], True), (["jane", "poe"], ["xjanex"], True), (["poe"], ["xpoex"], False), (["van", "thi"], ["van"], False), (["ann"], None, False)])
def test_mail_agreement(tokens, mail, agrees):
    assert names.mail_agrees(tokens, mail or []) is agrees


def test_variants():
    assert names.variants(("a", "b", "c")) == [("a", "b", "c"), ("c", "a", "b"), ("a", "c"), ("c", "a")]
    assert names.variants(("a", "b")) == [("a", "b"), ("b", "a")] and names.variants(("a",)) == [("a",)]
