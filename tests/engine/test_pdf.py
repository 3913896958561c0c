import pytest
from pyspark.sql import functions as F

from inkveil.sources import pdf
from inkveil.sources.pdf import Layers, Unsafe, parsed, without_hidden

GROUPS = {1: b"<< /Type /OCG /Name (On) >>", 2: b"<< /Type /OCG /Name (Off) >>", 3: b"<< /Type /OCMD /OCGs [1 0 R 2 0 R] /P /AllOn >>", 4: b"<< /Type /OCMD /VE [/Not 4 0 R] >>", 5: b"[1 0 R 2 0 R]", 6: b"[/Or 2 0 R [/Not 2 0 R]]"}
LAYERS = Layers(GROUPS, {2})


@pytest.mark.parametrize(
    ("membership", "hidden"),
    [
        (b"1 0 R", False), (b"2 0 R", True), (b"3 0 R", True), (b"4 0 R", True), (b"99 0 R", False), (b"<< /Type /OCMD /OCGs [1 0 R 2 0 R] >>", False), (b"<< /Type /OCMD /OCGs [1 0 R 2 0 R] /P /AnyOn >>", False),
        (b"<< /Type /OCMD /OCGs [1 0 R 2 0 R] /P /AnyOff >>", False), (b"<< /Type /OCMD /OCGs [1 0 R] /P /AnyOff >>", True), (b"<< /Type /OCMD /OCGs [2 0 R] /P /AllOff >>", False), (b"<< /Type /OCMD /OCGs 2 0 R >>", True), (b"<< /Type /OCMD /OCGs 5 0 R /P /AllOn >>", True),
        (b"<< /Type /OCMD >>", False), (b"<< /VE [/And 1 0 R [/Not 2 0 R]] >>", False), (b"<< /VE [/Or 2 0 R 2 0 R] >>", True), (b"<< /VE 6 0 R >>", False), (b"<< /VE [/Xor 1 0 R] >>", True), (b"<< /VE [/Not 1 0 R 2 0 R] >>", True),
        (b"<< /VE " + b"[/Not " * 9 + b"1 0 R" + b"]" * 9 + b" >>", True), (b"<< /Type /OCG /Name (Off) >>", True), (b"<< /Type /OCG /Name (On) >>", False), (b"<< /Type /OCG /Name (None) >>", True), (b"<< /Type /Page >>", True), (b"(x)", True), (b"<< /Type", True),
    ],
)
def test_layers(membership, hidden):
    assert LAYERS.hides(membership) is hidden


def test_objects():
    assert parsed(rb"<< /A#20b [1 -2.5 (a\)(b)) <41> true null /N] % end" + b"\n/C << /D 3 0 R >> >>") == {"A b": [1.0, -2.5, rb"a\)(b)", b"41", True, None, "/N"], "C": {"D": ("R", 3)}}
    for bad in (b"<< /A >>", b"[1", b"1 2", b"]", b"(x", b"(" * 65 + b")" * 65, b"{", b"R"):
        with pytest.raises(Unsafe):
            parsed(bad)


def strip(stream):
    return without_hidden(stream, lambda n: n == b"Off", lambda n: n == b"Fm", lambda raw: LAYERS.hides(raw))


@pytest.mark.parametrize(
    ("stream", "done"),
    [
        (b"BT (a) Tj ET", b"BT (a) Tj ET"), (b"/OC /On BDC (a) Tj EMC", b"  (a) Tj  "), (b"/OC /Off BDC (a) Tj EMC (b) Tj", b"      (b) Tj"), (b"/OC /O#66f BDC [(a) 3] TJ EMC", b"     "),
        (b"/OC /Off BDC /P BMC (x) ' EMC 1 2 (y) \" 0 0 m f* EMC", b"  /P BMC  T*  EMC  1 Tw 2 Tc T*  0 0 m  n   "), (b"/Fm Do /Im Do", b"  /Im Do"), (b"/OC /Off BDC /Im Do 3 Tr EMC", b"    3 Tr  "),
        (b"/OC << /VE [/Not 1 0 R] >> BDC (a) Tj EMC", b"     "), (b"/OC /Off BDC BI /W 1 ID x)EI( EI Q EMC", b"    Q  "), (b"/Span << /A (EMC) >> BDC (k) Tj EMC", b"/Span << /A (EMC) >> BDC (k) Tj EMC"), (b"% EMC\n(a) Tj", b"% EMC\n(a) Tj"),
    ],
)
def test_streams(stream, done):
    assert b" ".join(strip(stream)[0].split()) == b" ".join(done.split())


@pytest.mark.parametrize("stream", [b"EMC", b"/OC /On BDC", b"(a", b"BDC", b"/OC BDC EMC", b"[1 Tj]", b"Do", b"1 2", b"BI /W 1 ID x", b"]", b"/OC /Off BDC (x) \" EMC", b"{ }"])
def test_refused_streams(stream):
    with pytest.raises(Unsafe):
        strip(stream)


def test_streams_in_tables(spark):
    rows = [(b"/OC /A BDC (x) Tj EMC /F Do /G Do", {1: b"<< /Type /OCG >>", 7: b"<< /OC 1 0 R >>", 8: b"<< >>"}, [1], {"A": 1}, {"F": 7, "G": 8}), (b"EMC", {1: b"<< >>"}, [], {"A": 1}, {"F": 1})]
    df = spark.createDataFrame(rows, "stream binary, objects map<int,binary>, off array<int>, properties map<string,int>, forms map<string,int>").coalesce(1)
    got = [(r.filtered.code, r.filtered.content and bytes(r.filtered.content).split(), r.filtered.cuts) for r in pdf.filtered(df).collect()]
    assert got == [(None, [b"/G", b"Do"], 4), ("REDACT_SANITIZE_FAILED", None, 0)]


def test_words_and_changes(spark):
    words = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0, 5.0, 5.0), (1, 1, 1, "b", 20.0, 0.0, 25.0, 5.0), (1, 2, 0, "c", 0.0, 0.0, 5.0, 5.0)], "document_id int, page_number int, word_seq int, word string, x0 double, y0 double, x1 double, y1 double")
    hidden = spark.createDataFrame([(1, 1, [4.0, 4.0, 9.0, 9.0])], "document_id int, page_number int, box array<double>")
    assert sorted(r.word for r in pdf.visible_words(words, hidden).collect()) == ["b", "c"]
    changes = spark.createDataFrame([(1, 1, [2.0, 2.0, 11.0, 11.0]), (1, 1, [0.0, 4.0, 9.0, 9.0]), (1, 2, [0.0, 0.0, 1.0, 1.0])], "document_id int, page_number int, box array<double>")
    assert sorted((r.page_number, r.box[0]) for r in pdf.strayed(changes, hidden).collect()) == [(1, 0.0), (2, 0.0)]
    sizes = spark.createDataFrame([("[ID]", [0.0, 0.0, 100.0, 20.0]), ("[ID]", [0.0, 0.0, 14.0, 20.0]), ("[REDACTED]", [0.0, 0.0, 20.0, 20.0])], "label string, box array<double>").coalesce(1)
    assert [r.s for r in sizes.select(pdf.label_size(F.col("label"), F.col("box")).alias("s")).collect()] == [10.0, 7.5, None]


def test_equal_layers_are_read_once(spark, monkeypatch):
    read = []
    hides = pdf.Layers.hides
    monkeypatch.setattr(pdf.Layers, "hides", lambda self, m, *a: read.append(m) or hides(self, m, *a))
    made = []
    monkeypatch.setattr(pdf.F, "pandas_udf", lambda f, kind: made.append(f) or (lambda *_: pdf.F.lit(True)))
    pdf.layer_hidden(spark.range(1))
    import pandas as pd

    member, objects = b"<< /Type /OCMD /OCGs [1 0 R] /P /AllOn >>", {1: b"<< /Type /OCG /Name (a) >>"}
    got = made[0](pd.Series([member] * 100), pd.Series([objects] * 100), pd.Series([[1], []] * 50))
    assert list(got) == [True, False] * 50 and sum(m == member for m in read) == 2
