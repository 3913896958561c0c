import numpy as np
import pytest

from inkveil.functions.text import lines
from inkveil.operators import geometry as g
from inkveil.plans import detection

WORD = "document_id int, page_number int, word_seq int, word string, x0 double, y0 double, x1 double, y1 double"


def page(*words):
    """Rows of words: (word, x0, y0) of height 10 and 6 a letter, or with x1 and y1."""
    return [(1, 1, i, w[0], float(w[1]), float(w[2]), float(w[3] if len(w) > 3 else w[1] + 6 * len(w[0])), float(w[4] if len(w) > 4 else w[2] + 10)) for i, w in enumerate(words)]


def spot(spark, words, start, end):
    parts = g.page_parts(spark.createDataFrame(words, WORD))
    hits = spark.createDataFrame([(1, 0, start, end)], "document_id int, part_seq int, start int, end int")
    r = g.placed(parts, hits).first()
    return r if r.boxes is None else (r.boxes, r.ambiguous, r.partial_words)


def test_text_and_heights(spark):
    words = page(("Jane", 0, 0, 50, 20), ("Example", 60, 0, 130, 20), ("mail", 0, 30), ("skill", 0, 45))
    parts = g.page_parts(spark.createDataFrame(words, WORD))
    row = parts.first()
    assert (row.text, row.part_seq, [(s.start, s.end) for s in row.spans]) == ("Jane Example\nmail\nskill", 0, [(0, 4), (5, 12), (13, 17), (18, 23)])
    heights = g.line_heights(parts, lines(parts))
    assert sorted((r.line_no, r.height) for r in heights.collect()) == [(0, 20.0), (1, 10.0), (2, 10.0)]
    assert "largest_font" in detection.all_hits(parts.drop("spans"), heights).where("detector_id = 'name.header'").first().signals
    assert parts.select(g.unreadable(parts.text).alias("x")).first().x is False


CASES = {
    "joined along the line": (page(("ab", 0, 0), ("cd", 14, 0)), 0, 5, ([[0, 0, 26, 10]], False, 0)),
    "part of a word takes it whole": (page(("abcd", 0, 0)), 1, 3, ([[0, 0, 24, 10]], False, 1)),
    "wide gap": (page(("ab", 0, 0), ("cd", 40, 0)), 0, 5, ([[0, 0, 12, 10], [40, 0, 52, 10]], False, 0)),
    "two lines": (page(("ab", 0, 0), ("cd", 0, 20)), 0, 5, ([[0, 0, 12, 10], [0, 20, 12, 30]], False, 0)),
    "drawn twice": (page(("ab", 0, 0), ("zz", 40, 40), ("ab", 1, 0)), 0, 2, ([[0, 0, 12, 10], [1, 0, 13, 10]], True, 0)),
    "a neighbour stands between": (page(("ab", 0, 0), ("cd", 20, 0), ("x", 13, 0, 19, 10)), 0, 5, ([[0, 0, 12, 10], [20, 0, 32, 10]], False, 0)),
    "neighbouring line stays out": (page(("ab", 0, 0), ("cd", 0, 10)), 0, 2, ([[0, 0, 12, 10]], False, 0)),
}


@pytest.mark.parametrize("name", CASES)
def test_placing(spark, name):
    words, start, end, expected = CASES[name]
    assert spot(spark, words, start, end) == expected


def test_unplaceable(spark):
    parts = spark.createDataFrame([(1, 0, 1, "ab cd", [(0, 2, [[0.0, 0.0, 9.0, 9.0]]), (3, 5, [])]), (2, 0, 1, "ab", [])], f"document_id int, part_seq int, page_number int, text string, spans array<struct<start:int,end:int,boxes:{g.BOXES}>>")
    hits = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 3), (2, 0, 0, 2)], "document_id int, part_seq int, start int, end int")
    found = g.placed(parts, hits)
    assert sorted((r.document_id, r.end, r.boxes) for r in found.collect()) == [(1, 3, [[0.0, 0.0, 9.0, 9.0]]), (1, 5, None), (2, 2, None)]
    assert sorted(tuple(r) for r in g.unplaceable(found).collect()) == [(1, True, False), (2, True, False)]


def test_regions_and_residues(spark):
    rows = [(1, 1, "a", "phone", [[0.0, 0.0, 10.0, 10.0]]), (1, 1, "b", "national_id", [[8.0, 0.0, 20.0, 10.0], [0.0, 50.0, 9.0, 60.0]]), (1, 1, "c", "email", [[0.0, 20.0, 9.0, 30.0]]), (1, 2, "d", "religion", [[0.0, 0.0, 9.0, 9.0]]), (1, 2, "e", "gender", [[1.0, 0.0, 9.0, 9.0]]), (1, 1, "f", "phone", [[5.0, 51.0, 30.0, 60.0]])]
    found = spark.createDataFrame(rows, f"document_id int, page_number int, finding_id string, entity_type string, boxes {g.BOXES}")
    got = sorted((r.page_number, r.boxes, r.entity_type, r.replacement_label, r.finding_ids) for r in g.regions(found).collect())
    assert got == [
        (1, [[0, 0, 20, 10], [0, 50, 30, 60]], "national_id", "[ID]", ["a", "b", "f"]),
        (1, [[0, 20, 9, 30]], "email", "[EMAIL]", ["c"]),
        (2, [[0, 0, 9, 9]], "gender", "[REDACTED]", ["d", "e"]),
    ]
    words = spark.createDataFrame(page(("[ID]", 0, 0), ("left", 0, 21, 8, 29)), WORD)
    assert [r.finding_id for r in g.box_residues(found, words, ["[ID]"]).collect()] == ["c"]


def test_groups_against_search():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lists = [[[x, y, x + w, y + 10] for x, y, w in zip(rng.integers(0, 60, k), rng.integers(0, 4, k) * 12, rng.integers(1, 15, k), strict=True)] for k in rng.integers(1, 3, 12)]
        near = [[any(g.overlap(np.array(a, float), np.array(b, float)) for a in x for b in y) for y in lists] for x in lists]
        reach = {}
        for i in range(len(lists)):
            seen, todo = {i}, [i]
            while todo:
                at = todo.pop()
                new = [j for j in range(len(lists)) if near[at][j] and j not in seen]
                seen.update(new)
                todo += new
            reach[i] = min(seen)
        assert g.groups(lists).tolist() == list(reach.values())
