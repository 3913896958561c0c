"""What may not grow with the input: joins of hits with themselves, what a task is dealt, what a worker holds."""

from pyspark.sql import functions as F

from inkveil.operators import reports, resolve
from inkveil.plans.storage import TASK_BYTES, dealt

HITS = "document_id int, part_seq int, seq int, entity_type string, start int, end int, confidence double, detector_id string, signals array<string>"


def hits(spark, *rows):
    return spark.createDataFrame([(d, 0, seq, e, s, t, 0.9, f"d{seq}", []) for d, seq, e, s, t in rows], HITS)


def kept(df):
    return sorted((r.document_id, r.entity_type, r.start, r.end) for r in df.collect())


def test_hits_are_resolved_without_a_join(spark):
    df = hits(spark, (1, 0, "email", 0, 9), (1, 1, "phone", 2, 5))
    plan = resolve.resolve(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and kept(resolve.resolve(df)) == [(1, "email", 0, 9)]


def test_hits_that_cover_each_other(spark):
    rows = [
        (1, 5, "gender", 0, 4), (1, 5, "religion", 0, 4),  # equal in all that decides: both stay
        (2, 0, "email", 0, 4), (2, 1, "phone", 0, 4), (2, 2, "gender", 0, 4),  # the highest stays
        (3, 0, "phone", 0, 4), (3, 1, "email", 3, 9), (3, 2, "phone", 5, 9),  # one end shared
        (None, 0, "email", 0, 9), (None, 1, "phone", 2, 5),  # without a document nothing covers
        (4, 0, "phone", 0, 4), (4, 1, "phone", 4, 8), (4, 2, "gender", 4, 4),  # touching, and an empty one
    ]
    want = [(1, "gender", 0, 4), (1, "religion", 0, 4), (2, "email", 0, 4), (3, "email", 3, 9), (3, "phone", 0, 4), (4, "phone", 0, 4), (4, "phone", 4, 8)]
    got = resolve.drop_contained(resolve.merge_same_type(hits(spark, *rows)))
    assert kept(got.where("document_id is not null")) == want
    assert kept(got.where("document_id is null").fillna(0, ["document_id"])) == [(0, "email", 0, 9), (0, "phone", 2, 5)]


def test_hits_that_the_order_leaves_equal_are_one(spark):
    rows = [(d, 1, "email", s, s + 3) for d in range(50) for s in (0, 5, 5, 5, 9)]
    got = resolve.merge_same_type(hits(spark, *rows).repartition(3)).groupBy("document_id").agg(F.count("*").alias("n")).collect()
    assert {r.n for r in got} == {3}


def test_tasks_are_dealt_by_the_size_of_the_input(spark):
    wide, small = spark.range(10**7), spark.range(100)
    assert dealt(wide, "id").rdd.getNumPartitions() == 8 * 10**7 // TASK_BYTES > 4
    assert dealt(small, "id").count() == 100


def test_scores_need_no_join(spark):
    kind = "document_id int, part_key string, entity_type string, start int, end int"
    gold = spark.createDataFrame([(1, "p", "email", 0, 4), (1, "p", "email", 0, 4), (2, "p", "email", 0, 4), (None, "p", "email", 0, 4)], kind)
    told = spark.createDataFrame([(1, "p", "email", 0, 4), (2, "p", "email", 0, 5), (None, "p", "email", 0, 4), (1, "p", "phone", 0, 4)], kind)
    out = reports.scores(gold, told)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.entity_type: (r.gold, r.predicted, r.correct, r.precision, r.recall) for r in out.collect()}
    assert got == {"email": (3, 3, 1, 0.3333, 0.3333), "phone": (0, 1, 0, 0.0, None)}


def test_a_sharp_s_is_no_letter_of_a_searched_value(spark, tmp_path):
    from inkveil.plans.queries import QUERIES

    texts = {0: "schßst", 1: "schßste", 2: "ÉÈÀçüö", 3: "Đâ12é", 4: None, 5: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.searched for r in QUERIES["value_searchable"](spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: None, 5: False}


def test_values_are_searched_as_their_pattern_would(monkeypatch):
    import random
    import re

    from inkveil.operators import scan

    r = random.Random(1)
    for _ in range(20_000):
        tokens = ["".join(r.choice("ab1") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))]
        text = "".join(r.choice("ab1 -.é") for _ in range(r.randint(0, 14)))
        plain = re.search(r"(?<![a-z0-9])" + "[^a-z0-9]{0,3}".join(tokens) + r"(?![a-z0-9])", text)
        assert scan.holds(text, tokens) == (plain is not None)
    monkeypatch.setattr(re, "compile", None)  # a value of its own in each document must compile nothing
    assert scan.still_held([("phone", "0912 345 678")], ["tel 0912-345.678!", "0912345678x"]) == [("phone", 0)]


def test_workers_take_few_rows_at_a_time():
    import pyarrow as pa

    from inkveil.plans.storage import SLICE_BYTES, SLICE_ROWS, in_slices

    short, long = (pa.record_batch([pa.array([x] * 1000)], ["text"]) for x in ("x", "x" * 50_000))
    cut = [list(in_slices(iter([b]))) for b in (short, long)]
    assert [sum(b.num_rows for b in x) for x in cut] == [1000, 1000]
    assert max(b.num_rows for b in cut[0]) == SLICE_ROWS and max(b.nbytes for b in cut[1]) <= SLICE_BYTES + 50_004


def test_children_and_parts_are_told_without_a_join(spark):
    from inkveil.operators import records
    from inkveil.sources import docx

    known = spark.createDataFrame([(1, True, "passed"), (2, False, None)], "document_id int, has_counts boolean, outcome string")
    row = lambda kind, *rows: spark.createDataFrame(list(rows), kind)
    children = {
        "finding_counts": row("document_id int, entity_type string, n int", (1, "email", 1), (1, "email", 2), (2, "phone", 1)), "review_reasons": row("document_id int, reason string", (3, "x"), (None, "x")),
        "verification_failures": row("document_id int, code string", (2, "x")), "hidden_content": row("document_id int, category string, n int", (1, "forms", 1)),
        "residual_counts": row("document_id int, entity_type string, n int", (1, "email", 1)), "residual_pages": row("document_id int, entity_type string, page int", (1, "email", 1), (1, "email", 2), (1, None, 3), (2, "email", 1)),
    }
    out = records.child_violations(known, children)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r.document_id or 0), r.violation) for r in out.collect()) == [
        (0, "review_reasons_orphan"), (1, "finding_counts_repeat"), (1, "residual_page_without_count"), (2, "finding_counts_unrecorded"),
        (2, "residual_page_without_count"), (2, "residual_pages_unverified"), (2, "verification_failures_unverified"), (3, "review_reasons_orphan"),
    ]
    a, b = row("document_id int, name string", (1, "x"), (1, "x"), (1, "y"), (2, "x")), row("document_id int, name string", (1, "y"), (1, "z"), (3, "x"))
    made = docx.structure_differences(a, b)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, "x", "missing"), (1, "z", "added"), (2, "x", "missing"), (3, "x", "added")]
