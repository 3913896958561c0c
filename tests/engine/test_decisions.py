from pyspark.sql import functions as F

from inkveil.operators import jobs


def test_codes(spark):
    rows = [("DOCX_MACRO_OR_TEMPLATE",), ("DOCX_MALFORMED",), ("PDF_ENCRYPTED",), ("VERIFY_STRUCTURE_MISMATCH",), ("VERIFY_PAGE_COUNT_MISMATCH",), ("REDACT_FAILED",), ("INTERNAL_ERROR",), (None,)]
    x = F.col("x")
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").coalesce(1).select(jobs.code_group(x).alias("a"), jobs.code_format(x).alias("b"), jobs.retryable(x).alias("c")).collect()]
    assert got == [("upload", None, False), ("validation", "docx", False), ("validation", "pdf", False), ("verification", "docx", False), ("verification", "pdf", False), ("processing", None, True), ("internal", None, True), (None, None, False)]


def test_states_after_verification(spark):
    rows = [("passed", [], []), ("passed", ["MAP_AMBIGUOUS"], []), ("review_required", [], []), ("failed", ["MAP_AMBIGUOUS"], ["VERIFY_OUTPUT_INVALID", "VERIFY_RESIDUAL_DETECTION"])]
    df = spark.createDataFrame(rows, "outcome string, reasons array<string>, codes array<string>").coalesce(1)
    df = df.select("outcome", jobs.verified(F.col("outcome"), F.col("reasons"), F.col("codes")).alias("v")).select("outcome", "v.*")
    may, down = jobs.may_approve(F.col("state"), F.col("review_reasons"), F.col("outcome")), jobs.downloadable(F.col("state"), F.col("error_code"), F.lit(True))
    got = [tuple(r) for r in df.select("state", "review_reasons", "error_code", may.alias("may"), down.alias("down")).collect()]
    assert got == [
        ("completed", [], None, False, True), ("review_required", ["MAP_AMBIGUOUS"], None, True, True), ("review_required", ["VERIFY_REVIEW"], None, False, True),
        ("failed", [], "VERIFY_RESIDUAL_DETECTION", False, True),
    ]


def test_reasons_and_outputs(spark):
    rows = [("failed", "DOCX_MALFORMED", True), ("completed", None, False), ("failed", None, True)]
    df = spark.createDataFrame(rows, "s string, c string, o boolean").coalesce(1)
    assert [r.x for r in df.select(jobs.downloadable(F.col("s"), F.col("c"), F.col("o")).alias("x")).collect()] == [False, False, False]
    mixed = spark.createDataFrame([(["MAP_AMBIGUOUS", "VERIFY_REVIEW"],), ([],)], "r array<string>").coalesce(1)
    assert [r.x for r in mixed.select(jobs.may_approve(F.lit("review_required"), F.col("r"), F.lit("passed")).alias("x")).collect()] == [False, False]
