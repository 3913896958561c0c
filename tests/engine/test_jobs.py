import random

from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.operators import jobs, records

EVENT = "document_id int, seq int, command string, code string, reasons array<string>, outcome string, codes array<string>, format string, input_ref string, output_ref string, at timestamp"
UP = {"format": "docx", "input_ref": "in"}
OUT = {"output_ref": "out", "reasons": []}
START = [("mark_uploaded", UP), ("start_validation", {}), ("validation_passed", {}), ("start_processing", {})]
#: name: commands, and the state, version, refusals, code and reasons they end in.
WALKS = {
    "completed": ([*START, ("output_written", OUT), ("record_verification", {"outcome": "passed"})], ("completed", 6, 0, None, [])),
    "held and approved": ([*START, ("output_written", OUT | {"reasons": ["MAP_AMBIGUOUS"]}), ("record_verification", {"outcome": "passed"}), ("approve_review", {})], ("completed", 7, 0, None, [])),
    "held by the verifier": ([*START, ("output_written", OUT), ("record_verification", {"outcome": "review_required"}), ("approve_review", {}), ("deny_review", {})], ("rejected", 7, 1, None, [])),
    "failed verification": ([*START, ("output_written", OUT), ("record_verification", {"outcome": "failed", "codes": ["VERIFY_OUTPUT_INVALID", "VERIFY_RESIDUAL_DETECTION"]})], ("failed", 6, 0, "VERIFY_RESIDUAL_DETECTION", [])),
    "code of another format": ([*START, ("output_written", OUT), ("record_verification", {"outcome": "failed", "codes": ["VERIFY_PAGE_COUNT_MISMATCH"]})], ("verifying", 5, 1, None, [])),
    "blocking reason": ([*START[:2], ("validation_needs_review", {"reasons": ["PDF_ENCRYPTED"]}), ("validation_needs_review", {"reasons": ["DOCX_NO_TEXT"]}), ("approve_review", {})], ("review_required", 3, 2, None, ["DOCX_NO_TEXT"])),
    "codes by stage": ([*START[:2], ("fail", {"code": "MAP_FAILED"}), ("fail", {"code": "PDF_MALFORMED"}), ("fail", {"code": "DOCX_MALFORMED"})], ("failed", 3, 2, "DOCX_MALFORMED", [])),
    "timeout anywhere": ([*START, ("output_written", OUT), ("fail", {"code": "JOB_TIMEOUT"})], ("failed", 6, 0, "JOB_TIMEOUT", [])),
    "refused upload": ([("reject_upload", {"code": "PDF_MALFORMED"}), ("reject_upload", {"code": "UPLOAD_DUPLICATE"}), ("cancel", {})], ("failed", 1, 2, "UPLOAD_DUPLICATE", [])),
    "cancelled while waiting": ([("mark_uploaded", UP), ("cancel", {}), ("start_validation", {})], ("cancelled", 2, 1, "JOB_CANCELLED", [])),
    "output that is the input": ([*START, ("output_written", {"output_ref": "in", "reasons": []}), ("cancel", {}), ("interrupt", {})], ("failed", 5, 2, "JOB_INTERRUPTED", [])),
    "unknown command": ([("explode", {}), ("mark_uploaded", {"format": "txt", "input_ref": "x"})], ("created", 0, 2, None, [])),
}


def events(spark, walks):
    names = [x.split()[0] for x in EVENT.split(", ")][3:]
    return spark.createDataFrame([(i, k, command, *[more.get(n) for n in names]) for i, walk in enumerate(walks) for k, (command, more) in enumerate(walk)], EVENT)


def test_walks(spark):
    got = {r.document_id: (r.state, r.version, r.refused, r.error_code, r.reasons) for r in jobs.replay(events(spark, [w for w, _ in WALKS.values()])).collect()}
    assert {name: got[i] for i, name in enumerate(WALKS)} == {name: want for name, (_, want) in WALKS.items()}


def test_random_walks_keep_the_invariants(spark):
    """Whatever is asked, a job that only took what it allows breaks no rule."""
    r = random.Random(7)
    codes = ["UPLOAD_DUPLICATE", "PDF_MALFORMED", "DOCX_MALFORMED", "MAP_FAILED", "INTERNAL_ERROR", "JOB_TIMEOUT", "SECURITY_RATE_LIMITED", "VERIFY_RESIDUAL_FINDING", None]
    reasons = [[], ["MAP_AMBIGUOUS"], ["PDF_ENCRYPTED"], ["DOCX_NO_TEXT"], ["VERIFY_REVIEW"], None]

    def event():
        likely = r.choice([*c.COMMANDS, "start_validation", "validation_passed", "start_processing", "output_written", "record_verification"])
        return likely, {"code": r.choice(codes), "reasons": r.choice(reasons), "outcome": r.choice(["passed", "review_required", "failed", None]), "codes": r.choice([[], ["VERIFY_RESIDUAL_FINDING"], ["VERIFY_PAGE_COUNT_MISMATCH"], None]), "format": r.choice(["pdf", "docx"]), "input_ref": "in", "output_ref": r.choice(["out", "out2", "in"])}

    done = jobs.replay(events(spark, [[event() for _ in range(25)] for _ in range(300)]))
    at = F.timestamp_seconds(F.lit(1))
    rows = done.select("*", at.alias("created_at"), at.alias("uploaded_at"), F.lit("0").alias("content_sha256"), F.lit(5).alias("size_bytes"), (F.col("attempt") > 0).alias("has_policy"), F.col("output_ref").isNotNull().alias("has_counts"), F.lit(0).alias("hidden"), F.when(F.col("outcome").isNotNull(), F.col("output_ref")).alias("verified_ref")).withColumn("updated_at", at)
    rows = rows.withColumn("uploaded_at", F.when(F.col("input_ref").isNotNull(), at)).withColumn("content_sha256", F.when(F.col("input_ref").isNotNull(), F.lit("0"))).withColumn("size_bytes", F.when(F.col("input_ref").isNotNull(), F.lit(5)))
    found = records.violations(rows, records.job_rules()).select("state", "violations").collect()
    assert len({x.state for x in found}) > 5 and [x for x in found if x.violations] == []


def test_batches(spark):
    walk = [("start", None, None), ("add_document", None, None), ("set_mask_salary", False, None), ("start", None, None), ("add_document", None, None), ("finish", None, False), ("finish", None, True), ("record_retry", None, None), ("purge", None, None), ("purge", None, None)]
    full = [("add_document", None, None)] * 52 + [("remove_document", None, None)]
    rows = [(b, i, *x) for b, w in enumerate((walk, full)) for i, x in enumerate(w)]
    got = jobs.replay_batches(spark.createDataFrame(rows, "batch_id int, seq int, command string, mask_salary boolean, settled boolean")).orderBy("batch_id").collect()
    assert [tuple(x) for x in got] == [(0, "purged", 1, False, 6, 4), (1, "open", 49, True, 51, 2)]


def test_values(spark):
    row = spark.createDataFrame([("3f2b8c1e-0000-4000-8000-00000000000a", "0" * 64, "a.b-c_1", "1.2.3", 0.5), ("3F2b8c1e", "0" * 63, "A", "1.02.3", float("nan"))], "u string, s string, i string, v string, x double").coalesce(1)
    rules = records.value_rules({"u": "uuid", "s": "sha256", "i": "identifier", "v": "semver", "x": "share"})
    assert [r.violations for r in records.violations(row, rules).collect()] == [[], ["u_uuid", "s_sha256", "i_identifier", "v_semver", "x_share"]]


def test_next_and_late_deliveries(spark, tmp_path):
    from inkveil.streaming import queue

    batches = spark.createDataFrame([(1, "running", 2), (2, "running", 1), (3, "open", 0)], "batch_id int, state string, created_at int")
    documents = spark.createDataFrame([(1, 10, "uploaded", 1), (2, 21, "uploaded", 9), (2, 20, "completed", 1), (3, 30, "uploaded", 0)], "batch_id int, document_id int, state string, created_at int")
    assert tuple(jobs.next_document(documents, batches).first()) == (2, 21)
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "document_id int, attempt int").withColumn("at", F.timestamp_seconds(F.lit(1)))
    rows.write.parquet(str(tmp_path / "in"))
    stream = queue.queued(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    queue.start(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    assert sorted((r.document_id, r.attempt) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2)]
