"""Queries over jobs, batches, stored files and their rules, and their SQL. Orders stand for documents, line items for events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.operators import jobs, records, reports
from inkveil.plans.storage import dealt

WALK = ("mark_uploaded", "start_validation", "validation_passed", "start_processing", "output_written", "record_verification", "approve_review")
CODES = ("UPLOAD_UNSUPPORTED_TYPE", "PDF_MALFORMED", "DOCX_MALFORMED", "MAP_FAILED", "STORAGE_WRITE_FAILED", "INTERNAL_ERROR", "JOB_TIMEOUT", "SECURITY_RATE_LIMITED", "VERIFY_RESIDUAL_FINDING", "JOB_CANCELLED")
REASONS = ((), ("DETECT_LOW_CONFIDENCE",), ("PDF_ENCRYPTED",), ("DOCX_NO_TEXT",), ("MAP_AMBIGUOUS", "DETECT_NO_CANDIDATE_NAME"), ("VERIFY_REVIEW",))
FAILURES = (("VERIFY_RESIDUAL_FINDING",), ("VERIFY_PAGE_COUNT_MISMATCH", "VERIFY_RESIDUAL_DETECTION"), ("VERIFY_STRUCTURE_MISMATCH",))
OUTCOMES = ("passed", "review_required", "failed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(values: tuple, number: Column | str) -> Column:
    """The value at number modulo their count; a tuple of strings is an array."""
    made = [F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, tuple) else F.lit(v) for v in values]
    at = F.expr(number) if isinstance(number, str) else number
    return F.element_at(F.array(*made), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def sql_of(values: tuple, number: str) -> str:
    made = ["[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, tuple) else f"'{v}'" for v in values]
    return f"([{', '.join(made)}])[CAST({number} AS INTEGER) % {len(values)} + 1]"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk through the states for each order, one command in four another one, with what commands carry."""
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    command = F.when(F.expr("l_partkey % 4 = 0"), one_of(tuple(c.COMMANDS), "l_suppkey")).otherwise(one_of(WALK, "l_linenumber - 1"))
    outcome = one_of(OUTCOMES, "l_suppkey")
    codes = F.when(outcome == "failed", one_of(FAILURES, "l_partkey"))
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("seq"), command.alias("command"), one_of(CODES, "l_suppkey").alias("code"), one_of(REASONS[:5], "l_partkey").alias("reasons"), outcome.alias("outcome"), codes.alias("codes"), F.when(F.expr("l_orderkey % 2 = 0"), "pdf").otherwise("docx").alias("format"), F.concat(F.lit("i"), "l_orderkey").alias("input_ref"), F.concat_ws("-", F.lit("o"), "l_orderkey", "l_linenumber").alias("output_ref"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guarded moves leave each document in."""
    done = jobs.replay(events(spark, sf_dir))
    return done.select("document_id", "state", F.col("version").cast("long").alias("version"), F.col("attempt").cast("long").alias("attempt"), F.col("refused").cast("long").alias("refused"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "outcome", "error_code", "approved", F.col("output_ref"))


_GROUP = "CASE WHEN {0} = 'DOCX_MACRO_OR_TEMPLATE' OR {0} LIKE 'UPLOAD!_%' ESCAPE '!' THEN 'upload' WHEN {0} LIKE 'PDF!_%' ESCAPE '!' OR {0} LIKE 'DOCX!_%' ESCAPE '!' THEN 'validation' WHEN {0} LIKE 'DETECT!_%' ESCAPE '!' OR {0} LIKE 'MAP!_%' ESCAPE '!' OR {0} LIKE 'REDACT!_%' ESCAPE '!' THEN 'processing' WHEN {0} LIKE 'VERIFY!_%' ESCAPE '!' THEN 'verification' WHEN {0} LIKE 'JOB!_%' ESCAPE '!' THEN 'job' WHEN {0} LIKE 'STORAGE!_%' ESCAPE '!' THEN 'storage' WHEN {0} LIKE 'SECURITY!_%' ESCAPE '!' THEN 'security' WHEN {0} IS NOT NULL THEN 'internal' END"
_FORMAT = "CASE WHEN {0} LIKE 'PDF!_%' ESCAPE '!' OR {0} = 'VERIFY_PAGE_COUNT_MISMATCH' THEN 'pdf' WHEN ({0} LIKE 'DOCX!_%' ESCAPE '!' AND {0} <> 'DOCX_MACRO_OR_TEMPLATE') OR {0} = 'VERIFY_STRUCTURE_MISMATCH' THEN 'docx' END"
_KIND = "CASE WHEN {0} IN ('DETECT_LOW_CONFIDENCE', 'DETECT_NO_CANDIDATE_NAME', 'MAP_AMBIGUOUS') THEN 'findings' WHEN {0} = 'VERIFY_REVIEW' THEN 'verifier' WHEN {0} IN ('PDF_ENCRYPTED', 'PDF_TOO_MANY_PAGES', 'PDF_NO_TEXT_LAYER', 'PDF_TEXT_UNRELIABLE', 'DOCX_ENCRYPTED', 'DOCX_TOO_LARGE_TEXT', 'DOCX_NO_TEXT') THEN 'blocking' END"

_EVENTS = f"""ev AS (SELECT l_orderkey AS d, CAST(l_linenumber AS INTEGER) AS k, CASE WHEN l_partkey % 4 = 0 THEN {sql_of(tuple(c.COMMANDS), 'l_suppkey')} ELSE {sql_of(WALK, '(l_linenumber - 1)')} END AS cmd,
        {sql_of(CODES, 'l_suppkey')} AS code, {sql_of(REASONS[:5], 'l_partkey')} AS rs, {sql_of(OUTCOMES, 'l_suppkey')} AS oc,
        {sql_of(FAILURES, 'l_partkey')} AS fc, CASE WHEN l_orderkey % 2 = 0 THEN 'pdf' ELSE 'docx' END AS fmt, 'o-' || l_orderkey || '-' || l_linenumber AS oref FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
    num AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k) AS n FROM ev)"""

JOB_STATES = f"""WITH RECURSIVE {_EVENTS},
    st AS (SELECT DISTINCT d, 0 AS n, 'created' AS s, 0::BIGINT AS v, 0::BIGINT AS a, 0::BIGINT AS refused, []::VARCHAR[] AS r, NULL::VARCHAR AS o, NULL::VARCHAR AS e, false AS ok, NULL::VARCHAR AS f, NULL::VARCHAR AS oref FROM ev
      UNION ALL
      SELECT d, n, CASE WHEN t THEN ns ELSE s END, v + CAST(t AS INTEGER), a + CAST(t AND cmd = 'start_processing' AS INTEGER), refused + CAST(NOT t AS INTEGER),
        CASE WHEN NOT t THEN r WHEN cmd IN ('validation_needs_review', 'output_written') THEN rs WHEN cmd = 'record_verification' THEN CASE oc WHEN 'failed' THEN [] WHEN 'review_required' THEN list_append(r, 'VERIFY_REVIEW') ELSE r END WHEN ns IN ('completed', 'failed', 'rejected', 'cancelled') THEN [] ELSE r END,
        CASE WHEN t AND cmd = 'record_verification' THEN oc ELSE o END,
        CASE WHEN NOT t THEN e WHEN cmd IN ('reject_upload', 'fail') THEN code WHEN cmd = 'interrupt' THEN 'JOB_INTERRUPTED' WHEN cmd = 'cancel' THEN 'JOB_CANCELLED' WHEN cmd = 'record_verification' AND oc = 'failed' THEN fc[len(fc)] ELSE e END,
        ok OR (t AND cmd = 'approve_review'), CASE WHEN t AND cmd = 'mark_uploaded' THEN fmt ELSE f END, CASE WHEN t AND cmd = 'output_written' THEN noref ELSE oref END
      FROM (SELECT *, CASE cmd
          WHEN 'mark_uploaded' THEN s = 'created' WHEN 'reject_upload' THEN s = 'created' AND g IN ('upload', 'storage', 'internal') WHEN 'start_validation' THEN s = 'uploaded' WHEN 'validation_passed' THEN s = 'validating'
          WHEN 'validation_needs_review' THEN s = 'validating' AND len(rs) > 0 AND len(list_filter(rs, lambda x: x NOT LIKE upper(f) || '!_%' ESCAPE '!')) = 0 WHEN 'start_processing' THEN s = 'queued' AND a < 3
          WHEN 'output_written' THEN s = 'processing' AND len(list_filter(rs, lambda x: x LIKE 'PDF!_%' ESCAPE '!' OR x LIKE 'DOCX!_%' ESCAPE '!')) = 0
          WHEN 'record_verification' THEN s = 'verifying' AND (oc <> 'failed' OR (NOT (f = 'docx' AND list_contains(fc, 'VERIFY_PAGE_COUNT_MISMATCH')) AND NOT (f = 'pdf' AND list_contains(fc, 'VERIFY_STRUCTURE_MISMATCH'))))
          WHEN 'approve_review' THEN s = 'review_required' AND o = 'passed' AND len(r) > 0 AND len(list_filter(r, lambda x: x NOT IN ('DETECT_LOW_CONFIDENCE', 'DETECT_NO_CANDIDATE_NAME', 'MAP_AMBIGUOUS'))) = 0
          WHEN 'deny_review' THEN s = 'review_required' WHEN 'interrupt' THEN s IN ('validating', 'processing', 'verifying') WHEN 'cancel' THEN s IN ('created', 'uploaded', 'queued')
          WHEN 'fail' THEN s IN ('validating', 'processing', 'verifying') AND (code = 'JOB_TIMEOUT' OR g IN ('storage', 'internal') OR (s = 'validating' AND g = 'validation') OR (s = 'processing' AND g = 'processing')) AND coalesce(cf = f, true) END IS TRUE AS t,
          CASE cmd WHEN 'mark_uploaded' THEN 'uploaded' WHEN 'start_validation' THEN 'validating' WHEN 'validation_passed' THEN 'queued' WHEN 'start_processing' THEN 'processing' WHEN 'output_written' THEN 'verifying' WHEN 'approve_review' THEN 'completed'
            WHEN 'deny_review' THEN 'rejected' WHEN 'cancel' THEN 'cancelled' WHEN 'validation_needs_review' THEN 'review_required'
            WHEN 'record_verification' THEN CASE WHEN oc = 'failed' THEN 'failed' WHEN oc = 'review_required' OR len(r) > 0 THEN 'review_required' ELSE 'completed' END ELSE 'failed' END AS ns
        FROM (SELECT st.* EXCLUDE (n), num.n, num.cmd, num.code, num.rs, num.oc, num.fc, num.fmt, num.oref AS noref, {_GROUP.format('num.code')} AS g, {_FORMAT.format('num.code')} AS cf FROM st JOIN num ON num.d = st.d AND num.n = st.n + 1)))
    SELECT d AS document_id, s AS state, v AS version, a AS attempt, refused, array_to_string(list_sort(r), ',') AS reasons, o AS outcome, e AS error_code, ok AS approved, oref AS output_ref
    FROM st QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC) = 1"""


def one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's last event would do to a job that has just been queued."""
    last = events(spark, sf_dir).groupBy("document_id").agg(F.max_by(F.struct("command", "code", "reasons", "outcome", "codes", "format", "input_ref", "output_ref"), "seq").alias("e")).select("document_id", "e.*")
    now = jobs.replay(events(spark, sf_dir).select("document_id", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("command")) for i, x in enumerate(WALK[:3])])).alias("e"), "format", "input_ref").select("document_id", "e.*", "format", "input_ref").distinct())
    return jobs.step(now, last).select("document_id", "state", "accepted", "error_code")


ONE_STEP = f"""WITH {_EVENTS}, l AS (SELECT * FROM num QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC) = 1)
    SELECT d AS document_id, CASE cmd WHEN 'start_processing' THEN 'processing' WHEN 'cancel' THEN 'cancelled' ELSE 'queued' END AS state, cmd IN ('start_processing', 'cancel') AS accepted, CASE WHEN cmd = 'cancel' THEN 'JOB_CANCELLED' END AS error_code FROM l"""


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of batches from the line items of each supplier: many more than admission allows, so that caps show."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 50 < 25").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_partkey").alias("p"))
    command = F.when(F.expr("p % 10 < 6"), "add_document").otherwise(one_of(tuple(c.BATCH_COMMANDS)[1:6], "p"))
    return rows.select(F.col("l_suppkey").alias("batch_id"), F.col("l_orderkey").alias("seq"), command.alias("command"), F.expr("p % 3 = 0").alias("mask_salary"), F.expr("p % 4 = 1").alias("settled"))


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs.replay_batches(batch_events(spark, sf_dir))
    return done.select("batch_id", "state", *[F.col(k).cast("long").alias(k) for k in ("documents", "version", "refused")], "mask_salary")


BATCH_STATES = f"""WITH RECURSIVE ev AS (SELECT b, CASE WHEN p % 10 < 6 THEN 'add_document' ELSE {sql_of(tuple(c.BATCH_COMMANDS)[1:6], 'p')} END AS cmd, p % 3 = 0 AS ms, p % 4 = 1 AS fin, row_number() OVER (PARTITION BY b ORDER BY o) AS n
      FROM (SELECT l_suppkey AS b, l_orderkey AS o, max(l_partkey) AS p FROM lineitem WHERE l_suppkey % 50 < 25 GROUP BY ALL)),
    st AS (SELECT DISTINCT b, 0 AS n, 'open' AS s, 0::BIGINT AS d, 0::BIGINT AS v, 0::BIGINT AS refused, true AS m FROM ev
      UNION ALL
      SELECT b, n, CASE WHEN NOT t THEN s WHEN cmd = 'start' THEN 'running' WHEN cmd = 'finish' THEN 'finished' WHEN cmd = 'record_retry' AND s = 'finished' THEN 'running' ELSE s END,
        d + CASE WHEN NOT t THEN 0 WHEN cmd = 'add_document' THEN 1 WHEN cmd = 'remove_document' THEN -1 ELSE 0 END, v + CAST(t AS INTEGER), refused + CAST(NOT t AS INTEGER), CASE WHEN t AND cmd = 'set_mask_salary' THEN ms ELSE m END
      FROM (SELECT st.* EXCLUDE (n), ev.n, cmd, ms, fin, CASE cmd WHEN 'add_document' THEN s = 'open' AND d < 50 WHEN 'remove_document' THEN s = 'open' AND d > 0 WHEN 'set_mask_salary' THEN s = 'open' WHEN 'start' THEN s = 'open' AND d > 0 WHEN 'finish' THEN s = 'running' AND fin ELSE s <> 'purged' END AS t
        FROM st JOIN ev ON ev.b = st.b AND ev.n = st.n + 1))
    SELECT b AS batch_id, s AS state, d AS documents, v AS version, refused, m AS mask_salary FROM st QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC) = 1"""


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with fields from the orders, most of which break a rule."""
    k = "o_orderkey"
    x = lambda sql: F.expr(sql)
    at = F.timestamp_seconds(x(f"{k} % 1000"))
    return table(spark, sf_dir, "orders").select(
        F.col(k).alias("document_id"), one_of((*c.STATES, "odd"), f"{k} + o_custkey").alias("state"), at.alias("created_at"), F.timestamp_seconds(x(f"{k} % 1000 + {k} % 17 - 1")).alias("updated_at"),
        F.when(x(f"{k} % 5 > 0"), F.timestamp_seconds(x(f"{k} % 1000 + o_custkey % 3"))).alias("uploaded_at"), x(f"cast({k} % 11 - 1 as int)").alias("version"), x("cast(o_custkey % 5 as int)").alias("attempt"),
        F.when(x(f"{k} % 5 > 0"), F.when(x(f"{k} % 2 = 0"), "pdf").otherwise("docx")).alias("format"), F.when(x(f"{k} % 5 > 0"), F.concat(F.lit("r"), x(f"{k} % 3"))).alias("input_ref"), F.when(x(f"{k} % 5 > 0 and {k} % 13 > 0"), "00").alias("content_sha256"),
        F.when(x(f"{k} % 5 > 0"), x("o_custkey * 20000")).alias("size_bytes"), x("o_custkey % 4 > 0").alias("has_policy"), F.when(x("o_custkey % 3 > 0"), F.concat(F.lit("r"), x("o_custkey % 3"))).alias("output_ref"), x("o_custkey % 7 > 1").alias("has_counts"),
        x("o_custkey % 2").alias("hidden"), one_of(REASONS, f"{k} + o_custkey * 5").alias("reasons"), F.when(x(f"{k} % 4 > 0"), one_of(OUTCOMES, k)).alias("outcome"), F.when(x("o_custkey % 3 > 0"), F.concat(F.lit("r"), x(f"(o_custkey + {k} % 2) % 3"))).alias("verified_ref"),
        F.when(x(f"{k} % 3 > 0"), one_of(CODES, "o_custkey")).alias("error_code"), x(f"{k} % 6 = 0").alias("approved"),
    )


def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.violations(job_rows(spark, sf_dir), records.job_rules())
    return rows.select("document_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


def _violations_sql() -> str:
    k = "o_orderkey"
    rules = {
        "time_runs_back": "upd < crt", "version_negative": "version < 0", "attempt_range": "attempt > 3", "state_unknown": "state = 'odd'",
        "upload_partial": "up_n BETWEEN 1 AND 4", "upload_missing": "state IN ('uploaded', 'validating', 'queued', 'processing', 'verifying', 'review_required', 'completed', 'rejected') AND up_n < 5", "upload_early": "state = 'created' AND up_n = 5",
        "size_range": "size NOT BETWEEN 1 AND 20971520", "upload_time": "up_n = 5 AND (upl < crt OR upl > upd)", "policy_missing": "state IN ('processing', 'verifying', 'completed') AND (NOT pol OR attempt < 1)",
        "output_early": "state IN ('created', 'uploaded', 'validating', 'queued', 'processing') AND (oref IS NOT NULL OR cnt OR oc IS NOT NULL)", "verifying_incomplete": "state = 'verifying' AND (oref IS NULL OR NOT cnt OR oc IS NOT NULL)",
        "output_is_input": "oref = iref", "verified_other_output": "oc IS NOT NULL AND vref IS DISTINCT FROM oref", "hidden_early": "hid > 0 AND state IN ('created', 'uploaded', 'validating')",
        "review_without_reason": "state = 'review_required' AND len(rs) = 0", "review_blocking_output": "state = 'review_required' AND blk AND (oref IS NOT NULL OR oc IS NOT NULL OR hid > 0)",
        "review_unverified": "state = 'review_required' AND len(rs) > 0 AND NOT blk AND (oc IS NULL OR oc = 'failed' OR NOT cnt)", "review_verifier_mismatch": "state = 'review_required' AND len(rs) > 0 AND NOT blk AND oc IN ('passed', 'review_required') AND (list_contains(rs, 'VERIFY_REVIEW') <> (oc = 'review_required'))",
        "verifying_reasons": "state = 'verifying' AND (blk OR list_contains(rs, 'VERIFY_REVIEW'))", "reasons_elsewhere": "state NOT IN ('review_required', 'verifying') AND len(rs) > 0", "approval_elsewhere": "ok AND state <> 'completed'",
        "completed_unverified": "state = 'completed' AND (oc IS DISTINCT FROM 'passed' OR oref IS NULL OR NOT cnt)", "failed_code": f"state = 'failed' AND (ec IS NULL OR ec = 'JOB_CANCELLED' OR ec LIKE 'SECURITY%' OR coalesce(({_FORMAT.format('ec')}) <> fmt, ({_FORMAT.format('ec')}) IS NOT NULL))",
        "cancelled_code": "state = 'cancelled' AND ec IS DISTINCT FROM 'JOB_CANCELLED'", "code_elsewhere": "state NOT IN ('failed', 'cancelled') AND ec IS NOT NULL",
    }
    named = ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in rules.items())
    return f"""WITH j AS (SELECT {k}, {sql_of((*c.STATES, 'odd'), f'({k} + o_custkey)')} AS state, {k} % 1000 AS crt, {k} % 1000 + {k} % 17 - 1 AS upd, CASE WHEN {k} % 5 > 0 THEN {k} % 1000 + o_custkey % 3 END AS upl, {k} % 11 - 1 AS version, o_custkey % 5 AS attempt,
          CASE WHEN {k} % 5 > 0 THEN CASE WHEN {k} % 2 = 0 THEN 'pdf' ELSE 'docx' END END AS fmt, CASE WHEN {k} % 5 > 0 THEN 'r' || ({k} % 3) END AS iref, CASE WHEN {k} % 5 > 0 THEN o_custkey * 20000 END AS size,
          CASE WHEN {k} % 5 = 0 THEN 0 WHEN {k} % 13 = 0 THEN 4 ELSE 5 END AS up_n, o_custkey % 4 > 0 AS pol, CASE WHEN o_custkey % 3 > 0 THEN 'r' || (o_custkey % 3) END AS oref, o_custkey % 7 > 1 AS cnt, o_custkey % 2 AS hid,
          {sql_of(REASONS, f'({k} + o_custkey * 5)')} AS rs, CASE WHEN {k} % 4 > 0 THEN {sql_of(OUTCOMES, k)} END AS oc, CASE WHEN o_custkey % 3 > 0 THEN 'r' || ((o_custkey + {k} % 2) % 3) END AS vref, CASE WHEN {k} % 3 > 0 THEN {sql_of(CODES, 'o_custkey')} END AS ec, {k} % 6 = 0 AS ok FROM orders),
        b AS (SELECT *, list_contains(rs, 'PDF_ENCRYPTED') OR list_contains(rs, 'DOCX_NO_TEXT') AS blk FROM j)
        SELECT {k} AS document_id, array_to_string(list_sort(list_filter([{named}], lambda x: x IS NOT NULL)), ',') AS violations FROM b"""


def batch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("batch_id"), one_of(("open", "running", "finished", "purged", "gone"), k).alias("state"), (k % 53 - 1).alias("documents"), F.timestamp_seconds(k % 7).alias("created_at"), F.timestamp_seconds(k % 11).alias("updated_at"), (k % 9 - 1).alias("version"))
    return records.violations(rows, records.batch_rules()).select("batch_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


def code_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, format and retry of codes and kinds of reasons, over the orders' comments' stand-ins."""
    pool = (*CODES, *c.FAILURE_ORDER, *c.RETRYABLE, *c.FINDINGS_REASONS, *c.BLOCKING_REASONS, "VERIFY_REVIEW", "DOCX_MACRO_OR_TEMPLATE")
    x = one_of(pool, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("code")).select("o_orderkey", "code", jobs.code_group(F.col("code")).alias("code_group"), jobs.code_format(F.col("code")).alias("code_format"), jobs.retryable(F.col("code")).alias("retryable"), jobs.reason_kind(F.col("code")).alias("reason_kind"))


_POOL = (*CODES, *c.FAILURE_ORDER, *c.RETRYABLE, *c.FINDINGS_REASONS, *c.BLOCKING_REASONS, "VERIFY_REVIEW", "DOCX_MACRO_OR_TEMPLATE")


def after_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state, reasons and code that verification gives, and what a person may then do."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one_of(OUTCOMES, "o_orderkey").alias("outcome"), one_of(REASONS[:2] + REASONS[4:5], "o_custkey").alias("reasons"), one_of(FAILURES, "o_custkey").alias("codes"))
    rows = rows.select("o_orderkey", "outcome", jobs.verified(F.col("outcome"), F.col("reasons"), F.col("codes")).alias("v")).select("o_orderkey", "outcome", "v.*")
    may = jobs.may_approve(F.col("state"), F.col("review_reasons"), F.col("outcome"))
    return rows.select("o_orderkey", "state", F.array_join(F.array_sort("review_reasons"), ",").alias("reasons"), "error_code", may.alias("may_approve"), jobs.downloadable(F.col("state"), F.col("error_code"), F.expr("o_orderkey % 5 > 0")).alias("downloadable"))


def primary_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most serious of the codes that each order's line items stand for."""
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", one_of((*c.FAILURE_ORDER, "OTHER"), "l_partkey").alias("code"))
    return each.groupBy("l_orderkey").agg(F.collect_set("code").alias("codes")).select("l_orderkey", jobs.primary_failure(F.col("codes")).alias("code"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that repeat: one of each document and attempt is taken."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("attempt"), F.col("l_partkey").alias("arrival"))
    return jobs.claim_once(rows.distinct())


def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that expect a version: the first one right is applied."""
    now = table(spark, sf_dir, "orders").where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 3).alias("version"))
    asked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey")).select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 3).alias("expected_version"), F.col("l_linenumber").alias("arrival"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("change_id"))
    return jobs.change_if_unchanged(now, asked)


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), one_of(c.STATES, "o_orderkey").alias("state"))
    return jobs.recover(rows)


def task_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one_of(("done", "timeout", "stopped", "crash", "error"), "o_orderkey").alias("outcome"))
    return rows.select("o_orderkey", jobs.task_code(F.col("outcome")).alias("code"))


def _file_rows(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), one_of(c.STATES, k + shift).alias("state"), F.when(k % 7 > 0, F.concat(F.lit("i"), k)).alias("input_ref"), F.when(k % 4 > 0, F.concat(F.lit("o"), k, F.when((k % 9 == 0) & F.lit(shift > 0), "x").otherwise(""))).alias("output_ref"), one_of(CODES, "o_custkey").alias("error_code"))


def released_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a change of state sets free."""
    return jobs.released(_file_rows(spark, sf_dir, 0), _file_rows(spark, sf_dir, 3))


def purged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table are left when every fifth customer's documents are purged."""
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey")
    counts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    left = jobs.purged({"documents": documents, "counts": counts}, documents.where("o_custkey % 5 = 0"))
    return left["documents"].select(F.lit("documents").alias("name"), "document_id").unionByName(left["counts"].select(F.lit("counts").alias("name"), "document_id")).groupBy("name").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


def retried_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("batch_id"), one_of(c.STATES, "o_orderkey").alias("state"))
    uploads = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("failed_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10**9).alias("document_id"))
    return jobs.retried(documents, uploads)


def reconciled_with_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the last hour are left alone."""
    now = F.timestamp_seconds(F.lit(100_000))
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.timestamp_seconds(F.lit(100_000) - F.col("c_custkey") % 120 * 60).alias("modified"))
    uses = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("ref"), jobs.output_kept(one_of(c.STATES, "o_orderkey"), one_of(CODES, "o_orderkey")).alias("needed"))
    return jobs.reconcile(stored, uses, now)


def stale_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.timestamp_seconds(F.lit(100_000) - F.col("c_custkey") % 120 * 60).alias("modificationTime"))
    return jobs.stale(stored, F.timestamp_seconds(F.lit(100_000))).select("ref")


def _children(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_partkey", "l_suppkey", "l_linenumber")
    entity = one_of(tuple(c.ENTITIES), "l_partkey")
    of = lambda n: rows.where(f"l_linenumber = {n}")
    return {
        "finding_counts": rows.where("l_linenumber <= 2").select("document_id", one_of(("email", "phone"), "l_partkey").alias("entity_type"), F.col("l_suppkey").alias("n")),
        "review_reasons": of(3).select("document_id", one_of(c.FINDINGS_REASONS, "l_partkey").alias("reason")),
        "verification_failures": of(4).select("document_id", one_of(c.FAILURE_ORDER, "l_partkey").alias("code")),
        "hidden_content": of(5).select("document_id", one_of(c.HIDDEN_KINDS, "l_partkey").alias("category"), F.col("l_suppkey").alias("n")),
        "residual_counts": of(6).select("document_id", entity.alias("entity_type"), F.col("l_suppkey").alias("n")),
        "residual_pages": rows.where("l_linenumber >= 6").select("document_id", entity.alias("entity_type"), (F.col("l_suppkey") % 30 + 1).alias("page")),
    }


def child_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderkey % 50 > 0").select(F.col("o_orderkey").alias("document_id"), F.expr("o_custkey % 3 > 0").alias("has_counts"), F.when(F.expr("o_custkey % 4 > 0"), "passed").alias("outcome"))
    return records.child_violations(known, _children(spark, sf_dir))


_LIST = lambda values, n: sql_of(tuple(values), n)
_CHILD_SQL = f"""l AS (SELECT l_orderkey AS d, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
    kids AS (SELECT 'finding_counts' AS t, d, {_LIST(('email', 'phone'), 'p')} AS k, 0 AS g FROM l WHERE n <= 2 UNION ALL SELECT 'review_reasons', d, {_LIST(c.FINDINGS_REASONS, 'p')}, 0 FROM l WHERE n = 3
      UNION ALL SELECT 'verification_failures', d, {_LIST(c.FAILURE_ORDER, 'p')}, 0 FROM l WHERE n = 4 UNION ALL SELECT 'hidden_content', d, {_LIST(c.HIDDEN_KINDS, 'p')}, 0 FROM l WHERE n = 5
      UNION ALL SELECT 'residual_counts', d, {_LIST(c.ENTITIES, 'p')}, 0 FROM l WHERE n = 6 UNION ALL SELECT 'residual_pages', d, {_LIST(c.ENTITIES, 'p')}, s % 30 + 1 FROM l WHERE n >= 6)"""


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a caller sees them, children as text."""
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), one_of(c.STATES, "o_orderkey").alias("state"))
    children = _children(spark, sf_dir)
    for name, key in (("finding_counts", "entity_type"), ("residual_counts", "entity_type"), ("hidden_content", "category")):
        children[name] = children[name].groupBy("document_id", key).agg(F.max("n").alias("n"))
    out = records.view(documents, children)
    text = lambda m: F.coalesce(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit(""))
    return out.select("document_id", "state", text(F.col("finding_counts")).alias("counts"), F.coalesce(F.array_join("review_reasons", ","), F.lit("")).alias("reasons"), F.coalesce(F.array_join("failure_codes", ","), F.lit("")).alias("codes"), text(F.col("hidden_removed")).alias("hidden"), text(F.col("residual_counts")).alias("residual"))


def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many child rows of each table the orders' jobs are written as."""
    k = F.col("o_orderkey")
    residual = F.array(F.struct(F.lit("email").alias("entity_type"), F.lit(2).alias("count"), F.sequence(F.lit(1), (k % 4 + 1).cast("int")).alias("pages")))
    rows = table(spark, sf_dir, "orders").select(k.alias("document_id"), F.create_map(F.lit("email"), k % 5, F.lit("phone"), k % 3).alias("counts"), one_of(REASONS, "o_orderkey").alias("reasons"), one_of(FAILURES, "o_orderkey").alias("codes"), F.when(k % 2 == 0, F.create_map(F.lit("comments"), F.lit(1))).alias("hidden"), residual.alias("residual"))
    out = None
    for name, df in records.encoded(rows).items():
        one = df.groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))
        out = one if out is None else out.unionByName(one)
    return out


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.expr("o_orderkey % 3 = 0"), F.md5(k.cast("binary"))).otherwise(F.sha2(k, 256)).alias("digest"), F.concat_ws(".", F.expr("o_orderkey % 3"), F.lpad(F.expr("cast(o_orderkey % 20 as string)"), 1, "0"), F.when(F.expr("o_orderkey % 4 = 0"), "01").otherwise("1")).alias("version"), F.concat(F.when(F.expr("o_custkey % 5 = 0"), "X").otherwise("x"), F.expr("o_custkey")).alias("name"), (F.col("o_custkey") % 13 / 10).alias("share"))
    return records.violations(rows, records.value_rules({"digest": "sha256", "version": "semver", "name": "identifier", "share": "share"})).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings may lower a cap, never raise it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one_of((*[n for n, _, _ in c.CAPS], "port_x"), "o_orderkey").alias("name"), F.when(F.expr("o_custkey % 5 > 0"), F.concat(F.when(F.expr("o_custkey % 7 = 0"), "-").otherwise(""), F.expr("cast(o_custkey as bigint) * o_custkey % 2000"))).alias("raw"))
    return records.effective(rows).select("o_orderkey", "value", "error")


def failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation totals by format, of outcomes from the orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", one_of(("pdf", "docx", "other"), "o_orderkey").alias("format"), one_of(OUTCOMES, "o_custkey").alias("outcome"), F.when(F.expr("o_orderkey % 4 > 0"), F.col("o_custkey") % 3).alias("leaked"))
    return reports.totals(rows).select("format", "documents", "failed", "review_required", "scored", F.col("leaked").cast("long").alias("leaked"), "failure_rate", "review_rate")


QUERIES = {f.__name__: f for f in (job_states, one_step, batch_states, invariant_violations, batch_violations, code_lookups, after_verification, primary_failures, claims, version_conflicts, recovered, task_codes, released_files, purged_rows, retried_documents, reconciled_with_grace, stale_objects, child_violations, document_view, encoded_rows, value_checks, effective_settings, failure_totals)}

_STATE = lambda n: sql_of(c.STATES, n)
_KEPT = "({s} NOT IN ('rejected', 'cancelled') AND ({s} <> 'failed' OR coalesce({e} IN ('VERIFY_RESIDUAL_FINDING', 'VERIFY_RESIDUAL_DETECTION', 'VERIFY_RESIDUAL_METADATA'), false)))"

ORACLE_SQL = {
    "job_states": JOB_STATES,
    "one_step": ONE_STEP,
    "batch_states": BATCH_STATES,
    "invariant_violations": _violations_sql(),
    "batch_violations": f"""WITH b AS (SELECT c_custkey AS k, {sql_of(('open', 'running', 'finished', 'purged', 'gone'), 'c_custkey')} AS s FROM customer)
        SELECT k AS batch_id, array_to_string(list_sort(list_filter([CASE WHEN s = 'gone' THEN 'state_unknown' END, CASE WHEN k % 53 IN (0, 52) THEN 'documents_range' END, CASE WHEN k % 11 < k % 7 THEN 'time_runs_back' END, CASE WHEN k % 9 = 0 THEN 'version_negative' END, CASE WHEN s IN ('running', 'finished') AND k % 53 < 2 THEN 'started_empty' END], lambda x: x IS NOT NULL)), ',') AS violations FROM b""",
    "code_lookups": f"WITH x AS (SELECT o_orderkey, {sql_of(_POOL, 'o_orderkey')} AS code FROM orders) SELECT *, {_GROUP.format('code')} AS code_group, {_FORMAT.format('code')} AS code_format, list_contains({list(c.RETRYABLE)}, code) AS retryable, {_KIND.format('code')} AS reason_kind FROM x",
    "after_verification": f"""WITH x AS (SELECT o_orderkey, {sql_of(OUTCOMES, 'o_orderkey')} AS oc, {sql_of(REASONS[:2] + REASONS[4:5], 'o_custkey')} AS r, {sql_of(FAILURES, 'o_custkey')} AS fc FROM orders),
        y AS (SELECT *, CASE WHEN oc = 'failed' THEN 'failed' WHEN oc = 'review_required' OR len(r) > 0 THEN 'review_required' ELSE 'completed' END AS state, CASE WHEN oc = 'failed' THEN []::VARCHAR[] WHEN oc = 'review_required' THEN list_append(r, 'VERIFY_REVIEW') ELSE r END AS held, CASE WHEN oc = 'failed' THEN fc[len(fc)] END AS error_code FROM x)
        SELECT o_orderkey, state, array_to_string(list_sort(held), ',') AS reasons, error_code, state = 'review_required' AND oc = 'passed' AS may_approve, o_orderkey % 5 > 0 AND (state <> 'failed' OR error_code LIKE 'VERIFY_RESIDUAL%') AS downloadable FROM y""",
    "primary_failures": f"WITH x AS (SELECT l_orderkey, l_partkey % 7 AS i FROM lineitem) SELECT l_orderkey, ({list(c.FAILURE_ORDER)})[CAST(min(i) FILTER (i < 6) AS INTEGER) + 1] AS code FROM x GROUP BY l_orderkey",
    "claims": "SELECT l_orderkey AS document_id, l_linenumber % 2 AS attempt, min(l_partkey) AS arrival FROM lineitem GROUP BY ALL",
    "version_conflicts": """WITH x AS (SELECT l_orderkey AS d, l_suppkey % 3 AS want, l_linenumber AS n, o_custkey % 3 AS v FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 > 0) ON o_orderkey = l_orderkey)
        SELECT d || '-' || n AS change_id, d AS document_id, CASE WHEN v IS NULL THEN 'missing' WHEN want = v AND n = min(CASE WHEN want = v THEN n END) OVER (PARTITION BY d) THEN 'applied' ELSE 'conflict' END AS verdict FROM x""",
    "recovered": f"WITH x AS (SELECT o_orderkey AS document_id, {_STATE('o_orderkey')} AS s FROM orders) SELECT document_id, CASE WHEN s IN ('validating', 'processing', 'verifying') THEN 'failed' ELSE s END AS state, CASE WHEN s IN ('validating', 'processing', 'verifying') THEN 'JOB_INTERRUPTED' END AS error_code FROM x",
    "task_codes": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'JOB_TIMEOUT' WHEN 2 THEN 'JOB_INTERRUPTED' WHEN 3 THEN 'INTERNAL_ERROR' WHEN 4 THEN 'INTERNAL_ERROR' END AS code FROM orders",
    "released_files": f"""WITH x AS (SELECT o_orderkey AS k, {_STATE('(o_orderkey + 3)')} AS s, {sql_of(CODES, 'o_custkey')} AS e FROM orders),
        y AS (SELECT k, 'i' || k AS ref, 'input' AS kind FROM x WHERE k % 7 > 0 AND s IN ('completed', 'failed', 'rejected', 'cancelled') UNION ALL SELECT k, 'o' || k, 'output' FROM x WHERE k % 4 > 0 AND (k % 9 = 0 OR NOT {_KEPT.format(s='s', e='e')}))
        SELECT k AS document_id, ref, kind FROM y""",
    "purged_rows": "SELECT 'documents' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'counts', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)",
    "retried_documents": f"""WITH u AS (SELECT l_orderkey AS k, min(l_orderkey * 10 + l_linenumber + 1000000000) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), x AS (SELECT o_orderkey AS k, o_custkey AS b, {_STATE('o_orderkey')} AS s FROM orders)
        SELECT CASE WHEN s = 'failed' AND n IS NOT NULL THEN n ELSE x.k END AS document_id, b AS batch_id, CASE WHEN s = 'failed' AND n IS NOT NULL THEN 'uploaded' ELSE s END AS state, CASE WHEN s = 'failed' AND n IS NOT NULL THEN x.k END AS replaces FROM x LEFT JOIN u ON u.k = x.k""",
    "reconciled_with_grace": f"""WITH u AS (SELECT o_custkey AS k, bool_or({_KEPT.format(s=_STATE('o_orderkey'), e=sql_of(CODES, 'o_orderkey'))}) AS needed FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL)
        SELECT c_custkey AS ref, CASE WHEN needed THEN 'in_use' WHEN NOT needed THEN 'unneeded' WHEN c_custkey % 120 < 60 THEN 'recent' ELSE 'orphan' END AS verdict FROM customer LEFT JOIN u ON k = c_custkey""",
    "stale_objects": "SELECT c_custkey AS ref FROM customer WHERE c_custkey % 120 > 60",
    "child_violations": f"""WITH {_CHILD_SQL}, o AS (SELECT o_orderkey AS k, o_custkey % 3 > 0 AS c, o_custkey % 4 > 0 AS v FROM orders WHERE o_orderkey % 50 > 0),
        f AS (SELECT d, t || '_orphan' AS x FROM kids WHERE d NOT IN (SELECT k FROM o) UNION SELECT d, t || '_repeat' FROM kids GROUP BY d, t, kids.k, g HAVING count(*) > 1
          UNION SELECT d, 'finding_counts_unrecorded' FROM kids JOIN o ON o.k = d WHERE t = 'finding_counts' AND NOT c UNION SELECT d, t || '_unverified' FROM kids JOIN o ON o.k = d WHERE t IN ('verification_failures', 'residual_counts', 'residual_pages') AND NOT v
          UNION SELECT p.d, 'residual_page_without_count' FROM kids p WHERE p.t = 'residual_pages' AND NOT EXISTS (SELECT 1 FROM kids q WHERE q.t = 'residual_counts' AND q.d = p.d AND q.k = p.k))
        SELECT d AS document_id, x AS violation FROM f""",
    "document_view": f"""WITH l AS (SELECT l_orderkey AS d, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
        k AS (SELECT d, 'c' AS t, {_LIST(('email', 'phone'), 'p')} || '=' || max(s) AS x FROM l WHERE n <= 2 GROUP BY d, {_LIST(('email', 'phone'), 'p')} UNION ALL SELECT DISTINCT d, 'r', {_LIST(c.FINDINGS_REASONS, 'p')} FROM l WHERE n = 3 UNION ALL SELECT DISTINCT d, 'f', {_LIST(c.FAILURE_ORDER, 'p')} FROM l WHERE n = 4
          UNION ALL SELECT d, 'h', {_LIST(c.HIDDEN_KINDS, 'p')} || '=' || max(s) FROM l WHERE n = 5 GROUP BY d, {_LIST(c.HIDDEN_KINDS, 'p')} UNION ALL SELECT d, 'e', {_LIST(c.ENTITIES, 'p')} || '=' || max(s) FROM l WHERE n = 6 GROUP BY d, {_LIST(c.ENTITIES, 'p')})
        SELECT o_orderkey AS document_id, {_STATE('o_orderkey')} AS state, coalesce(string_agg(x, ',' ORDER BY x) FILTER (t = 'c'), '') AS counts, coalesce(string_agg(x, ',' ORDER BY x) FILTER (t = 'r'), '') AS reasons, coalesce(string_agg(x, ',' ORDER BY x) FILTER (t = 'f'), '') AS codes, coalesce(string_agg(x, ',' ORDER BY x) FILTER (t = 'h'), '') AS hidden, coalesce(string_agg(x, ',' ORDER BY x) FILTER (t = 'e'), '') AS residual
        FROM orders LEFT JOIN k ON k.d = o_orderkey GROUP BY o_orderkey""",
    "encoded_rows": f"""WITH x AS (SELECT o_orderkey AS k, len({sql_of(REASONS, 'o_orderkey')}) AS r, len({sql_of(FAILURES, 'o_orderkey')}) AS f FROM orders)
        SELECT 'finding_counts' AS name, 2 * count(*) AS n, count(*) AS documents FROM x UNION ALL SELECT 'review_reasons', CAST(sum(r) AS BIGINT), count(*) FILTER (r > 0) FROM x UNION ALL SELECT 'verification_failures', CAST(sum(f) AS BIGINT), count(*) FROM x
        UNION ALL SELECT 'hidden_content', count(*), count(*) FROM x WHERE k % 2 = 0 UNION ALL SELECT 'residual_counts', count(*), count(*) FROM x UNION ALL SELECT 'residual_pages', CAST(sum(k % 4 + 1) AS BIGINT), count(*) FROM x""",
    "value_checks": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'digest_sha256' END, CASE WHEN o_orderkey % 4 = 0 THEN 'version_semver' END, CASE WHEN o_custkey % 5 = 0 THEN 'name_identifier' END, CASE WHEN o_custkey % 13 > 10 THEN 'share_share' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders""",
    "effective_settings": """WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS i, CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey AS BIGINT) * o_custkey % 2000 END AS v, o_custkey % 7 = 0 AS neg FROM orders), y AS (SELECT *, ([20971520, 50, 524288000, 900, 600, NULL])[CAST(i AS INTEGER) + 1] AS cap FROM x),
        z AS (SELECT *, CASE WHEN v IS NULL THEN cap WHEN NOT neg AND v BETWEEN 1 AND cap THEN v END AS value FROM y) SELECT o_orderkey, CAST(value AS BIGINT) AS value, CASE WHEN cap IS NULL THEN 'unknown' WHEN value IS NULL THEN 'out_of_range' END AS error FROM z""",
    "failure_totals": f"""WITH x AS (SELECT {sql_of(('pdf', 'docx', 'other'), 'o_orderkey')} AS format, {sql_of(OUTCOMES, 'o_custkey')} AS oc, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 3 END AS leaked FROM orders)
        SELECT format, count(*) AS documents, count(*) FILTER (oc = 'failed') AS failed, count(*) FILTER (oc = 'review_required') AS review_required, count(*) FILTER (oc <> 'failed' AND leaked IS NOT NULL) AS scored, CAST(coalesce(sum(leaked) FILTER (oc <> 'failed'), 0) AS BIGINT) AS leaked, round(count(*) FILTER (oc = 'failed') / count(*), 4) AS failure_rate, round(count(*) FILTER (oc = 'review_required') / count(*), 4) AS review_rate FROM x GROUP BY format""",
}
