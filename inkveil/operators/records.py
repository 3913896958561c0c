"""What rows must hold: constraints of jobs, batches, their child tables and values, each rule a named condition.

A rule gives true where it is broken; a row's `violations` are the names of its broken rules. Rules are rows of a table of
expressions, so all of them are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.operators.jobs import code_group, fits_format, reason_kind
from inkveil.plans.storage import dealt

UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SHA256, IDENTIFIER, SEMVER = "^[0-9a-f]{64}$", "^[a-z][a-z0-9_.-]{0,63}$", r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that are broken, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def job_rules() -> dict[str, Column]:
    """Over document_id, state, created_at, updated_at, uploaded_at, version, attempt, format, input_ref, content_sha256,
    size_bytes, has_policy, output_ref, has_counts, hidden, reasons, outcome, verified_ref, error_code, approved."""
    x = F.col
    state, kinds = x("state"), F.transform(F.coalesce("reasons", F.array().cast("array<string>")), reason_kind)
    upload = [x(k) for k in ("format", "input_ref", "content_sha256", "size_bytes", "uploaded_at")]
    has_all = F.reduce(F.array(*[u.isNotNull() for u in upload]), F.lit(True), lambda a, b: a & b)
    has_any = F.reduce(F.array(*[u.isNotNull() for u in upload]), F.lit(False), lambda a, b: a | b)
    output = x("output_ref").isNotNull() | x("has_counts") | x("outcome").isNotNull()
    review, blocking = state == "review_required", F.forall(kinds, lambda k: k == "blocking")
    later = F.forall(kinds, lambda k: k.isin("findings", "verifier"))
    verifier = F.coalesce(F.array_contains(kinds, "verifier"), F.lit(False))
    some = F.size(kinds) > 0
    return {
        "time_runs_back": x("updated_at") < x("created_at"),
        "version_negative": x("version") < 0,
        "attempt_range": ~x("attempt").between(0, c.MAX_ATTEMPTS),
        "state_unknown": ~state.isin(*c.STATES) | state.isNull(),
        "reason_unknown": F.exists(kinds, lambda k: k.isNull()),
        "upload_partial": has_any & ~has_all,
        "upload_missing": state.isin(*c.STATES_WITH_UPLOAD) & ~has_all,
        "upload_early": (state == "created") & has_all,
        "size_range": ~x("size_bytes").between(1, c.MAX_FILE_BYTES),
        "upload_time": has_all & ~x("uploaded_at").between(x("created_at"), x("updated_at")),
        "policy_missing": state.isin(*c.STATES_WITH_POLICY) & (~x("has_policy") | (x("attempt") < 1)),
        "output_early": state.isin(*c.STATES_WITHOUT_OUTPUT) & output,
        "verifying_incomplete": (state == "verifying") & (x("output_ref").isNull() | ~x("has_counts") | x("outcome").isNotNull()),
        "output_is_input": x("output_ref") == x("input_ref"),
        "verified_other_output": x("outcome").isNotNull() & ~x("verified_ref").eqNullSafe(x("output_ref")),
        "hidden_early": (x("hidden") > 0) & state.isin(*c.STATES_BEFORE_EXTRACTION),
        "review_without_reason": review & ~some,
        "review_mixed": review & some & ~blocking & ~later,
        "review_blocking_output": review & some & blocking & (x("output_ref").isNotNull() | x("outcome").isNotNull() | (x("hidden") > 0)),
        "review_unverified": review & some & later & (x("outcome").isNull() | (x("outcome") == "failed") | ~x("has_counts")),
        "review_verifier_mismatch": review & some & later & x("outcome").isNotNull() & (x("outcome") != "failed") & (verifier != (x("outcome") == "review_required")),
        "verifying_reasons": (state == "verifying") & ~F.forall(kinds, lambda k: k == "findings"),
        "reasons_elsewhere": ~state.isin("review_required", "verifying") & some,
        "approval_elsewhere": x("approved") & (state != "completed"),
        "completed_unverified": (state == "completed") & (~x("outcome").eqNullSafe("passed") | x("output_ref").isNull() | ~x("has_counts")),
        "failed_code": (state == "failed") & (x("error_code").isNull() | (x("error_code") == "JOB_CANCELLED") | (code_group(x("error_code")) == "security") | ~fits_format(x("error_code"), x("format"))),
        "cancelled_code": (state == "cancelled") & ~x("error_code").eqNullSafe("JOB_CANCELLED"),
        "code_elsewhere": ~state.isin("failed", "cancelled") & x("error_code").isNotNull(),
    }


def batch_rules() -> dict[str, Column]:
    """Over batch_id, state, documents, created_at, updated_at, version."""
    x = F.col
    return {
        "state_unknown": ~x("state").isin("open", "running", "finished", "purged") | x("state").isNull(),
        "documents_range": ~x("documents").between(0, c.MAX_BATCH_FILES),
        "time_runs_back": x("updated_at") < x("created_at"),
        "version_negative": x("version") < 0,
        "started_empty": x("state").isin("running", "finished") & (x("documents") < 1),
    }


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `violations`; an empty array where all holds."""
    return rows.withColumn("violations", broken(rules))


def value_rules(columns: dict[str, str]) -> dict[str, Column]:
    """Rules for columns by the kind of their values: uuid, sha256, identifier, semver, share (0 to 1), count, utc."""
    shape = {"uuid": UUID4, "sha256": SHA256, "identifier": IDENTIFIER, "semver": SEMVER}
    out = {}
    for name, kind in columns.items():
        x = F.col(name)
        out[f"{name}_{kind}"] = ~x.rlike(shape[kind]) | x.isNull() if kind in shape else ~x.between(0, 1) | F.isnan(x) | x.isNull() if kind == "share" else (x < 0) | x.isNull()
    return out


#: Child tables of a job and the column that tells their rows apart.
CHILDREN = {"finding_counts": "entity_type", "review_reasons": "reason", "verification_failures": "code", "hidden_content": "category", "residual_counts": "entity_type", "residual_pages": ("entity_type", "page")}


def child_violations(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """document_id, violation of child rows that do not go with their document (document_id, has_counts, outcome) or with
    each other: orphans, repeats, counts without the flag, failures or residues without a verification, pages without a count.

    Documents and children are dealt by document once; rows of one key become one, and then those of one document.
    """
    none = F.lit(None).cast("string")
    each = documents.select("document_id", none.alias("t"), none.alias("k"), none.alias("g"), (~F.col("has_counts")).alias("uncounted"), F.col("outcome").isNull().alias("unverified"))
    for name, key in CHILDREN.items():
        first, second = (key, None) if isinstance(key, str) else key
        own = children[name].select("document_id", F.lit(name).alias("t"), F.col(first).cast("string").alias("k"), (none if second is None else F.col(second).cast("string")).alias("g"))
        each = each.unionByName(own, allowMissingColumns=True)
    rows = dealt(each, "document_id").groupBy("document_id", "t", "k", "g").agg(F.count(F.lit(1)).alias("n"), F.bool_or("uncounted").alias("uncounted"), F.bool_or("unverified").alias("unverified"))
    is_ = lambda name: F.col("t") == name
    there = [F.bool_or(is_(name)).alias(f"{name}_there") for name in CHILDREN] + [F.bool_or(is_(name) & (F.col("n") > 1)).alias(f"{name}_repeat") for name in CHILDREN]
    lists = [F.collect_set(F.when(is_(name), F.struct("k"))).alias(name) for name in ("residual_pages", "residual_counts")]
    found = rows.groupBy("document_id").agg(F.bool_or(F.col("t").isNull()).alias("known"), F.bool_or("uncounted").alias("uncounted"), F.bool_or("unverified").alias("unverified"), *there, *lists)
    told = F.col("known") & F.col("document_id").isNotNull()
    broken_ = []
    for name in CHILDREN:
        here = F.col(f"{name}_there")
        broken_ += [F.when(here & ~told, f"{name}_orphan"), F.when(F.col(f"{name}_repeat"), f"{name}_repeat")]
        if name == "finding_counts":
            broken_.append(F.when(here & told & F.col("uncounted"), "finding_counts_unrecorded"))
        elif name in ("verification_failures", "residual_counts", "residual_pages"):
            broken_.append(F.when(here & told & F.col("unverified"), f"{name}_unverified"))
    alone = F.exists("residual_pages", lambda p: F.col("document_id").isNull() | p["k"].isNull() | ~F.array_contains(F.col("residual_counts"), p))
    broken_.append(F.when(alone, "residual_page_without_count"))
    each = found.select("document_id", F.explode(F.array(*broken_)).alias("violation"))
    return each.where("violation is not null")


def encoded(jobs: DataFrame) -> dict[str, DataFrame]:
    """The child rows of jobs (document_id, counts map, reasons, codes, hidden map, residual array of entity_type, count,
    pages): each list or map as rows of its own table."""
    one = lambda column, *names: jobs.select("document_id", F.explode(column).alias(*names))
    residual = one("residual", "r")
    return {
        "finding_counts": one("counts", "entity_type", "n"),
        "review_reasons": one("reasons", "reason"),
        "verification_failures": one("codes", "code"),
        "hidden_content": one("hidden", "category", "n"),
        "residual_counts": residual.select("document_id", "r.entity_type", F.col("r.count").alias("n")),
        "residual_pages": residual.select("document_id", "r.entity_type", F.explode("r.pages").alias("page")),
    }


def view(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One row for each document as a caller sees it, its children as sorted arrays and maps: six left joins with tables
    that are aggregated by document first."""
    lists = {
        "finding_counts": ("finding_counts", F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n"))))),
        "review_reasons": ("review_reasons", F.array_sort(F.collect_set("reason"))),
        "verification_failures": ("failure_codes", F.array_sort(F.collect_set("code"))),
        "hidden_content": ("hidden_removed", F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))),
        "residual_counts": ("residual_counts", F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n"))))),
    }
    out = documents
    for table, (name, made) in lists.items():
        out = out.join(children[table].groupBy("document_id").agg(made.alias(name)), "document_id", "left")
    pages = children["residual_pages"].groupBy("document_id", "entity_type").agg(F.array_sort(F.collect_set("page")).alias("p"))
    pages = pages.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "p")))).alias("residual_pages"))
    return out.join(pages, "document_id", "left")


def effective(settings: DataFrame) -> DataFrame:
    """settings (name, raw string) with value and error: a number within its limits, which settings may lower, never raise."""
    least = F.create_map(*[F.lit(x) for name, a, _ in c.CAPS for x in (name, a)])[F.col("name")]
    most = F.create_map(*[F.lit(x) for name, _, b in c.CAPS for x in (name, b)])[F.col("name")]
    number = F.when(F.col("raw").rlike("^[0-9]{1,18}$"), F.col("raw").cast("long"))
    value = F.when(F.col("raw").isNull(), most).when(number.between(least, most), number)
    return settings.withColumn("value", value.cast("long")).withColumn("error", F.when(most.isNull(), "unknown").when(F.col("value").isNull(), "out_of_range"))
