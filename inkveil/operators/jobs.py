"""Documents and batches as append-only events: states, the queue, what is stored and no longer needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c


#: What an event may carry besides document_id, seq and command; columns that are missing are null.
PAYLOAD = {"code": "string", "reasons": "array<string>", "outcome": "string", "codes": "array<string>", "format": "string", "input_ref": "string", "output_ref": "string", "at": "timestamp"}
JOB = "struct<state:string,version:int,format:string,attempt:int,input_ref:string,output_ref:string,reasons:array<string>,outcome:string,error_code:string,approved:boolean,updated_at:timestamp,refused:int>"
def _none() -> Column:
    return F.array().cast("array<string>")



def transitions(spark: SparkSession) -> DataFrame:
    """command, state, next: the fixed table of moves; next is null where it depends on what the command carries."""
    return spark.createDataFrame([(m, s, n) for m, (states, n) in c.COMMANDS.items() for s in states], "command string, state string, next string")


def fits_format(code: Column, document_format: Column) -> Column:
    """A code that only one format can have goes with documents of that format alone."""
    return F.coalesce(code_format(code) == document_format, code_format(code).isNull())


def reasons_fit(reasons: Column, kinds: tuple[str, ...], document_format: Column) -> Column:
    """Every reason is of one of the kinds and goes with the document's format."""
    of = F.lit("docx")
    fine = lambda r: F.coalesce(reason_kind(r).isin(*kinds), F.lit(False)) & F.coalesce(~r.startswith("PDF_") | (document_format == "pdf"), F.lit(False)) & F.coalesce(~r.startswith("DOCX_") | (document_format == of), F.lit(False))
    return F.forall(reasons, fine)


def allowed(now: Column, event: Column) -> Column:
    """Whether a job in state `now` (JOB) takes an event (command and PAYLOAD): its state and what it carries must fit."""
    command, state = event["command"], now["state"]
    in_state = F.lit(False)
    for name, (states, _) in c.COMMANDS.items():
        in_state = F.when(command == name, state.isin(*states)).otherwise(in_state)
    reasons, group = F.coalesce(event["reasons"], _none()), code_group(event["code"])
    in_group = F.lit(False)
    for at, groups in c.FAILURE_GROUPS.items():
        in_group = F.when(state == at, group.isin(*groups)).otherwise(in_group)
    judged = event["outcome"].isin("passed", "review_required") | ((event["outcome"] == "failed") & (F.size(F.coalesce(event["codes"], _none())) > 0) & F.forall(F.coalesce(event["codes"], _none()), lambda x: fits_format(x, now["format"])))
    carried = (
        F.when(command == "mark_uploaded", event["format"].isin("pdf", "docx") & event["input_ref"].isNotNull())
        .when(command == "reject_upload", group.isin(*c.REJECTION_GROUPS))
        .when(command == "validation_needs_review", (F.size(reasons) > 0) & reasons_fit(reasons, ("blocking",), now["format"]))
        .when(command == "start_processing", now["attempt"] < c.MAX_ATTEMPTS)
        .when(command == "output_written", event["output_ref"].isNotNull() & (event["output_ref"] != now["input_ref"]) & reasons_fit(reasons, ("findings",), now["format"]))
        .when(command == "record_verification", judged)
        .when(command == "approve_review", may_approve(state, now["reasons"], now["outcome"]))
        .when(command == "fail", (in_group | (event["code"] == "JOB_TIMEOUT")) & fits_format(event["code"], now["format"]))
        .otherwise(True)
    )
    return F.coalesce(in_state & carried, F.lit(False))


def moved(now: Column, event: Column) -> Column:
    """The job after an event; one that it does not take changes nothing but the count of refusals. Time never runs back."""
    command, taken = event["command"], allowed(now, event)
    reasons = F.coalesce(event["reasons"], _none())
    after = verified(event["outcome"], now["reasons"], F.coalesce(event["codes"], _none()))
    state = F.when(command == "record_verification", after["state"])
    for name, (_, follows) in c.COMMANDS.items():
        if follows:
            state = state.when(command == name, follows)
    held = F.when(command.isin("validation_needs_review", "output_written"), reasons).when(command == "record_verification", after["review_reasons"]).when(state.isin(*c.TERMINAL), _none()).otherwise(now["reasons"])
    code = F.when(command.isin("reject_upload", "fail"), event["code"]).when(command == "interrupt", "JOB_INTERRUPTED").when(command == "cancel", "JOB_CANCELLED").when(command == "record_verification", after["error_code"]).otherwise(now["error_code"])
    is_ = lambda name, new, old: F.when(command == name, event[new]).otherwise(now[old])
    new = {
        "state": state, "version": now["version"] + 1, "format": is_("mark_uploaded", "format", "format"), "attempt": now["attempt"] + (command == "start_processing").cast("int"),
        "input_ref": is_("mark_uploaded", "input_ref", "input_ref"), "output_ref": is_("output_written", "output_ref", "output_ref"), "reasons": held,
        "outcome": is_("record_verification", "outcome", "outcome"), "error_code": code, "approved": now["approved"] | (command == "approve_review"), "updated_at": F.greatest(now["updated_at"], event["at"]), "refused": now["refused"],
    }
    done = F.struct(*[v.alias(k) for k, v in new.items()]).cast(JOB)
    kept = F.struct(*[(now[k] + 1 if k == "refused" else now[k]).alias(k) for k in new]).cast(JOB)
    return F.when(taken, done).otherwise(kept)


def replay(events: DataFrame) -> DataFrame:
    """document_id and the job's columns: events (document_id, seq, command, and what PAYLOAD names) applied from `created`.

    Every event depends on those before, so a document's few events are folded as one array, within the JVM.
    """
    blank = {"state": F.lit("created"), "version": F.lit(0), "attempt": F.lit(0), "reasons": _none(), "approved": F.lit(False), "refused": F.lit(0)}
    fields = [x.split(":")[0] for x in JOB[7:-1].replace("array<string>", "list").split(",")]
    start = F.struct(*[blank.get(k, F.lit(None)).alias(k) for k in fields]).cast(JOB)
    carried = [(F.col(k) if k in events.columns else F.lit(None)).cast(t).alias(k) for k, t in PAYLOAD.items()]
    lists = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command", *carried))).alias("e"))
    return lists.select("document_id", F.aggregate("e", start, moved).alias("s")).select("document_id", "s.*")


def step(current: DataFrame, commands: DataFrame) -> DataFrame:
    """current jobs (document_id and the columns of JOB) after one event each, with `accepted`. Documents without an event
    are not among them."""
    carried = [(F.col(k) if k in commands.columns else F.lit(None)).cast(t).alias(k) for k, t in PAYLOAD.items()]
    asked = commands.select("document_id", F.struct("command", *carried).alias("__e"))
    fields = [x for x in current.columns if x != "document_id"]
    rows = current.select("document_id", F.struct(*fields).cast(JOB).alias("__s")).join(asked, "document_id")
    return rows.select("document_id", moved(F.col("__s"), F.col("__e")).alias("s"), allowed(F.col("__s"), F.col("__e")).alias("accepted")).select("document_id", "s.*", "accepted")


def change_if_unchanged(current: DataFrame, changes: DataFrame) -> DataFrame:
    """change_id, document_id, verdict of changes (change_id, document_id, expected_version, arrival) that meet documents
    (document_id, version): the first that expects the version there is, is applied; others conflict or miss."""
    first = Window.partitionBy("document_id", F.col("expected_version") == F.col("version")).orderBy("arrival", "change_id")
    rows = changes.join(current.select("document_id", "version"), "document_id", "left").withColumn("__n", F.row_number().over(first))
    verdict = F.when(F.col("version").isNull(), "missing").when((F.col("expected_version") == F.col("version")) & (F.col("__n") == 1), "applied").otherwise("conflict")
    return rows.select("change_id", "document_id", verdict.alias("verdict"))


BATCH = "struct<state:string,documents:int,mask_salary:boolean,version:int,refused:int>"


def replay_batches(events: DataFrame) -> DataFrame:
    """batch_id, state, documents, mask_salary, version, refused: events (batch_id, seq, command, mask_salary, settled)
    applied in order from an open batch. finish needs `settled` (the states of all its documents: none can go on alone)."""
    start = F.struct(F.lit("open").alias("state"), F.lit(0).alias("documents"), F.lit(True).alias("mask_salary"), F.lit(0).alias("version"), F.lit(0).alias("refused")).cast(BATCH)

    def move(now: Column, event: Column) -> Column:
        command, state = event["command"], now["state"]
        fits = F.lit(False)
        for name, (states, _) in c.BATCH_COMMANDS.items():
            fits = F.when(command == name, state.isin(*states)).otherwise(fits)
        full = F.when(command == "add_document", now["documents"] < c.MAX_BATCH_FILES).when(command.isin("remove_document", "start"), now["documents"] > 0).when(command == "finish", F.coalesce(event["settled"], F.lit(False))).when(command == "set_mask_salary", event["mask_salary"].isNotNull()).otherwise(True)
        after = F.when((command == "record_retry") & (state == "finished"), "running")
        for name, (_, follows) in c.BATCH_COMMANDS.items():
            if follows:
                after = after.when(command == name, follows)
        documents = now["documents"] + F.when(command == "add_document", 1).when(command == "remove_document", -1).otherwise(0)
        salary = F.when(command == "set_mask_salary", event["mask_salary"]).otherwise(now["mask_salary"])
        done = F.struct(after.otherwise(state).alias("state"), documents.alias("documents"), salary.alias("mask_salary"), (now["version"] + 1).alias("version"), now["refused"].alias("refused")).cast(BATCH)
        kept = F.struct(state.alias("state"), now["documents"].alias("documents"), now["mask_salary"].alias("mask_salary"), now["version"].alias("version"), (now["refused"] + 1).alias("refused")).cast(BATCH)
        return F.when(F.coalesce(fits & full, F.lit(False)), done).otherwise(kept)

    lists = events.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command", F.col("mask_salary").cast("boolean").alias("mask_salary"), F.col("settled").cast("boolean").alias("settled")))).alias("e"))
    return lists.select("batch_id", F.aggregate("e", start, move).alias("s")).select("batch_id", "s.*")


def next_document(documents: DataFrame, batches: DataFrame) -> DataFrame:
    """The oldest uploaded document of the oldest running batch."""
    b = batches.where("state = 'running'").select("batch_id", F.col("created_at").alias("batch_created_at"))
    waiting = documents.where("state = 'uploaded'").join(b, "batch_id")
    return waiting.orderBy("batch_created_at", "batch_id", "created_at", "document_id").limit(1).select("batch_id", "document_id")


def in_order(documents: DataFrame) -> DataFrame:
    """documents with `position`: their place in their batch by creation, then id."""
    return documents.withColumn("position", F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "document_id")))


def settled(documents: DataFrame) -> DataFrame:
    """batch_id, settled: all its documents are final or wait for a person."""
    return documents.groupBy("batch_id").agg(F.bool_and(F.col("state").isin(*c.TERMINAL, "review_required")).alias("settled"))


def reconcile(stored: DataFrame, uses: DataFrame, now: Column | None = None, grace_hours: int = 1) -> DataFrame:
    """ref, verdict of stored objects: in_use, unneeded (only uses that are over), or orphan. With `now` and stored.modified,
    an orphan younger than the grace is `recent`: what wrote it may be about to record it."""
    known = uses.groupBy("ref").agg(F.bool_or("needed").alias("needed"))
    lone = F.lit("orphan") if now is None else F.when(F.col("modified") > now - F.make_interval(hours=F.lit(grace_hours)), "recent").otherwise("orphan")
    return stored.join(known, "ref", "left").select("ref", F.when(F.col("needed").isNull(), lone).when(F.col("needed"), "in_use").otherwise("unneeded").alias("verdict"))


def output_kept(state: Column, code: Column) -> Column:
    """Whether a job's output is still needed: not when denied or cancelled, nor failed for a reason nobody may look at."""
    inspect = F.coalesce(code.isin(*c.INSPECTABLE), F.lit(False))
    return ~state.isin("rejected", "cancelled") & ((state != "failed") | inspect)


def released(before: DataFrame, after: DataFrame) -> DataFrame:
    """document_id, ref, kind (input or output) of the files that a change of jobs (document_id, state, input_ref,
    output_ref, error_code) sets free."""
    a = after.select("document_id", F.col("state").alias("__state"), F.col("output_ref").alias("__output"), F.col("error_code").alias("__code"))
    rows = before.join(a, "document_id")
    mine = F.when(F.col("__state").isin(*c.TERMINAL) & F.col("input_ref").isNotNull(), F.struct(F.col("input_ref").alias("ref"), F.lit("input").alias("kind")))
    other = ~F.col("output_ref").eqNullSafe(F.col("__output")) | ~output_kept(F.col("__state"), F.col("__code"))
    done = F.when(F.col("output_ref").isNotNull() & other, F.struct(F.col("output_ref").alias("ref"), F.lit("output").alias("kind")))
    return rows.select("document_id", F.explode(F.array_compact(F.array(mine, done))).alias("f")).select("document_id", "f.*")


def purged(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of what is gone (key): a removed document, or all documents of a purged batch."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def retried(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """documents (document_id, batch_id, state) with failed ones replaced by uploads (failed_id, document_id): the new row
    stands as uploaded in the same batch. Uploads for documents that have not failed are refused, as is a second one."""
    first = uploads.groupBy("failed_id").agg(F.min("document_id").alias("__new"))
    rows = documents.join(first, documents.document_id == first.failed_id, "left")
    again = F.col("__new").isNotNull() & (F.col("state") == "failed")
    return rows.select(F.when(again, F.col("__new")).otherwise(documents.document_id).alias("document_id"), "batch_id", F.when(again, "uploaded").otherwise(F.col("state")).alias("state"), F.when(again, F.col("failed_id")).alias("replaces"))


def stale(objects: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    return objects.where(F.col("modificationTime") < now - F.make_interval(hours=F.lit(hours)))


def task_code(outcome: Column) -> Column:
    """The code of a task that did not finish: past its time, stopped with its worker, or for any other reason."""
    return F.when(outcome == "timeout", "JOB_TIMEOUT").when(outcome == "stopped", "JOB_INTERRUPTED").when(outcome.isin("crash", "error"), "INTERNAL_ERROR")


def claim_once(events: DataFrame) -> DataFrame:
    """One row for each (document_id, attempt), the first: a delivery that repeats is processed once."""
    first = Window.partitionBy("document_id", "attempt").orderBy("arrival")
    return events.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def recover(documents: DataFrame) -> DataFrame:
    """Documents that were being worked on fail with a code, as after a crash."""
    busy = F.col("state").isin("validating", "processing", "verifying")
    return documents.withColumn("error_code", F.when(busy, "JOB_INTERRUPTED")).withColumn("state", F.when(busy, "failed").otherwise(F.col("state")))


def code_group(code: Column) -> Column:
    """What an error code belongs to; a macro file is refused as an upload although its code names the format."""
    out = F.when(code == "DOCX_MACRO_OR_TEMPLATE", "upload")
    for start, group in c.CODE_GROUPS.items():
        out = out.when(code.startswith(start), group)
    return out.when(code.isNotNull(), "internal")


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*c.RETRYABLE), F.lit(False))


def code_format(code: Column) -> Column:
    """The only format a code fits, or null."""
    docx = (code.startswith("DOCX_") & (code != "DOCX_MACRO_OR_TEMPLATE")) | (code == "VERIFY_STRUCTURE_MISMATCH")
    return F.when(code.startswith("PDF_") | (code == "VERIFY_PAGE_COUNT_MISMATCH"), "pdf").when(docx, "docx")


def reason_kind(reason: Column) -> Column:
    """findings (a person may accept the output), verifier (may only deny it), blocking (may only delete the file)."""
    return F.when(reason.isin(*c.FINDINGS_REASONS), "findings").when(reason == "VERIFY_REVIEW", "verifier").when(reason.isin(*c.BLOCKING_REASONS), "blocking")


def primary_failure(codes: Column) -> Column:
    """The most serious of a document's failure codes, or null."""
    return F.get(F.array_intersect(F.array(*[F.lit(x) for x in c.FAILURE_ORDER]), codes), F.lit(0))


def verified(outcome: Column, reasons: Column, codes: Column) -> Column:
    """struct<state, review_reasons, error_code> after verification, for a document with reasons to be held (an array)."""
    held = F.when(outcome == "review_required", F.array_union(reasons, F.array(F.lit("VERIFY_REVIEW")))).otherwise(reasons)
    failed = outcome == "failed"
    state = F.when(failed, "failed").when(F.size(held) > 0, "review_required").otherwise("completed")
    return F.struct(state.alias("state"), F.when(failed, F.array().cast("array<string>")).otherwise(held).alias("review_reasons"), F.when(failed, primary_failure(codes)).alias("error_code"))


def may_approve(state: Column, reasons: Column, outcome: Column) -> Column:
    """Held for findings alone, and verified."""
    only = (F.size(reasons) > 0) & F.forall(reasons, lambda r: F.coalesce(reason_kind(r) == "findings", F.lit(False)))
    return F.coalesce((state == "review_required") & only & (outcome == "passed"), F.lit(False))


def downloadable(state: Column, code: Column, has_output: Column) -> Column:
    inspect = (state == "failed") & code.isin(*c.INSPECTABLE)
    return has_output & (state.isin("completed", "review_required") | F.coalesce(inspect, F.lit(False)))
