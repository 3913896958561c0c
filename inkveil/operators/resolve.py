"""Overlapping hits to disjoint findings, findings to ranges with one label, ranges to redacted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.plans.storage import dealt

PART = ("document_id", "part_seq")


def entity_number(entity: Column, of: int) -> Column:
    """Priority (of = 1) or ordinal (of = 0) of an entity."""
    table = {e: (i, p) for i, (e, (_, p)) in enumerate(c.ENTITIES.items())}
    return F.create_map(*[F.lit(x) for e, v in table.items() for x in (e, v[of])])[entity]


def label_of(entity: Column) -> Column:
    return F.create_map(*[F.lit(x) for e, (label, _) in c.ENTITIES.items() for x in (e, label)])[entity]


def islands(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """rows with `island`: a run of spans of which each overlaps one before it strictly; those that only touch stay apart.
    Rows that the order leaves equal are of one island."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("island", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def merge_same_type(hits: DataFrame) -> DataFrame:
    """Hits of one entity that overlap become one: the union, the best confidence, the first strongest detector."""
    keys = (*PART, "entity_type")
    rows = islands(dealt(hits, "document_id"), keys, "start", "end", "seq").withColumn("first_seen", F.min("seq").over(Window.partitionBy(*keys)))
    best = F.max_by("detector_id", F.struct(F.col("confidence"), -F.col("start"), -F.col("end"), -F.col("seq")))
    signals = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "seq", "signals"))), lambda x: x["signals"])))
    out = rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), best.alias("detector_id"), signals.alias("signals"), F.min("first_seen").alias("first_seen"))
    return out.drop("island")


def drop_contained(hits: DataFrame) -> DataFrame:
    """Merged hits without those that a longer (or equal, but higher or earlier) hit of another entity covers.

    What covers a dropped hit either stays or is itself covered by what then covers both. By start, longest first, then
    highest and earliest, all that may cover a hit come before it and those that end behind it do cover it; hits of its
    own entity are disjoint, so one look at the farthest end so far is enough. Hits equal in all of that cover none of
    each other: each looks at what came before the first of them.
    """
    rows = hits.withColumns({"__end": -F.col("end"), "__rank": -entity_number(F.col("entity_type"), 1)})
    order = ("start", "__end", "__rank", "first_seen")
    known = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("entity_type").isNotNull()
    w = Window.partitionBy(*PART).orderBy(*order)
    before, one = w.rowsBetween(Window.unboundedPreceding, -1), F.struct(F.when(known, F.col("__end")).alias("end"), "entity_type")
    # of the hits that end farthest, the first and the last entity by name
    seen = F.struct(F.min(F.when(known, one)).over(before).alias("a"), F.max(F.when(known, F.struct("end", "entity_type"))).over(before).alias("b"))
    rows = rows.withColumns({"__n": F.row_number().over(w), "__seen": seen})
    rows = rows.withColumn("__first", F.min_by("__seen", "__n").over(Window.partitionBy(*PART, *order)))
    far, other = F.col("__first.b.end"), (F.col("__first.a.entity_type") != F.col("entity_type")) | (F.col("__first.b.entity_type") != F.col("entity_type"))
    covered = F.col("document_id").isNotNull() & F.col("part_seq").isNotNull() & known & (far >= F.col("end")) & other
    return rows.where(~F.coalesce(covered, F.lit(False))).select(*hits.columns)


def resolve(hits: DataFrame) -> DataFrame:
    return drop_contained(merge_same_type(hits))


def action(entity: Column, confidence: Column, mask_salary: bool = True) -> Column:
    """What the policy does with a hit."""
    off = c.UNHANDLED if mask_salary else (*c.UNHANDLED, *c.OPTIONAL)
    return F.when(confidence < c.DISCARD_BELOW, "discard").when(entity.isin(*off), "detected_not_redacted").when(confidence >= c.REDACT_AT, "redact").otherwise("redact_and_review")


def findings(resolved: DataFrame, mask_salary: bool = True) -> DataFrame:
    """Resolved hits that are not discarded, with action, label, requires_review and an id made of their place."""
    return described(resolved.withColumn("action", action(F.col("entity_type"), F.col("confidence"), mask_salary)).where("action <> 'discard'"))


def suppressed(resolved: DataFrame) -> DataFrame:
    """document_id, suppressed: resolved hits too weak to count."""
    return resolved.groupBy("document_id").agg(F.count_if(F.col("confidence") < c.DISCARD_BELOW).alias("suppressed"))


def described(out: DataFrame) -> DataFrame:
    """Findings (with action) with label, requires_review and an id made of their place."""
    out = out.withColumn("replacement_label", label_of(F.col("entity_type"))).withColumn("requires_review", F.col("confidence") < c.REDACT_AT)
    return out.withColumn("finding_id", F.sha2(F.concat_ws("|", "document_id", "part_seq", "start", "end", "entity_type"), 256))


def review_reasons(documents: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, low_confidence, no_candidate_name, ambiguous of every document, those without any finding too.

    found may have a column `ambiguous`: that its place on the page is drawn over by another."""
    redacted = F.col("action").isin("redact", "redact_and_review")
    drawn = F.bool_or(redacted & F.coalesce("ambiguous", F.lit(False))) if "ambiguous" in found.columns else F.lit(False)
    flags = found.groupBy("document_id").agg(F.bool_or(redacted & F.col("requires_review")).alias("low_confidence"), F.bool_or(F.col("entity_type") == "candidate_name").alias("named"), drawn.alias("ambiguous"))
    out = documents.select("document_id").join(flags, "document_id", "left")
    return out.select("document_id", F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"), (~F.coalesce("named", F.lit(False))).alias("no_candidate_name"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def ordered(resolved: DataFrame) -> DataFrame:
    """Resolved hits with `position`, their place in the order of results: start, end, then the entities' order."""
    by = Window.partitionBy(*PART).orderBy("start", "end", entity_number(F.col("entity_type"), 0))
    return resolved.withColumn("position", F.row_number().over(by))


def ranges(found: DataFrame) -> DataFrame:
    """Redacted findings that overlap, whatever their entity, as one range with the label of the highest priority."""
    rows = islands(found.where("action in ('redact', 'redact_and_review')"), PART, "start", "end")
    winner = F.max_by("entity_type", F.struct(entity_number(F.col("entity_type"), 1), -entity_number(F.col("entity_type"), 0)))
    out = rows.groupBy(*PART, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), winner.alias("entity_type"), F.count("*").alias("n_findings"))
    return out.drop("island").withColumn("replacement_label", label_of(F.col("entity_type")))


def replaced(text: Column, cuts: Column) -> Column:
    """text with the ranges of an array (start, end, replacement_label; disjoint, in order) replaced by their labels."""
    last = F.struct(F.length(text).alias("start"), F.lit(0).alias("end"), F.lit("").alias("replacement_label"))
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["end"]))
    pieces = F.zip_with(F.concat(cuts, F.array(last)), ends, lambda r, at: F.concat(F.substring(text, at + 1, r["start"] - at), r["replacement_label"]))
    return F.array_join(pieces, "")


def redact(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """parts with `redacted`: every range replaced by its label. Parts without a range keep their text. For ranges that
    are rows of their own; plans.detection.judged() redacts within the document's row."""
    lists = placed.groupBy(*PART).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement_label"))).alias("__r"))
    text = F.when(F.col("__r").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__r")))
    return parts.join(lists, list(PART), "left").withColumn("redacted", text).drop("__r")


def validated(selected: tuple[str, ...]) -> tuple[str, ...]:
    """A selection of entities to redact, in their order; an error if it names an unknown one, one that is never handled,
    or leaves out one that is mandatory."""
    unknown = set(selected) - set(c.ENTITIES)
    if unknown or set(selected) & set(c.UNHANDLED):
        raise ValueError(f"cannot be redacted: {sorted(unknown | set(selected) & set(c.UNHANDLED))}")
    missing = [e for e in c.ENTITIES if e not in (*c.UNHANDLED, *c.OPTIONAL, *selected)]
    if missing:
        raise ValueError(f"must be redacted: {missing}")
    return tuple(e for e in c.ENTITIES if e in selected)


def selection_errors(selections: DataFrame) -> DataFrame:
    """selections (policy_id, entities) with `missing`, `refused` (arrays) and `valid`: validated() for a table."""
    must = F.array(*[F.lit(e) for e in c.ENTITIES if e not in (*c.UNHANDLED, *c.OPTIONAL)])
    may = F.array(*[F.lit(e) for e in c.ENTITIES if e not in c.UNHANDLED])
    out = selections.withColumn("missing", F.array_except(must, "entities")).withColumn("refused", F.array_sort(F.array_except("entities", may)))
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("refused") == 0))