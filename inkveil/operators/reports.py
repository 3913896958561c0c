"""Counts, the report table, and how well detection did."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.functions.text import spans
from inkveil.operators.resolve import entity_number
from inkveil.plans.storage import dealt


def finding_counts(found: DataFrame) -> DataFrame:
    """document_id, entity_type, ordinal, n."""
    return found.groupBy("document_id", "entity_type").agg(F.count("*").alias("n")).withColumn("ordinal", entity_number(F.col("entity_type"), 0))


def report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each document with a count for every entity, zero where there is none."""
    wide = found.groupBy("document_id").pivot("entity_type", list(c.ENTITIES)).agg(F.count(F.lit(1)))
    out = documents.select("document_id").join(wide, "document_id", "left").fillna(0, list(c.ENTITIES))
    return out.select("document_id", *[F.col(e).cast("long").alias(f"count_{e}") for e in c.ENTITIES])


def batch_report(documents: DataFrame, found: DataFrame, hidden: DataFrame) -> DataFrame:
    """document_id, status, error_code, count_* of every entity and hidden_* of every kind, for each of documents
    (document_id, state, error_code). hidden: document_id, category, n."""
    wide = hidden.groupBy("document_id").pivot("category", list(c.HIDDEN_KINDS)).agg(F.sum("n"))
    out = documents.select("document_id", F.col("state").alias("status"), "error_code").join(report(documents, found), "document_id").join(wide, "document_id", "left").fillna(0, list(c.HIDDEN_KINDS))
    return out.select("document_id", "status", "error_code", *[f"count_{e}" for e in c.ENTITIES], *[F.col(k).cast("long").alias(f"hidden_{k}") for k in c.HIDDEN_KINDS])


def part_key(page_number: Column, part_name: Column) -> Column:
    return F.when(page_number.isNotNull(), F.concat(F.lit("page:"), page_number.cast("string"))).when(part_name.isNotNull(), F.concat(F.lit("part:"), part_name)).otherwise("unknown")


def gold_spans(parts: DataFrame, annotations: DataFrame) -> DataFrame:
    """document_id, part_key, entity_type, start, end of every occurrence of the annotated values (document_id,
    entity_type, value) in their document's parts; those inside longer ones go."""
    keyed = parts.select("document_id", "text", part_key(F.col("page_number"), F.col("part_name")).alias("part_key"))
    asked = annotations.where(F.length("value") > 0).distinct().withColumn("__p", F.concat(F.lit("\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    each = keyed.join(asked, "document_id").select("document_id", "part_key", "entity_type", F.explode(spans(F.col("text"), F.col("__p"))).alias("s"))
    return gold_without_nested(each.select("document_id", "part_key", "entity_type", "s.start", "s.end"))


def totals(outcomes: DataFrame) -> DataFrame:
    """format, documents, failed, review_required, scored, leaked, failure_rate, review_rate of outcomes (document_id,
    format, outcome, leaked; leaked is null where nothing was scored)."""
    out = outcomes.groupBy("format").agg(F.count("*").alias("documents"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "review_required").alias("review_required"), F.count_if((F.col("outcome") != "failed") & F.col("leaked").isNotNull()).alias("scored"), F.coalesce(F.sum(F.when(F.col("outcome") != "failed", F.col("leaked"))), F.lit(0)).alias("leaked"))
    return out.withColumn("failure_rate", F.round(F.col("failed") / F.col("documents"), 4)).withColumn("review_rate", F.round(F.col("review_required") / F.col("documents"), 4))


def gold_without_nested(gold: DataFrame) -> DataFrame:
    """Gold spans that no longer one of the same part covers."""
    part = (F.col("o.document_id") == F.col("g.document_id")) & (F.col("o.part_key") == F.col("g.part_key"))
    covers = (F.col("o.start") <= F.col("g.start")) & (F.col("g.end") <= F.col("o.end")) & (F.col("o.end") - F.col("o.start") > F.col("g.end") - F.col("g.start"))
    return gold.alias("g").join(gold.alias("o"), part & covers, "left_anti").select(*[F.col(f"g.{x}").alias(x) for x in gold.columns])


def scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """entity_type, gold, predicted, correct, precision, recall by exact spans; null where nothing is divided."""
    key = ["document_id", "part_key", "entity_type", "start", "end"]
    none, one = F.lit(None).cast("int"), F.lit(1)
    each = gold.select(*key, one.alias("g"), none.alias("p")).unionByName(predicted.select(*key, none.alias("g"), one.alias("p")))
    # a span without one of its keys is nothing that the other side could have meant
    whole = reduce(and_, [F.col(k).isNotNull() for k in key])
    both = dealt(each, "document_id").groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    out = both.groupBy("entity_type").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.when(whole & F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("correct"))
    return out.withColumn("precision", F.when(F.col("predicted") > 0, F.round(F.col("correct") / F.col("predicted"), 4))).withColumn("recall", F.when(F.col("gold") > 0, F.round(F.col("correct") / F.col("gold"), 4)))


def leaked(values: DataFrame, outputs: DataFrame) -> DataFrame:
    """document_id, leaked: distinct annotated values of six characters or more that the output still holds."""
    asked = values.where(F.length("value") >= c.MIN_SEARCHED_CHARS).select("document_id", "value").distinct()
    held = asked.join(outputs.select("document_id", "text"), "document_id").where(F.col("text").contains(F.col("value")))
    n = held.groupBy("document_id").agg(F.countDistinct("value").alias("leaked"))
    return outputs.select("document_id").distinct().join(n, "document_id", "left").select("document_id", F.coalesce("leaked", F.lit(0)).alias("leaked"))
