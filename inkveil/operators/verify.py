"""Checks of redacted text that do not trust what redacted it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.functions.text import exactly_folded
from inkveil.operators.resolve import action, resolve


def value_pattern(entity: Column, value: Column, folded: Callable[[Column], Column] = exactly_folded) -> Column:
    """A pattern for a source value in folded text, or null where the value is too plain to be searched for. folded must be
    what folds the text that is searched."""
    tokens = F.regexp_extract_all(folded(value), F.lit("[a-z0-9]+"), F.lit(0))
    long_enough = F.length(F.array_join(tokens, "")) >= c.MIN_SEARCHED_CHARS
    digit = value.rlike(r"(?U)\d")
    searched = (
        F.when(entity.isin("candidate_name", "reference_name"), F.size(tokens) >= 2)
        .when(entity == "date_of_birth", digit)
        .when(entity == "postal_address", digit & (F.size(tokens) >= 3))
        .otherwise(entity.isin("email", "phone", "national_id", "passport"))
    )
    return F.when(long_enough & searched, F.concat(F.lit("(?<![a-z0-9])"), F.array_join(tokens, "[^a-z0-9]{0,3}"), F.lit("(?![a-z0-9])")))


def without_kept_urls(folded: Column) -> Column:
    """Profile addresses, which stay in the output, blanked: four spaces, more than a value's gaps may span."""
    return F.regexp_replace(folded, c.KEPT_URL, "    ")


def residues(values: DataFrame, outputs: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """document_id, entity_type, part_seq, page_number of each source value (document_id, entity_type, value) that an
    output part (document_id, part_seq, text, page_number if known) still holds; with raw objects of the output
    (document_id, text) also, without a part, of those that only they hold.

    An equi join by document; the value stays out of the result. Folding is exact, so decomposed text hides nothing.
    """
    asked = values.withColumn("__p", value_pattern(F.col("entity_type"), F.col("value"))).where("__p is not null").select("document_id", "entity_type", "__p").distinct()
    page = F.col("page_number").cast("int") if "page_number" in outputs.columns else F.lit(None).cast("int")
    found = _holding(asked, outputs.select("document_id", "part_seq", page.alias("page_number"), exactly_folded(F.col("text")).alias("__t")))
    if raw is not None:
        none = F.lit(None).cast("int")
        more = _holding(asked, raw.select("document_id", none.alias("part_seq"), none.alias("page_number"), exactly_folded(F.col("text")).alias("__t"))).distinct()
        key = ["document_id", "entity_type", "__p"]
        found = found.unionByName(more.join(found.select(*key).distinct(), key, "left_anti"))
    return found.drop("__p")


def _holding(asked: DataFrame, held: DataFrame) -> DataFrame:
    names = F.col("entity_type").isin("candidate_name", "reference_name")
    hay = F.when(names, without_kept_urls(F.col("__t"))).otherwise(F.col("__t"))
    return asked.join(held, "document_id").where(F.regexp_like(hay, F.col("__p"))).select("document_id", "entity_type", "part_seq", "page_number", "__p")


def residual_counts(found: DataFrame) -> DataFrame:
    """document_id, entity_type, count, pages: how often each entity is left, and its pages in order, each once."""
    return found.groupBy("document_id", "entity_type").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("page_number")).alias("pages"))


def label_only(text: Column) -> Column:
    """True where nothing but replacement labels and marks is left."""
    return ~F.regexp_replace(text, "|".join(re.escape(x) for x in c.REPLACEMENTS), "").rlike(r"(?U)[\p{L}\p{N}]")


def rerun(hits: DataFrame, outputs: DataFrame, mask_salary: bool = True) -> DataFrame:
    """document_id, residual, uncertain: how many of the field hits of the output (document_id, part_seq, text) are of
    entities that the policy redacts, and more than labels."""
    asked = action(F.col("entity_type"), F.col("confidence"), mask_salary).startswith("redact")
    hits = resolve(hits).where(asked).join(outputs.select("document_id", "part_seq", "text"), ["document_id", "part_seq"])
    live = hits.where(~label_only(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))))
    counts = live.groupBy("document_id").agg(F.count_if(F.col("confidence") >= c.REDACT_AT).alias("residual"), F.count_if((F.col("confidence") >= c.DISCARD_BELOW) & (F.col("confidence") < c.REDACT_AT)).alias("uncertain"))
    zero = F.lit(0).cast("long")
    return outputs.select("document_id").distinct().join(counts, "document_id", "left").select("document_id", F.coalesce("residual", zero).alias("residual"), F.coalesce("uncertain", zero).alias("uncertain"))


def same_text(expected: Column, found: Column) -> Column:
    """Equal but for white space."""
    return F.regexp_replace(expected, r"(?U)\s+", "") == F.regexp_replace(found, r"(?U)\s+", "")


def outcome(failures: Column, uncertain: Column) -> Column:
    return F.when(failures > 0, "failed").when(uncertain > 0, "review_required").otherwise("passed")
