"""Value shapes as Catalyst expressions: what needs no context stays in the JVM. All other rules are in operators.scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.functions.text import spans

SHAPES = (("email", c.EMAIL, c.SCORE_HIGH), ("phone", c.PHONE, c.SCORE_HIGH), ("national_id", c.CITIZEN_ID, c.SCORE_VALUE))


def shape_hits(parts: DataFrame, entities: tuple[str, ...] = ("email", "phone", "national_id")) -> DataFrame:
    """document_id, part_seq, seq and the hit's columns of e-mail addresses, telephone and citizen numbers anywhere."""
    made = [_hits(e, spans(F.col("text"), p), x) for e, p, x in SHAPES if e in entities]
    return parts.select("document_id", "part_seq", F.posexplode(F.concat(*made)).alias("seq", "h")).select("document_id", "part_seq", "seq", "h.*")


def _hits(entity: str, found: Column, score: float) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(entity).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(score).alias("confidence"), F.lit(entity).alias("detector_id"), F.array().cast("array<string>").alias("signals")))
