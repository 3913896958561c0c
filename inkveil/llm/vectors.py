"""Matrices from Arrow list columns, and which vectors take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import as_long


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold no null and no infinite or undefined component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def selected(rows: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """(id, others, v array<double>) of the rows with an id and a usable vector."""
    v = F.col(vector_col).cast("array<double>")
    return rows.select(as_long(id_col).alias("id"), *others, v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column whose lists are equally long, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def dimension(rows: DataFrame) -> int:
    """The one length of all vectors in v; an error if they differ, 0 if there is none."""
    found = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if found[0] != found[1]:
        raise ValueError(f"vectors of {found[0]} and of {found[1]} components cannot be compared")
    return found[0] or 0
