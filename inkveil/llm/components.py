"""Connected components of a link table, with every step a shuffle and none on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import discard, materialize, release


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least) of every node in the links (a, b) but the least of each component, within one task."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        before = root
        low = np.minimum(before[x], before[y])
        root = before.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node a (b < a, no link twice) has one link and is nobody's b: the links are the result then."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionAll(links.select(F.col("b").alias("n"), F.lit(0).alias("up")))
    open_ = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count("*").alias("all")).where("up > 0 and all > 1")
    return not open_.agg(F.count("*")).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b: long): component is the smallest node reachable.

    Alternates large-star and small-star until only stars are left, O(log n) rounds of two joins, none if the links are
    stars from the start. Each round is written to the shared folder, so the lineage stays short and a lost executor costs
    one round at most; what the driver and the executors hold of the finished ones is let go.
    Nulls and self-links are left out; repeated links count once; an empty table gives an empty result.
    """
    now = materialize(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    release(links.sparkSession)
    while not _settled(now):
        before = now
        now = materialize(_small_star(_large_star(before)))
        discard(before)
        release(links.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
