"""Exact top-k search by inner product with vector-approximation cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import partitions, small_batches
from inkveil.llm.vectors import dimension, matrix, selected

#: Each component's range is cut into so many cells.
CELLS = 16
#: Queries that are held against the candidates at a time: this bounds what is broadcast (x 64 components x 8 bytes: 4 MB).
QUERY_BLOCK = 8192
#: Candidates whose cells are scanned at a time.
CANDIDATE_BLOCK = 2048


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of each query's k best in a block, and how many exact vectors were read.

    The cells alone give an upper and a lower bound for every inner product. The kth best lower bound is what a query's
    kth result reaches at least. Exact vectors are then read from the highest upper bound on (the least distance), for as
    long as the bound may still reach the kth result; ids decide ties, so a bound that equals it is read as well.
    """
    cells = np.clip(np.floor((vectors - low) / width), 0, CELLS - 1)
    base, span = cells * width + low, width  # a component lies in [base, base + span]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    core = queries @ base.T
    upper, lower = core + (up @ span)[:, None], core + (down @ span)[:, None]
    own = query_ids[:, None] == ids[None, :]
    slack = 1e-9 * (1 + np.abs(upper).max(initial=0.0))  # for the rounding of these sums
    upper = np.where(own, -np.inf, upper + slack)
    lower = np.where(own, -np.inf, lower - slack)
    count = min(k, len(ids))
    sure = np.partition(lower, len(ids) - count, axis=1)[:, len(ids) - count]
    order = np.argsort(-upper, axis=1, kind="stable")
    out_q, out_i, out_s, read = [], [], [], 0
    for q in range(len(queries)):
        ranked = order[q]
        ranked = ranked[upper[q][ranked] >= sure[q]]
        ranked = ranked[np.isfinite(upper[q][ranked])]
        best_s, best_i, at = np.zeros(0), np.zeros(0, np.int64), 0
        while at < len(ranked):
            if len(best_s) == count and upper[q][ranked[at]] < best_s[-1]:
                break
            step = ranked[at : at + 4 * k]
            at += len(step)
            read += len(step)
            s, i = np.concatenate((best_s, vectors[step] @ queries[q])), np.concatenate((best_i, ids[step]))
            top = np.lexsort((i, -s))[:count]
            best_s, best_i = s[top], i[top]
        out_q.append(np.full(len(best_s), q))
        out_i.append(best_i)
        out_s.append(best_s)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s), read


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other rows, ties to the smaller id.

    With `scale`, components are floor(scale * x), so scores are exact integers (long); without, they are doubles.
    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id; a query
    among them has no result. Fewer than k candidates give as many rows. Rows that repeat an id are candidates each, and
    a query that repeats is answered once (by its first row). Other columns are not looked at.

    The candidates are never shuffled: each task scans its rows in blocks of cells against a block of queries. Query
    blocks are cut so that what is broadcast has a fixed bound; a task hands on k rows for each query.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = selected(rows, id_col, vector_col, is_query.alias("asks"))
    if scale is not None:
        v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    kind = "long" if scale is not None else "double"
    schema = f"query_id long, rank int, vec_id long, score {kind}"
    dim = dimension(v)
    if not dim:
        return spark.createDataFrame([], schema)
    ends = v.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dim) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    low = np.array([ends[f"a{i}"] for i in range(dim)])
    width = np.maximum((np.array([ends[f"b{i}"] for i in range(dim)]) - low) / CELLS, 1e-12)
    queries = v.where(F.coalesce("asks", F.lit(False))).groupBy("id").agg(F.first("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        asked = queries.where(block == b).collect() if blocks > 1 else queries.collect()  # about QUERY_BLOCK rows
        asked.sort(key=lambda r: r["id"])
        if not asked:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["v"] for r in asked]), np.array([r["id"] for r in asked], np.int64), low, width))
        part = v.select("id", "v").mapInArrow(_scan(sent, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.repartition(partitions(spark), "query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score"))


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, low, width = sent.value
        best_s = np.full((len(queries), k), -np.inf)
        best_i = np.full((len(queries), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                b = batch.slice(at, CANDIDATE_BLOCK)
                vectors, ids = matrix(b.column("v")), b.column("id").to_numpy()
                for q in range(0, len(queries), 512):
                    own = slice(q, q + 512)
                    qi, i, s, _ = search_block(queries[own], query_ids[own], vectors, ids, low, width, k)
                    # each query's results of this block beside its best so far
                    place = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
                    new_s, new_i = np.full((len(best_s[own]), k), -np.inf), np.full((len(best_s[own]), k), np.iinfo(np.int64).max)
                    new_s[qi, place], new_i[qi, place] = s, i
                    all_s, all_i = np.hstack((best_s[own], new_s)), np.hstack((best_i[own], new_i))
                    top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    best_s[own], best_i[own] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
        real = np.isfinite(best_s)
        if real.any():
            q = np.nonzero(real)[0]
            yield pa.record_batch([pa.array(query_ids[q]), pa.array(best_i[real]), pa.array(best_s[real])], ["query_id", "vec_id", "score"])

    return run
