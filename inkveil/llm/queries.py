"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import automaton, bpe, lattice, mixing, packing, pii, quality, simhash, suffix_dedup, topk
from inkveil.llm.common import table

#: Of the pseudonyms. A real run passes its own secret.
PII_KEY = "inkveil-example-key"


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain): the language of those documents that the labels table covers. The ids broadcast are bounded."""
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40))
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    cut = int(min(1.0, mixing.LABELLED / max(1, ids.count())) * (1 << 40))
    picked = ids.where(part < cut).limit(2 * mixing.LABELLED)
    return docs.join(F.broadcast(picked), "doc_id").select("text", F.col("lang").alias("domain"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.substring_dedup(table(spark, sf_dir, "documents"), 13)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), *tokenizer(), capacity=2048))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), 50)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), shingle=4, seed=42, distance=4)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domains = ("en", "de", "fr", "es")
    return mixing.document_rates(docs.select("doc_id", "text"), labelled_domains(docs, table(spark, sf_dir, "labels")), {k: 0.25 for k in domains})


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1,
    "op2_bpe": op2,
    "op3_packing": op3,
    "op4_suffix_dedup": op4,
    "op5_simhash_dedup": op5,
    "op6_top_k": op6,
    "op7_pii": op7,
    "op8_mixing": op8,
    "op9_quality": op9,
    "op10_embedding_dedup": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT win.doc_id, win.i, unnest(range(0, 13)) AS k FROM win JOIN least USING (s) WHERE m < win.doc_id)),
        tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT tok.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY tok.i) AS t FROM tok ANTI JOIN gone USING (doc_id, i) GROUP BY tok.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        byte AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM d),
        win AS (SELECT doc_id, i, s FROM (SELECT doc_id, i, string_agg(x, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM byte) WHERE length(s) = 100),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (s) WHERE m < win.doc_id),
        marked AS (SELECT byte.doc_id, byte.i, x, max(hit.i) OVER (PARTITION BY byte.doc_id ORDER BY byte.i) AS last FROM byte LEFT JOIN hit ON byte.doc_id = hit.doc_id AND byte.i = hit.i),
        gone AS (SELECT *, coalesce(i - last < 50, false) AS g FROM marked),
        told AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS b FROM gone),
        kept AS (SELECT doc_id, count(*) FILTER (g) AS n, count(*) FILTER (b) AS spans, string_agg(x, '' ORDER BY i) FILTER (NOT g) AS t FROM told GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(kept.n, 0) AS n_removed, coalesce(kept.spans, 0) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(least.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(least.m, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least ON e.vec_id = least.a""",
}
