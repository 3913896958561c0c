"""A training corpus from raw documents: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents (the last: tokens). run()
writes each stage's rows as Parquet in the shared folder and reads them as the next stage's docs, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, mixing, pii, quality, simhash
from inkveil.llm.common import materialize, table
from inkveil.llm.queries import PII_KEY, labelled_domains, tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels outside the held-out quarter.

    A row's text alone decides: null and empty texts count as empty, repeated rows fare alike, null ids are kept or not like
    others. Without labels or documents all rows stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words (null, empty) are one group. Rows with a null id, and all that repeat a group's smallest id, stay.
    """
    return simhash.keep_first(docs, simhash.similar_groups(docs, shingle=5, similarity=0.8))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data; n_chars follows the new text. Null texts stay null, repeated
    rows get the same pseudonyms."""
    out = pii.pseudonymise(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of thin languages as often as brings the shares to N ** 0.7; none is lost.

    Null and empty texts have no words and the languages' priors. Repeated rows are repeated alike; without labels every
    row comes once.
    """
    return mixing.resample(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), 0.7)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null texts count as empty, repeated rows repeat."""
    return bpe.round_trip(docs, *tokenizer())


STAGES = [("quality", good), ("near_dedup", distinct), ("pii", private), ("mixing", mixed), ("bpe", tokens)]

#: A classifier, fingerprints and merges by rank are beyond SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
