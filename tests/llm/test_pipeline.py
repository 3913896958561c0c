import hashlib
import time

import pyarrow as pa
import pytest

import corpus_pipeline
from inkveil.llm import queries
from inkveil.llm.bpe import load

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, SF))
        assert after.columns == docs.columns, name
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        if name in ("quality", "near_dedup"):
            assert ids(after) < ids(before)
        else:
            assert ids(after) == ids(before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    own, want = load(*queries.tokenizer()), []
    for r in before.select("doc_id", "text").collect():
        e = own.encode([r.text])[0].tolist()
        want.append((r.doc_id, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(x) for x in last.collect()) == sorted(want)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_nulls_and_empty_tables(spark, stage):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "word " * 5000, None, "s", 25000), (2, "word " * 5000, None, "s", 25000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = corpus_pipeline.STAGES[stage][1]
    run(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert run(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_workers_let_the_encoder_go(spark):
    """Workers outlive their stage; an encoder that they kept would take memory from the stages that follow."""

    def held(batches):
        from inkveil.llm.bpe import load

        sizes = [load.cache_info().currsize for b in batches]
        yield pa.record_batch([pa.array(sizes, pa.int64())], ["n"])

    probe = spark.range(0, 4, 1, 4).mapInArrow(held, "n long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    assert corpus_pipeline.tokens(spark, docs, SF).collect()
    assert sum(r.n for r in probe.collect()) > 0  # these are the same workers
    time.sleep(7)
    assert sum(r.n for r in probe.collect()) == 0
