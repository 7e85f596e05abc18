"""Stages of the pipeline hand wide rows to Python in batches bounded by bytes, not by rows alone."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm import bpe_words

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_bound_the_bytes_of_a_batch(spark):
    before = spark.conf.get(LIMIT)
    docs = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("x"), 3000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.set(LIMIT, before)
            stage(spark, spark.createDataFrame([], "doc_id long, text string"), "/root/testdata/sf0.001")
            assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 1.5 * corpus_pipeline.BATCH_BYTES  # once 27 MB
    finally:
        spark.conf.set(LIMIT, before)


def test_texts_are_tokenized_in_batches_of_bounded_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(bpe_words, "bucketed", lambda df, name, key, f=bpe_words.bucketed: held.append(f(df, name, key)) or held[-1])
    docs = spark.range(0, 20, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id", F.lit(" ")), 120_000).alias("text"))
    rows = corpus_pipeline.token_ids(spark, docs, "").select("doc_id", "n_tokens", "decoded_sha256").collect()
    want = {r["doc_id"]: r["sha"] for r in docs.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == want and min(r["n_tokens"] for r in rows) > 120_000
    assert max(len(r["doc_ids"]) for r in held[0].select("doc_ids").collect()) * 120_000 * 7 <= corpus_pipeline.TOKEN_BATCH_BYTES  # once all 20 in one batch
