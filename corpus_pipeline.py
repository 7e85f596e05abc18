"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage takes documents with ``doc_id`` and ``text`` and any further columns, and all but the last return the columns they
were given. Edge cases, in all stages: an empty table gives no rows; a null text is empty; rows with a null doc_id belong to
no group and repeat nothing, and are judged by their text alone; rows that repeat a doc_id are judged one by one, but
for the near copies, of which one stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe_words, decontaminate, minhash_dedup, quality_classifier, substring_dedup
from colloquy.llm.queries import BYTE_RANKS
from colloquy.llm.shared import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, does not reject; null and empty texts go."""
    return quality_classifier.keep_good(docs, quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; texts without words are no copies."""
    return minhash_dedup.drop_near_duplicates(docs, minhash_dedup.NearDedup(percent=80, margin=0.1, rows=6, bands=42))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; what is left may be empty, and the row stays."""
    return substring_dedup.cut_passages(docs, substring_dedup.find_passages(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty items are no items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


#: Bytes of text that are tokenized as one batch. A task holds several times as much, and its Python process lives on into the next stages.
TOKEN_BATCH_BYTES = 2 << 20


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` by byte-level BPE; an empty text has no ids."""
    out = bpe_words.byte_bpe(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, batch_bytes=TOKEN_BATCH_BYTES)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Bytes of a batch that goes to Python or comes from it. By rows alone a batch has 10,000 documents, and the JVM and Python hold several.
BATCH_BYTES = 4 << 20


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with batches of ``BATCH_BYTES`` in its session; results do not depend on batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_classifier", _in_small_batches(good_documents)),
    ("near_dedup", _in_small_batches(one_of_near_copies)),
    ("substring_dedup", _in_small_batches(without_repeated_passages)),
    ("decontamination", _in_small_batches(without_benchmark)),
    ("byte_bpe", _in_small_batches(token_ids)),
]

#: Fitted models, chains of seeds and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
