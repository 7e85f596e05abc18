"""The registered queries of this subpackage: each operator over its whole table, as its contract digests it."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe_words, chat_format, decontaminate, entropy_mix, html_extract, license_scan, merkle_manifest, minhash_dedup, oracles, product_codes, quality_classifier, quality_rules, substring_dedup, token_orc
from colloquy.llm.shared import new_path, table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_passages(table(spark, sf_dir, "documents"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER), end_id=1)
    return token_orc.with_checksum(token_orc.read_token_orc(spark, path))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    template = chat_format.ChatTemplate()
    out = chat_format.read_back(chat_format.format_chats(given.unionByName(probe), template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "valid_order",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.byte_bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    leaves = merkle_manifest.document_leaves(table(spark, sf_dir, "documents"), {"text": F.when(tampered, lower).otherwise(F.col("text"))})
    out = merkle_manifest.merkle_manifest(leaves)
    out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("proof_sha256"), merkle_manifest.folded("found").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.entropy_mix(table(spark, sf_dir, "documents"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = product_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    out = product_codes.with_label_error(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(product_codes.codebook_digest(books)))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_substring_dedup, op3_token_orc, op4_minhash_dedup, op5_chat_format, op6_html_extract, op7_byte_bpe, op8_quality_rules, op9_license_scan, op10_decontaminate, op11_merkle_manifest, op12_entropy_mix, op13_product_codes)}

ORACLE_SQL = oracles.ORACLE_SQL
