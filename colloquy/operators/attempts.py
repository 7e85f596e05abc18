"""A table of every attempt to rewrite a chunk: what went in, what came out, and the verdict.

A rewriter takes the words of open chunks (``transcript_id, chunk, i, text`` and further columns) and the number of the attempt, and adds
``new_text``. Chunks whose rewriting passes its check are closed; the others are tried again, ``most`` times at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import chunks, redact
from colloquy.operators.segments import joined
from colloquy.work import materialise

Check = Callable[[DataFrame], DataFrame]


def attempts(words: DataFrame, rewrite: Callable[[DataFrame, int], DataFrame], check: Check = redact.validate_first_pass, number: int = 1, most: int = 4, size: int = 400, overlap: int = 70, min_final: int = 200) -> DataFrame:
    """``pass, transcript_id, chunk, attempt, from_word, to_word, from_s, to_s, input, output, input_words, output_words, passed, reason``.

    Each attempt is written before the next begins, so a rewriter sees a chunk once an attempt.
    """
    placed = materialise(chunks.chunk_words(words, size, overlap, min_final), "placed")
    text = lambda c, name: joined(F.collect_list(F.struct("i", F.col(c).alias("text")))).alias(name)
    done, open_ = [], placed
    for attempt in range(1, most + 1):
        spans = [F.min("word_idx").alias("from_word"), F.max("word_idx").alias("to_word"), F.min_by("start_s", "i").alias("from_s"), F.max_by("end_s", "i").alias("to_s")]
        pairs = rewrite(open_, attempt).groupBy("transcript_id", "chunk").agg(text("text", "original"), text("new_text", "processed"), *spans)
        count = lambda c: F.size(redact.split_words(F.col(c)))
        rows = check(pairs).select(
            F.lit(number).alias("pass"), "transcript_id", "chunk", F.lit(attempt).alias("attempt"), "from_word", "to_word", "from_s", "to_s",
            F.col("original").alias("input"), F.col("processed").alias("output"), count("original").alias("input_words"), count("processed").alias("output_words"), "passed", "reason",
        )
        done.append(materialise(rows, f"attempt{attempt}"))
        failed = done[-1].where("NOT passed").select("transcript_id", "chunk")
        if failed.isEmpty():
            break
        open_ = placed.join(failed, ["transcript_id", "chunk"], "left_semi")
    return reduce(DataFrame.unionByName, done)


def last_words(rows: DataFrame) -> DataFrame:
    """The output of the attempt that passed, else the input, per chunk: ``pass, transcript_id, chunk, attempts, passed, text``."""
    last = F.max_by(F.struct("passed", F.when(F.col("passed"), F.col("output")).otherwise(F.col("input")).alias("text")), "attempt")
    return rows.groupBy("pass", "transcript_id", "chunk").agg(F.max("attempt").alias("attempts"), last.alias("l")).select("pass", "transcript_id", "chunk", "attempts", "l.passed", "l.text")


def write_attempts(rows: DataFrame, path: str) -> None:
    """Adds attempts to the table at ``path``, by ``pass`` and ``chunk``; those of the same transcripts' chunks there are replaced.

    Only partitions that ``rows`` has chunks of are written: what other transcripts have there is read, put beside the new rows and
    written back with dynamic overwriting. Running one chunk again changes one partition.
    """
    spark = rows.sparkSession
    new = materialise(rows, "new_attempts")
    try:
        there = spark.read.schema(new.schema).parquet(path)
    except Exception as e:  # noqa: BLE001  the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = new.limit(0)
    touched, replaced = new.select("pass", "chunk").distinct(), new.select("pass", "chunk", "transcript_id").distinct()
    kept = there.join(touched, ["pass", "chunk"], "left_semi").join(replaced, ["pass", "chunk", "transcript_id"], "left_anti")
    whole = materialise(new.unionByName(kept), "attempts")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass", "chunk").parquet(path)


def read_attempts(rows_like: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the columns of ``rows_like``."""
    return rows_like.sparkSession.read.schema(rows_like.schema).parquet(path).select(*rows_like.columns)
