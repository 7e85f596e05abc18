"""Grids of overlapping chunks over words and over seconds, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_grid(sizes: DataFrame, size: int = 400, overlap: int = 70, min_final: int = 200) -> DataFrame:
    """Chunks of each row's ``n`` words: ``chunk, from_word, to_word``; a rest under ``min_final`` joins the chunk before."""
    step = size - overlap
    last = F.when(F.col("n") <= size, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col("n") - size - min_final) / step) + 1)).cast("int")
    grid = sizes.where("n > 0").withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    start = F.col("chunk").cast("long") * step
    return grid.withColumns({"from_word": start, "to_word": F.when(F.col("chunk") < F.col("last"), start + size).otherwise(F.col("n"))}).drop("last")


def chunk_words(words: DataFrame, size: int = 400, overlap: int = 70, min_final: int = 200) -> DataFrame:
    """Every word of a transcript with each chunk that holds it (``i``: its place in the chunk)."""
    sizes = words.groupBy("transcript_id").agg(F.count("*").alias("n"))
    step = size - overlap
    n, i = F.col("n"), F.col("word_idx")
    last = F.when(n <= size, 0).otherwise(F.greatest(F.lit(0), F.floor((n - size - min_final) / step) + 1)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("int")
    own = words.join(sizes, "transcript_id").withColumn("last", last)
    own = own.withColumn("chunk", F.explode(F.sequence(F.least(low, F.col("last")), F.least(F.floor(i / step).cast("int"), F.col("last")))))
    return own.withColumn("i", i - F.col("chunk") * step).drop("n", "last")


def chunk_texts(texts: DataFrame, size: int = 400, overlap: int = 70, min_final: int = 200) -> DataFrame:
    """``transcript_id, chunk, n_words, text`` of whole texts: the grid of ``word_grid`` over their words, white space as one blank."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    sized = texts.select("transcript_id", words.alias("w")).withColumn("n", F.size("w").cast("long"))
    piece = F.slice("w", (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int"))
    return word_grid(sized, size, overlap, min_final).select("transcript_id", "chunk", F.size(piece).cast("long").alias("n_words"), F.array_join(piece, " ").alias("text"))


def second_grid(audio: DataFrame, length: float = 60.0, overlap: float = 4.0, least: float = 7.0) -> DataFrame:
    """Chunks of each row's ``seconds``: ``chunk, from_s, to_s``; a last chunk under ``least`` joins the one before."""
    step = length - overlap
    full = F.greatest(F.lit(0), F.ceil((F.col("seconds") - length) / step)).cast("int")
    short = (full > 0) & (F.col("seconds") - full * step < least)
    grid = audio.where("seconds > 0").withColumn("last", F.when(short, full - 1).otherwise(full))
    grid = grid.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    start = F.col("chunk") * F.lit(step)
    return grid.withColumns({"from_s": start, "to_s": F.when(F.col("chunk") < F.col("last"), start + length).otherwise(F.col("seconds"))}).drop("last")


def long_enough(seconds: Column, least: float = 60.0) -> Column:
    return seconds >= least


def segment_chunks(segments: DataFrame, limit: float = 50.0, length: float = 25.0, overlap: float = 4.0, least: float = 7.0) -> DataFrame:
    """Segments over ``limit`` seconds in chunks that begin ``overlap`` early; a short rest joins the last, a longer one is a chunk without overlap."""
    seconds = F.col("end_s") - F.col("start_s")
    whole = F.floor(seconds / length).cast("int")
    rest = seconds - whole * length
    count = F.when(seconds <= limit, 1).otherwise(whole + F.when(rest >= least, 1).otherwise(0))
    grid = segments.withColumns({"whole": whole, "rest": rest, "chunks": count}).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    start = F.col("start_s") + F.col("chunk") * F.lit(length)
    tail = F.col("chunk") >= F.col("whole")
    one = F.col("chunks") == 1
    from_s = F.when(one | (F.col("chunk") == 0), F.col("start_s")).when(tail, start).otherwise(start - overlap)
    to_s = F.when(one | (F.col("chunk") == F.col("chunks") - 1), F.col("end_s")).otherwise(start + length)
    return grid.withColumns({"from_s": from_s, "to_s": to_s}).drop("whole", "rest", "chunks")
