"""Names for speaker ids: parsing, applying and checking mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_mapping(args: DataFrame, column: str = "arg") -> DataFrame:
    """``id, name`` of ``ID=Name,ID=Name`` strings; parts without ``=`` or with an empty side are left out, later ones win."""
    part = args.select(F.posexplode(F.split(column, ",")).alias("pos", "part"))
    cut = F.split("part", "=", 2)
    pairs = part.where(F.col("part").contains("=")).select("pos", F.trim(cut[0]).alias("id"), F.trim(cut[1]).alias("name"))
    return pairs.where("id <> '' AND name <> ''").groupBy("id").agg(F.max_by("name", "pos").alias("name"))


def apply_mapping(words: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped speakers get their name, others keep their id."""
    names = mapping.select(F.col("id").alias("speaker"), "name")
    return words.join(names, "speaker", "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


def validate_mapping(words: DataFrame, mapping: DataFrame) -> DataFrame:
    """``issue, value``: speakers without a name, names without a speaker, names given twice."""
    actual = words.where("speaker IS NOT NULL AND speaker <> ''").select(F.col("speaker").alias("id")).distinct()
    issue = lambda df, what, col: df.select(F.lit(what).alias("issue"), F.col(col).alias("value"))
    twice = mapping.groupBy("name").count().where("count > 1")
    return issue(actual.join(mapping, "id", "left_anti"), "unmapped", "id").unionAll(issue(mapping.join(actual, "id", "left_anti"), "extra", "id")).unionAll(issue(twice, "duplicate", "name"))


def default_names(words: DataFrame) -> DataFrame:
    """Suggested names of each transcript's speakers by their order."""
    found = words.where("speaker IS NOT NULL AND speaker <> ''").select("transcript_id", "speaker").distinct()
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("speaker"))
    name = F.when(F.col("n") == 1, "Interviewer").when(F.col("n") == 2, "Participant").otherwise(F.concat(F.lit("Speaker "), F.col("n")))
    return found.withColumn("n", n).select("transcript_id", "speaker", name.alias("suggested"))


def rename_turns(turns: DataFrame, names: dict[str, str]) -> DataFrame:
    """Names for the speakers of turns and of their interjections."""
    if not names:
        return turns
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    name = lambda c: F.coalesce(table[c], c)
    inner = F.transform("interjections", lambda x: x.withField("speaker", name(x["speaker"])))
    return turns.withColumns({"speaker": name(F.col("speaker")), "interjections": inner})


def infer_mode(words: DataFrame, declared: Column | None = None) -> DataFrame:
    """``mode`` per transcript: the declared one, else by the look of its speakers; none: combined."""
    who = F.lower(F.nullif(F.col("speaker"), F.lit("")))
    flags = words.groupBy("transcript_id").agg(
        F.bool_and(who.startswith("speaker_") | (who == "unknown")).alias("generic"),
        F.bool_or(who.contains("interviewer") | who.contains("participant") | who.contains("speaker")).alias("named"),
    )
    guessed = F.when(F.coalesce("generic", F.lit(True)), "combined_audio").when(F.col("named"), "split_audio")
    return flags.select("transcript_id", (F.coalesce(declared, guessed) if declared is not None else guessed).alias("mode"))


def reentry_check(words: DataFrame) -> DataFrame:
    """Whether a checkpoint can be taken up again: it needs speakers, and warns of words without."""
    named = F.count_if(F.coalesce(F.col("speaker") != "", F.lit(False)))
    out = words.groupBy("transcript_id").agg(F.count("*").alias("n"), named.alias("named"))
    share = F.format_string("%.1f%%", F.col("named") / F.col("n") * 100)
    return out.select("transcript_id", (F.col("named") > 0).alias("valid"), F.when((F.col("named") > 0) & (F.col("named") < F.col("n")), share).alias("partial"))
