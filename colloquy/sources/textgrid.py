"""Word timings from aligner files: TextGrid tiers and ``[ms] --> [ms] word`` lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.work import materialise

# Labels that stand for silence.
SILENCE = ("", "<eps>", "sil", "sp", "spn")
_INTERVAL = r'intervals\s*\[\d+\]:?\s*xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"((?:[^"]|"")*)"'


def parse_textgrids(files: DataFrame, offset_s: float = 0.0, least_s: float = 0.02) -> DataFrame:
    """``path, word_idx, text, start_s, end_s`` of the ``words`` tier of ``path, value`` (one file a row).

    Silences and words shorter than ``least_s`` are left out; ``offset_s`` is added to all times. A file without such a tier
    gives no rows.
    """
    tier = F.regexp_extract("value", r'(?s)name\s*=\s*"words"(.*?)(?:item\s*\[\d+\]|\z)', 1)
    found = F.arrays_zip(*(F.regexp_extract_all(F.col("tier"), F.lit(_INTERVAL), F.lit(i)).alias(n) for i, n in ((1, "xmin"), (2, "xmax"), (3, "text"))))
    rows = files.withColumn("tier", tier).select("path", F.posexplode(found).alias("pos", "w"))
    times = rows.select("path", "pos", F.replace(F.col("w.text"), F.lit('""'), F.lit('"')).alias("text"), (F.col("w.xmin").cast("double")).alias("s"), F.col("w.xmax").cast("double").alias("e"))
    kept = times.where(~F.lower(F.trim("text")).isin(*SILENCE) & (F.round(F.col("e") - F.col("s"), 9) >= least_s))
    place = (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).cast("long")
    return kept.select("path", place.alias("word_idx"), "text", (F.col("s") + offset_s).alias("start_s"), (F.col("e") + offset_s).alias("end_s"))


def read_textgrids(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_textgrids(files, **options)


#: Why lines of a file are passed over; the first that holds is given.
PROBLEMS = ("cut_off", "xmin", "xmax", "text", "number")


def _words_tier(value: str) -> Column:
    """What stands behind the first ``name = "words"`` of a file, up to the line that names the phones; empty without such a tier."""
    name = 'name = "words"'
    rest = F.substr(value, F.locate(name, F.col(value)) + len(name))
    before = F.substring_index(rest, 'name = "phones"', 1)
    whole = F.substr(before, F.lit(1), F.length(before) - F.length(F.substring_index(before, "\n", -1)))
    return F.when(~F.contains(F.col(value), F.lit(name)), "").when(F.contains(rest, F.lit('name = "phones"')), whole).otherwise(rest)


def scan_textgrids(files: DataFrame, offset_s: float = 0.0, digits: int | None = None, whole_text: bool = True, seen: Observation | None = None) -> DataFrame:
    """Every interval of the ``words`` tier of ``path, value`` by its lines: ``path, pos, text, start_s, end_s, problem, lines``.

    An interval takes the three lines behind its head, whatever they hold, and the next head is looked for behind them. ``problem``
    is null, or why the lines are passed over: a line without ``=``, times that are no numbers, or a tier that ends within the
    interval; ``lines`` then has them. ``text`` is what stands behind the first ``=``, up to the next one unless ``whole_text``;
    times are rounded to ``digits``. The tier ends where that of the phones begins. ``seen`` counts the kept
    and the passed over by reason while the rows are read, without a further pass.
    """
    head = r"(?m)^[ \t]*intervals \[[^\n]*(?:\n[^\n]*)?(?:\n[^\n]*)?(?:\n[^\n]*)?"
    found = F.regexp_extract_all(F.regexp_replace(_words_tier("value"), r"\n\z", ""), F.lit(head), F.lit(0))
    rows = files.select("path", F.posexplode(found).alias("pos", "lines")).withColumn("line", F.split("lines", "\n"))
    at = lambda i: F.coalesce(F.get("line", F.lit(i)), F.lit(""))
    rows = rows.select("path", F.col("pos").cast("long").alias("pos"), "lines", F.size("line").alias("n"), at(1).alias("xmin"), at(2).alias("xmax"), at(3).alias("said"))
    behind = lambda c: F.btrim(F.get(F.split(c, "="), F.lit(1)), F.lit(" \t\r"))
    seconds = lambda c: F.expr(f"try_cast({c} AS double)")
    text = F.regexp_replace("said", "^[^=]*=", "")
    rows = rows.withColumns({"from": behind("xmin"), "to": behind("xmax"), "text": F.btrim(F.btrim(text if whole_text else F.get(F.split("said", "="), F.lit(1)), F.lit(" \t\r")), F.lit('"'))})
    rows = rows.withColumns({"start_s": seconds("`from`"), "end_s": seconds("`to`")})
    problem = F.when(F.col("n") < 4, "cut_off")
    for line in ("xmin", "xmax", "said"):
        problem = problem.when(~F.contains(F.col(line), F.lit("=")), "text" if line == "said" else line)
    rows = rows.withColumn("problem", problem.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "number"))
    shown = lambda c: F.floor(c * 10**digits + 0.5) / 10**digits if digits is not None else c
    out = rows.select(
        "path", "pos",
        *(F.when(F.col("problem").isNull(), c).alias(n) for n, c in (("text", F.col("text")), ("start_s", shown(F.col("start_s")) + offset_s), ("end_s", shown(F.col("end_s")) + offset_s))),
        "problem", F.when(F.col("problem").isNotNull(), F.col("lines")).alias("lines"),
    )
    if seen is None:
        return out
    return out.observe(seen, F.count(F.when(F.col("problem").isNull(), 1)).alias("kept"), *(F.count(F.when(F.col("problem") == p, 1)).alias(p) for p in PROBLEMS))


def scanned_words(scanned: DataFrame) -> DataFrame:
    """``path, word_idx, text, start_s, end_s`` of the intervals that were kept, without silences."""
    kept = scanned.where(F.col("problem").isNull() & ~F.col("text").isin(*SILENCE))
    place = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return kept.select("path", place.cast("long").alias("word_idx"), "text", "start_s", "end_s")


def scan_report(scanned: DataFrame, problems: tuple[str, ...] = PROBLEMS) -> DataFrame:
    """Per file: rows kept, and rows passed over by reason."""
    return scanned.groupBy("path").agg(F.count(F.when(F.col("problem").isNull(), 1)).alias("kept"), *(F.count(F.when(F.col("problem") == p, 1)).alias(p) for p in problems))


def stage_scan(scanned: DataFrame, to: str) -> tuple[DataFrame, DataFrame]:
    """Writes a scan to ``to``, the kept rows apart from the others, and gives both: files are read once for words and reports alike."""
    scanned.withColumn("passed_over", F.col("problem").isNotNull()).write.partitionBy("passed_over").parquet(to)
    rows = scanned.sparkSession.read.schema(scanned.withColumn("passed_over", F.lit(True)).schema).parquet(to)
    return rows.where("NOT passed_over").drop("passed_over", "problem", "lines"), rows.where("passed_over").drop("passed_over")


def aligner_words(files: DataFrame, original: DataFrame, digits: int = 2) -> DataFrame:
    """Words as the aligner gives them: times to ``digits``, forms of the n-th equal word of ``original`` (``path, word_idx, text``)."""
    return restore_case(scanned_words(scan_textgrids(files, digits=digits, whole_text=False)), original)


def fallback_words(files: DataFrame, original: DataFrame, offset_s: float = 0.0, seconds_per_word: float = 0.5) -> DataFrame:
    """Words of a fallback aligner: forms of equal originals, by place where the counts agree; without a ``words`` tier half a second a word."""
    # Written once: files would be scanned for the counts and again for the words.
    words = by_place(materialise(restore_case(scanned_words(scan_textgrids(files, offset_s)), original), "aligned_words"), original)
    tiers = files.where(F.contains("value", F.lit('name = "words"'))).select("path")
    step = F.lit(seconds_per_word)
    even = original.join(tiers, "path", "left_anti").select("path", "word_idx", "text", (offset_s + F.col("word_idx") * step).alias("start_s"), (offset_s + (F.col("word_idx") + 1) * step).alias("end_s"))
    return words.select("path", "word_idx", "text", "start_s", "end_s").unionByName(even)


def restore_case(aligned: DataFrame, original: DataFrame) -> DataFrame:
    """Words of ``aligned`` in the form of the n-th equal word of ``original`` (counting round when there are fewer).

    Both: ``path, word_idx, text``; ``aligned`` keeps its further columns.
    """
    norm = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    nth = F.row_number().over(Window.partitionBy("path", "norm").orderBy("word_idx")) - 1
    forms = original.withColumn("norm", norm).withColumn("nth", nth).withColumn("of", F.count("*").over(Window.partitionBy("path", "norm")))
    forms = forms.select("path", "norm", "nth", "of", F.col("text").alias("form"))
    counts = forms.groupBy("path", "norm").agg(F.max("of").alias("of"))
    mine = aligned.withColumn("norm", F.lower("text")).withColumn("nth", nth).join(counts, ["path", "norm"], "left")
    mine = mine.withColumn("nth", F.when(F.col("of") > 0, F.pmod(F.col("nth"), F.col("of"))))
    return mine.drop("of").join(forms.drop("of"), ["path", "norm", "nth"], "left").withColumn("text", F.coalesce("form", "text")).drop("norm", "nth", "form")


def by_place(aligned: DataFrame, original: DataFrame) -> DataFrame:
    """Words of ``aligned`` in the form of the original at the same place, for files whose counts agree; others stay as they are."""
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    agreed = count(aligned, "n").join(count(original, "m"), "path").where("n = m").select("path", F.lit(True).alias("agreed"))
    forms = original.select("path", "word_idx", F.col("text").alias("form")).join(agreed, "path")
    return aligned.join(forms, ["path", "word_idx"], "left").withColumn("text", F.when(F.col("agreed"), F.col("form")).otherwise(F.col("text"))).drop("form", "agreed")


def or_even(aligned: DataFrame, original: DataFrame, seconds: float) -> DataFrame:
    """Aligned words; a file of ``original`` without any has its words spread evenly over ``seconds``."""
    missing = original.join(aligned.select("path").distinct(), "path", "left_anti")
    step = F.lit(seconds) / F.count("*").over(Window.partitionBy("path"))
    even = missing.select("path", "word_idx", "text", (F.col("word_idx") * step).alias("start_s"), ((F.col("word_idx") + 1) * step).alias("end_s"))
    return aligned.select("path", "word_idx", "text", "start_s", "end_s").unionByName(even)


def parse_wts(lines: DataFrame) -> DataFrame:
    """``text, start_s, end_s`` of lines ``[start ms] --> [end ms] word`` in column ``value``; others are left out."""
    pattern = r"\[(\d+)\]\s*-->\s*\[(\d+)\]\s+(.+)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select(
        *(c for c in lines.columns if c != "value"), F.trim(part(3)).alias("text"), (part(1).cast("double") / F.lit(1000.0)).alias("start_s"), (part(2).cast("double") / F.lit(1000.0)).alias("end_s")
    )


def scan_wts(lines: DataFrame) -> DataFrame:
    """Lines of ``value`` as ``text, start_s, end_s, problem`` beside the other columns; ``problem`` is null, ``blank`` or ``pattern``."""
    pattern = r"^\[(\d+)\]\s*-->\s*\[(\d+)\]\s+(.+)"
    line = F.btrim("value", F.lit(" \t\r\n"))
    part = lambda i: F.regexp_extract(line, pattern, i)
    problem = F.when(line == "", "blank").when(~line.rlike(pattern), "pattern")
    seconds = lambda i: F.when(F.col("problem").isNull(), part(i).cast("double") / F.lit(1000.0))
    rows = lines.withColumn("problem", problem)
    return rows.select(*(c for c in lines.columns if c != "value"), F.when(F.col("problem").isNull(), F.trim(part(3))).alias("text"), seconds(1).alias("start_s"), seconds(2).alias("end_s"), "problem")


def clamp_words(words: DataFrame, from_s: float, to_s: float, least_s: float = 0.01) -> DataFrame:
    """Aligned words inside a segment: no silences, none too short, times within the segment."""
    kept = words.where(~F.lower("text").isin(*SILENCE) & (F.col("end_s") - F.col("start_s") >= least_s))
    inside = kept.withColumns({"start_s": F.greatest("start_s", F.lit(from_s)), "end_s": F.least("end_s", F.lit(to_s))})
    return inside.where("start_s < end_s")
