"""Outputs of transcripts: JSON, plain and timestamped text, subtitles, Markdown, scripts and an HTML timeline.

Every writer is a DataFrame of ``transcript_id, content``; ``write_contents`` puts each into a file. Nested turns go through
array expressions; a transcript's document is one row, as it is one file.
"""

from __future__ import annotations

import textwrap
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import format as fmt
from colloquy.functions import text as tx
from colloquy.operators import metrics
from colloquy.operators.segments import joined, paragraphs
from colloquy.work import materialise


def _document(rows: DataFrame, order: str, line: Column, sep: str = "\n") -> DataFrame:
    return rows.groupBy("transcript_id").agg(joined(F.collect_list(F.struct(order, line.alias("text"))), sep).alias("content"))


def timestamped_lines(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), fmt.timestamp(F.col("start_s")), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    return turns.select("transcript_id", "turn", line.alias("line"))


def timestamped_text(turns: DataFrame) -> DataFrame:
    return _document(timestamped_lines(turns), "turn", F.col("line"))


def plain_text(turns: DataFrame) -> DataFrame:
    return _document(paragraphs(turns), "paragraph", F.concat("speaker", F.lit(": "), "text"), "\n\n")


def word_text(words: DataFrame) -> DataFrame:
    return _document(words.where(F.trim("text") != ""), "word_idx", F.col("text"), " ")


def srt_blocks(turns: DataFrame) -> DataFrame:
    """Numbered subtitle blocks; no block ends before it starts."""
    i = F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn"))
    span = F.concat(fmt.timestamp(F.col("start_s"), "srt"), F.lit(" --> "), fmt.timestamp(F.greatest("start_s", "end_s"), "srt"))
    line = F.concat(F.col("i").cast("string"), F.lit("\n"), span, F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"), F.lit("\n"))
    return turns.withColumn("i", i).select("transcript_id", "turn", line.alias("line"))


def srt(turns: DataFrame) -> DataFrame:
    return _document(srt_blocks(turns), "turn", F.col("line"))


def timeline_layout(turns: DataFrame) -> DataFrame:
    """Places of turns on a transcript's time line, in percent."""
    w = Window.partitionBy("transcript_id")
    first, last = F.min("start_s").over(w), F.max("end_s").over(w)
    out = turns.withColumns({"t0": first, "total": last - first})
    left = fmt.position_percent(F.col("start_s"), F.col("total"), F.col("t0"))
    width = fmt.position_percent(F.greatest("end_s", "start_s"), F.col("total"), F.col("start_s"))
    return out.withColumns({"left_percent": left, "width_percent": F.greatest(width, F.lit(0.5))})


def flow_json(turns: DataFrame) -> DataFrame:
    """The whole transcript document: metrics, statistics of speakers, and nested turns."""
    inner = F.transform(
        F.col("interjections"),
        lambda x: F.struct(x["speaker"].alias("speaker"), x["start_s"].alias("start"), x["end_s"].alias("end"), x["text"].alias("text"), x["itype"].alias("interjection_type"), F.round(x["confidence"], 3).alias("confidence"), x["level"].alias("interrupt_level")),
    )
    item = F.struct(
        F.col("turn").alias("turn_id"), F.col("speaker").alias("primary_speaker"), F.round("start_s", 3).alias("start"), F.round("end_s", 3).alias("end"), F.col("duration_s").alias("duration"), "text",
        F.col("n_words").alias("word_count"), F.col("rate_wpm").alias("speaking_rate"), F.col("flow").alias("flow_continuity"), "turn_type", inner.alias("interjections"),
    )
    docs = turns.groupBy("transcript_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    stats = metrics.speaker_statistics(turns)
    by_speaker = stats.groupBy("transcript_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct(*(c for c in stats.columns if c not in ("transcript_id", "speaker"))))))).alias("speaker_statistics"))
    talk = metrics.conversation_metrics(turns)
    whole = talk.select("transcript_id", F.struct(*(c for c in talk.columns if c != "transcript_id")).alias("conversation_metrics"))
    meta = F.struct(F.lit("2.0").alias("format_version"), F.array_sort(F.map_keys("speaker_statistics")).alias("speakers"))
    body = F.struct(meta.alias("metadata"), "conversation_metrics", "speaker_statistics", "turns")
    return docs.join(whole, "transcript_id").join(by_speaker, "transcript_id").select("transcript_id", F.to_json(body).alias("content"))


def turns_json(turns: DataFrame) -> DataFrame:
    """The flat form: ``metadata`` and ``turns`` of speaker, start, end and text."""
    item = F.struct("turn", F.struct("speaker", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text").alias("t"))
    docs = turns.groupBy("transcript_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("n_words").alias("n"), F.array_sort(F.collect_set(F.nullif(F.col("speaker"), F.lit("")))).alias("speakers"))
    meta = F.struct(F.size("items").alias("total_turns"), F.col("n").alias("total_words"), "speakers", F.lit("1.0").alias("format_version"))
    return docs.select("transcript_id", F.to_json(F.struct(meta.alias("metadata"), F.transform("items", lambda x: x["t"]).alias("turns"))).alias("content"))


def markdown(turns: DataFrame) -> DataFrame:
    """A summary, a table of speakers, and the turns with their interjections."""
    said = F.transform("interjections", lambda x: F.concat(F.lit("> *"), x["speaker"], F.lit(" "), fmt.interjection_verb(x["itype"]), F.lit(": "), x["text"], F.lit("*")))
    head = F.concat(F.lit("**"), F.col("speaker"), F.lit("** ["), fmt.timestamp(F.col("start_s")), F.lit("]"))
    block = F.concat_ws("\n\n", head, tx.escape_markdown(F.col("text")), F.nullif(F.array_join(said, "\n"), F.lit("")), F.concat(F.lit("_flow "), fmt.percentage(F.col("flow")), F.lit("_")))
    body = _document(turns, "turn", block, "\n\n---\n\n").withColumnRenamed("content", "body")
    stats = metrics.speaker_statistics(turns)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "speaker", "total_turns", "total_words", "total_interjections", "avg_flow"), F.lit(" |"))
    table = _document(stats, "speaker", row).withColumnRenamed("content", "table")
    talk = metrics.conversation_metrics(turns)
    top = F.concat(F.lit("# Transcript\n\n"), F.lit("- turns: "), F.col("total_turns"), F.lit("\n- duration: "), fmt.duration(F.col("total_duration")), F.lit("\n- words: "), F.col("total_words"))
    joined_all = talk.join(table, "transcript_id").join(body, "transcript_id")
    head_row = "| Speaker | Turns | Words | Interjections | Flow |\n|-|-|-|-|-|"
    return joined_all.select("transcript_id", F.concat_ws("\n\n", top, F.concat(F.lit(head_row + "\n"), F.col("table")), F.col("body")).alias("content"))


def _wrapped(turns: pd.Series, width: int) -> pd.Series:
    fill = lambda t: textwrap.fill(t, width=width, initial_indent="    ", subsequent_indent="    ")
    return turns.map(fill)


def dialogue_script(turns: DataFrame, width: int = 75) -> DataFrame:
    """Speakers in capitals, wrapped text, interjections in brackets."""

    @F.pandas_udf("string")
    def wrap(text: pd.Series) -> pd.Series:
        return _wrapped(text, width)

    said = F.transform("interjections", lambda x: F.concat(F.lit("        ["), F.upper(x["speaker"]), F.lit(": ("), fmt.timestamp(x["start_s"], "ms"), F.lit(") "), x["text"], F.lit("]")))
    block = F.concat_ws("\n", F.concat(F.upper("speaker"), F.lit(" ("), fmt.timestamp(F.col("start_s"), "ms"), F.lit(")")), wrap("text"), F.nullif(F.array_join(said, "\n"), F.lit("")))
    return _document(turns, "turn", block, "\n\n")


def speaker_cards(turns: DataFrame) -> DataFrame:
    """``transcript_id, speaker, card``: each speaker's statistics as a card of the timeline page."""
    stats = metrics.speaker_statistics(turns)
    of = Window.partitionBy("transcript_id").orderBy("speaker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = stats.withColumn("speakers", F.collect_list("speaker").over(of))
    values = {
        "Turns": F.col("total_turns").cast("string"), "Words": F.col("total_words").cast("string"), "Avg Duration": F.format_string("%.1fs", "avg_turn_duration"),
        "Avg WPM": F.format_string("%.0f", "avg_speaking_rate"), "Interjections": F.col("total_interjections").cast("string"), "Flow": fmt.percentage(F.col("avg_flow")),
    }
    items = [F.concat(F.lit(f'<div class="stat"><em>{label}</em><b>'), value, F.lit("</b></div>")) for label, value in values.items()]
    head = F.concat(F.lit('<div class="card"><h3 style="color:'), fmt.speaker_color(F.col("speaker"), F.col("speakers")), F.lit('">'), tx.escape_html(tx.display_speaker(F.col("speaker"))), F.lit("</h3>"))
    return rows.select("transcript_id", "speaker", F.concat(head, *items, F.lit("</div>")).alias("card"))


def turns_blob(turns: DataFrame) -> DataFrame:
    """``transcript_id, blob``: the turns as a JSON array for the page's script; ``</`` is written so that no tag can end in it."""
    inner = F.transform("interjections", lambda x: F.struct(x["speaker"].alias("speaker"), x["start_s"].alias("start"), x["end_s"].alias("end"), x["text"].alias("text"), x["itype"].alias("type")))
    item = F.struct(
        F.col("turn").alias("id"), "speaker", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.col("n_words").alias("wordCount"), F.col("rate_wpm").alias("speakingRate"),
        F.col("flow").alias("flowContinuity"), F.col("turn_type").alias("turnType"), F.coalesce(inner, F.array()).alias("interjections"),
    )
    docs = turns.groupBy("transcript_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return docs.select("transcript_id", F.replace(F.to_json("turns", {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/")).alias("blob"))


def html_timeline(turns: DataFrame) -> DataFrame:
    """A page with figures on top, one lane per speaker, turns placed by percent, a legend, a time axis of six ticks, cards of the speakers, and the turns as JSON."""
    placed = timeline_layout(turns)
    speakers = placed.groupBy("transcript_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    rows = placed.join(speakers, "transcript_id")
    lane = F.array_position("speakers", F.col("speaker"))
    style = F.format_string("left:%.3f%%;width:%.3f%%;top:%dpx;background:%s", F.col("left_percent"), F.col("width_percent"), ((lane - 1) * 30).cast("int"), fmt.speaker_color(F.col("speaker"), F.col("speakers")))
    box = F.concat(F.lit('<div class="turn" data-turn="'), F.col("turn").cast("string"), F.lit('" style="'), style, F.lit('" title="'), tx.escape_html(F.col("text")), F.lit('"></div>'))
    body = _document(rows, "turn", box).withColumnRenamed("content", "boxes")
    dot = F.transform("speakers", lambda s: F.concat(F.lit('<li style="color:'), fmt.speaker_color(s, F.col("speakers")), F.lit('">'), tx.escape_html(s), F.lit("</li>")))
    axis = placed.groupBy("transcript_id").agg(F.first("t0").alias("t0"), F.first("total").alias("total"))
    tick = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("<span>"), fmt.timestamp(F.col("t0") + F.col("total") * i / 5, "ms"), F.lit("</span>")))
    cards = _document(speaker_cards(turns), "speaker", F.col("card")).withColumnRenamed("content", "cards")
    page = speakers.join(body, "transcript_id").join(axis, "transcript_id").join(cards, "transcript_id").join(turns_blob(turns), "transcript_id").join(metrics.conversation_metrics(turns), "transcript_id")
    figures = {"Duration": fmt.duration(F.greatest("total", F.lit(0.0))), "Total Turns": F.col("total_turns").cast("string"), "Interjections": F.col("total_interjections").cast("string"), "Avg Flow": fmt.percentage(F.col("avg_flow"))}
    top = [part for label, value in figures.items() for part in (F.lit(f"<div>{label}: "), value, F.lit("</div>"))]
    parts = [
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Timeline</title></head><body><div class="figures">'), *top, F.lit('</div><ul class="legend">'), F.array_join(dot, ""),
        F.lit('</ul><div class="axis">'), F.array_join(tick, ""), F.lit('</div><div class="lanes">'), F.col("boxes"), F.lit('</div><div class="cards">'), F.col("cards"),
        F.lit('</div><script type="application/json" id="turns">'), F.col("blob"), F.lit("</script></body></html>"),
    ]
    return page.select("transcript_id", F.concat(*parts).alias("content"))


def word_csv(text: DataFrame) -> DataFrame:
    """``transcript_id, line, word`` of texts, lines from 1."""
    words = text.select("transcript_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "word"))
    return words.select("transcript_id", (F.col("i") + 1).alias("line"), "word")


FORMATS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "timestamped-txt": ("transcript.timestamped.txt", timestamped_text),
    "plain-txt": ("transcript.txt", plain_text),
    "srt": ("transcript.srt", srt),
    "turns-json": ("transcript.turns.json", flow_json),
    "markdown": ("transcript.md", markdown),
    "dialogue-script": ("transcript.script.txt", dialogue_script),
    "html-timeline": ("transcript_timeline.html", html_timeline),
}


def all_contents(turns: DataFrame, formats: list[str]) -> DataFrame:
    """``transcript_id, format, content`` for all ``formats``; an unknown one is an error that names those there are.

    Turns are written once, and every format reads that table.
    """
    unknown = sorted(set(formats) - set(FORMATS))
    if unknown:
        raise ValueError(f"unknown formats {unknown}; there are {sorted(FORMATS)}")
    held = materialise(turns, "turns")
    return reduce(DataFrame.unionByName, [FORMATS[name][1](held).select("transcript_id", F.lit(name).alias("format"), "content") for name in dict.fromkeys(formats)])


def write_outputs(turns: DataFrame, path: str, formats: list[str]) -> dict[str, str]:
    """Writes all formats in one job, each under ``path/format=<format>/transcript_id=<id>/``, and gives these folders."""
    rows = all_contents(turns, formats).select("format", "transcript_id", F.col("content").alias("value"))
    rows.write.partitionBy("format", "transcript_id").text(path)
    return {name: f"{path}/format={name}" for name in formats}
