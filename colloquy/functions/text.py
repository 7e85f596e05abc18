"""Scalar text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and what stands for them.
SPECIAL = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "..."}
PROMPT_FRAGMENTS = ("make sure to include disfluencies", "can you transcribe the speech into a written format")
MARKDOWN_SPECIAL = "\\`*_{}[]()#+-.!|"
HTML_SPECIAL = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def special_characters(text: Column) -> Column:
    for char, plain in SPECIAL.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def speaker_label(speaker: Column) -> Column:
    """Without special characters, each word capitalised; nothing: Unknown."""
    label = F.initcap(normalize_whitespace(F.regexp_replace(speaker, r"(?U)[^\w\s-]", "")))
    return F.when(speaker.isNull() | (speaker == ""), "Unknown").otherwise(label)


def sentences(text: Column) -> Column:
    """Cuts behind every full stop, exclamation and question mark; blank pieces are left out."""
    parts = F.transform(F.split(text, r"(?<=[.!?])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def clean_transcript(text: Column) -> Column:
    """Without dialogue labels and double quotation marks."""
    for label in ("User", "AI Assistant", "Assistant"):
        text = F.regexp_replace(text, rf"(?i)\b{label}:\s*", "")
    for mark in ('"', "“", "”"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_prompt(text: Column) -> Column:
    """What stands before the first fragment of a prompt; the whole text, if nothing does."""
    out = text
    for fragment in PROMPT_FRAGMENTS:
        at = F.instr(F.lower(out), fragment)
        out = F.when(at > 0, F.substring(out, F.lit(1), at - 1)).otherwise(out)
    out = F.trim(F.rtrim(out, F.lit(" .,\n\t")))
    return F.when(out == "", F.trim(text)).otherwise(out)


def aligner_text(text: Column) -> Column:
    """Words of letters, digits and apostrophes only, a space between them; a word that has none of them leaves its spaces."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[^\p{L}\p{N}' ]", "")


def final_channel(reply: Column) -> Column:
    """What a model's reply says in its final channel; without channels the whole reply, else what follows its last message mark."""
    said = r"(?s)<\|channel\|>final<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>|<\|start\|>|$)"
    # other channels go first, as their text may quote the marks of the final one
    others = F.regexp_replace(reply, r"(?s)<\|channel\|>(?!final<)\w+<\|message\|>.*?(?:<\|end\|>|<\|return\|>|<\|start\|>|$)", "")
    last = F.regexp_replace(F.element_at(F.split(reply, r"<\|message\|>"), -1), r"(?s)<\|[^|]+\|>.*$", "")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(others.rlike(said), strip(F.regexp_extract(others, said, 1)))
        .when(~reply.contains("<|"), strip(reply))
        .when(reply.contains("<|message|>"), strip(last))
        .otherwise(strip(reply))
    )


def escape_markdown(text: Column) -> Column:
    for char in MARKDOWN_SPECIAL:
        text = F.replace(text, F.lit(char), F.lit("\\" + char))
    return text


def escape_html(text: Column) -> Column:
    for char, entity in HTML_SPECIAL.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def normal_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def word_similarity(a: Column, b: Column, least: float = 0.6) -> Column:
    """1 for equal normal forms, 0.7 to 0.9 for a beginning, else the edit ratio if it is at least ``least``."""
    x, y = normal_word(a), normal_word(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    begins = x.startswith(y) | y.startswith(x)
    ratio = 1 - F.levenshtein(x, y) / long
    far = long - short > F.floor(long / 2)
    return F.when(x == y, 1.0).when(begins, 0.7 + 0.2 * short / long).when(far, 0.0).when(ratio >= least, ratio).otherwise(0.0)


@F.pandas_udf(T.StringType())
def title_case(names: pd.Series) -> pd.Series:
    """Title case with apostrophes and hyphens as word borders, for which there is no built-in function."""
    return names.str.title()


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode normal form C, for which there is no built-in function."""
    return text.str.normalize("NFC")


def display_speaker(speaker: Column) -> Column:
    return F.when(speaker.isNull() | (speaker == ""), "Unknown").when(F.upper(speaker).startswith("SPEAKER_"), F.upper(speaker)).otherwise(title_case(speaker))
