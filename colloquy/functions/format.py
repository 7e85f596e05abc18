"""Times, durations, shares and colours for display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of speakers in order, and symbols and verbs of interjection types.
PALETTE = ("#4A90D9", "#D94A4A", "#4AD94A", "#D9A84A", "#9B4AD9", "#4AD9D9", "#D94A9B", "#7AD94A")
SYMBOLS = {"acknowledgment": "✓", "question": "?", "reaction": "!", "unclear": "·", "overlap": "≈"}
VERBS = {"acknowledgment": "acknowledges", "question": "questions", "reaction": "reacts", "unclear": "interjects", "overlap": "overlaps"}


def _parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    t = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(t)
    ms = F.round((t - whole) * 1000).cast("int")
    return F.floor(whole / 3600).cast("int"), (F.floor(whole / 60) % 60).cast("int"), (whole % 60).cast("int"), ms


def timestamp(seconds: Column, style: str = "hms") -> Column:
    """``hms`` 00:00:00.000, ``srt`` with a comma, ``ms`` 00:00.000, ``seconds`` 1.50s, ``compact`` 1h 2m 3s."""
    h, m, s, ms = _parts(seconds)
    if style == "seconds":
        return F.format_string("%.2fs", F.greatest(seconds, F.lit(0.0)))
    if style == "ms":
        return F.format_string("%02d:%02d.%03d", h * 60 + m, s, ms)
    if style == "compact":
        return F.concat_ws(" ", F.when(h > 0, F.format_string("%dh", h)), F.when((m > 0) | (h > 0), F.format_string("%dm", m)), F.format_string("%ds", s))
    return F.format_string("%02d:%02d:%02d,%03d" if style == "srt" else "%02d:%02d:%02d.%03d", h, m, s, ms)


def duration(seconds: Column) -> Column:
    h, m, s, _ = _parts(seconds)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(" " + name), F.when(n != 1, "s").otherwise(""))
    return F.concat_ws(" ", F.when(h > 0, unit(h, "hour")), F.when(m > 0, unit(m, "minute")), F.when((s > 0) | ((h == 0) & (m == 0)), unit(s, "second")))


def position_percent(time: Column, total: Column, offset: Column | float = 0.0) -> Column:
    offset = F.lit(offset) if isinstance(offset, float) else offset
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (time - offset) / total * 100)))


def percentage(share: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", share * 100)


def speaker_color(speaker: Column, speakers: Column) -> Column:
    """By the speaker's place among all; unknown ones have the first colour."""
    at = F.array_position(speakers, speaker)
    palette = F.array(*map(F.lit, PALETTE))
    return F.when(at > 0, F.element_at(palette, (F.pmod(at - 1, F.lit(len(PALETTE))) + 1).cast("int"))).otherwise(PALETTE[0])


def _lookup(kind: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(F.lower(kind) == key, value).otherwise(out)
    return out


def interjection_symbol(kind: Column) -> Column:
    return _lookup(kind, SYMBOLS, "·")


def interjection_verb(kind: Column) -> Column:
    return _lookup(kind, VERBS, "interjects")
