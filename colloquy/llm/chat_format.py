"""Chat formatting with a declarative template, by DataFrame expressions only.

A finite-state machine over roles (a map of allowed transitions, folded over each conversation's turns)
checks the order of turns; every conversation is formatted, whatever the verdict. The template gives the
text around each role's turns and whether the turn's own text counts for the loss. Output is a list of
segments, each a piece of text with its loss flag; joined, they are the formatted conversation.

Control strings of the template are broken up inside texts: backslashes are doubled and one backslash goes
behind the first character of a control string, so that none survives in a text and the text can be had
back exactly. Reading back splits the formatted string at the template's marks.

Turns of a conversation are brought together by its id; a conversation is one output row, so its size bounds
the group. Edge cases: null text is empty; a null role is the empty role; rows with equal or null turn are
ordered by role and text (nulls first); repeated rows are repeated turns; an empty table gives no rows. Only
``conv_id, turn, role, text`` are read, so further columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleTemplate:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """``roles``: what stands around a turn. Other roles stand between ``other_open``, the role, ``other_close``."""

    roles: dict[str, RoleTemplate] = field(
        default_factory=lambda: {
            "system": RoleTemplate("<<SYS>>\n", "\n<</SYS>>"),
            "user": RoleTemplate("[INST] ", " [/INST]"),
            "assistant": RoleTemplate("<s>", "", loss=True),
        }
    )
    other_open: str = "[ROLE]"
    other_close: str = "[/ROLE]"
    end: str = "</s>"
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def control(self) -> list[str]:
        marks = {m.strip() for r in self.roles.values() for m in (r.before, r.after)} | {self.other_open, self.other_close, self.end}
        return sorted(m for m in marks if m)


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.control():
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def valid_order(roles: Column, template: ChatTemplate) -> Column:
    """Folds the machine over an array of roles; ``x`` is the state of no return."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("x")
        for name, following in template.transitions.items():
            out = F.when((state == name) & role.isin(*following), role).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step) == "assistant"


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid_order, segments, formatted``."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        before = F.concat(F.lit(template.other_open), escape(t["role"], template), F.lit(template.other_close))
        after, loss = F.lit(""), F.lit(False)
        for role, r in template.roles.items():
            here = t["role"] == role
            before = F.when(here, F.lit(r.before)).otherwise(before)
            after = F.when(here, F.lit(r.after)).otherwise(after)
            loss = F.when(here, F.lit(r.loss)).otherwise(loss)
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(before, F.lit(False)), piece(escape(t["text"], template), loss), piece(F.concat(after, F.lit(template.end)), F.lit(False)))

    out = gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid_order"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds ``turns``, the roles and texts that the formatted string holds, and ``loss_text``, what of them counts for the loss."""

    def turn(part: Column) -> Column:
        rest = F.substring(part, F.lit(len(template.other_open) + 1), F.length(part))
        cut = F.instr(rest, template.other_close)
        role = unescape(F.substring(rest, F.lit(1), cut - 1))
        text = F.substring(rest, cut + len(template.other_close), F.length(rest))
        for name, r in template.roles.items():
            inner = F.substring(part, F.lit(len(r.before) + 1), F.length(part) - len(r.before) - len(r.after))
            here = part.startswith(r.before)
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    quoted = "\\Q" + template.end + "\\E"
    parts = F.split("formatted", quoted)
    out = formatted.withColumn("turns", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn))
    lossy = [role for role, r in template.roles.items() if r.loss]
    return out.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(lossy)), lambda t: t["text"]), ""))
