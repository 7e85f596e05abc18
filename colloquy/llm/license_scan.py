"""Licence scan: identifier tags, notice phrases and licence expressions in whole texts.

Method: one Aho-Corasick automaton over all phrases and tags goes once through each text (its words in
lower case, one blank between them); what follows an identifier tag is read as a licence expression by a
shunting-yard parser (``WITH`` binds tighter than ``AND``, that tighter than ``OR``). Each row depends on
its own text only, so the scan is a map over partitions; the automaton is built once per Python worker.

Words are runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased. Edge cases: a null or empty
text has no words, no places, empty label strings and score 0. Phrases that overlap count at each place.
An expression is read to the end of its line. One that parses gives all its operands as labels
(with prose behind it, those listed or with a version); one that does not yields the known identifiers before the fault.
Expressions of any length are kept whole, in a normal form as long as they are. Time is linear in a text. Repeated rows are scanned
one by one. Only ``doc_id`` and ``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import texts

# The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Wording of public licence notices, and the label each one supports.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license": "gpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
# Short identifiers that may stand after a tag.
IDENTIFIERS = (
    "mit", "apache-2.0", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later",
    "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "isc",
    "mpl-2.0", "epl-2.0", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "unlicense", "zlib", "classpath-exception-2.0",
)
TAG = "spdx license identifier"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ID = re.compile(r"(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.-]*\+?")
_VERSIONED = re.compile(r"-\d|licenseref-")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> tuple[list[str], bool]:
    """Identifiers of a licence expression in postfix order, and whether all of it parsed.

    >>> parse_expression("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")[1]
    True
    """
    output: list[str] = []
    waiting: list[str] = []
    depth = 0
    operand_next = True
    for token in re.findall(r"[()]|[^\s()]+", text):
        low = token.lower()
        if low == "(":
            if not operand_next:
                return output, False
            waiting.append(low)
            depth += 1
        elif low == ")":
            if operand_next or not depth:
                return output, False
            depth -= 1
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        elif low in _RANK:
            if operand_next:
                return output, False
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                output.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            output.append(low.rstrip(".,;*/"))
            operand_next = False
    complete = not operand_next and not depth
    return output + [w for w in reversed(waiting) if w != "("], complete


def satisfied(postfix: list[str], accepted: frozenset[str] | set[str]) -> bool:
    """Whether a parsed expression can be met with ``accepted`` licences alone (an exception needs its licence only)."""
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if token == "or" else left and right if token == "and" else left)
        else:
            stack.append(token in accepted)
    return bool(stack) and stack[-1]


def normal_form(postfix: list[str]) -> str:
    """A parsed expression with ``|`` and ``&`` and no more brackets than it needs."""
    stack: list[str | tuple[str, list]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        own = left[1] if isinstance(left, tuple) and left[0] == token else [left]
        own += right[1] if isinstance(right, tuple) and right[0] == token else [right]
        stack.append((token, own))
    out: list[str] = []
    waiting: list = [stack[-1]] if stack else []
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        op, kids = node
        sign = {"or": " | ", "and": " & ", "with": " with "}[op]
        parts: list = []
        for k, kid in enumerate(kids):
            inner = isinstance(kid, tuple) and _RANK[kid[0]] < _RANK[op]
            parts += ([_Text(sign)] if k else []) + ([_Text("("), kid, _Text(")")] if inner else [kid])
        waiting += reversed(parts)
    return "".join(out)


class _Text(str):
    """A sign of the normal form."""


def _known(name: str) -> bool:
    return name in IDENTIFIERS or name.removesuffix("+") in IDENTIFIERS


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            key = f" {phrase} "
            entry = auto.get(key, ())
            auto.add_word(key, (*entry, (kind, label, len(key))))
    auto.make_automaton()
    return auto


def scan(text: bytes) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, expressions`` of one text."""
    words = text.translate(_FOLD).split()
    folded = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, labels, places, tagged, notices = set(), set(), [], False, 0
    for end, entries in _automaton().iter(folded):
        for kind, label, length in entries:
            if kind == "tag":
                tagged = True
            elif kind == "base":
                base.add(label)
                places.append(end - length + 1)
            else:
                labels.add(label)
                notices += 1
    starts: list[int] = []
    if places:  # the blank before a word stands at the sum of the lengths before it
        begins = np.cumsum([0, *(len(w) + 1 for w in folded[1:-1].split(" "))])
        starts = np.searchsorted(begins, places).tolist()
    expressions = []
    if tagged:
        for found in re.finditer(r"(?i)spdx-license-identifier\s*:[ \t]*([^\n\r]+)", text.decode("utf-8", "replace")):
            postfix, complete = parse_expression(found[1])
            # every operand of an expression that parses counts; before a fault, only known ones do
            alone = sum(any(map(str.isalnum, x)) for x in re.findall(r"[^\s()]+", found[1])) == len(postfix)  # no prose behind it
            known = [x for x in postfix if x not in _RANK and (_known(x) or complete and _ID.fullmatch(x) and (alone or _VERSIONED.search(x)))]
            if known:
                expressions.append(normal_form(postfix) if complete else known[0])
                labels.update(known)
    score = 1.0 if expressions else min(1.0, 0.5 * bool(starts) + 0.25 * min(notices, 2))
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score, expressions,
    )


_COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string()),
}


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: places and labels of licence notices, and the expressions behind identifier tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offs in tk.blocks(batch.column("text")):
                raw = data.tobytes()
                rows = [scan(raw[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                cols = [pa.array(col, t) for col, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *cols], names=["doc_id", *_COLUMNS])

    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
    return texts(docs).mapInArrow(run, f"doc_id long, {kinds}")
