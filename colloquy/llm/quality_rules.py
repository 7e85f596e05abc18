"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it has said before.

Method: rolling hashes of several n-gram lengths over the words of a block of texts (numpy, one pass,
no Python loop over words). A window of n words that equals an earlier window of the same text covers its
words; the characters of all covered words, against the characters of all words, is the coverage at n.
Lines are measured the same way. Each row depends on its own text only: no shuffle, no state.

Edge cases: a null or empty text has no words, all counts 0, coverage 0, and fails the base rule. Texts
shorter than a window have none of that length. Repeated rows are judged one by one; ties cannot arise.
Of the input only ``doc_id`` and ``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import texts


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict; a text passes if no coverage is above its limit."""

    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_limit: float = 0.20
    symbol_limit: float = 0.10
    min_words: int = 50
    repeat_percent: int = 50


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows equal an earlier one of the same owner, and which equal any other one."""
    with np.errstate(over="ignore"):
        keys = tk.mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    return later, shared


def _covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each window."""
    grams, where = tk.ngrams(hashes, first, n)
    count = np.diff(where)
    owner = np.repeat(np.arange(len(count)), count)
    return grams, owner, np.arange(len(grams)) + np.repeat(first[:-1] - where[:-1], count)


def measure(data: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts and coverages of each text of a block."""
    starts, ends, first = tk.words(data, offs)
    hashes = tk.hash_runs(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    chars_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars_before[1:])
    word_len = chars_before[ends] - chars_before[starts]
    len_before = np.zeros(len(word_len) + 1, np.int64)
    np.cumsum(word_len, out=len_before[1:])
    out = {
        "n_words": np.diff(first),
        "word_chars": len_before[first[1:]] - len_before[first[:-1]],
        "n_symbols": _per_text(_SYMBOL[data], offs),
    }
    of_text = np.repeat(np.arange(len(offs) - 1), np.diff(first))

    ls, le, lfirst = tk.runs(data != 0x0A, offs)
    with_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    l_text = np.repeat(np.arange(len(offs) - 1), np.diff(lfirst))[with_word]
    ls, le = ls[with_word], le[with_word]
    later, _ = _repeats(tk.hash_runs(data, ls, le), l_text)
    out["n_dup_lines"] = np.bincount(l_text[later], minlength=len(offs) - 1)
    dup_line_chars = np.bincount(l_text[later], weights=(chars_before[le] - chars_before[ls])[later], minlength=len(offs) - 1)
    line_chars = np.bincount(l_text, weights=chars_before[le] - chars_before[ls], minlength=len(offs) - 1)
    out["dup_line_coverage"] = dup_line_chars / np.maximum(line_chars, 1)

    grams, owner, at = _windows(hashes, first, 3)
    _, shared = _repeats(grams, owner)
    inside = _covered(len(hashes), at[shared], 3)
    out["n_repeat_words"] = np.bincount(of_text[inside], minlength=len(offs) - 1)

    # Only texts that repeat a window of the shortest length can repeat a longer one.
    some = np.arange(len(offs) - 1)
    for n in sorted(lengths):
        out[f"dup_{n}gram_coverage"] = np.zeros(len(offs) - 1)
        if not len(some):
            continue
        count = np.diff(first)[some]
        own_first = np.concatenate([[0], np.cumsum(count)])
        pick = tk.expand(first[:-1][some], count)
        grams, owner, at = _windows(hashes[pick], own_first, n)
        later, _ = _repeats(grams, owner)
        inside = _covered(len(pick), at[later], n)
        covered = np.bincount(np.repeat(np.arange(len(some)), count)[inside], weights=word_len[pick][inside], minlength=len(some))
        out[f"dup_{n}gram_coverage"][some] = covered / np.maximum(out["word_chars"][some], 1)
        some = some[covered > 0]
    return out


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per document: counts, coverages, ``base_failed``, the method's ``repetition_failed`` and ``kept``."""
    lengths = tuple(sorted(rules.ngram_limits))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    doubles = ("dup_line_coverage", *(f"dup_{n}gram_coverage" for n in lengths))
    schema = "doc_id long, " + ", ".join([f"{c} long" for c in longs] + [f"{c} double" for c in doubles])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text")):
                m = measure(data, offs, lengths)
                cols = [batch.column("doc_id").slice(a, b - a)]
                cols += [pa.array(m[c].astype(np.int64)) for c in longs] + [pa.array(m[c].astype(np.float64)) for c in doubles]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *longs, *doubles])

    measured = texts(docs).mapInArrow(run, schema)
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    over = F.col("dup_line_coverage") > rules.line_limit
    for n, limit in sorted(rules.ngram_limits.items()):
        over = over | (F.col(f"dup_{n}gram_coverage") > limit)
    over = over | (F.col("n_symbols") > rules.symbol_limit * F.col("word_chars"))
    return measured.withColumns({"base_failed": base, "repetition_failed": over, "kept": ~base & ~over})
