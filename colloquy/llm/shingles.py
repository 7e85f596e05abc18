"""Sets of word shingles of whole texts, as 64-bit hashes, for the near-duplicate stages.

Edge cases: null and empty texts and texts without words have an empty set; fewer words than a shingle are one shingle; a
shingle that a text repeats is in its set once; very long texts are hashed in segments; no rows give no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from colloquy.llm import textkernel as tk

_ODD = np.uint64(0xA0761D6478BD642F)


def shingle_blocks(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first_row, end_row, hashes, where, sequence keys)`` of blocks of texts, A-Z in lower case.

    ``hashes[where[i]:where[i + 1]]`` are the shingles of text i in order, repeats included: all windows of ``n``
    words, or the whole sequence as one if it has fewer. A text without words has none. Two texts have equal
    sequence keys (two 64-bit numbers) if they have the same words in the same order.
    """
    for a, b, data, offs in tk.blocks(column):
        data = tk.LOWER[data]
        starts, ends, first = tk.words(data, offs)
        hashes = tk.hash_runs(data, starts, ends)
        count = np.diff(first)
        at = np.arange(len(hashes)) - np.repeat(first[:-1], count)
        with np.errstate(over="ignore"):
            weight = np.cumprod(np.full(int(count.max(initial=0)) + 1, tk._Q, np.uint64), dtype=np.uint64)
            keys = np.zeros((2, len(count)), np.uint64)
            full = np.flatnonzero(count > 0)
            if len(full):
                w = weight[at]
                keys[0, full] = tk.mix(np.add.reduceat(hashes * w, first[:-1][full]) + count[full].astype(np.uint64))
                keys[1, full] = tk.mix(np.add.reduceat(tk.mix(hashes ^ _ODD) * w, first[:-1][full]) ^ _ODD)
        grams, where = tk.ngrams(hashes, first, n)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            grams = np.insert(grams, where[short], keys[0, short])
            extra = np.zeros(len(where), np.int64)
            extra[short + 1] = 1
            where = where + np.cumsum(extra)
        yield a, b, grams, where, keys


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's shingles, sorted and distinct."""
    out: list[np.ndarray] = []
    for _, _, grams, where, _ in shingle_blocks(column, n):
        out += [np.unique(grams[s:e]) for s, e in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
    return out
