"""Cutting texts into pieces that a tokenizer treats alone, and giving distinct pieces small numbers.

A text may be cut where a blank, tab or line break follows a character that is no white space: the pieces'
tokens are then the tokens of the text. Cutting there finds most words without a regular expression;
patterns and tokenizers only see the distinct pieces of a block.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
# ASCII bytes that some definition of white space includes.
_ANY_SPACE = np.zeros(256, bool)
_ANY_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes before each place may be a white-space character outside ASCII (never misses one)."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    short = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    long = (three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)) & (one >= 0x80)
    return short | long


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece begins (and the end of the block), and the first piece of each text."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        at = np.flatnonzero(_BLANK[data[1:]] & ~_ANY_SPACE[data[:-1]]) + 1
        cut[at[~_after_wide_space(data, at)]] = True
    cut[offs] = True
    where = np.flatnonzero(cut)
    return where, np.searchsorted(where, offs)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each run of bytes and the distinct runs in order of their number. Runs adjoin or not."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    if np.array_equal(starts[1:], ends[:-1]):
        offs, body = np.append(starts, ends[-1]), data
    else:
        length = ends - starts
        offs = np.concatenate([[0], np.cumsum(length)])
        body = data[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], length)]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


_KIND = np.zeros(256, np.uint8)  # 1: letters and digits, 2: punctuation; 0: apostrophe, white space, outside ASCII
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0


def distinct_words(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Numbers of the words between white space, cut further where ASCII letters or digits meet ASCII punctuation other
    than an apostrophe (tokenizers that part words by kind of character cut there anyway); the distinct words; each text's first.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), [], np.zeros(len(offs), np.int64)
    word = ~space[data]
    start = word.copy()
    kind = _KIND[data]
    cut = (kind[1:] ^ kind[:-1]) == 3
    start[1:] &= ~word[:-1] | cut
    inner = offs[(offs > 0) & (offs < n)]
    start[inner] = word[inner]
    starts = np.flatnonzero(start)
    chars = np.zeros(n + 1, np.int64)
    np.cumsum(word, out=chars[1:])
    where = np.append(chars[starts], chars[-1])  # words have no gaps once white space is left out
    body = data[word]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(body)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, offs)


class Ragged:
    """Lists of numbers of many keys in one flat array, to be laid out by arrays of key numbers."""

    def __init__(self, lists: list) -> None:
        self.length = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32)

    def lay_out(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``keys`` one after the other, and where each one begins (with the end)."""
        length = self.length[keys]
        where = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[keys] - where[:-1], length)
        at += np.arange(where[-1])
        return self.flat[at], where
