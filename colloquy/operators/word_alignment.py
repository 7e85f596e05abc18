"""Global alignment of two word sequences by the similarity of their words, in numpy over anti-diagonals.

All cells of an anti-diagonal depend on the two before it only, so each is a handful of vector operations, and
every cell is computed as in the plain recursion: scores, and with them ties, are the same to the last bit. Moves take a byte a cell up to ``CELLS`` cells; beyond,
only the scores of some diagonals are kept, and the moves between two of them are computed again on the way back,
so that memory grows with the square root of the cells times the shorter side.

Many short alignments run side by side (``align_all``): the same cells, one array operation for a diagonal of all of them. Words are compared
only where counts of their letters leave it open whether they are alike, each pair of words once a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CELLS = 1 << 26
LEAST_RATIO = 0.6
SMALL_CELLS = 1 << 14  # alignments up to this size run side by side
GROUP_CELLS = 1 << 18  # and this many cells at once
_BUCKETS = 32


def _norm(word: str) -> str:
    return "".join(c.lower() for c in word if c.isalnum())


def _similarities(x: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Similarity of ``x`` with each of the words in ``codes`` (a row each, padded with -1)."""
    own = np.array([ord(c) for c in x], np.int32)
    short, long = np.minimum(lengths, len(x)), np.maximum(lengths, len(x))
    out = np.zeros(len(codes))
    width = min(len(x), codes.shape[1])
    common = np.logical_and.accumulate(codes[:, :width] == own[:width], axis=1).sum(axis=1) if width else np.zeros(len(codes), np.int64)
    begins = common == short
    out[begins] = 0.7 + 0.2 * short[begins] / np.maximum(long[begins], 1)
    out[begins & (lengths == len(x))] = 1.0
    some = np.flatnonzero(~begins & (long - short <= long // 2))
    if len(some):
        other, n = codes[some], lengths[some]
        columns = np.arange(codes.shape[1] + 1)
        row = np.tile(columns, (len(some), 1))
        for i, c in enumerate(own.tolist(), 1):
            # Insertions run along the row: a running minimum once the column is taken off.
            step = np.minimum(row[:, :-1] + (other != c), row[:, 1:] + 1)
            step = np.concatenate([np.full((len(some), 1), i), step], axis=1)
            row = np.minimum.accumulate(step - columns, axis=1) + columns
        ratio = 1.0 - row[np.arange(len(some)), n] / long[some]
        out[some] = np.where(ratio >= LEAST_RATIO, ratio, 0.0)
    return out


def similarity_table(source: Sequence[str], target: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of both sides, and the similarity of each distinct pair; an empty word is like nothing."""
    sides = []
    for words in (source, target):
        keys = {}
        sides.append((np.array([keys.setdefault(_norm(w) if w else None, len(keys)) for w in words], np.int64), list(keys)))
    (a, left), (b, right) = sides
    if len(left) > len(right):
        b, a, table = similarity_table(target, source)
        return a, b, table.T
    texts = [w or "" for w in right]
    lengths = np.array([len(w) for w in texts], np.int64)
    codes = np.full((len(texts), max(map(len, texts), default=0)), -1, np.int32)
    for k, w in enumerate(texts):
        codes[k, : len(w)] = [ord(c) for c in w]
    table = np.zeros((len(left), len(right)))
    for k, w in enumerate(left):
        if w is not None:
            table[k] = _similarities(w, codes, lengths)
    if None in right:
        table[:, right.index(None)] = 0.0
    return a, b, table


def align_words(source: Sequence[str], target: Sequence[str], gap: float = -0.5, cells: int = CELLS) -> list[tuple[int, int]]:
    """Best global alignment: pairs of places, -1 for a gap. On ties a match goes before a source word alone, that before a target word alone."""
    n, m = len(source), len(target)
    if not n or not m:
        return [(i, -1) for i in range(n)] + [(-1, j) for j in range(m)]
    a, b, table = similarity_table(source, target)
    ends = n + m + 1

    def sweep(first: int, last: int, newest: np.ndarray, older: np.ndarray, keep: bool):
        """Diagonals ``first`` to ``last``; with ``keep``, the moves of their inner cells and the first row of each."""
        moves = []
        for k in range(first, last):
            lo, hi = max(1, k - m), min(n, k - 1)
            now = np.empty(n + 1)
            if k <= m:
                now[0] = newest[0] + gap
            if k <= n:
                now[k] = newest[k - 1] + gap
            if lo <= hi:
                match = older[lo - 1 : hi] + table[a[lo - 1 : hi], b[k - hi - 1 : k - lo][::-1]]
                alone, other = newest[lo - 1 : hi] + gap, newest[lo : hi + 1] + gap
                best = np.maximum(alone, other)
                now[lo : hi + 1] = np.maximum(match, best)
                if keep:
                    moves.append((lo, np.where(match >= best, 0, np.where(alone >= other, 1, 2)).astype(np.uint8)))
            elif keep:
                moves.append((lo, np.zeros(0, np.uint8)))
            newest, older = now, newest
        return newest, older, moves

    block = ends if (n + 1) * (m + 1) <= cells else max(64, int(ends**0.5))
    starts, newest, older = [], np.zeros(n + 1), np.zeros(n + 1)
    for first in range(1, ends, block):
        starts.append((first, newest, older))
        if first + block < ends:
            newest, older, _ = sweep(first, first + block, newest, older, False)
    out, i, j = [], n, m
    for first, newest, older in reversed(starts):
        _, _, moves = sweep(first, min(first + block, ends), newest, older, True)
        while i + j >= first:
            lo, inner = moves[i + j - first]
            move = 2 if not i else 1 if not j else inner[i - lo]
            i, j = i - (move != 2), j - (move != 1)
            out.append((i if move != 2 else -1, j if move != 1 else -1))
    return out[::-1]


# --- many alignments side by side -----------------------------------------------------------------


def letter_codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all ``words`` behind each other, and the length of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def letter_bags(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``lengths`` of the words, and how many letters of each fall into each of some buckets (a row each)."""
    codes, lengths = letter_codes(words)
    owner = np.repeat(np.arange(len(words)) * _BUCKETS, lengths)
    bags = np.bincount(owner + codes % _BUCKETS, minlength=len(words) * _BUCKETS).reshape(-1, _BUCKETS)
    return lengths, bags.astype(np.uint8 if lengths.max(initial=0) < 256 else np.int64)


def letters_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows of two sets of bags, a number of letters that the words share at most."""
    kind = np.result_type(left, right)
    return np.minimum(left.T[:, :, None], right.T[:, None, :]).sum(axis=0, dtype=kind).astype(np.int64)


def _pair_similarities(codes: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of the words numbered ``x`` with those numbered ``y``, place by place; no word is held against itself."""
    n, m = lengths[x], lengths[y]
    short, long = np.minimum(n, m), np.maximum(n, m)
    out = np.zeros(len(x))
    order = np.argsort(long, kind="stable")
    for some in np.array_split(order, max(1, len(order) >> 13)):
        if not len(some):
            continue
        width = int(long[some].max())
        a, b = codes[x[some], :width], codes[y[some], :width]
        s, l = short[some], long[some]
        begins = np.logical_and.accumulate((a == b) & (a >= 0), axis=1).sum(axis=1) == s
        value = np.where(begins, 0.7 + 0.2 * s / np.maximum(l, 1), 0.0)
        open_ = np.flatnonzero(~begins & (l - s <= l // 2))
        if len(open_):
            a, b, own, other = a[open_], b[open_], n[some][open_], m[some][open_]
            columns = np.arange(width + 1)
            row = np.tile(columns, (len(open_), 1))
            distance = np.where(own == 0, other, 0)
            for i in range(1, int(own.max()) + 1):
                # Insertions run along the row: a running minimum once the column is taken off.
                step = np.minimum(row[:, :-1] + (b != a[:, i - 1 : i]), row[:, 1:] + 1)
                step = np.concatenate([np.full((len(open_), 1), i), step], axis=1)
                row = np.minimum.accumulate(step - columns, axis=1) + columns
                done = np.flatnonzero(own == i)
                distance[done] = row[done, other[done]]
            ratio = 1.0 - distance / l[open_]
            value[open_] = np.where(ratio >= LEAST_RATIO, ratio, 0.0)
        out[some] = value
    return out


def _tables(pairs: Sequence[tuple[Sequence[str], Sequence[str]]], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of the words of each pair of lists, padded with 0."""
    keys: dict[str | None, int] = {None: 0}  # an empty word is like nothing
    numbers = [[np.array([keys.setdefault(_norm(w) if w else None, len(keys)) for w in side], np.int64) for side in pair] for pair in pairs]
    words = [w or "" for w in keys]
    lengths, bags = letter_bags(words)
    flat, _ = letter_codes(words)
    codes = np.full((len(words), max(int(lengths.max(initial=0)), 1)), -1, np.int32)
    codes[np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    first = codes[:, 0]
    table = np.zeros((len(pairs), int(n.max()), int(m.max())))
    places, found = [], []
    for k, (a, b) in enumerate(numbers):
        la, lb = lengths[a][:, None], lengths[b][None]
        short, long = np.minimum(la, lb), np.maximum(la, lb)
        shared = letters_shared(bags[a], bags[b])
        # A word that begins the other shares all its letters; a distance of d leaves the longer word all but d letters to share.
        begins = (shared >= short) & ((first[a][:, None] == first[b][None]) | (short == 0))
        near = (long - short <= long // 2) & (1.0 - (long - shared) / np.maximum(long, 1) >= LEAST_RATIO)
        i, j = np.nonzero((begins | near) & (a[:, None] > 0) & (b[None] > 0))
        x, y = a[i], b[j]
        table[k, i[x == y], j[x == y]] = 1.0
        i, j, x, y = (v[x != y] for v in (i, j, x, y))
        places.append((np.full(len(i), k), i, j))
        found.append(np.minimum(x, y) * len(words) + np.maximum(x, y))
    distinct, back = np.unique(np.concatenate(found), return_inverse=True)
    table[tuple(np.concatenate(p) for p in zip(*places, strict=True))] = _pair_similarities(codes, lengths, distinct // len(words), distinct % len(words))[back]
    return table


def _side_by_side(pairs: Sequence[tuple[Sequence[str], Sequence[str]]], gap: float) -> list[np.ndarray]:
    n, m = (np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1))
    table = _tables(pairs, n, m)
    most, other_most = table.shape[1:]
    ends = most + other_most + 1
    moves = np.zeros((ends, len(pairs), most + 1), np.uint8)
    newest, older = np.zeros((len(pairs), most + 1)), np.zeros((len(pairs), most + 1))
    # Cells beyond the end of a shorter list are computed too; nothing inside depends on them.
    for k in range(1, ends):
        lo, hi = max(1, k - other_most), min(most, k - 1)
        now = np.zeros((len(pairs), most + 1))
        if k <= other_most:
            now[:, 0] = newest[:, 0] + gap
        if k <= most:
            now[:, k] = newest[:, k - 1] + gap
        if lo <= hi:
            at = np.arange(lo - 1, hi)
            match = older[:, lo - 1 : hi] + table[:, at, k - 2 - at]
            alone, other = newest[:, lo - 1 : hi] + gap, newest[:, lo : hi + 1] + gap
            best = np.maximum(alone, other)
            now[:, lo : hi + 1] = np.maximum(match, best)
            moves[k, :, lo : hi + 1] = np.where(match >= best, 0, np.where(alone >= other, 1, 2))
        newest, older = now, newest
    # All ways back together: a step of each that is not at its beginning.
    i, j, own = n.copy(), m.copy(), np.arange(len(pairs))
    left, right = (np.full((len(pairs), ends), -2, np.int32) for _ in range(2))
    for step in range(ends - 1, -1, -1):
        going = np.flatnonzero(i + j > 0)
        if not len(going):
            break
        a, b = i[going], j[going]
        move = np.where(a == 0, 2, np.where(b == 0, 1, moves[a + b, own[going], a]))
        i[going] -= move != 2
        j[going] -= move != 1
        left[going, step] = np.where(move != 2, i[going], -1)
        right[going, step] = np.where(move != 1, j[going], -1)
    return [np.stack([x[x > -2], y[x > -2]], axis=1) for x, y in zip(left, right, strict=True)]


def align_all(pairs: Sequence[tuple[Sequence[str], Sequence[str]]], gap: float = -0.5) -> Iterator[np.ndarray]:
    """``align_words`` of each of many pairs of lists, in order, as two columns of places; groups of like size run side by side."""
    sizes = [(len(s) + 1) * (len(t) + 1) for s, t in pairs]
    out: list[np.ndarray | None] = [None] * len(pairs)
    small = sorted((k for k, (s, t) in enumerate(pairs) if s and t and sizes[k] <= SMALL_CELLS), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    group: list[int] = []
    wide = long = 0
    for k in [*small, None]:
        w, h = (max(wide, len(pairs[k][0]) + 1), max(long, len(pairs[k][1]) + 1)) if k is not None else (0, 0)
        if group and (k is None or w * h * (len(group) + 1) > GROUP_CELLS):
            for own, found in zip(group, _side_by_side([pairs[g] for g in group], gap), strict=True):
                out[own] = found
            group, wide, long = [], 0, 0
        if k is not None:
            group.append(k)
            wide, long = max(wide, len(pairs[k][0]) + 1), max(long, len(pairs[k][1]) + 1)
    for k, found in enumerate(out):
        yield np.array(align_words(*pairs[k], gap), np.int32).reshape(-1, 2) if found is None else found
