"""Passages that documents share, found by collinear chaining of k-mer seeds.

1. Seeds: of every ``window`` windows of ``k`` words in a row the one with the least hash (a minimizer), so any run of
   ``k + window - 1`` equal words in two documents shares a seed. Long seeds of ``long_k`` words are taken beside them: they
   link holders of the passage itself, where short seeds may stand alone in many other documents.
2. Seeds are sorted by seed and doc_id over range partitions. Each place of a seed is linked with the first document that has it
   and with the document just before it, place by place where a document has several, and never with all others: two rows at most per
   place, however many documents share it. Ranges include the doc_id, so a seed in a third of all documents is spread over many tasks;
   what meets across the borders of partitions is linked by a table of border rows, so links do not depend on the partitions.
3. Matches of a document with an earlier one are merged along their diagonals and chained: the best chain that keeps the
   order in both texts, less a cost for gaps, by a Fenwick tree of prefix maxima.
4. Chains are aligned: the words of both stretches are fetched, ends are extended over equal words, and the identity is that of
   the seeds' words and of the longest common subsequences (bit-parallel) between them, by the longer stretch. A chain whose identity is too
   low is split at its widest gap, so passages on both sides of other words are each found. This runs in two rounds: chains with
   first holders and of long seeds, then whatever matches lie in no stretch found, single ones and those with nearest holders too.
5. A document's aligned stretches, of whichever owners, are joined where they touch; those of ``min_words`` words or
   more are its repeated passages. The first document (smallest doc_id) of a passage has none for it.

Groups are bounded by one document: matches, stretches and passages are gathered by document (and owner) only.

Words are compared with A-Z in lower case. Edge cases: null and empty texts, and texts under ``k`` words, share nothing; a
passage repeated inside one document alone is none; rows that repeat a doc_id are one document; rows with a null doc_id
take no part (and pass ``cut_passages`` unchanged). ``find_passages`` reads ``doc_id`` and ``text`` only; ``cut_passages``
returns all columns of its input under their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.shared import materialise, texts


@dataclass(frozen=True)
class PassageSearch:
    k: int = 5
    window: int = 4
    long_k: int = 20  # a long seed stands for long_k / k matches
    long_window: int = 30  # any long_k + long_window - 1 equal words share a long seed: less than min_words
    reach: int = 48  # words between matches on one diagonal that are taken as one stretch
    gap_cost: float = 0.25
    first_chain: int = 12  # words from a chain's first match to its last that are aligned in the first round; shorter ones wait for the second
    min_stretch: int = 12  # words of an aligned stretch
    flank: int = 48  # words fetched beyond a chain's ends
    late_flank: int = 16  # the same in the second round, whose chains are short and stand beside others
    min_words: int = 50
    identity: float = 0.8
    join_gap: int = 3  # words between stretches of one passage
    company: int = 20  # words within which a match left for the second round has another one, or a stretch, beside it


def _slide(values: np.ndarray, window: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each run of ``window`` values from its first place on, by doubling (the last places see fewer)."""
    out, span = values.copy(), 1
    while span < window:
        step = min(span, window - span)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:])
        span += step
    return out


def _minimizers(grams: np.ndarray, where: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of every ``window`` grams in a row of each text (of all grams, if fewer)."""
    count = np.diff(where)
    least = _slide(grams, window, np.minimum)
    fits = np.ones(len(grams), bool)  # windows that lie in one text
    fits[tk.expand(np.maximum(where[1:] - window + 1, where[:-1]), np.minimum(count, window - 1))] = False
    least[~fits] = 0
    # a gram is the least of a window if the greatest minimum of the windows that it is in is its own
    pad = np.concatenate([np.zeros(window - 1, grams.dtype), least])
    mark = _slide(pad, window, np.maximum)[: len(grams)] == grams
    short = np.flatnonzero((count > 0) & (count < window))
    if len(short):
        mark[tk.expand(where[short], count[short])] = False
        lowest = np.minimum.reduceat(grams, where[:-1][count > 0])[np.searchsorted(np.flatnonzero(count > 0), short)]
        inside = tk.expand(where[short], count[short])
        mark[inside] = grams[inside] == np.repeat(lowest, count[short])
    return np.flatnonzero(mark)


def _hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, offs)
    return tk.hash_runs(low, starts, ends), first


def seeds(docs: DataFrame, how: PassageSearch) -> DataFrame:
    """``seed, doc_id, pos``: the minimizers, long ones odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, data, offs in tk.blocks(batch.column("text")):
                hashes, first = _hashes(data, offs)
                for odd, k, window in ((0, how.k, how.window), (1, how.long_k, how.long_window)):
                    grams, where = tk.ngrams(hashes, first, k)
                    if not len(grams):
                        continue
                    at = _minimizers(grams, where, window)
                    text = np.searchsorted(where, at, "right") - 1
                    seed = grams[at] & ~np.uint64(1) | np.uint64(odd)
                    cols = [pa.array(seed.view(np.int64)), pa.array(ids[a:b][text]), pa.array((at - where[text]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["seed", "doc_id", "pos"])

    return texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, "seed long, doc_id long, pos int")


def link_places(seed: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (later, earlier) of sorted places: each with the first document of its seed, then each with the one before it, if another.

    Where documents have a seed several times, the places are paired in order (what is left with the last).
    """
    n = len(seed)
    new_seed = np.ones(n, bool)
    new_seed[1:] = seed[1:] != seed[:-1]
    new_doc = new_seed.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(new_doc)  # of each run of one seed in one document
    count = np.diff(start, append=n)
    run = np.cumsum(new_doc) - 1
    rank = np.arange(n) - start[run]
    run_of_seed = np.maximum.accumulate(np.where(new_seed[start], np.arange(len(start)), 0))
    pairs = []
    here = np.arange(len(start))
    for other, wanted in ((run_of_seed, run_of_seed < here), (here - 1, run_of_seed < here - 1)):
        later = np.flatnonzero(wanted[run])
        partner = other[run[later]]
        pairs.append((later, start[partner] + np.minimum(rank[later], count[partner] - 1)))
    return pairs


_LINKS = "kind byte, part int, seed long, doc_id long, owner long, pos int, opos int, at array<int>"
_FIRST, _NEAR, _TO_FIRST, _TO_LAST, _HEAD, _TAIL = range(6)


def _links(columns: dict, kind: int, part: int) -> pa.RecordBatch:
    n = len(columns["seed"])
    types = {"seed": pa.int64(), "doc_id": pa.int64(), "owner": pa.int64(), "pos": pa.int32(), "opos": pa.int32(), "at": pa.list_(pa.int32())}
    cols = [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, part, np.int32))]
    cols += [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "part", *types])


def seed_matches(rows: DataFrame) -> DataFrame:
    """``seed, doc_id, owner, pos, opos, near`` of linked places; ``owner`` is the first document of the seed, or (``near``) the one just before.

    A seed whose places fill several partitions is linked as if it stood in one: the first seed of every partition may have begun
    before, so links of its places to the first document (and, of its first two documents, to the one before) stay open until the borders
    are known: ``opos`` is the place's number in its document then. A partition's borders are the first and the last document of its first
    seed and of its last one, with their places: four rows a partition at most. All links look them up, one row each; only open ones find any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        linked = 0  # rows of ``held`` that are linked already
        opening: int | None = None  # the partition's first seed
        opened: list[tuple[int, list[int]]] = []  # its first and its last document so far, with their places

        def link(table: list[np.ndarray], upto: int, fresh_from: int) -> Iterator[pa.RecordBatch]:
            seed, doc, pos = (x[:upto] for x in table)
            for kind, (later, earlier) in zip((_FIRST, _NEAR), link_places(seed, doc)):
                fresh = (later >= fresh_from) & ((kind == _NEAR) | (seed[later] != opening))
                later, earlier = later[fresh], earlier[fresh]
                yield _links({"seed": seed[later], "doc_id": doc[later], "owner": doc[earlier], "pos": pos[later], "opos": pos[earlier]}, kind, part)

        def open_rows(table: list[np.ndarray], upto: int, fresh_from: int) -> Iterator[pa.RecordBatch]:
            """The first seed's places: each to the first document, those of the first two documents here to the last one before them."""
            n = int(np.searchsorted(table[0][:upto] != opening, True)) if upto and table[0][0] == opening else 0
            if n <= fresh_from:
                return
            doc, pos = table[1][:n], table[2][:n]
            new = np.append(True, doc[1:] != doc[:-1])
            start, run = np.flatnonzero(new), np.cumsum(new) - 1
            rank = np.arange(n) - start[run]
            at = np.arange(fresh_from, n)
            yield _links({"seed": np.full(len(at), opening), "doc_id": doc[at], "pos": pos[at], "opos": rank[at]}, _TO_FIRST, part)
            one, two = at[run[at] == 0], at[run[at] == 1]
            yield _links({"seed": np.full(len(one), opening), "doc_id": doc[one], "pos": pos[one], "opos": rank[one]}, _TO_LAST, part)
            if len(two):
                other = pos[np.minimum(rank[two], start[1] - 1)]
                yield _links({"seed": np.full(len(two), opening), "doc_id": doc[two], "owner": doc[np.zeros_like(two)], "pos": pos[two], "opos": other}, _TO_LAST, part)
            x = start[-1]
            opened[:] = [opened[0] if opened else (int(doc[0]), pos[run == 0].tolist()), (int(doc[x]), pos[x:].tolist())]

        def edge(kind: int, seed: int, doc: int, places: list[int]) -> pa.RecordBatch:
            return _links({"seed": [seed], "doc_id": [doc], "at": [places]}, kind, part)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("seed", "doc_id", "pos"), strict=True)]
            seed, doc, _ = table
            opening = int(seed[0]) if opening is None else opening
            last = len(seed) - int(np.argmax((seed[::-1] != seed[-1]) | (doc[::-1] != doc[-1]))) if (seed[0], doc[0]) != (seed[-1], doc[-1]) else 0
            yield from link(table, last, linked)
            yield from open_rows(table, last, linked)
            # kept for the next batch: the last run, which may go on, and if its seed has others the first and the last of them
            same = int(np.searchsorted(seed[:last] == seed[-1], True)) if last and seed[last - 1] == seed[-1] else last
            keep = np.zeros(len(seed), bool)
            keep[last:] = True
            if same < last:
                keep[same:last] = (doc[same:last] == doc[same]) | (doc[same:last] == doc[last - 1])
            linked = int(keep[:last].sum())
            held = [x[keep] for x in table]
        yield from link(held, len(held[0]), linked)
        yield from open_rows(held, len(held[0]), linked)
        if opening is not None:
            yield edge(_HEAD, opening, *opened[0])
            seed, doc, pos = held
            if seed[-1] == opening:
                yield edge(_TAIL, opening, *opened[-1])
            else:
                own = seed == seed[-1]
                first = own & (doc == doc[own][0])
                final = own & (doc == doc[-1])
                yield edge(_HEAD, int(seed[-1]), int(doc[first][0]), pos[first].tolist())
                yield edge(_TAIL, int(seed[-1]), int(doc[-1]), pos[final].tolist())

    dealt = rows.repartitionByRange("seed", "doc_id").sortWithinPartitions("seed", "doc_id", "pos")
    found = materialise(dealt.mapInArrow(run, _LINKS), "seed-links")
    heads = found.where(F.col("kind") == _HEAD).groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("head"))
    # the last document of the last partition before that has the seed too
    tails = found.where(F.col("kind") == _TAIL).select("seed", F.col("part").alias("tail_part"), F.struct("doc_id", "at").alias("tail"))
    parts = found.where(F.col("kind") == _HEAD).select("seed", "part").distinct()
    earlier = parts.join(tails, "seed").where("tail_part < part").groupBy("seed", "part").agg(F.max_by("tail", "tail_part").alias("tail"))
    edges = materialise(parts.join(heads, "seed").join(earlier, ["seed", "part"], "left"), "edges")  # two rows a partition at most
    kind, own = F.col("kind"), F.col("owner")
    place = lambda at: F.element_at(at, F.least(F.col("opos") + 1, F.size(at)))
    owner = F.when(kind == _TO_FIRST, F.col("head.doc_id")).when(kind == _TO_LAST, F.coalesce(own, F.col("tail.doc_id"))).otherwise(own)
    opos = F.when(kind == _TO_FIRST, place(F.col("head.at"))).when((kind == _TO_LAST) & own.isNull(), place(F.col("tail.at"))).otherwise(F.col("opos"))
    links = found.where(kind <= _TO_LAST).join(F.broadcast(edges), ["seed", "part"], "left")
    links = links.select("kind", "seed", "doc_id", owner.alias("owner"), "pos", opos.alias("opos"), kind.isin(_NEAR, _TO_LAST).alias("near"), F.col("head.doc_id").alias("first"))
    held = (kind <= _NEAR) | ((F.col("doc_id") != F.col("owner")) & ((kind == _TO_FIRST) | (F.col("owner") != F.col("first"))))
    return links.where(held).drop("kind", "first")


class _PrefixMax:
    """A Fenwick tree: the greatest value put at any place up to a place, with who put it."""

    def __init__(self, n: int) -> None:
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, who: int) -> None:
        i = place + 1
        while i < len(self.tree):
            if value > self.tree[i][0]:
                self.tree[i] = (value, who)
            i += i & -i

    def best(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        i = place + 1
        while i > 0:
            if self.tree[i][0] > found[0]:
                found = self.tree[i]
            i -= i & -i
        return found


def runs_of_groups(group: np.ndarray, pos: np.ndarray, opos: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, ...]:
    """Matches of a group on one diagonal at most ``reach`` words apart as one stretch: ``group, start, end, other start, words covered``, sorted."""
    d = pos - opos
    order = np.lexsort((pos, d, group))
    g, p, d = group[order], pos[order], d[order]
    new = np.ones(len(p), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > reach)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(p))[: len(begin)] - 1
    step = np.minimum(np.diff(p, append=p[-1:] + k), k)
    step[last] = k
    found = g[begin], p[begin], p[last] + k, p[begin] - d[begin], np.add.reduceat(step, begin) if len(begin) else step
    order = np.lexsort(found[::-1])
    return tuple(x[order] for x in found)


def diagonal_runs(pos: np.ndarray, opos: np.ndarray, k: int, reach: int) -> list[tuple[int, int, int, int]]:
    """``runs_of_groups`` of one group: ``start, end, other start, words covered``."""
    return list(zip(*(x.tolist() for x in runs_of_groups(np.zeros(len(pos), np.int64), pos, opos, k, reach)[1:]), strict=True))


def chains(runs: list[tuple[int, int, int, int]], gap_cost: float) -> list[list[int]]:
    """Chains of stretches in order in both texts, best first; each stretch is in one chain at most."""
    if len(runs) == 1:
        return [[0]]
    ends = [os + e - s for s, e, os, _ in runs]
    rank = {v: i for i, v in enumerate(sorted(set(ends) | {os for _, _, os, _ in runs}))}
    tree = _PrefixMax(len(rank))
    score, back = [0.0] * len(runs), [-1] * len(runs)
    waiting: list[tuple[int, int]] = []
    for i, (s, e, os, words) in enumerate(runs):
        while waiting and waiting[0][0] <= s:
            j = heapq.heappop(waiting)[1]
            tree.put(rank[ends[j]], score[j] + gap_cost * (runs[j][1] + ends[j]), j)
        value, j = tree.best(rank[os])
        gain = value - gap_cost * (s + os)
        score[i], back[i] = (words + gain, j) if j >= 0 and gain > 0 else (float(words), -1)
        heapq.heappush(waiting, (e, i))
    used = [False] * len(runs)
    out = []
    for i in sorted(range(len(runs)), key=lambda x: -score[x]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _stretches(matches: DataFrame, how: PassageSearch, least: int = 0) -> DataFrame:
    """``doc_id, owner, s, e, os, oe, ps, pe, po`` of chained matches; the last three are starts, ends and other starts of what the seeds cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            offs = lists.offsets.to_numpy()
            pos, opos = (lists.values.field(i).to_numpy()[offs[0] : offs[-1]].astype(np.int64) for i in (0, 1))
            group = np.repeat(np.arange(len(lists)), np.diff(offs))
            docs, owners = (batch.column(c).to_numpy() for c in ("doc_id", "owner"))
            g, *runs = runs_of_groups(group, pos, opos, how.k, how.reach)
            h, *pieces = runs_of_groups(group, pos, opos, how.k, how.k)
            where, piece_at = (np.searchsorted(x, np.arange(len(lists) + 1)) for x in (g, h))
            # most groups are one stretch, which is its own chain with all pieces
            one = np.flatnonzero(np.diff(where) == 1)
            s, e, os, _ = (x[where[one]] for x in runs)
            one, s, e, os = (x[e - s >= least] for x in (one, s, e, os))
            n = np.diff(piece_at)[one]
            of_one = tk.expand(piece_at[one], n)
            ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            cols = [docs[one], owners[one], *(x.astype(np.int32) for x in (s, e, os, os + e - s))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.ListArray.from_arrays(ends, pa.array(x[of_one].astype(np.int32))) for x in pieces[:3])], names=names)
            rows = []
            for i in np.flatnonzero(np.diff(where) > 1).tolist():
                own = list(zip(*(x[where[i] : where[i + 1]].tolist() for x in runs), strict=True))
                on: dict[int, list] = {}
                for s, e, os in zip(*(x[piece_at[i] : piece_at[i + 1]].tolist() for x in pieces[:3]), strict=True):
                    on.setdefault(s - os, []).append((s, e))
                for chain in chains(own, how.gap_cost):
                    (s, e1, os, _), (s2, e, os2, _) = own[chain[0]], own[chain[-1]]
                    if e - s < least:
                        continue
                    parts = [(x, y, x - ps + po) for ps, pe, po, _ in (own[r] for r in chain) for x, y in on[ps - po] if ps <= x < pe]
                    rows.append((int(docs[i]), int(owners[i]), s, e, os, os2 + e - s2, *map(list, zip(*parts, strict=True))))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    names = ["doc_id", "owner", "s", "e", "os", "oe", "ps", "pe", "po"]
    grouped = matches.groupBy("doc_id", "owner").agg(F.collect_list(F.struct("pos", "opos")).alias("at"))
    return grouped.mapInArrow(run, "doc_id long, owner long, s int, e int, os int, oe int, ps array<int>, pe array<int>, po array<int>")


def _span(start: str, end: str, how: PassageSearch):
    """A stretch with its flanks, widened to multiples of 16 words so that few different stretches are fetched."""
    lo = F.greatest(F.lit(0), F.floor((F.col(start) - how.flank) / 16) * 16).cast("int")
    return lo, (F.ceil((F.col(end) + how.flank) / 16) * 16).cast("int")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, lo, hi, words``: hashes of the wanted stretches of words, of 16 bits: of 65,536 words that differ one counts as equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for a, b, data, offs in tk.blocks(batch.column("text")):
                hashes, first = _hashes(data, offs)
                short = (hashes >> np.uint64(48)).astype("<u2")
                rows = []
                for i in range(a, b):
                    doc = batch.column("doc_id")[i].as_py()
                    f, g = int(first[i - a]), int(first[i - a + 1])
                    for span in spans[i].as_py():
                        rows.append((doc, span["lo"], span["hi"], short[f + span["lo"] : min(g, f + span["hi"])].tobytes()))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "lo", "hi", "words"])

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).hint("merge")  # as many rows as documents: never broadcast
    return texts(docs).join(asked, "doc_id").mapInArrow(run, "doc_id long, lo int, hi int, words binary").dropDuplicates(["doc_id", "lo", "hi"])


def _extend(a: np.ndarray, b: np.ndarray, cost: int = 2) -> int:
    """How far two sequences go on together from their beginning: one point a match, ``cost`` off a mismatch, as far as it pays."""
    n = min(len(a), len(b))
    if not n:
        return 0
    sums = np.cumsum(np.where(a[:n] == b[:n], 1, -cost))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(sums, 0)) - sums > 8 * cost)
    if len(stop):
        sums = sums[: stop[0] + 1]
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))  # the farthest of equal ones
    return best + 1 if sums[best] > 0 else 0


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one big integer per word of ``a``."""
    places: dict[int, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _on(a: np.ndarray, b: np.ndarray, cost: int) -> int:
    """``_extend`` in widening looks, so that it costs what it finds."""
    n, look = min(len(a), len(b)), 128
    while True:
        found = _extend(a[:look], b[:look], cost)
        if look >= n or found < look - 8 * cost - 1:
            return found
        look *= 4


def parts_alike(a: np.ndarray, b: np.ndarray, pieces: list[tuple[int, int, int]], how: PassageSearch, ends: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """``start, end, other start, other end, identity`` of a chain, or of its parts if it is not alike as a whole.

    ``ends``: how far the whole chain goes on before it and after it at one off a mismatch, if that is known.

    ``pieces`` are the stretches ``start, end, other start`` of the chain that seeds cover; they are equal word by word. The words between two
    of them are compared once (their longest common subsequence), so any part's equal words are a difference of sums. A chain
    under the identity is split at its widest gap, again and again down to single pieces.
    """
    n = len(pieces)
    equal, wide = [pieces[0][1] - pieces[0][0]], []
    for (s, e, os), (s2, e2, os2) in zip(pieces, pieces[1:]):
        oe = os + e - s
        between = 0
        if e < s2 and oe < os2:
            x, y = a[e:s2], b[oe:os2]
            between = len(x) if np.array_equal(x, y) else common(x.tolist(), y.tolist())
        equal += [between, e2 - s2]
        wide.append(max(s2 - e, os2 - oe))
    sums = np.concatenate([[0], np.cumsum(equal)])
    found = set()
    left = [(0, n)]
    while left:
        i, j = left.pop()
        s, e, os = pieces[i][0], pieces[j - 1][1], pieces[i][2]
        oe = pieces[j - 1][2] + e - pieces[j - 1][0]
        inner = int(sums[2 * j - 1] - sums[2 * i])
        for cost in (1, 2, 4):  # the widest that is alike; at 4, what an exact piece is extended by is
            known = ends is not None and cost == 1 and j - i == n
            back, on = ends if known else (_on(a[:s][::-1], b[:os][::-1], cost), _on(a[e:], b[oe:], cost))
            same = inner + int((a[s - back : s] == b[os - back : os]).sum()) + int((a[e : e + on] == b[oe : oe + on]).sum())
            identity = same / max(e - s + back + on, oe - os + back + on, 1)
            if identity >= how.identity:
                break
        if identity >= how.identity:
            if e + on - s + back >= how.min_stretch:
                found.add((s - back, e + on, os - back, oe + on, identity))
        elif j - i > 1:
            cut = i + 1 + int(np.argmax(wide[i : j - 1]))
            left += [(i, cut), (cut, j)]
    return sorted(found)


def _ends(words: np.ndarray, at: np.ndarray, own: np.ndarray, other: np.ndarray, step: int) -> np.ndarray:
    """``_extend`` of many rows at once, at one off a mismatch: from the places ``at`` of two flat arrays on, ``step`` 1 or -1, within ``own`` words.

    ``words`` and ``at`` have a row for each side.
    """
    room = np.minimum(own, other)
    width = int(room.max(initial=0))
    if not width:
        return np.zeros(len(room), np.int64)
    k = np.arange(width)
    ok = k[None] < room[:, None]
    i, j = (np.where(ok, x[:, None] + step * k[None], 0) for x in at)
    points = np.where(ok, np.where(words[0][i] == words[1][j], 1, -1), -64)
    sums = np.cumsum(points, axis=1)
    dropped = np.maximum.accumulate(np.maximum(sums, 0), axis=1) - sums > 8
    sums[np.logical_or.accumulate(dropped, axis=1)] = -1
    best = width - 1 - np.argmax(sums[:, ::-1], axis=1)
    return np.where(sums[np.arange(len(best)), best] > 0, best + 1, 0)


def _align(pairs: DataFrame, how: PassageSearch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                yield one(whole.slice(start, 2048))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda c: batch.column(c).to_numpy().astype(np.int64)
        flat, begin, length = [], [], []
        for c in ("words", "owords"):
            size = pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) // 2
            flat.append(np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2"))
            begin.append(np.cumsum(size) - size)
            length.append(size)
        doc, owner, lo, olo = (get(c) for c in ("doc_id", "owner", "lo", "olo"))
        s, e, os, oe = get("s") - lo, get("e") - lo, get("os") - olo, get("oe") - olo
        back = _ends(flat, [begin[0] + s - 1, begin[1] + os - 1], s, os, -1)
        on = _ends(flat, [begin[0] + e, begin[1] + oe], length[0] - e, length[1] - oe, 1)
        x, y, ox, oy = s - back, e + on, os - back, oe + on
        alike = np.flatnonzero(y - x == oy - ox)
        equal = flat[0][tk.expand(begin[0][alike] + x[alike], (y - x)[alike])] == flat[1][tk.expand(begin[1][alike] + ox[alike], (y - x)[alike])]
        differ = np.bincount(np.repeat(alike, (y - x)[alike])[~equal], minlength=batch.num_rows) > 0
        differ[y - x != oy - ox] = True
        exact = np.flatnonzero(~differ & (y - x >= how.min_stretch))
        cols = [[v[exact]] for v in (doc, x + lo, y + lo, owner, ox + olo, oy + olo, np.ones(len(doc)))]
        rows = []
        where, values = batch.column("ps").offsets.to_numpy(), [batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("ps", "pe", "po")]
        where = where - where[0]
        for i in np.flatnonzero(differ).tolist():
            a, b = (f[z[i] : z[i] + n[i]] for f, z, n in zip(flat, begin, length, strict=True))
            own, other = int(lo[i]), int(olo[i])
            pieces = list(zip(*((v[where[i] : where[i + 1]] - z).tolist() for v, z in zip(values, (own, own, other), strict=True)), strict=True))
            ends = int(back[i]), int(on[i])
            rows += [(int(doc[i]), p + own, q + own, int(owner[i]), r + other, t + other, identity) for p, q, r, t, identity in parts_alike(a, b, pieces, how, ends)]
        for c, more in zip(cols, zip(*rows, strict=True)):
            c.append(np.array(more))
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32, np.float64)
        names = ["doc_id", "s", "e", "owner", "os", "oe", "identity"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, kinds, strict=True)], names=names)

    return pairs.mapInArrow(run, "doc_id long, s int, e int, owner long, os int, oe int, identity double")


PASSAGES = "doc_id long, start_word long, end_word long, n_words long, source_doc_id long, source_start_word long, source_end_word long, identity double"


def _passages(aligned: DataFrame, how: PassageSearch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                joined: list[list] = []
                for p in sorted(parts, key=lambda p: (p["s"], p["e"], p["owner"], p["os"])):
                    if joined and p["s"] <= joined[-1][1] + how.join_gap:
                        joined[-1][1] = max(joined[-1][1], p["e"])
                        joined[-1][2].append(p)
                    else:
                        joined.append([p["s"], p["e"], [p]])
                for s, e, own in joined:
                    if e - s >= how.min_words:
                        longest = max(own, key=lambda p: (p["e"] - p["s"], -p["owner"], -p["s"]))
                        rows.append((doc, s, e, e - s, longest["owner"], longest["os"], longest["oe"], longest["identity"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    parts = aligned.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "owner", "os", "oe", "identity")).alias("parts"))
    return parts.mapInArrow(run, PASSAGES)


def _aligned(docs: DataFrame, matches: DataFrame, how: PassageSearch, least: int) -> DataFrame:
    """Aligned stretches of chained matches (``doc_id, owner, pos, opos``) of ``least`` words or more."""
    found = materialise(_stretches(matches, how, least), "stretches")
    lo, hi = _span("s", "e", how)
    olo, ohi = _span("os", "oe", how)
    found = found.withColumns({"lo": lo, "hi": hi, "olo": olo, "ohi": ohi})
    wanted = found.select("doc_id", "lo", "hi").unionByName(found.select(F.col("owner").alias("doc_id"), F.col("olo").alias("lo"), F.col("ohi").alias("hi"))).distinct()
    fetched = materialise(_fetch(docs, wanted), "stretch-words")
    other = fetched.select(F.col("doc_id").alias("owner"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("words").alias("owords"))
    pairs = found.join(other, ["owner", "olo", "ohi"]).join(fetched, ["doc_id", "lo", "hi"])
    return materialise(_align(pairs.select("doc_id", "owner", "s", "e", "os", "oe", "lo", "olo", "ps", "pe", "po", "words", "owords"), how), "aligned")


def _merged(spans: Column) -> Column:
    """Sorted spans ``s, e`` with those that touch as one."""

    def step(acc: Column, x: Column) -> Column:
        last, kept = F.get(acc, F.size(acc) - 1), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(last["e"] >= x["s"], F.concat(kept, F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.expr("CAST(array() AS array<struct<s:int,e:int>>)"), step)


def find_passages(docs: DataFrame, how: PassageSearch = PassageSearch()) -> DataFrame:
    """One row per passage that a document shares with an earlier one.

    The first round aligns what is linked with first holders and by long seeds. Its stretches explain most matches; the others, those
    with the nearest earlier holder and single ones of a pair included, are chained and aligned in the second round, where the document has another
    one, of any owner, within ``company`` words, or a stretch of the first round. A passage at identity 0.8 has a shared seed every eight words
    or so; one match alone is a phrase.
    """
    within = F.when(F.col("seed").bitwiseAND(1) == 1, F.sequence(F.lit(0), F.lit(how.long_k - how.k), F.lit(how.k))).otherwise(F.array(F.lit(0)))
    links = seed_matches(seeds(docs, how))
    spread = lambda rows: rows.select("doc_id", "owner", "pos", "opos", F.explode(within).alias("step")).selectExpr("doc_id", "owner", "pos + step AS pos", "opos + step AS opos")
    one = _aligned(docs, spread(links.where("NOT near OR seed & 1 = 1")), how, how.first_chain)
    known = one.groupBy("doc_id").agg(_merged(F.array_sort(F.collect_set(F.struct("s", "e")))).alias("known")).hint("merge")  # grows with the documents: never broadcast
    pos, most = F.col("pos"), how.company
    none = F.array().cast("array<struct<s:int,e:int>>")
    rest = spread(links).join(known, "doc_id", "left").withColumn("known", F.coalesce("known", none))
    rest = rest.where(~F.exists("known", lambda x: (x["s"] <= pos) & (pos + how.k <= x["e"])))
    rest = rest.withColumn("beside", F.exists("known", lambda x: (x["s"] - most <= pos) & (pos <= x["e"] + most))).drop("known")
    by_place = Window.partitionBy("doc_id").orderBy("pos")
    company = F.max("pos").over(by_place.rangeBetween(-most, -1)).isNotNull() | F.max("pos").over(by_place.rangeBetween(1, most)).isNotNull()
    rest = rest.withColumn("company", company).where("beside OR company").select("doc_id", "owner", "pos", "opos")
    return _passages(one.unionByName(_aligned(docs, rest, replace(how, flank=how.late_flank), 0)), how)


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the words of their repeated passages; a column ``n_chars`` follows the text."""
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_cut_spans"))
    spans = spans.select(F.col("doc_id").alias("_cut_doc_id"), "_cut_spans").hint("merge")  # grows with the documents: never broadcast
    names = [f"c{i}" for i in range(len(docs.columns))]  # positions stand for names, which may clash
    at = docs.columns.index("text")
    joined = docs.join(spans, docs["doc_id"] == spans["_cut_doc_id"], "left").drop("_cut_doc_id").toDF(*names, "_cut_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans and text[i]:
                    text[i] = _without(text[i], [(s["start_word"], s["end_word"]) for s in spans])
            cols = [pa.array(text, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    out = joined.mapInArrow(run, kinds)
    if "n_chars" in docs.columns:
        k = names[docs.columns.index("n_chars")]
        out = out.withColumn(k, F.length(names[at]).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = tk.words(data, np.array([0, len(raw)]))
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[min(e, len(ends)) - 1])
    out.append(raw[at:])
    return b"".join(out).decode().strip(" \n")
