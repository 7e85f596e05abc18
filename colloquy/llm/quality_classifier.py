"""Quality classifier from weak labels: heuristic labellers, EM over their votes, and a hashed linear scorer.

1. Labellers. Overlapping heuristics each vote ``keep``, ``reject`` or nothing on a whole text: symbols, capitals,
   exclamation marks, repeated word windows, function words, word length, distinct words, and word stems that labelled
   abusive documents have far oftener than others: a text is rejected by how many of its words begin with one, by the ratio of
   the likelihoods of that count at the rates of abusive and of other texts.
2. EM. The votes of all documents are counted by pattern (at most 3 to the number of labellers, whatever the
   corpus). A mixture of a good class and one bad class per labeller, each labeller voting by itself given the class, is
   fitted by expectation-maximisation: its parameters are the labellers' accuracies, its posterior the weak label of a
   pattern. The labelled rows take part as one more labeller, which votes on them alone.
3. Scorer. The posteriors of a sample of documents (``sample_rows`` at most in expectation) train a logistic scorer on hashed
   features: the distinct 4- and 5-letter stems of a text and the votes. The scorer judges every whole text.

The labelled rows that give stems are at most about ``label_rows``. All passes over the corpus are maps; what is shuffled is
counts per batch, what is broadcast is one weight vector of ``2 ** bits`` numbers and the hashes of the stems, which the labelled
rows bound (each stands in ``stem_share`` of the abusive ones).

Edge cases: a null or empty text is rejected (score 1); without labels, or with labels of no document, the stem
labeller abstains; null labels are no label; repeated rows are scored each; without documents nothing is fitted and there
are no rows. ``score_documents`` reads ``doc_id`` and ``text`` only; ``keep_good`` passes all columns through unchanged,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.quality_rules import _covered, _per_text, _repeats, _windows
from colloquy.llm.shared import texts

# Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in is it that this a be for with as on was by from are or an at not have he she they we you "
    "le la les de des du un une et en est que qui dans pour par sur pas au aux ne se ce avec "
    "el los las y una se del al por para con como su lo no más o "
    "der die das und ist den von zu mit auf für ein eine nicht im dem des sich auch es er sie"
).split()
BLOCK = 1 << 18  # bytes of text that are measured at once: measures take some 60 times as much
ABUSIVE = 7  # the place of the labeller of abuse
TELLING_STEMS, FEATURE_STEMS = (4, 5, 6), (4, 5)  # letters
LABELLERS = ("symbols", "capitals", "exclamation", "repetition", "function_words", "word_length", "distinct_words", "stems")


@dataclass(frozen=True)
class QualityModel:
    bits: int = 18
    sample_rows: int = 8192
    label_rows: int = 40_000
    stem_share: float = 0.004  # share of the abusive texts that a telling stem stands in, 4 of them at least
    stem_ratio: float = 15.0  # how much commoner it is among the words of abusive texts
    stem_evidence: float = 3.5  # logarithm of the ratio of likelihoods that makes a text abusive
    threshold: float = 0.5
    em_rounds: int = 60
    train_rounds: int = 160
    l2: float = 1e-5


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _LETTER, _BANG, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BANG[33] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _hash_list(items: list[str]) -> np.ndarray:
    raw = [w.encode() for w in items]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(tk.hash_runs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends))


def _within(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values


_FUNCTION = _hash_list(sorted(set(FUNCTION_WORDS)))


@dataclass(frozen=True)
class Stems:
    """Telling stems (sorted hashes) and how many of 1 words begin with one, in abusive and in other texts."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    abusive: float = 0.5
    other: float = 0.5

    def evidence(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Logarithm of the ratio of likelihoods (Poisson) of ``hits`` among ``words``."""
        return hits * np.log(self.abusive / self.other) - words * (self.abusive - self.other)


@dataclass
class _Block:
    """Measures of a block of texts: ``n`` words, stems with their texts, words with a telling stem, all words of letters, votes."""

    n: np.ndarray
    stems: np.ndarray
    stem_text: np.ndarray
    hits: np.ndarray
    plain_words: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELLERS)), np.int8))


def _measure(data: np.ndarray, offs: np.ndarray, known: Stems, how: QualityModel, lengths: tuple[int, ...] = FEATURE_STEMS) -> _Block:
    """``lengths``: of the stems that are listed; telling ones are counted at ``TELLING_STEMS``."""
    rows = len(offs) - 1
    starts, ends, first = tk.words(data, offs)
    n = np.diff(first)
    hashes = tk.hash_runs(data, starts, ends)
    grams, owner, at = _windows(hashes, first, 3)
    _, shared = _repeats(grams, owner)
    repeated = np.bincount(np.repeat(np.arange(rows), n)[_covered(len(hashes), at[shared], 3)], minlength=rows)
    letters, upper = _per_text(_LETTER[data], offs), _per_text(_UPPER[data], offs)
    bangs, symbols = _per_text(_BANG[data], offs), _per_text(_SYMBOL[data], offs)

    low = tk.LOWER[data]
    ws, we, wfirst = tk.runs(_WORD[data], offs)
    wn = np.diff(wfirst)
    of_word = np.repeat(np.arange(rows), wn)
    plain = tk.hash_runs(low, ws, we)
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    char_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=char_before[1:])
    c0, c1 = char_before[ws], char_before[we]
    count = lambda flags: np.bincount(of_word[flags], minlength=rows)
    function = count(_within(plain, _FUNCTION))
    length = np.bincount(of_word, weights=c1 - c0, minlength=rows)
    stems, stem_text = [], []
    telling = np.zeros(len(ws), bool)
    for k in TELLING_STEMS:
        long = np.flatnonzero(c1 - c0 >= k)
        own = tk.hash_runs(low, ws[long], lead[c0[long] + k])
        telling[long] |= _within(own, known.hashes)
        if k in lengths:
            stems.append(own)
            stem_text.append(of_word[long])
    stems, stem_text = np.concatenate(stems), np.concatenate(stem_text)
    again, _ = _repeats(plain, of_word)
    distinct = np.bincount(of_word[~again], minlength=rows)
    hits = count(telling)

    w, pw, let = np.maximum(n, 1), np.maximum(wn, 1), np.maximum(letters, 1)
    vote = lambda keep, reject: np.where(reject, -1, np.where(keep, 1, 0)).astype(np.int8)
    many = n >= 20
    votes = np.stack(
        [
            vote(symbols < 0.05 * w, symbols > 0.30 * w),
            vote(upper < 0.12 * let, (upper > 0.35 * let) & many),
            vote(bangs < 0.05 * w, bangs > 0.25 * w),
            vote(repeated < 0.15 * w, (repeated > 0.40 * w) & many),
            vote(function > 0.10 * pw, (function < 0.02 * pw) & many),
            vote((length > 3.8 * pw) & (length < 6.3 * pw), ((length < 3.0 * pw) | (length > 7.5 * pw)) & many),
            vote(distinct > 0.35 * pw, (distinct < 0.15 * pw) & (wn >= 60)),
            vote(np.zeros(rows, bool), (hits > 0) & (known.evidence(hits, wn) >= how.stem_evidence)),
        ],
        axis=1,
    )
    return _Block(n, stems, stem_text, hits, wn, votes)


def _patterns(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def _features(block: _Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features and where each text's begin."""
    rows, k = len(block.n), len(LABELLERS)
    stems = np.maximum(block.stems >> np.uint64(64 - bits), np.uint64(3 * k))  # below stand the votes
    idx = np.concatenate([stems, ((np.arange(k, dtype=np.uint64) * np.uint64(3))[None] + (block.votes + 1).astype(np.uint64)).reshape(-1)])
    text = np.concatenate([block.stem_text, np.repeat(np.arange(rows), k)]).astype(np.uint64)
    both = np.unique(text << np.uint64(bits) | idx)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(bits), np.arange(rows + 1))


def _labelled(docs: DataFrame, labels: DataFrame, how: QualityModel) -> DataFrame | None:
    """``text, label`` (1 good, 2 junk, 3 abusive) of about ``label_rows`` labelled documents at most; None without labels."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = known.where("toxic IS NOT NULL OR quality IS NOT NULL")
    n = known.count()
    if not n:
        return None
    share = int(min(1.0, how.label_rows / n) * (1 << 20))
    label = F.when(F.col("toxic") > 0, 3).when(F.col("quality") == 0, 2).otherwise(1)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("doc_id", label.alias("label"))
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "label")  # bounded by label_rows


def _stems_from_labels(labelled: DataFrame, how: QualityModel) -> Stems:
    """Stems that begin words of abusive texts far oftener than others, and the rates of words with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text"), BLOCK):
                toxic = batch.column("label").slice(a, b - a).to_numpy() == 3
                m = _measure(data, offs, Stems(), how, TELLING_STEMS)
                stem, code = np.unique(m.stems, return_inverse=True)
                seen = np.unique(code * np.int64(len(toxic)) + m.stem_text)
                texts_with = np.bincount((seen // len(toxic))[toxic[seen % len(toxic)]], minlength=len(stem))
                bad = np.bincount(code[toxic[m.stem_text]], minlength=len(stem))
                good = np.bincount(code, minlength=len(stem)) - bad
                # the row of stem 0 counts the texts and words themselves
                words = m.plain_words
                cols = [np.append(stem.view(np.int64), 0), np.append(texts_with, toxic.sum()), np.append(bad, words[toxic].sum()), np.append(good, words[~toxic].sum())]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=["stem", "texts", "bad", "good"])

    sums = [F.sum(c).alias(c) for c in ("texts", "bad", "good")]
    counts = labelled.mapInArrow(run, "stem long, texts long, bad long, good long").groupBy("stem").agg(*sums)
    total = counts.where("stem = 0").first()
    if total is None or not total["bad"] or not total["good"]:
        return Stems()
    least = max(4, how.stem_share * total["texts"])
    telling = counts.where((F.col("stem") != 0) & (F.col("texts") >= least) & (F.col("bad") * total["good"] >= (F.col("good") + 0.5) * total["bad"] * how.stem_ratio))
    found = np.sort(np.array([r[0] for r in telling.select("stem").collect()], np.int64).view(np.uint64))
    if not len(found):
        return Stems()

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text"), BLOCK):
                toxic = batch.column("label").slice(a, b - a).to_numpy() == 3
                m = _measure(data, offs, Stems(found), how)
                yield pa.RecordBatch.from_arrays([pa.array([int(x[toxic].sum()), int(x[~toxic].sum())]) for x in (m.hits, m.plain_words)] + [pa.array([1, 0])], names=["hits", "words", "toxic"])

    hits = {r["toxic"]: (r["hits"] + 0.5) / max(r["words"], 1) for r in labelled.mapInArrow(rates, "hits long, words long, toxic long").groupBy("toxic").agg(F.sum("hits").alias("hits"), F.sum("words").alias("words")).collect()}
    return Stems(found, hits[1], hits[0]) if hits[1] > hits[0] else Stems()


def _pattern_counts(rows: DataFrame, stems: Stems, how: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vote patterns of ``text, label``, their labels and how many texts have them; counted per partition first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for a, b, data, offs in tk.blocks(batch.column("text"), BLOCK):
                seen.update(zip(_patterns(_measure(data, offs, stems, how).votes).tolist(), batch.column("label").slice(a, b - a).to_pylist(), strict=True))
        cols = [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["pattern", "label", "n"])

    found = rows.mapInArrow(count, "pattern long, label long, n long").groupBy("pattern", "label").agg(F.sum("n").alias("n")).orderBy("pattern", "label").collect()
    return tuple(np.array([r[i] for r in found], np.int64) for i in range(3))


def fit_accuracies(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns.

    Classes are "good" and, for each labeller, the kind of bad text that it looks for; labels (0: none) are one more vote,
    of known accuracy. Returns each labeller's vote distribution by class and P(not good) of each pattern.
    """
    kinds = votes.shape[1]
    rejects = votes == -1
    first = np.where(rejects.any(axis=1), 1 + rejects.argmax(axis=1), 0)
    first = np.where(rejects[:, ABUSIVE], 1 + ABUSIVE, first)
    belief = np.full((len(votes), kinds + 1), 0.1 / kinds)
    belief[np.arange(len(votes)), first] = 0.9
    says = np.full((4, kinds + 1), 0.01)  # P(label | class)
    says[0] = 1.0
    says[1, 0] = says[2, 1:] = 0.98
    says[2, 1 + ABUSIVE] = 0.01
    says[3, 1 + ABUSIVE] = 0.98
    rates = np.zeros((kinds + 1, kinds, 3))
    for _ in range(rounds):
        mass = belief * weight[:, None]
        prior = (mass.sum(axis=0) + 1) / (weight.sum() + kinds + 1)
        for v in (-1, 0, 1):
            rates[:, :, v + 1] = mass.T @ (votes == v) + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(prior)[None] + np.log(says[label]) + sum(np.log(rates[:, j, votes[:, j] + 1]).T for j in range(kinds))
        belief = np.exp(log - log.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    return rates, 1 - belief[:, 0]


def _values(flat: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A vote counts 1; the stems of a text share a length of 1, so that long texts do not drown their votes."""
    length = np.diff(where)
    return np.where(flat < 3 * len(LABELLERS), 1.0, np.repeat(1 / np.sqrt(np.maximum(length, 1)), length))


def train_scorer(flat: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray, size: int, rounds: int, l2: float) -> np.ndarray:
    """Logistic regression by full-batch adaptive gradient; the last weight is the bias."""
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    n = len(target)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[flat] * value, minlength=n) + w[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(flat, weights=g[row] * value, minlength=size), g.sum()) / n + l2 * w
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w.astype(np.float32)


@dataclass(frozen=True)
class FittedQuality:
    how: QualityModel
    stems: Stems
    weights: np.ndarray
    accuracies: dict[str, list[list[float]]]


def fit_quality(docs: DataFrame, labels: DataFrame | None = None, how: QualityModel = QualityModel()) -> FittedQuality:
    """Fits labellers' accuracies on the votes of all documents and the scorer on a bounded sample."""
    given = texts(docs)
    labelled = _labelled(docs, labels, how) if labels is not None else None
    stems = _stems_from_labels(labelled, how) if labelled is not None else Stems()
    pattern, label, weight = _pattern_counts(given.withColumn("label", F.lit(0)), stems, how)
    size = 1 << how.bits
    if not len(pattern):
        return FittedQuality(how, stems, np.zeros(size + 1, np.float32), {})
    total = weight.sum()
    all_patterns, all_labels, all_weights = pattern, label, weight
    if labelled is not None:
        more = _pattern_counts(labelled, stems, how)
        all_patterns, all_labels, all_weights = (np.concatenate([a, b]) for a, b in zip((pattern, label, weight), more, strict=True))
    rates, bad = fit_accuracies(_votes_of(all_patterns), all_labels, all_weights.astype(float), how.em_rounds)
    bad = bad[: len(pattern)]
    share = int(min(1.0, how.sample_rows / total) * (1 << 20))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column("text"), BLOCK):
                m = _measure(data, offs, stems, how)
                flat, where = _features(m, how.bits)
                key = [hashlib.blake2b(data[s:e], digest_size=8).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                cols = [pa.array(_patterns(m.votes)), pa.array(key), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names=["pattern", "key", "features"])

    drawn = given.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20)) < max(share, 1)).mapInArrow(sample, "pattern long, key binary, features array<int>").toArrow()
    if not drawn.num_rows:
        return FittedQuality(how, stems, np.zeros(size + 1, np.float32), {})
    drawn = drawn.sort_by([("pattern", "ascending"), ("key", "ascending")]).combine_chunks()  # one order, however the rows came: equal keys are equal texts
    lists = drawn.column("features").chunk(0) if drawn.column("features").num_chunks else drawn.column("features")
    where = lists.offsets.to_numpy()
    length, flat = np.diff(where), lists.values.to_numpy().astype(np.int64)[where[0] : where[-1]]
    target = bad[np.searchsorted(pattern, drawn.column("pattern").to_numpy())]
    weights = train_scorer(flat, _values(flat, where), np.repeat(np.arange(len(length)), length), target, size, how.train_rounds, how.l2)
    return FittedQuality(how, stems, weights, {name: rates[:, j].round(4).tolist() for j, name in enumerate(LABELLERS)})


def _scores(model: FittedQuality, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offs in tk.blocks(column, BLOCK):
        m = _measure(data, offs, model.stems, model.how)
        flat, where = _features(m, model.how.bits)
        of_text = np.repeat(np.arange(len(m.n)), np.diff(where))  # sums by text: scores are the same whatever the blocks
        z = np.bincount(of_text, weights=model.weights[flat] * _values(flat, where), minlength=len(m.n)) + model.weights[-1]
        score = np.where(m.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1.0)
        yield a, b, score, m.votes


def score_documents(docs: DataFrame, model: FittedQuality) -> DataFrame:
    """``doc_id, score, votes, kept``; the score is the scorer's probability that a document is no good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, score, votes in _scores(sent.value, batch.column("text")):
                text = np.array(["r", "-", "k"])[votes.astype(np.int64) + 1]
                cols = [batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array(["".join(v) for v in text]), pa.array(score < sent.value.how.threshold)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "votes", "kept"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, votes string, kept boolean")


def keep_good(docs: DataFrame, model: FittedQuality) -> DataFrame:
    """The rows of ``docs`` whose text the scorer keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, score, _ in _scores(sent.value, batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(score < sent.value.how.threshold))

    return docs.mapInArrow(run, docs.schema)
