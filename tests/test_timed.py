"""Frames, aligned words and scans of aligner files against plain Python."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from colloquy.operators import frames
from colloquy.operators.word_alignment import align_words, similarity_table
from colloquy.sources import checkpoint, textgrid

# frames


def _plain_spans(labels, tokens, fill):
    """Frame by frame: a token opens at its label and closes where the label ends."""
    out, opened = [], None
    for at, label in enumerate([*labels, -1]):
        if opened is not None and label != tokens[len(out)]:
            out.append((len(out), opened * 20.0, at * 20.0))
            opened = None
        if opened is None and label not in (0, -1) and len(out) < len(tokens) and label == tokens[len(out)]:
            opened = at
    missing, last, total = len(tokens) - len(out), out[-1][2] if out else 0.0, len(labels) * 20.0
    if fill and missing and total > last:
        step, n = (total - last) / missing, len(out)
        out += [(n + i, last + i * step, last + (i + 1) * step) for i in range(missing)]
    return out


def _plain_peaks(scores, tokens):
    out, n = [], len(scores)
    for i, token in enumerate(tokens):
        share = n / len(tokens)
        first, last = max(0, int(i * share) - int(share)), min(n, int(i * share) + int(share * 2))
        if first < last:
            peak = max(range(first, last), key=lambda f: (scores[f][token], -f))
            out.append((i, peak * 20.0, (peak + 1) * 20.0))
    return out


def _cases(rng):
    """Clean labels, noisy ones, missing tokens, no tokens at all, a single label, and one long transcript."""
    for t in range(40):
        tokens = [rng.randint(1, 4) for _ in range(rng.randint(0, 12) if t else 3000)]
        labels = []
        for token in tokens:
            if t % 4 and rng.random() < 0.1:
                continue
            labels += [rng.randint(1, 9)] * (t % 4 == 2 and rng.random() < 0.2) + [token] * rng.randint(1, 4) + [0] * rng.randint(t % 3 == 0, 2)
        yield t, labels or [0], tokens


@pytest.mark.parametrize("fill", [False, True])
def test_spans_of_frames(spark, fill):
    cases = list(_cases(random.Random(8)))
    given = spark.createDataFrame([(t, f, x) for t, labels, _ in cases for f, x in enumerate(labels)], "transcript_id int, frame long, label int").repartition(5)
    tokens = spark.createDataFrame([(t, i, x) for t, _, tokens in cases for i, x in enumerate(tokens)], "transcript_id int, token_idx long, token int").repartition(3)
    found = frames.frame_spans(given, tokens, fill=fill).collect()
    key = {(t, i): x for t, _, tokens in cases for i, x in enumerate(tokens)}
    assert all(r["token"] == key[r["transcript_id"], r["token_idx"]] for r in found)
    expected = {(t, i): (a, b) for t, labels, tokens in cases for i, a, b in _plain_spans(labels, tokens, fill)}
    assert {(r["transcript_id"], r["token_idx"]) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        assert (r["start_ms"], r["end_ms"]) == pytest.approx(expected[r["transcript_id"], r["token_idx"]])


def test_peaks_of_frames(spark):
    rng = random.Random(5)
    cases = [(t, [[rng.randint(0, 5) for _ in range(5)] for _ in range(rng.randint(1, 60))], [rng.randint(0, 4) for _ in range(rng.randint(0, 80))]) for t in range(30)]
    given = spark.createDataFrame([(t, f, [float(v) for v in s]) for t, scores, _ in cases for f, s in enumerate(scores)], "transcript_id int, frame long, scores array<float>")
    tokens = spark.createDataFrame([(t, i, x) for t, _, tokens in cases for i, x in enumerate(tokens)], "transcript_id int, token_idx long, token int")
    found = sorted((r["transcript_id"], r["token_idx"], r["start_ms"], r["end_ms"]) for r in frames.peak_spans(given, tokens).collect())
    assert found == sorted((t, *p) for t, scores, tokens in cases for p in _plain_peaks(scores, tokens))


def test_no_frames(spark):
    none = spark.createDataFrame([], "transcript_id int, frame long, label int")
    tokens = spark.createDataFrame([(1, 0, 5)], "transcript_id int, token_idx long, token int")
    assert frames.frame_spans(none, tokens, fill=True).count() == 0
    assert frames.peak_spans(none.withColumn("scores", F.array(F.lit(1.0))).drop("label"), tokens).count() == 0


# aligned words


def _likeness(a, b):
    """Similarity of two words with a distance over all pairs of letters."""
    if not a or not b:
        return 0.0
    x, y = ("".join(c.lower() for c in w if c.isalnum()) for w in (a, b))
    if x == y:
        return 1.0
    short, long = sorted((len(x), len(y)))
    if x.startswith(y) or y.startswith(x):
        return 0.7 + 0.2 * short / long
    if long - short > long // 2:
        return 0.0
    far = [[i + j if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i, c in enumerate(x, 1):
        for j, d in enumerate(y, 1):
            far[i][j] = min(far[i - 1][j] + 1, far[i][j - 1] + 1, far[i - 1][j - 1] + (c != d))
    ratio = 1.0 - far[-1][-1] / long
    return ratio if ratio >= 0.6 else 0.0


def _plain_alignment(a, b, gap=-0.5):
    n, m = len(a), len(b)
    score, move = [[0.0] * (m + 1) for _ in range(n + 1)], [[2] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                ways = [score[i - 1][j - 1] + _likeness(a[i - 1], b[j - 1]), score[i - 1][j] + gap, score[i][j - 1] + gap]
                move[i][j] = ways.index(max(ways))
                score[i][j] = max(ways)
            elif i or j:
                score[i][j], move[i][j] = (score[i - 1][j] if i else score[i][j - 1]) + gap, 1 if i else 2
    out, i, j = [], n, m
    while i or j:
        k = move[i][j]
        i, j = i - (k != 2), j - (k != 1)
        out.append((i if k != 2 else -1, j if k != 1 else -1))
    return out[::-1], score[n][m]


def test_alignment_equals_the_plain_recursion():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=rng.randint(0, 6))) for _ in range(40)] + ["--", "don't", "Don't", "…"]
    for _ in range(250):
        a, b = rng.choices(words, k=rng.randint(0, 14)), rng.choices(words, k=rng.randint(0, 14))
        expected, score = _plain_alignment(a, b)
        for cells in (1 << 26, 0):  # all moves kept, and moves computed again between kept diagonals
            found = align_words(a, b, cells=cells)
            assert found == expected
        assert sum(_likeness(a[i], b[j]) if i >= 0 and j >= 0 else -0.5 for i, j in found) == pytest.approx(score)


def test_similarities_of_all_pairs():
    rng = random.Random(6)
    a, b = (["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(60)] for _ in range(2))
    of_a, of_b, table = similarity_table(a, b)
    assert all(table[of_a[i], of_b[j]] == _likeness(x, y) for i, x in enumerate(a) for j, y in enumerate(b))


def test_long_sequences_are_aligned_in_seconds():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2500)]
    a = rng.choices(words, k=5000)
    b = [w for w in a if rng.random() > 0.05]
    began = time.perf_counter()
    pairs = align_words(a, b)
    assert time.perf_counter() - began < 60  # some four seconds where nothing else runs
    assert [i for i, _ in pairs if i >= 0] == list(range(5000)) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
    assert sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in pairs) > 0.99 * len(b)


# files


def _grid(intervals, name="words", tail=""):
    lines = ['File type = "ooTextFile"', "item []:", f'        name = "{name}"']
    for k, part in enumerate(intervals, 1):
        lines += [f"        intervals [{k}]:", *part]
    return "\n".join(lines) + "\n" + tail


def _whole(a, b, text):
    return (f"xmin = {a}", f"xmax = {b}", f'text = "{text}"')


def test_scan_says_what_it_passes_over(spark, tmp_path):
    good, bad = _whole(0, 0.525, "a=b"), [("xmin 0", "xmax = 1", 'text = "x"'), ("xmin = 0", "xmax", 'text = "x"'), ("xmin = 0", "xmax = 1", "text"), ("xmin = zero", "xmax = 1", 'text = "x"')]
    phones = '    item [2]:\n        name = "phones"\n        intervals [1]:\n xmin = 0\n xmax = 1\n text = "P"\n'
    files = {"a": _grid([good, *bad, _whole(1, 2, "sil"), _whole(2, 3, "end")], tail=phones), "b": _grid([good], tail="        intervals [2]:\n  xmin = 1"), "c": _grid([good], "other"), "d": "", "e": _grid([good]).replace("\n", "\r\n")}
    given = spark.createDataFrame(list(files.items()), "path string, value string")
    seen = Observation("scan")
    words, rest = textgrid.stage_scan(textgrid.scan_textgrids(given, 10.0, seen=seen), str(tmp_path / "scan"))
    assert seen.get == {"kept": 5, "cut_off": 1, "xmin": 1, "xmax": 1, "text": 1, "number": 1}
    assert sorted((r["path"], r["text"], r["start_s"]) for r in words.collect()) == [("a", "a=b", 10.0), ("a", "end", 12.0), ("a", "sil", 11.0), ("b", "a=b", 10.0), ("e", "a=b", 10.0)]
    assert Counter((r["path"], r["problem"]) for r in rest.collect()) == Counter([("a", p) for p in ("xmin", "xmax", "text", "number")] + [("b", "cut_off")])
    assert all("intervals [" in r["lines"] for r in rest.collect())
    report = {r["path"]: r.asDict() for r in textgrid.scan_report(textgrid.scan_textgrids(given)).collect()}
    assert report["a"] == {"path": "a", "kept": 3, "cut_off": 0, "xmin": 1, "xmax": 1, "text": 1, "number": 1} and set(report) == {"a", "b", "e"}


def test_aligner_and_fallback_words(spark):
    files = spark.createDataFrame([("a", _grid([_whole(0.004, 0.525, "hi"), _whole(0.6, 0.7, "sp"), _whole(1, 2, "hi"), _whole(2, 3, "a=b")])), ("b", _grid([_whole(0, 1, "one"), _whole(1, 2, "x")])), ("c", "none")], "path string, value string")
    said = {"a": "Hi, there hi! Hi", "b": "One two", "c": "Left alone"}
    original = spark.createDataFrame([(p, i, w) for p, t in said.items() for i, w in enumerate(t.split())], "path string, word_idx long, text string")
    rows = lambda df, p: [(r["text"], r["start_s"], r["end_s"]) for r in df.where(F.col("path") == p).orderBy("word_idx").collect()]
    aligned = textgrid.aligner_words(files, original)
    assert rows(aligned, "a") == [("Hi,", 0.0, 0.53), ("hi!", 1.0, 2.0), ("a", 2.0, 3.0)] and rows(aligned, "c") == []
    fallback = textgrid.fallback_words(files, original, 5.0)
    assert rows(fallback, "a") == [("Hi,", 5.004, 5.525), ("hi!", 6.0, 7.0), ("a=b", 7.0, 8.0)]
    assert rows(fallback, "b") == [("One", 5.0, 6.0), ("two", 6.0, 7.0)]  # counts agree: by place
    assert rows(fallback, "c") == [("Left", 5.0, 5.5), ("alone", 5.5, 6.0)]


def test_scans_of_word_lists_and_checkpoints(spark):
    lines = spark.createDataFrame([("a", x) for x in ["[1250] --> [1580] hello ", " \t", "[x] --> [2] no", "[1]-->[2]  two words", "x [1] --> [2] no"]], "path string, value string")
    assert [(r["text"], r["start_s"], r["problem"]) for r in textgrid.scan_wts(lines).collect()] == [("hello", 1.25, None), (None, None, "blank"), (None, None, "pattern"), ("two words", 0.001, None), (None, None, "pattern")]
    word = '{"text": "a", "start": 0.5, "end": 1.0}'
    docs = [("whole", f'{{"transcript_id": 1, "words": [{word}]}}'), ("odd", f'{{"words": [{word}, {{"start": 1.0}}, {{"text": "b"}}, {{"text": "b", "start": 2}}]}}'), ("empty", '{"words": []}'), ("none", "{}"), ("broken", "{oops")]
    found = checkpoint.scan_checkpoints(spark.createDataFrame(docs, "path string, value string"))
    assert sorted((r["path"], r["problem"] or "") for r in found.collect()) == [("broken", "json"), ("empty", "words"), ("none", "words"), ("odd", ""), ("odd", "end"), ("odd", "start"), ("odd", "text"), ("whole", "")]
