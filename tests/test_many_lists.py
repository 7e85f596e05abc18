"""Many lists of words at once: alignments and overlaps against the ways that take them one by one."""

import random

import pyarrow as pa

from colloquy.operators import align, scan, word_alignment
from colloquy.operators.word_alignment import align_words


def _lists(seed: int, n: int) -> list[tuple[list[str], list[str]]]:
    r = random.Random(seed)
    word = lambda: r.choice(["", "...", "ß", "İx", "日本"]) if r.random() < 0.05 else "".join(r.choice("abcdeé") for _ in range(r.choice([1, 2, 3, 4, 6, 9])))
    odd = lambda w: w if r.random() < 0.6 else r.choice([w + "s", w[1:], "x" + w[:3], w[::-1], w.upper(), word()])
    said = [[word() for _ in range(r.choice([0, 1, 2, 7, 30, 60]))] for _ in range(n)]
    return [(a, [odd(w) for w in a if r.random() > 0.1] + [word() for _ in range(r.choice([0, 0, 3]))]) for a in said]


def test_alignments_side_by_side_are_those_one_by_one(monkeypatch):
    pairs = _lists(5, 60)
    one_by_one = [align_words(*p) for p in pairs]
    calls = []
    monkeypatch.setattr(word_alignment, "align_words", lambda *a: calls.append(a) or align_words(*a))
    assert [list(map(tuple, found.tolist())) for found in word_alignment.align_all(pairs)] == one_by_one
    assert all(not a or not b for a, b, _ in calls)  # only where there is nothing to align
    monkeypatch.setattr(word_alignment, "SMALL_CELLS", 100)  # long ones take the other way
    assert [list(map(tuple, found.tolist())) for found in word_alignment.align_all(pairs)] == one_by_one


def test_original_texts_are_timed_slice_by_slice(spark, monkeypatch):
    rows = [(k, " ".join(b), [(w, float(i), i + 0.5) for i, w in enumerate(a)], 0.0, 70.0) for k, (a, b) in enumerate(_lists(9, 12))]
    given = spark.createDataFrame(rows, "transcript_id int, original string, aligned array<struct<text:string,start_s:double,end_s:double>>, start_s double, end_s double").coalesce(1)
    timed = lambda: sorted(map(tuple, align.with_original_text(given).collect()))
    plain = [(k, i, w["text"], w["start_s"], w["end_s"]) for k, text, said, s, e in rows for i, w in enumerate(align.original_with_times(text.split(), [dict(zip(("text", "start_s", "end_s"), x)) for x in said], s, e))]
    assert timed() == sorted(plain)
    assert max(map(len, align.slices(pa.array(range(5000))))) <= 512


def test_lengths_of_overlap_that_letters_rule_out_are_not_compared(monkeypatch):
    calls = []
    monkeypatch.setattr(align, "_alike", lambda a, b: calls.append((a, b)) or alike(a, b))
    alike = align._alike.__wrapped__ if hasattr(align._alike, "__wrapped__") else align._alike
    left, right = ([f"{a}{b}{a}{b}" for a in letters for b in letters] for letters in ("abcdefgh", "mnopqrst"))
    assert align.overlap_length(left, right) == (0, "none") and len(calls) < 10  # once 600


def test_overlaps_by_letters_are_those_word_by_word():
    for a, b in _lists(7, 150):
        b = b[len(b) // 2 :] + b[: len(b) // 3]
        most = min(len(a), len(b))
        end, begin = [w.lower() for w in a[len(a) - most :]], [w.lower() for w in b[:most]]
        plain = next((n for n in range(most, 0, -1) if align._share_alike(end[most - n :], begin[:n], 0.6)), 0)
        n, rule = align.overlap_length(a, b)
        assert (n if rule in ("exact", "fuzzy") else 0) == plain


def test_nested_columns_become_plain_values_by_columns():
    values = [[{"a": 1, "w": [{"t": "x", "s": 1.5}, None, {"t": None, "s": None}]}, None], None, [], [{"a": None, "w": None}, {"a": 3, "w": []}]]
    given = pa.array(values, pa.list_(pa.struct([("a", pa.int64()), ("w", pa.list_(pa.struct([("t", pa.string()), ("s", pa.float64())])))])))
    assert all(scan.plain(given.slice(i, n)) == values[i : i + n] for i in range(4) for n in range(4 - i + 1))


def test_chunks_are_built_once(spark, monkeypatch):
    written = []
    for module in (align, scan):
        monkeypatch.setattr(module, "materialise", lambda df, name, real=module.materialise: written.append((name, df)) or real(df, name))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(1, k, [f"w{k * 5 + i}" for i in range(10)]) for k in range(20)]
    given = spark.createDataFrame(rows, "transcript_id int, chunk int, words array<string>")
    out = align.stitch_chunks(given.mapInArrow(seen, given.schema)).first()
    assert out["words"] == [f"w{i}" for i in range(105)] and out["skipped"] == 95
    assert read.value == 20  # once each pass; it was read twice for the longest chunk and for the blocks


def test_functions_whose_lists_are_exploded_run_once(spark):
    kind = "array<struct<text:string,start_s:double,end_s:double>>"
    timed = spark.sql(f"SELECT id AS transcript_id, 'a b c' AS original, CAST(array() AS {kind}) AS aligned, 0D AS start_s, 1D AS end_s FROM range(3)")
    spans = spark.sql("SELECT id AS transcript_id, 'a b' AS text, CAST(array() AS array<struct<char:string,start_ms:double,end_ms:double>>) AS spans FROM range(3)")
    diffs = align.word_diff(spark.sql("SELECT split('a b', ' ') AS original, split('a c', ' ') AS processed FROM range(3)")).selectExpr("explode(diff) AS d")
    for rows in (align.with_original_text(timed), align.word_spans(spans), diffs):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1  # once two
    assert [align.with_original_text(timed).count(), align.word_spans(spans).count(), diffs.count()] == [9, 6, 3]
