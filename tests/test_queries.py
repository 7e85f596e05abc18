"""Every registered query with SQL beside it, side by side with DuckDB; the others against plain Python."""

import difflib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else str(list(map(str, x)) if isinstance(x, (list, tuple)) else x)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, SMALL)
    cursor = tables.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(cursor.fetchall(), names) == plain(got.collect(), got.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_clamped_words_are_in_order(spark):
    by = defaultdict(list)
    for r in entry.queries()["vad_stitch_clamp"](spark, SMALL).collect():
        by[r["transcript_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["word_idx"])
        assert all(a["end_s"] <= b["start_s"] <= b["end_s"] for a, b in zip(rows, rows[1:], strict=False))


def test_repaired_words_have_a_least_length(spark):
    rows = entry.queries()["monotonic_repair"](spark, SMALL).collect()
    assert rows and all(r["start_s"] <= r["end_s"] for r in rows)


def test_word_diff_restores_the_processed_words(spark):
    from colloquy.operators.align import word_diff

    rows = [(1, "my name is Maria and I work".split(), "my name is [REDACTED] and work".split()), (2, [], ["a"]), (3, ["a"], []), (4, ["A"], ["a"])]
    for r in word_diff(spark.createDataFrame(rows, "id int, original array<string>, processed array<string>")).collect():
        out, at = [], 0
        for d in r["diff"]:
            out += r["original"][at : d["a_from"]] + r["processed"][d["b_from"] : d["b_to"]]
            at = d["a_to"]
        assert [w.lower() for w in out + r["original"][at:]] == [w.lower() for w in r["processed"]]
        if r["id"] == 1:
            assert [d["kind"] for d in r["diff"]] == ["redact", "delete"]


def test_alignment_has_the_best_score():
    from functools import lru_cache

    from colloquy.operators.word_alignment import align_words, similarity_table

    word_similarity = lambda x, y: similarity_table([x], [y])[2][0, 0]
    a, b = "the quick brown fox jumps over".split(), "quick browne fox over the".split()

    @lru_cache(None)
    def best(i, j):
        if not i or not j:
            return -0.5 * (i + j)
        return max(best(i - 1, j - 1) + word_similarity(a[i - 1], b[j - 1]), best(i - 1, j) - 0.5, best(i, j - 1) - 0.5)

    score = sum(word_similarity(a[i], b[j]) if i >= 0 and j >= 0 else -0.5 for i, j in align_words(a, b))
    assert score == pytest.approx(best(len(a), len(b)))


@pytest.mark.parametrize(
    "left, right, n, rule",
    [
        ("a b c d", "c d e", 2, "exact"), ("well generational", "rational talk", 1, "fuzzy"), ("say gener thing", "generational thing so", 2, "partial"), ("we go hyper", "hypertension rises", 1, "partial"),
        ("apple bread crate dune echo fox", "quite other terms dune echo fox ill", 6, "sequence"), ("p1 p2 k1 k2 x9 k3 k4", "z0 k1 k2 k3 k4 m7 m8 m9", 5, "sequence"),
        ("alpha beta gammas", "betta gammas delta", 2, "fuzzy"), ("they walk", "walkedthrough home", 1, "partial"), ("see b", "x y", 1, "partial"), ("red blue", "green pink", 0, "none"), ("", "x", 0, "none"),
    ],
)
def test_overlap_of_chunks(left, right, n, rule):
    from colloquy.operators.align import overlap_length

    assert overlap_length(left.split(), right.split()) == (n, rule)


@pytest.mark.parametrize("a, b, same", [("abcdef", "bcde", False), ("generational", "national", True), ("walk", "walkedthrough", True), ("cat", "dog", False), ("b", "x", True), ("ab", "xb", True)])
def test_words_that_may_be_cut_off(a, b, same):
    from colloquy.operators.align import _partly

    assert _partly(a, b) is same and _partly(b, a) is same


def test_stitched_chunks_say_each_word_once(spark):
    from colloquy.operators.align import stitch_chunks

    said = ["".join(chr(97 + (i * 7 + k * k * 5 + i * k) % 26) for k in range(6)) for i in range(40)]
    rows = [(1, k, said[a : a + 15]) for k, a in enumerate(range(0, 40, 10))]
    assert stitch_chunks(spark.createDataFrame(rows, "transcript_id int, chunk int, words array<string>")).first()["words"] == said


def test_stitch_steps_add_up(spark):
    whole = {r["transcript_id"]: r for r in entry.queries()["stitch_chunks"](spark, "/root/testdata/sf0.01").collect()}
    skipped = defaultdict(int)
    for r in entry.queries()["stitch_steps"](spark, "/root/testdata/sf0.01").collect():
        assert (r["skipped"] > 0) == (r["rule"] != "none") and r["skipped"] <= r["n_right"]
        skipped[r["transcript_id"]] += r["skipped"]
    assert all(r["skipped"] == skipped[t] for t, r in whole.items())


def test_unknown_words_are_filled_in_order(spark):
    from colloquy.operators.align import fill_unknown

    row = spark.createDataFrame([(["we", "<unk>", "home", "<unk>"], ["we", "go", "home", "now"])], "aligned array<string>, original array<string>")
    assert fill_unknown(row).first()["filled"] == ["we", "go", "home", "now"]


def test_packed_sentences_keep_the_limit(spark):
    from colloquy.operators.align import pack_sentences

    sentences = ["a b c.", "d e.", "f g h i j k.", "l."]
    row = spark.createDataFrame([(sentences,)], "sentences array<string>")
    assert pack_sentences(row, 5).first()["pieces"] == ["a b c. d e.", "f g h i j k.", "l."]


def timed(text, start=0.0, step=1.0):
    return [{"text": w, "start_s": start + i * step, "end_s": start + i * step + 0.8} for i, w in enumerate(text.split())]


def test_overlap_by_times():
    from colloquy.operators.align import overlap_length

    left = timed("we went home and then we slept")
    assert overlap_length(left, timed("then we slept and rose", 4.0)) == (3, "temporal")
    assert overlap_length(left, timed("um then we slept well", 3.0)) == (4, "temporal")
    assert overlap_length(left, timed("other words we slept not", 4.0)) == (4, "sequence")  # one word alone in the shared times
    assert overlap_length(left, timed("we slept well", 100.0)) == (2, "exact")  # times do not overlap
    assert overlap_length(left, timed("quite other words", 4.0))[1] in ("none", "partial")


def test_original_words_get_the_times_of_aligned_ones():
    from colloquy.operators.align import original_with_times

    spans = lambda rows: [(r["text"], r["start_s"], r["end_s"]) for r in rows]
    assert spans(original_with_times(["A", "B"], timed("a b"), 0.0, 2.0)) == [("A", 0.0, 0.8), ("B", 1.0, 1.8)]
    assert spans(original_with_times("The quick fox".split(), timed("the fox"), 0.0, 2.0)) == [("The", 0.0, 0.8), ("quick", 0.8, 1.0), ("fox", 1.0, 1.8)]
    assert spans(original_with_times("The fox".split(), timed("the fox fox"), 0.0, 3.0))[0][0] == "The"
    assert spans(original_with_times("one two".split(), timed("one"), 0.0, 3.0)) == [("one", 0.0, 0.8), ("two", 0.8, 3.0)]
    assert original_with_times([], timed("a"), 0.0, 1.0) == []


def test_characters_become_words(spark):
    from colloquy.operators.align import word_spans, words_from_characters

    chars = [{"char": c, "start_ms": 100.0 * i, "end_ms": 100.0 * i + 80} for i, c in enumerate("HI|YOU")]
    assert [(w["text"], w["start_s"], w["end_s"]) for w in words_from_characters(["Hi,", "you!", "--"], chars)] == [("Hi,", 0.0, 0.18), ("you!", 0.3, 0.58), ("--", 0.58, 0.88)]
    rows = spark.createDataFrame([(1, "Hi you", [("H", 0.0, 50.0), ("I", 50.0, 90.0)]), (2, None, None)], "transcript_id int, text string, spans array<struct<char:string,start_ms:double,end_ms:double>>")
    assert [(r["text"], r["start_s"], r["end_s"]) for r in word_spans(rows).orderBy("word_idx").collect()] == [("Hi", 0.0, 0.09), ("you", 0.09, 0.54)]


def test_long_groups_are_split_and_keep_their_segments(spark):
    from colloquy.operators import vad
    from colloquy.plans import fixtures

    grouped = vad.combine(fixtures.long_speech(spark, SMALL))
    whole = {(r["transcript_id"], r["group"]): r for r in vad.combined(fixtures.long_speech(spark, SMALL)).collect()}
    pieces = defaultdict(list)
    for r in vad.split_long(grouped).collect():
        pieces[r["transcript_id"], r["group"]].append(r)
    assert set(pieces) == set(whole) and any(len(p) > 1 for p in pieces.values())
    for key, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert sum(r["n_segments"] for r in own) == whole[key]["n_segments"]
        assert (own[0]["start_s"], max(r["end_s"] for r in own)) == (whole[key]["start_s"], whole[key]["end_s"])


def test_preparation_refuses_unknown_modes(spark):
    from colloquy.operators.prepare import prepare_turns, turn_segments

    rows = spark.createDataFrame([(1, 1, "a: b", "x: y. z!")], "transcript_id int, turn int, speaker string, text string")
    with pytest.raises(ValueError, match="there are"):
        prepare_turns(rows, "wild")
    assert [r["segment"] for r in turn_segments(prepare_turns(rows, labels=False), 1).collect()] == ["a: b: x: y.", "a: z!"]


def test_ranges_must_not_end_before_they_start(spark):
    from colloquy.operators.segments import restrict_range

    with pytest.raises(ValueError):
        restrict_range(spark.range(1), 5.0, 5.0)


def test_words_that_differ_in_composition_only_are_the_same(spark):
    from colloquy.operators.redact import validate_first_pass

    row = spark.createDataFrame([("caf\u00e9 noir", "cafe\u0301 noir")], "original string, processed string")
    assert validate_first_pass(row).first()["passed"]


def test_registry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
