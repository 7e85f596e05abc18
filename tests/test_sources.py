"""Checkpoints, aligner files, and every writer, on small inputs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.sources import checkpoint, formats, textgrid, writers

SMALL = "/root/testdata/sf0.001"
GRID = '''File type = "ooTextFile"
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        intervals [1]:
            xmin = 0.0
            xmax = 0.50
            text = "well"
        intervals [2]:
            xmin = 0.5
            xmax = 0.9
            text = "<eps>"
        intervals [3]:
            xmin = 0.9
            xmax = 1.25
            text = "say ""hi"""
        intervals [4]:
            xmin = 1.25
            xmax = 1.26
            text = "x"
    item [2]:
        name = "phones"
        intervals [1]:
            xmin = 0.0
            xmax = 0.5
            text = "W"
'''


def words_of(spark, n=6):
    rows = [(1, i, f"w{i}", float(i), i + 0.5, "A" if i < 3 else None) for i in range(n)]
    return spark.createDataFrame(rows, "transcript_id int, word_idx long, text string, start_s double, end_s double, speaker string")


@pytest.fixture(scope="module")
def turns(spark):
    from colloquy.plans.queries import _turns

    return _turns(spark, SMALL).where("transcript_id <= 3").cache()


def test_checkpoint_round_trip(spark, tmp_path):
    words = words_of(spark)
    (row,) = checkpoint.checkpoint_json(words, "combined_audio").collect()
    (tmp_path / "a.json").write_text(row["json"])
    back = checkpoint.read_checkpoints(spark, str(tmp_path))
    assert sorted(map(tuple, back.drop("mode").collect())) == sorted(map(tuple, words.collect())) and back.first()["mode"] == "combined_audio"


@pytest.mark.parametrize("words", ["[]", "null"])
def test_checkpoint_without_words_is_an_error(spark, tmp_path, words):
    (tmp_path / "a.json").write_text('{"transcript_id": 1, "metadata": {}, "words": %s}' % words)
    with pytest.raises(Exception, match="no words"):
        checkpoint.read_checkpoints(spark, str(tmp_path)).collect()
    assert checkpoint.read_checkpoints(spark, str(tmp_path), strict=False).count() == 0


def test_checkpoint_with_a_broken_word(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"transcript_id": 1, "words": [{"text": "a", "start": 0.0, "end": 1.0}, {"text": "b", "start": None, "end": 2.0}]}))
    with pytest.raises(Exception, match="lacks"):
        checkpoint.read_checkpoints(spark, str(tmp_path)).collect()
    assert checkpoint.read_checkpoints(spark, str(tmp_path), strict=False).count() == 1


def test_textgrid(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(GRID)
    (tmp_path / "b.TextGrid").write_text("no tiers")
    rows = textgrid.read_textgrids(spark, str(tmp_path), offset_s=10.0).orderBy("word_idx").collect()
    assert [(r["word_idx"], r["text"], r["start_s"], r["end_s"]) for r in rows] == [(0, "well", 10.0, 10.5), (1, 'say "hi"', 10.9, 11.25)]


def test_textgrid_in_the_form_of_the_original(spark):
    rows = textgrid.parse_textgrids(spark.createDataFrame([("a", GRID)], "path string, value string"))
    original = spark.createDataFrame([("a", 0, "Well,"), ("a", 1, "Say")], "path string, word_idx long, text string")
    same = textgrid.by_place(rows, original).orderBy("word_idx").collect()
    assert [r["text"] for r in same] == ["Well,", "Say"]
    other = textgrid.by_place(rows, original.limit(1)).orderBy("word_idx").collect()
    assert [r["text"] for r in other] == ["well", 'say "hi"']
    spread = textgrid.or_even(spark.createDataFrame([], "path string, word_idx long, text string, start_s double, end_s double"), original, 4.0).orderBy("word_idx").collect()
    assert [(r["text"], r["start_s"], r["end_s"]) for r in spread] == [("Well,", 0.0, 2.0), ("Say", 2.0, 4.0)]


def test_restored_case(spark):
    aligned = spark.createDataFrame([("a", i, t, float(i)) for i, t in enumerate("the us and the us the".split())], "path string, word_idx long, text string, start_s double")
    original = spark.createDataFrame([("a", i, t) for i, t in enumerate("The US, and the".split())], "path string, word_idx long, text string")
    rows = textgrid.restore_case(aligned, original).orderBy("word_idx").collect()
    assert [r["text"] for r in rows] == ["The", "US,", "and", "the", "US,", "The"] and [r["start_s"] for r in rows] == [float(i) for i in range(6)]


def test_wts(spark):
    lines = spark.createDataFrame([("[100] --> [250]  hello there",), ("no times",), ("[250] --> [300] x",)], "value string")
    assert sorted(map(tuple, textgrid.parse_wts(lines).collect())) == [("hello there", 0.1, 0.25), ("x", 0.25, 0.3)]


def test_plain_writers(spark, turns):
    lines = {r["transcript_id"]: r["content"] for r in writers.timestamped_text(turns).collect()}
    first = {r["transcript_id"]: r for r in turns.where("turn = 1").collect()}
    for t, r in first.items():
        assert lines[t].split("\n")[0].endswith(f"] {r['speaker']}: {r['text']}") and lines[t].startswith("[00:0")
    assert all("\n\n" in r["content"] or ":" in r["content"] for r in writers.plain_text(turns).collect())
    assert writers.word_text(words_of(spark)).first()["content"] == "w0 w1 w2 w3 w4 w5"
    assert [tuple(r) for r in writers.word_csv(spark.createDataFrame([(1, "  one two\nthree ")], "transcript_id int, text string")).orderBy("line").collect()] == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three")]


def test_subtitles(turns):
    for r in writers.srt(turns).collect():
        blocks = r["content"].strip().split("\n\n")
        assert [int(b.split("\n")[0]) for b in blocks] == list(range(1, len(blocks) + 1))
        for b in blocks:
            start, end = b.split("\n")[1].split(" --> ")
            assert start <= end and len(start) == 12


def test_json_writers(turns):
    n = {r["transcript_id"]: r["n"] for r in turns.groupBy("transcript_id").agg({"turn": "count"}).withColumnRenamed("count(turn)", "n").collect()}
    for r in writers.flow_json(turns).collect():
        doc = json.loads(r["content"])
        assert len(doc["turns"]) == n[r["transcript_id"]] and [t["turn_id"] for t in doc["turns"]] == sorted(t["turn_id"] for t in doc["turns"])
        assert set(doc["speaker_statistics"]) == set(doc["metadata"]["speakers"]) and doc["conversation_metrics"]["total_turns"] == n[r["transcript_id"]]
    for r in writers.turns_json(turns).collect():
        doc = json.loads(r["content"])
        assert doc["metadata"]["total_turns"] == len(doc["turns"]) == n[r["transcript_id"]] and set(doc["turns"][0]) == {"speaker", "start", "end", "text"}


def test_documents_for_reading(turns):
    n = turns.where("transcript_id = 1").count()
    page = {r["transcript_id"]: r["content"] for r in writers.markdown(turns).collect()}[1]
    assert page.startswith("# Transcript") and page.count("\n\n---\n\n") == n - 1 and "| Speaker | Turns |" in page
    script = {r["transcript_id"]: r["content"] for r in writers.dialogue_script(turns).collect()}[1]
    assert max(map(len, script.split("\n"))) <= 75 + 60 and "SPEAKER_0" in script
    html = {r["transcript_id"]: r["content"] for r in writers.html_timeline(turns).collect()}[1]
    assert html.count('<div class="turn"') == n and html.count("<span>") == 6 and html.startswith("<!DOCTYPE html>")


def test_outputs_go_to_their_folders(spark, turns, tmp_path):
    out = writers.write_outputs(turns, str(tmp_path / "out"), list(writers.FORMATS))
    ids = {r["transcript_id"] for r in turns.select("transcript_id").distinct().collect()}
    assert set(out) == set(writers.FORMATS)
    for name, folder in out.items():
        files = {p.parent.name: p.read_text() for p in Path(folder).glob("transcript_id=*/*.txt")}
        assert set(files) == {f"transcript_id={t}" for t in ids}
        alone = {f"transcript_id={r['transcript_id']}": r["content"] for r in writers.FORMATS[name][1](turns).collect()}
        assert {t: c.rstrip("\n") for t, c in files.items()} == {t: c.rstrip("\n") for t, c in alone.items()}
    with pytest.raises(ValueError, match="there are"):
        writers.write_outputs(turns, str(tmp_path / "none"), ["pdf"])


def test_timeline_holds_figures_cards_and_turns(spark, turns):
    odd = turns.where("transcript_id = 1").withColumn("text", F.when(F.col("turn") == 1, "</script><b>").otherwise(F.col("text")))
    rows = {r["turn"]: r for r in odd.collect()}
    page = writers.html_timeline(odd).first()["content"]
    blob = page.split('id="turns">')[1].split("</script>")[0]
    found = json.loads(blob)
    assert [t["id"] for t in found] == sorted(rows) and found[0]["text"] == "</script><b>"
    for t in found:
        r = rows[t["id"]]
        assert (t["speaker"], t["start"], t["wordCount"], t["flowContinuity"], t["turnType"]) == (r["speaker"], r["start_s"], r["n_words"], r["flow"], r["turn_type"])
        assert [x["text"] for x in t["interjections"]] == [x["text"] for x in r["interjections"]]
    assert page.count('<div class="card">') == len({r["speaker"] for r in rows.values()} | {x["speaker"] for r in rows.values() for x in r["interjections"]})
    assert f"Total Turns: {len(rows)}<" in page and page.count("<em>Flow</em>") == page.count('<div class="card">')


def _stream(spark, kind, path, to, options):
    query = spark.readStream.format(kind).options(**options).load(path).writeStream.format("parquet").option("checkpointLocation", f"{to}/at").option("path", f"{to}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{to}/rows").collect()


def test_word_lists_are_read_in_blocks_and_streams(spark, tmp_path):
    formats.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"[{i * 100}] --> [{i * 100 + 90}] wörd{i}" if i % 7 else ("" if i % 2 else "odd line") for i in range(500)]
    (folder / "a.wts").write_text("\n".join(lines))
    whole = textgrid.scan_wts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    key = lambda r: (r["text"], r["start_s"], r["end_s"], r["problem"])
    for block in (64, 999, 1 << 20):
        rows = spark.read.format("wts").option("block_bytes", block).load(str(folder))
        assert rows.rdd.getNumPartitions() == -(-(folder / "a.wts").stat().st_size // block)
        assert [key(r) for r in sorted(rows.collect(), key=lambda r: r["at"])] == [key(r) for r in whole]
    assert sorted(map(str, map(key, _stream(spark, "wts", str(folder), tmp_path / "s", {"block_bytes": "300"})))) == sorted(map(str, map(key, whole)))
    (folder / "b.wts").write_text("[1] --> [2] late")
    assert len(_stream(spark, "wts", str(folder), tmp_path / "s", {"block_bytes": "300"})) == len(whole) + 1


def test_textgrids_are_read_in_batches_and_streams(spark, tmp_path):
    formats.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    odd = GRID.replace("xmax = 0.9", "xmax 0.9", 1).replace("xmin = 1.25", "xmin = x")
    texts = {"a.TextGrid": GRID, "b.TextGrid": odd, "c.TextGrid": "no tiers", "d.TextGrid": GRID.split("    item [2]")[0] + "        intervals [5]:\n            xmin = 2"}
    for name, text in texts.items():
        (folder / name).write_text(text)
    scanned = textgrid.scan_textgrids(spark.createDataFrame([(str(folder / n), t) for n, t in texts.items()], "path string, value string"))
    key = lambda r: str((r["path"], r["text"], r["start_s"], r["end_s"], r["problem"]))
    expected = sorted(map(key, scanned.collect()))
    assert sorted(map(key, spark.read.format("textgrid").option("files_per_task", 2).load(str(folder)).collect())) == expected
    assert sorted(map(key, _stream(spark, "textgrid", str(folder), tmp_path / "s", {}))) == expected
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("textgrid").load(str(empty)).count() == 0
