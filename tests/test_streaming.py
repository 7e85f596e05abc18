from datetime import datetime, timedelta

from colloquy.streaming.activity import speaking_sessions


def test_stream_and_batch_agree(spark, tmp_path):
    start = datetime(2024, 1, 1)
    seconds = [("A", 0), ("A", 1), ("A", 3.5), ("B", 3.6), ("A", 20), (None, 21), ("", 22), ("A", None)]
    rows = [(1, s, None if t is None else start + timedelta(seconds=t)) for s, t in seconds] + [(2, "A", start), (2, "A", start + timedelta(hours=1))]
    words = spark.createDataFrame(rows, "transcript_id int, speaker string, ts timestamp")
    expected = {(r["transcript_id"], r["speaker"], r["start_ts"]): r["n_words"] for r in speaking_sessions(words).collect()}
    assert expected[(1, "A", start)] == 3 and expected[(1, "Unknown", start + timedelta(seconds=21))] == 2 and len(expected) == 6

    words.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(words.schema).parquet(str(tmp_path / "in"))
    run = speaking_sessions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    found = {(r["transcript_id"], r["speaker"], r["start_ts"]): r["n_words"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found and found.items() <= expected.items()  # the newest session stays open
