"""Frame labels and frame scores of an acoustic aligner as rows: spans of tokens, and peaks where no alignment is given.

Frames are rows ``transcript_id, frame, label`` (or ``scores``), tokens rows ``transcript_id, token_idx, token``, both numbered from 0. A
transcript of any length is many tasks: runs are found by equi-joins and numbered by ranges (``ordering.positions``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordering import positions
from colloquy.work import materialise

FRAME_MS = 20.0


def label_runs(frames: DataFrame, blank: int = 0) -> DataFrame:
    """``transcript_id, run, label, from_frame, to_frame``: runs of one label other than ``blank``, numbered in order; ``to_frame`` is behind the run."""
    at = F.col("frame")
    before = frames.select("transcript_id", (at + 1).alias("frame"), F.col("label").alias("last"))
    behind = frames.select("transcript_id", (at - 1).alias("frame"), F.col("label").alias("next"))
    spoken = frames.where(F.col("label") != blank)
    key = ["transcript_id", "frame"]
    edges = materialise(
        spoken.join(before, key, "left").join(behind, key, "left")
        .select(*key, "label", F.col("last").eqNullSafe(F.col("label")).alias("goes_on"), F.col("next").eqNullSafe(F.col("label")).alias("continues"))
        .where("NOT (goes_on AND continues)"),
        "edges",
    )
    # The n-th start and the n-th end belong together.
    starts = positions(edges.where("NOT goes_on").select(*key, "label"), ["transcript_id"], ["frame"], "run")
    ends = positions(edges.where("NOT continues").select("transcript_id", (at + 1).alias("to_frame")), ["transcript_id"], ["to_frame"], "run")
    return starts.join(ends, ["transcript_id", "run"]).select("transcript_id", "run", "label", F.col("frame").alias("from_frame"), "to_frame")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and runs in order, tokens first: each run takes the token that waits first if it is the same, else it is passed over."""
    whose, waiting = None, deque()
    for batch in batches:
        found = []
        for transcript, _, is_run, number, label, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            if transcript != whose:
                whose, waiting = transcript, deque()
            if not is_run:
                waiting.append((number, label))
            elif waiting and waiting[0][1] == label:
                found.append((transcript, waiting.popleft()[0], label, begin, end))
        columns = list(zip(*found)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["transcript_id", "token_idx", "token", "from_frame", "to_frame"])


def frame_spans(frames: DataFrame, tokens: DataFrame, blank: int = 0, frame_ms: float = FRAME_MS, fill: bool = False) -> DataFrame:
    """``transcript_id, token_idx, token, start_ms, end_ms``: each token takes the first run of its label behind the one of the token before.

    Runs of other labels than the one expected are passed over. As long as runs and tokens agree one by one, the match is a
    join by number; from the first disagreement of a transcript on, its runs and tokens are replayed in order, in batches.
    With ``fill``, tokens that found no run share the time from the last span's end to the end of the frames evenly.
    """
    runs = materialise(label_runs(frames, blank), "runs")
    given = tokens.select("transcript_id", F.col("token_idx").cast("long").alias("token_idx"), F.col("token").cast("int").alias("token"))
    pairs = materialise(runs.join(given, (runs["transcript_id"] == given["transcript_id"]) & (F.col("run") == F.col("token_idx"))).select(runs["transcript_id"], "token_idx", "token", F.col("label").cast("int").alias("label"), "from_frame", "to_frame"), "pairs")
    odd = pairs.where("label <> token").groupBy("transcript_id").agg(F.min("token_idx").alias("first_odd"))
    agreed = pairs.join(odd, "transcript_id", "left").where("first_odd IS NULL OR token_idx < first_odd")
    none = F.lit(None).cast("long")
    left_runs = runs.join(odd, "transcript_id").where("run >= first_odd").select("transcript_id", F.col("run").alias("at"), F.lit(True).alias("is_run"), F.col("run").alias("number"), F.col("label").cast("int").alias("label"), "from_frame", "to_frame")
    left_tokens = given.join(odd, "transcript_id").where("token_idx >= first_odd").select("transcript_id", F.col("token_idx").alias("at"), F.lit(False), F.col("token_idx"), "token", none, none)
    kind = frames.schema["transcript_id"].dataType.simpleString()
    replayed = left_runs.union(left_tokens).repartition("transcript_id").sortWithinPartitions("transcript_id", "at", "is_run").mapInArrow(_matched, f"transcript_id {kind}, token_idx long, token int, from_frame long, to_frame long")
    timed = lambda c: F.col(c) * F.lit(frame_ms)
    spans = agreed.select("transcript_id", "token_idx", "token", "from_frame", "to_frame").unionByName(replayed)
    spans = spans.select("transcript_id", "token_idx", "token", timed("from_frame").alias("start_ms"), timed("to_frame").alias("end_ms"))
    if not fill:
        return spans
    spans = materialise(spans, "spans")
    found = spans.groupBy("transcript_id").agg(F.count("*").alias("n_found"), F.max("end_ms").alias("last_ms"))
    sizes = frames.groupBy("transcript_id").agg((F.count("*") * F.lit(frame_ms)).alias("total_ms"))
    wanted = given.groupBy("transcript_id").agg(F.count("*").alias("n_tokens"))
    rest = sizes.join(wanted, "transcript_id").join(found, "transcript_id", "left").fillna(0, ["n_found"]).fillna(0.0, ["last_ms"]).where("n_found < n_tokens AND total_ms > last_ms")
    late = given.join(rest, "transcript_id").where("token_idx >= n_found")
    step = (F.col("total_ms") - F.col("last_ms")) / (F.col("n_tokens") - F.col("n_found"))
    start = F.col("last_ms") + (F.col("token_idx") - F.col("n_found")) * step
    return spans.unionByName(late.select("transcript_id", "token_idx", "token", start.alias("start_ms"), (start + step).alias("end_ms")))


def peak_spans(frames: DataFrame, tokens: DataFrame, frame_ms: float = FRAME_MS) -> DataFrame:
    """``transcript_id, token_idx, token, start_ms, end_ms``: the frame near a token's even place where its score is greatest.

    ``frames`` has ``scores``, an array by token id. Of n frames and k tokens, token i is looked for from one share of n / k frames before its place to two
    behind; the first of equal peaks counts. A token without any frame in its window has no row. Windows overlap threefold, so
    three rows per frame meet in one equi-join by frame, whatever the transcript's length.
    """
    sizes = frames.groupBy("transcript_id").agg(F.count("*").alias("n"))
    counts = tokens.groupBy("transcript_id").agg(F.count("*").alias("k"))
    share = F.col("n") / F.col("k")
    middle = F.floor(F.col("token_idx") * share)
    first, last = F.greatest(middle - F.floor(share), F.lit(0)), F.least(middle + F.floor(2 * share), F.col("n")) - 1
    near = tokens.join(sizes.join(counts, "transcript_id"), "transcript_id").withColumns({"first": first, "last": last}).where("first <= last")
    near = near.select("transcript_id", F.col("token_idx").cast("long").alias("token_idx"), F.col("token").cast("int").alias("token"), F.explode(F.sequence("first", "last")).alias("frame"))
    scored = near.join(frames.select("transcript_id", F.col("frame").cast("long").alias("frame"), "scores"), ["transcript_id", "frame"])
    score = F.get("scores", F.col("token"))
    best = scored.groupBy("transcript_id", "token_idx", "token").agg(F.max(F.struct(score.alias("score"), (-F.col("frame")).alias("before"))).alias("b"))
    peak = -F.col("b.before")
    return best.select("transcript_id", "token_idx", "token", (peak * F.lit(frame_ms)).alias("start_ms"), ((peak + 1) * F.lit(frame_ms)).alias("end_ms"))
