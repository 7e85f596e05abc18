"""Speech segments: combining across short pauses, scores for splitting, and the silences between."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from colloquy.config import VadConfig


def by_time() -> WindowSpec:
    return Window.partitionBy("transcript_id").orderBy("start_s", "end_s")


def combine(segments: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """Adds ``group``: segments stay together over micro pauses, disfluencies and thinking pauses. Only neighbours decide."""
    duration = F.col("end_s") - F.col("start_s")
    rows = segments.withColumn("duration_s", duration)
    prev = F.lag("duration_s").over(by_time())
    gap = F.col("start_s") - F.lag("end_s").over(by_time())
    rows = rows.withColumns({"gap_s": gap, "prev_s": prev})
    g, p, d = F.col("gap_s"), F.col("prev_s"), F.col("duration_s")
    disfluent = ((p < config.disfluency) | (d < config.disfluency)) & (p + d >= config.disfluency_context)
    thinking = (g < config.thinking_pause) & (((p < config.short) & (d < config.short)) | (g < (p + d) / 2 * 0.5))
    together = F.when(g.isNull(), False).when(g < config.micro_pause, True).when(g >= config.boundary, False).otherwise(disfluent | thinking)
    return rows.withColumn("group", F.sum(F.when(together, 0).otherwise(1)).over(by_time())).drop("prev_s")


def combined(segments: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    return combine(segments, config).groupBy("transcript_id", "group").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_segments"))


def split_scores(grouped: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """Score of splitting each group before its segment ``idx`` (from 1): balance of the sides, width of the gap, and how it stands out."""
    w = Window.partitionBy("transcript_id", "group").orderBy("start_s", "end_s")
    rows = grouped.withColumns(
        {
            "idx": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("transcript_id", "group")),
            "gap": F.col("start_s") - F.lag("end_s").over(w),
            "g_start": F.min("start_s").over(Window.partitionBy("transcript_id", "group")), "g_end": F.max("end_s").over(Window.partitionBy("transcript_id", "group")),
        }
    )
    rows = rows.withColumns({"gap_prev": F.lag("gap").over(w), "gap_next": F.lead("gap").over(w)}).where("idx > 0")
    left, right = F.col("start_s") - F.col("g_start"), F.col("g_end") - F.col("start_s")
    prominence = F.when(F.col("idx") > 1, 0.1 * (F.col("gap") - F.col("gap_prev"))).otherwise(0.0) + F.when(F.col("idx") < F.col("n") - 1, 0.1 * (F.col("gap") - F.col("gap_next"))).otherwise(0.0)
    score = 0.4 * F.least(left, right) / F.greatest(left, right) + 0.3 * F.least(F.col("gap") / config.full_gap, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), prominence)
    return rows.select("transcript_id", "group", "idx", "gap", left.alias("left_s"), right.alias("right_s"), score.alias("score"))


def split_points(scores: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """At most ``max_splits`` places per group: by score, each at least two segments behind the last one taken."""
    fit = scores.where((F.col("gap") >= config.split_gap) & (F.col("left_s") >= config.min_piece) & (F.col("right_s") >= config.min_piece))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "idx")))
    taken = F.aggregate(
        order, F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) < config.max_splits) & (x["idx"] - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) >= 2), F.concat(acc, F.array(x["idx"].cast("int")))).otherwise(acc),
    )
    return fit.groupBy("transcript_id", "group").agg(taken.alias("points"))


def silences(segments: DataFrame) -> DataFrame:
    """Gaps between speech segments in order of time."""
    before = F.lag("end_s").over(by_time())
    rows = segments.withColumn("from_s", before).where(F.col("from_s") < F.col("start_s"))
    return rows.select("transcript_id", "from_s", F.col("start_s").alias("to_s"), F.round(F.col("start_s") - F.col("from_s"), 6).alias("silence_s"))


def summary(segments: DataFrame) -> DataFrame:
    out = segments.groupBy("transcript_id").agg(F.count("*").alias("n_segments"), F.round(F.sum((F.col("end_s") - F.col("start_s")).cast("decimal(18,3)")).cast("double"), 3).alias("speech_s"), F.max("end_s").alias("end_s"))
    return out.withColumn("speech_percent", F.round(F.col("speech_s") / F.col("end_s") * 100, 1))


def speech_or_whole(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """Speech segments; a recording of ``audio`` (``transcript_id, seconds``) without any is one segment from its start to its end."""
    silent = audio.join(segments, "transcript_id", "left_anti")
    return segments.select("transcript_id", "start_s", "end_s").unionByName(silent.select("transcript_id", F.lit(0.0).alias("start_s"), F.col("seconds").cast("double").alias("end_s")))


def _score(parts: list[tuple[float, float]], i: int, config: VadConfig) -> float:
    gap = parts[i][0] - parts[i - 1][1]
    left, right = parts[i][0] - parts[0][0], parts[-1][1] - parts[i][0]
    out = 0.0
    if i > 1:
        out += 0.1 * (gap - (parts[i - 1][0] - parts[i - 2][1]))
    if i < len(parts) - 1:
        out += 0.1 * (gap - (parts[i + 1][0] - parts[i][1]))
    longer = max(left, right)
    return (0.4 * min(left, right) / longer if longer > 0 else 0.0) + 0.3 * min(gap / config.full_gap, 1.0) + 0.3 * max(0.0, out)


def _cuts(parts: list[tuple[float, float]], config: VadConfig) -> list[int]:
    """Places to split a run of segments at: by score, each two segments behind the last one taken at least."""
    scored = []
    for i in range(1, len(parts)):
        fits = parts[i][0] - parts[i - 1][1] >= config.split_gap and parts[i][0] - parts[0][0] >= config.min_piece and parts[-1][1] - parts[i][0] >= config.min_piece
        if fits:
            scored.append((-_score(parts, i, config), i))
    taken: list[int] = []
    for _, i in sorted(scored):
        if len(taken) < config.max_splits and i - (taken[-1] if taken else 0) >= 2:
            taken.append(i)
    return sorted(taken)


def split_run(parts: list[tuple[float, float]], config: VadConfig) -> list[list[tuple[float, float]]]:
    """A run of segments in pieces of at most ``max_seconds`` where there are places to split it, again and again."""
    done, waiting = [], [parts]
    while waiting:
        run = waiting.pop(0)
        cuts = _cuts(run, config) if run[-1][1] - run[0][0] > config.max_seconds else []
        if not cuts:
            done.append(run)
            continue
        waiting += [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True)]
    return done


def split_long(grouped: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """``transcript_id, group, piece, start_s, end_s, n_segments``: groups over ``max_seconds`` in pieces, numbered by time."""

    @F.pandas_udf("array<struct<start_s:double,end_s:double,n_segments:int>>")
    def pieces(parts: pd.Series) -> pd.Series:
        def one(rows) -> list[dict]:
            runs = split_run([(r["start_s"], r["end_s"]) for r in rows], config)
            return sorted(({"start_s": r[0][0], "end_s": max(e for _, e in r), "n_segments": len(r)} for r in runs), key=lambda r: (r["start_s"], r["end_s"]))

        return pd.Series([one(rows) for rows in parts])

    runs = grouped.groupBy("transcript_id", "group").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("parts"))
    rows = runs.select("transcript_id", "group", F.posexplode(pieces("parts")).alias("piece", "p"))
    return rows.select("transcript_id", "group", "piece", "p.*")


def audit_rows(grouped: DataFrame) -> DataFrame:
    """``transcript_id, group, place, combined, individual, gap`` for an audit sheet: each group (place 0), then its segments."""
    gap = F.when(F.col("before").isNull(), "").otherwise(F.format_string("%.3fs", F.col("start_s") - F.col("before")))
    span = F.format_string("%.3f - %.3f (%.3fs)", "start_s", "end_s", F.col("end_s") - F.col("start_s"))
    of = Window.partitionBy("transcript_id", "group").orderBy("start_s", "end_s")
    numbered = grouped.withColumns({"n": F.row_number().over(by_time()), "place": F.row_number().over(of), "before": F.lag("end_s").over(by_time())})
    none = F.lit("")
    own = numbered.select("transcript_id", "group", "place", none.alias("combined"), F.concat(F.col("n").cast("string"), F.lit(" - "), span).alias("individual"), gap.alias("gap"))
    whole = grouped.groupBy("transcript_id", "group").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    whole = whole.withColumn("before", F.lag("end_s").over(Window.partitionBy("transcript_id").orderBy("group")))
    top = whole.select("transcript_id", "group", F.lit(0).alias("place"), span.alias("combined"), none.alias("individual"), gap.alias("gap"))
    return top.unionByName(own)
