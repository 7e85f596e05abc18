"""Registered queries of the transcript operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import INTERJECTION_PATTERNS, REDACTED, TurnConfig, VadConfig
from colloquy.functions import format as fmt
from colloquy.functions import text as tx
from colloquy.operators import align, assign, chunks, classify, mapping, metrics, redact, segments, turns, vad
from colloquy.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- steps shared by the queries ------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_gaps(segments.speaker_segments(fixtures.words(spark, sf_dir)))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_segments(_segments(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.assign_turns(_classified(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.build_turns(_assigned(spark, sf_dir))


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segments.with_gaps(segments.speaker_segments(fixtures.words(spark, sf_dir), keep_words=True))
    return turns.refine_turns(turns.assign_turns(classify.classify_segments(held)))


def _flat(t: DataFrame) -> DataFrame:
    return t.select("transcript_id", "turn", "speaker", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text", "n_words", "duration_s", "n_interjections", "rate_wpm", "flow", "turn_type")


# --- the same steps in SQL ------------------------------------------------------------------------

_TYPE = " ".join(f"WHEN contains(low, {_quoted(p)}) THEN {_quoted(c)}" for c, ps in INTERJECTION_PATTERNS.items() for p in ps)
_BOOST = " ".join(
    f"WHEN contains(low, {_quoted(p)}) THEN CASE WHEN low = {_quoted(p)} THEN 0.3::DOUBLE WHEN starts_with(low, {_quoted(p + ' ')}) OR ends_with(low, {_quoted(' ' + p)}) THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"
    for ps in INTERJECTION_PATTERNS.values() for p in ps
)
_C = TurnConfig()

_WORDS = f"WITH {fixtures.oracle('words')}"
_SEGMENTS = (
    _WORDS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_s, end_s, word_idx) - 1 AS ord, coalesce(nullif(speaker, ''), 'Unknown') AS who FROM words),
m AS (SELECT *, CASE WHEN lag(who) OVER w IS DISTINCT FROM who THEN 1 ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY transcript_id ORDER BY ord)),
ws AS (SELECT *, sum(b) OVER (PARTITION BY transcript_id ORDER BY ord) AS seg FROM m),
s0 AS (SELECT transcript_id, seg, min(who) AS speaker, arg_min(start_s, ord) AS start_s, arg_max(end_s, ord) AS end_s, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_words FROM ws GROUP BY ALL),
s AS (SELECT *, end_s - start_s AS duration_s, start_s - lag(end_s) OVER w AS gap_before, lead(start_s) OVER w - end_s AS gap_after FROM s0 WINDOW w AS (PARTITION BY transcript_id ORDER BY seg))"""
)
_CLASSES = (
    _SEGMENTS
    + f""", c0 AS (SELECT *, lower(trim(text)) AS low, duration_s <= {_C.max_seconds} AND n_words <= {_C.max_words} AS is_interjection,
  lag(speaker) OVER w AS prev, lead(speaker) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY transcript_id ORDER BY seg)),
c1 AS (SELECT *, CASE WHEN NOT is_interjection THEN 'none' {_TYPE} ELSE 'unclear' END AS itype,
  CASE WHEN NOT is_interjection THEN 0.0::DOUBLE {_BOOST} ELSE 0.0::DOUBLE END AS boost FROM c0),
c AS (SELECT *, CASE WHEN is_interjection THEN least(1.0::DOUBLE, ((1 - duration_s / {_C.max_seconds}::DOUBLE) + (1 - n_words / {_C.max_words}::DOUBLE)) / 2 + boost) ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN NOT is_interjection THEN 'none' WHEN gap_before < 0 AND gap_after < 0 THEN 'high'
    WHEN gap_before < 0 OR gap_after < 0 THEN CASE WHEN -least(gap_before, gap_after) > 0.5::DOUBLE THEN 'high' WHEN -least(gap_before, gap_after) > 0.2::DOUBLE THEN 'medium' ELSE 'low' END
    WHEN least(gap_before, gap_after) < 0.3::DOUBLE THEN 'low' ELSE 'none' END AS level,
  coalesce(is_interjection AND n_words = 1 AND itype = 'unclear' AND prev = nxt AND prev <> speaker, false) AS error FROM c1)"""
)
_ASSIGNED = (
    _CLASSES
    + f""", a AS (SELECT *, bool_and(is_interjection) OVER (PARTITION BY transcript_id) AS lone FROM c),
p0 AS (SELECT * FROM a WHERE NOT is_interjection OR lone),
p AS (SELECT transcript_id, seg, sum(CASE WHEN lone OR lag_s IS NULL OR lag_s <> speaker OR start_s - lag_e > {_C.merge_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY seg) AS turn
  FROM (SELECT *, lag(speaker) OVER w AS lag_s, lag(end_s) OVER w AS lag_e FROM p0 WINDOW w AS (PARTITION BY transcript_id ORDER BY seg)) q),
t AS (SELECT a.*, NOT a.is_interjection OR a.lone AS is_primary,
  CAST(coalesce(max(p.turn) OVER (PARTITION BY a.transcript_id ORDER BY a.seg ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS turn
  FROM a LEFT JOIN p ON a.transcript_id = p.transcript_id AND a.seg = p.seg)"""
)
_METRICS = """round(end_s - start_s, 3) AS duration_s FROM {0}),
{1} AS (SELECT *, CASE WHEN duration_s > 0 THEN round(n_words / duration_s * 60 + 1e-9, 1) ELSE 0 END AS rate_wpm,
  CASE WHEN n_interjections = 0 OR duration_s = 0 THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, (duration_s - spoken) / duration_s) * (1 - least(n_interjections * 0.1::DOUBLE, 0.5::DOUBLE)) - least(n_bad * 0.1::DOUBLE, 0.3::DOUBLE)), 3) END AS flow,
  CASE WHEN n_interjections = 0 THEN 'monologue' WHEN n_bad > 0 THEN 'interrupted' ELSE 'acknowledged' END AS turn_type FROM {1}0)"""
_TURNS = (
    _ASSIGNED
    + """, u AS (SELECT transcript_id, turn, arg_min(speaker, seg) FILTER (is_primary) AS speaker, arg_min(start_s, seg) FILTER (is_primary) AS start_s,
  arg_max(end_s, seg) FILTER (is_primary) AS end_s, string_agg(text, ' ' ORDER BY seg) FILTER (is_primary) AS text, CAST(sum(n_words) FILTER (is_primary) AS BIGINT) AS n_words,
  count(*) FILTER (NOT is_primary) AS n_interjections, coalesce(sum(end_s - start_s ORDER BY start_s, seg) FILTER (NOT is_primary), 0) AS spoken,
  count(*) FILTER (NOT is_primary AND level IN ('medium', 'high')) AS n_bad FROM t GROUP BY ALL),
turns0 AS (SELECT *, """
    + _METRICS.format("u", "turns")
)
_REFINED = (
    _TURNS
    + """, wt AS (SELECT ws.*, t.turn, NOT t.is_primary AS late FROM ws JOIN t ON ws.transcript_id = t.transcript_id AND ws.seg = t.seg WHERE t.is_primary OR t.error),
wa AS (SELECT transcript_id, turn, string_agg(text, ' ' ORDER BY start_s, late, ord) AS all_text, min(start_s) AS lo, max(end_s) AS hi, count(*) AS n, bool_or(late) AS has_error FROM wt GROUP BY ALL),
ri AS (SELECT transcript_id, turn, count(*) AS n_interjections, sum(end_s - start_s ORDER BY start_s, seg) AS spoken, count(*) FILTER (level IN ('medium', 'high')) AS n_bad FROM t WHERE NOT is_primary AND NOT error GROUP BY ALL),
r AS (SELECT u.transcript_id, u.turn, u.speaker, CASE WHEN has_error THEN least(start_s, lo) ELSE start_s END AS start_s, CASE WHEN has_error THEN greatest(end_s, hi) ELSE end_s END AS end_s,
  CASE WHEN has_error THEN all_text ELSE text END AS text, CASE WHEN has_error THEN n ELSE n_words END AS n_words,
  coalesce(ri.n_interjections, 0) AS n_interjections, coalesce(ri.spoken, 0) AS spoken, coalesce(ri.n_bad, 0) AS n_bad
  FROM u JOIN wa USING (transcript_id, turn) LEFT JOIN ri USING (transcript_id, turn)),
refined0 AS (SELECT *, """
    + _METRICS.format("r", "refined")
)
_FLAT = "transcript_id, turn, speaker, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, text, n_words, duration_s, n_interjections, rate_wpm, flow, turn_type"


# --- segments -------------------------------------------------------------------------------------


@query(_WORDS + " SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_s, end_s, word_idx) - 1 AS ord FROM words")
def words_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.order_words(segments.coerce_words(fixtures.words(spark, sf_dir)))


@query(
    _WORDS
    + """, n AS (SELECT *, lead(start_s) OVER (PARTITION BY transcript_id ORDER BY word_idx) AS next_start_s FROM words)
SELECT transcript_id, word_idx, start_s, next_start_s, round(start_s - next_start_s, 6) AS jump_s, round(start_s - next_start_s, 6) > 0.5 AS significant FROM n WHERE next_start_s < start_s"""
)
def time_jump_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.time_jumps(fixtures.words(spark, sf_dir))


@query(_SEGMENTS + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, speaker, start_s, end_s, text, n_words, round(duration_s, 6) AS duration_s FROM s")
def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.speaker_segments(fixtures.words(spark, sf_dir)).withColumn("duration_s", F.round("duration_s", 6))


@query(_SEGMENTS + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, round(gap_before, 6) AS gap_before, round(gap_after, 6) AS gap_after FROM s")
def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("transcript_id", "seg", F.round("gap_before", 6).alias("gap_before"), F.round("gap_after", 6).alias("gap_after"))


@query(
    _TURNS
    + """, b AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM turns WINDOW w AS (PARTITION BY transcript_id ORDER BY turn)),
g AS (SELECT *, sum(b) OVER (PARTITION BY transcript_id ORDER BY turn) AS paragraph FROM b)
SELECT transcript_id, CAST(paragraph AS BIGINT) AS paragraph, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY 1, 2"""
)
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.paragraphs(_turns(spark, sf_dir))


# --- classification -------------------------------------------------------------------------------


@query(_CLASSES + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, text, itype FROM c WHERE is_interjection")
def interjection_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("is_interjection").select("transcript_id", "seg", "text", "itype")


@query(_CLASSES + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, round(confidence, 6) AS confidence FROM c WHERE is_interjection")
def interjection_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("is_interjection").select("transcript_id", "seg", F.round("confidence", 6).alias("confidence"))


@query(_CLASSES + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, level FROM c WHERE is_interjection")
def interrupt_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("is_interjection").select("transcript_id", "seg", "level")


@query(_CLASSES + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, speaker, n_words, is_interjection, itype, level, round(confidence, 6) AS confidence, error FROM c")
def segment_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("transcript_id", "seg", "speaker", "n_words", "is_interjection", "itype", "level", F.round("confidence", 6).alias("confidence"), "error")


@query(_CLASSES + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, speaker, text FROM c WHERE error")
def diarization_error_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("error").select("transcript_id", "seg", "speaker", "text")


# --- turns ----------------------------------------------------------------------------------------


@query(_ASSIGNED + " SELECT transcript_id, CAST(seg AS BIGINT) AS seg, turn, is_primary FROM t")
def turn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("transcript_id", "seg", "turn", "is_primary")


@query(_TURNS + f" SELECT {_FLAT} FROM turns")
def hierarchical_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_turns(spark, sf_dir))


@query(_ASSIGNED + " SELECT transcript_id, turn, speaker, start_s, end_s, text, itype, level, round(confidence, 6) AS confidence, error FROM t WHERE NOT is_primary")
def turn_interjections(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _turns(spark, sf_dir).select("transcript_id", "turn", F.explode("interjections").alias("i"))
    return inner.select("transcript_id", "turn", *(f"i.{c}" for c in ("speaker", "start_s", "end_s", "text", "itype", "level")), F.round("i.confidence", 6).alias("confidence"), "i.error")


@query(_TURNS + " SELECT transcript_id, turn, duration_s, rate_wpm, flow, turn_type FROM turns")
def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("transcript_id", "turn", "duration_s", "rate_wpm", "flow", "turn_type")


@query(_REFINED + f" SELECT {_FLAT} FROM refined")
def turns_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_refined(spark, sf_dir))


@query(
    _REFINED
    + """, b AS (SELECT transcript_id, count(*) AS n, sum(n_interjections) AS i FROM turns GROUP BY 1), e AS (SELECT transcript_id, count(*) AS n, sum(n_interjections) AS i FROM refined GROUP BY 1)
SELECT transcript_id, b.n - coalesce(e.n, 0) AS turns_merged, CAST(b.i - coalesce(e.i, 0) AS BIGINT) AS interjections_merged, CAST(b.n - coalesce(e.n, 0) + b.i - coalesce(e.i, 0) AS BIGINT) AS merged FROM b LEFT JOIN e USING (transcript_id)"""
)
def refined_merge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.merge_counts(_turns(spark, sf_dir), _refined(spark, sf_dir))


# --- aggregates -----------------------------------------------------------------------------------


@query(
    _SEGMENTS
    + """ SELECT transcript_id, count(*) AS total_words, string_agg(DISTINCT nullif(speaker, ''), ',' ORDER BY nullif(speaker, '')) AS speakers, count(DISTINCT nullif(speaker, '')) AS speaker_count,
  arg_min(start_s, ord) AS first_start_s, arg_max(end_s, ord) AS last_end_s, round(arg_max(end_s, ord) - arg_min(start_s, ord), 6) AS duration_s FROM o GROUP BY 1"""
)
def transcript_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transcript_metadata(fixtures.words(spark, sf_dir))


# The oracle rounds doubles downwards at ties like 4.015, so a little is added to them.
_MEAN = "round(CAST(sum(CAST({0} AS DECIMAL(18, {1}))) AS DOUBLE) / count(*) + 1e-9, {2})"


def _conversation_sql(table: str) -> str:
    return f""" SELECT transcript_id, count(*) AS total_turns, CAST(sum(n_interjections) AS BIGINT) AS total_interjections, CAST(sum(n_words) AS BIGINT) AS total_words,
  {_MEAN.format("duration_s", 3, 2)} AS avg_turn_duration, round(sum(n_words) / count(*) + 1e-9, 1) AS avg_turn_words, {_MEAN.format("rate_wpm", 1, 1)} AS avg_speaking_rate,
  {_MEAN.format("flow", 3, 3)} AS avg_flow, round(arg_max(end_s, turn) - arg_min(start_s, turn) + 1e-9, 2) AS total_duration,
  CASE WHEN arg_max(end_s, turn) - arg_min(start_s, turn) > 0 THEN round(sum(n_interjections) / (arg_max(end_s, turn) - arg_min(start_s, turn)) * 60 + 1e-9, 2) ELSE 0 END AS interjection_rate
FROM {table} GROUP BY 1"""


@query(_TURNS + _conversation_sql("turns"))
def conversation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conversation_metrics(_turns(spark, sf_dir))


@query(_REFINED + _conversation_sql("refined"))
def conversation_metrics_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conversation_metrics(_refined(spark, sf_dir))


@query(_TURNS + " SELECT transcript_id, count(*) FILTER (turn_type = 'monologue') AS monologue, count(*) FILTER (turn_type = 'acknowledged') AS acknowledged, count(*) FILTER (turn_type = 'interrupted') AS interrupted FROM turns GROUP BY 1")
def turn_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.turn_type_distribution(_turns(spark, sf_dir))


@query(
    _TURNS
    + f""", b AS (SELECT transcript_id, speaker, count(*) AS total_turns, CAST(sum(n_words) AS BIGINT) AS total_words, round(CAST(sum(CAST(duration_s AS DECIMAL(18, 3))) AS DOUBLE) + 1e-9, 2) AS total_duration,
  {_MEAN.format("duration_s", 3, 2)} AS avg_turn_duration, {_MEAN.format("rate_wpm", 1, 1)} AS avg_speaking_rate, {_MEAN.format("flow", 3, 3)} AS avg_flow FROM turns GROUP BY 1, 2),
i AS (SELECT transcript_id, speaker, count(*) AS n FROM t WHERE NOT is_primary GROUP BY 1, 2)
SELECT transcript_id, speaker, coalesce(total_turns, 0) AS total_turns, coalesce(total_words, 0) AS total_words, coalesce(total_duration, 0) AS total_duration, coalesce(n, 0) AS total_interjections,
  coalesce(avg_turn_duration, 0) AS avg_turn_duration, coalesce(avg_speaking_rate, 0) AS avg_speaking_rate, coalesce(avg_flow, 0) AS avg_flow FROM b FULL JOIN i USING (transcript_id, speaker)"""
)
def speaker_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.speaker_statistics(_turns(spark, sf_dir))


@query(_WORDS + " SELECT transcript_id, coalesce(nullif(speaker, ''), '(no speaker)') AS speaker, count(*) AS n_words FROM words GROUP BY ALL")
def speaker_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.speaker_word_counts(fixtures.words(spark, sf_dir))


@query(_WORDS + " SELECT DISTINCT transcript_id, speaker FROM words WHERE speaker <> ''")
def distinct_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.words(spark, sf_dir).where("speaker <> ''").select("transcript_id", "speaker").distinct()


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, speaker ORDER BY word_idx) - 1 AS i, count(*) OVER (PARTITION BY transcript_id, speaker) AS n FROM spoken),
k AS (SELECT *, unnest([0, 1, 2]) AS sample, unnest([0, CASE WHEN n > 60 THEN n // 2 END, CASE WHEN n > 90 THEN n - 30 END]) AS pos FROM n)
SELECT transcript_id, speaker, sample, string_agg(text, ' ' ORDER BY i) AS text FROM k WHERE pos IS NOT NULL AND i >= pos AND i < pos + 30 GROUP BY 1, 2, 3"""
)
def speaker_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.speaker_samples(fixtures.spoken_words(spark, sf_dir))


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, speaker ORDER BY word_idx) AS i FROM spoken)
SELECT transcript_id, speaker, string_agg(text, ' ' ORDER BY i) || CASE WHEN count(*) >= 20 THEN '...' ELSE '' END AS sample FROM n WHERE i <= 20 GROUP BY 1, 2"""
)
def speaker_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_words(fixtures.spoken_words(spark, sf_dir))


@query(
    _WORDS
    + """, p AS (SELECT *, lag(end_s, 1, 0.0) OVER (PARTITION BY transcript_id ORDER BY word_idx) AS prev_end FROM words)
SELECT transcript_id, count(*) AS n_words, count(*) FILTER (start_s < prev_end) AS n_overlaps, count(*) FILTER (start_s >= prev_end AND start_s > prev_end + 1.0) AS n_gaps, count(*) FILTER (start_s > end_s) AS n_reversed,
  count(*) FILTER (speaker IS NULL OR speaker = '') AS n_without_speaker, count(*) FILTER (lower(speaker) = 'unknown') AS n_unknown_speaker FROM p GROUP BY 1"""
)
def checkpoint_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.checkpoint_quality(fixtures.words(spark, sf_dir))


@query(
    _CLASSES
    + """ SELECT category, count(*) AS n FROM (SELECT CASE WHEN error THEN 'diarization_error' WHEN is_interjection THEN 'interjection' ELSE 'primary' END AS category FROM c) q GROUP BY 1"""
)
def audit_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("error"), "diarization_error").when(F.col("is_interjection"), "interjection").otherwise("primary")
    return _classified(spark, sf_dir).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


# --- joins and mapping ----------------------------------------------------------------------------

_OVERLAP = (
    f"WITH {fixtures.oracle('words', 'diar')}"
    + """ SELECT w.transcript_id, w.word_idx, coalesce(arg_max(d.speaker, (least(w.end_s, d.end_s) - greatest(w.start_s, d.start_s), d.speaker)), 'Unknown') AS speaker
FROM words w LEFT JOIN diar d ON w.transcript_id = d.transcript_id AND least(w.end_s, d.end_s) > greatest(w.start_s, d.start_s) GROUP BY 1, 2"""
)


@query(_OVERLAP)
def overlap_speaker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign.assign_speakers(fixtures.words(spark, sf_dir), fixtures.diarization(spark, sf_dir))
    return out.select("transcript_id", "word_idx", "speaker")


_MAP = "SPEAKER_00=Interviewer, SPEAKER_01 = Participant ,SPEAKER_09=Nobody,bad,=x,y=,SPEAKER_00=Host"
_MAP_SQL = f"""mp0 AS (SELECT unnest(string_split({_quoted(_MAP)}, ',')) AS part, unnest(range(20)) AS pos),
mp1 AS (SELECT pos, trim(part[1:instr(part, '=') - 1]) AS id, trim(part[instr(part, '=') + 1:]) AS name FROM mp0 WHERE contains(part, '=')),
mp AS (SELECT id, arg_max(name, pos) AS name FROM mp1 WHERE id <> '' AND name <> '' GROUP BY 1)"""


def _mapping(spark: SparkSession) -> DataFrame:
    return mapping.parse_mapping(spark.createDataFrame([(_MAP,)], "arg string"))


@query(_WORDS + ", " + _MAP_SQL + " SELECT transcript_id, word_idx, coalesce(name, speaker) AS speaker FROM words LEFT JOIN mp ON speaker = id")
def speaker_mapping_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.apply_mapping(fixtures.words(spark, sf_dir), _mapping(spark)).select("transcript_id", "word_idx", "speaker")


@query(
    _WORDS + ", " + _MAP_SQL
    + """, sp AS (SELECT DISTINCT speaker AS id FROM words WHERE speaker <> '')
SELECT 'unmapped' AS issue, id AS value FROM sp WHERE id NOT IN (SELECT id FROM mp) UNION ALL SELECT 'extra', id FROM mp WHERE id NOT IN (SELECT id FROM sp)
UNION ALL SELECT 'duplicate', name FROM mp GROUP BY name HAVING count(*) > 1"""
)
def speaker_mapping_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.validate_mapping(fixtures.words(spark, sf_dir), _mapping(spark))


@query(
    _WORDS
    + """, f AS (SELECT DISTINCT transcript_id, speaker FROM words WHERE speaker <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY speaker) AS n FROM f)
SELECT transcript_id, speaker, CASE n WHEN 1 THEN 'Interviewer' WHEN 2 THEN 'Participant' ELSE 'Speaker ' || n END AS suggested FROM n"""
)
def default_speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.default_names(fixtures.words(spark, sf_dir))


@query(
    _WORDS
    + """ SELECT transcript_id, CASE WHEN coalesce(bool_and(starts_with(lower(nullif(speaker, '')), 'speaker_') OR lower(nullif(speaker, '')) = 'unknown'), true) THEN 'combined_audio'
  WHEN bool_or(contains(lower(speaker), 'interviewer') OR contains(lower(speaker), 'participant') OR contains(lower(speaker), 'speaker')) THEN 'split_audio' END AS mode FROM words GROUP BY 1"""
)
def checkpoint_mode_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.infer_mode(fixtures.words(spark, sf_dir))


@query(_WORDS + " SELECT transcript_id, count(*) FILTER (speaker <> '') > 0 AS valid, CASE WHEN count(*) FILTER (speaker <> '') BETWEEN 1 AND count(*) - 1 THEN printf('%.1f%%', count(*) FILTER (speaker <> '') / count(*) * 100) END AS partial FROM words GROUP BY 1")
def checkpoint_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.reentry_check(fixtures.words(spark, sf_dir))


@query(_WORDS + " SELECT transcript_id, count(*) AS n, round(min(start_s), 3) AS first_s, round(max(end_s), 3) AS last_s FROM words WHERE start_s >= 10 AND end_s <= 100 GROUP BY 1")
def range_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = segments.restrict_range(fixtures.words(spark, sf_dir), 10.0, 100.0)
    return kept.groupBy("transcript_id").agg(F.count("*").alias("n"), F.round(F.min("start_s"), 3).alias("first_s"), F.round(F.max("end_s"), 3).alias("last_s"))


@query(_WORDS + " SELECT transcript_id, word_idx, round(start_s + 12.5, 6) AS start_s, round(end_s + 12.5, 6) AS end_s FROM words")
def shift_to_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.words(spark, sf_dir).select("transcript_id", "word_idx", F.round(F.col("start_s") + 12.5, 6).alias("start_s"), F.round(F.col("end_s") + 12.5, 6).alias("end_s"))


@query(
    _WORDS
    + """ SELECT transcript_id, word_idx, greatest(start_s, 5.0) AS start_s, least(end_s, 90.0) AS end_s FROM words
WHERE lower(text) NOT IN ('', '<eps>', 'sil', 'sp', 'spn') AND end_s - start_s >= 0.01::DOUBLE AND greatest(start_s, 5.0) < least(end_s, 90.0)"""
)
def aligner_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.sources.textgrid import clamp_words

    return clamp_words(fixtures.words(spark, sf_dir), 5.0, 90.0).select("transcript_id", "word_idx", "start_s", "end_s")


# --- grids ----------------------------------------------------------------------------------------


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT transcript_id, count(*) AS n FROM spoken GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 400 THEN 0 ELSE greatest(0, CAST(floor((n - 600) / 330) AS INT) + 1) END AS last FROM n)
SELECT transcript_id, n, CAST(c AS INT) AS chunk, CAST(c * 330 AS BIGINT) AS from_word, CAST(CASE WHEN c < last THEN c * 330 + 400 ELSE n END AS BIGINT) AS to_word FROM (SELECT *, unnest(range(last + 1)) AS c FROM k) q"""
)
def word_chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(F.count("*").alias("n"))
    return chunks.word_grid(sizes)


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT transcript_id, count(*) AS n FROM spoken GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 400 THEN 0 ELSE greatest(0, CAST(floor((n - 600) / 330) AS INT) + 1) END AS last FROM n),
g AS (SELECT *, unnest(range(last + 1)) AS c FROM k)
SELECT g.transcript_id, CAST(c AS INT) AS chunk, count(*) AS n_words, min(word_idx) AS first_word, max(word_idx) AS last_word FROM g JOIN spoken s ON s.transcript_id = g.transcript_id AND word_idx >= c * 330 AND word_idx < CASE WHEN c < last THEN c * 330 + 400 ELSE n END GROUP BY 1, 2"""
)
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.chunk_words(fixtures.spoken_words(spark, sf_dir))
    return out.groupBy("transcript_id", "chunk").agg(F.count("*").alias("n_words"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"))


_SECONDS = "SELECT transcript_id, max(end_s) AS seconds FROM spoken GROUP BY 1"


@query(
    f"WITH {fixtures.oracle('spoken')}, n AS ({_SECONDS})"
    + """, k AS (SELECT *, greatest(0, CAST(ceil((seconds - 60) / 56) AS INT)) AS fl FROM n), l AS (SELECT *, CASE WHEN fl > 0 AND seconds - fl * 56 < 7 THEN fl - 1 ELSE fl END AS last FROM k)
SELECT transcript_id, seconds, CAST(c AS INT) AS chunk, c * 56.0::DOUBLE AS from_s, CASE WHEN c < last THEN c * 56.0::DOUBLE + 60 ELSE seconds END AS to_s FROM (SELECT *, unnest(range(last + 1)) AS c FROM l) q"""
)
def audio_chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.second_grid(fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(F.max("end_s").alias("seconds")))


@query(
    f"WITH {fixtures.oracle('spoken')}, n AS ({_SECONDS})"
    + """, k AS (SELECT *, CAST(floor(seconds / 25.0::DOUBLE) AS INT) AS whole, seconds - CAST(floor(seconds / 25.0::DOUBLE) AS INT) * 25.0::DOUBLE AS rest FROM n),
l AS (SELECT *, CASE WHEN seconds <= 50 THEN 1 ELSE whole + CASE WHEN rest >= 7 THEN 1 ELSE 0 END END AS n FROM k)
SELECT transcript_id, CAST(c AS INT) AS chunk, CASE WHEN n = 1 OR c = 0 THEN 0.0::DOUBLE WHEN c >= whole THEN c * 25.0::DOUBLE ELSE c * 25.0::DOUBLE - 4 END AS from_s,
  CASE WHEN n = 1 OR c = n - 1 THEN seconds ELSE c * 25.0::DOUBLE + 25 END AS to_s FROM (SELECT *, unnest(range(n)) AS c FROM l) q"""
)
def long_segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(F.lit(0.0).alias("start_s"), F.max("end_s").alias("end_s"))
    return chunks.segment_chunks(segs).select("transcript_id", "chunk", "from_s", "to_s")


@query(f"WITH {fixtures.oracle('spoken')}, n AS ({_SECONDS}) SELECT transcript_id, seconds, seconds >= 60 AS long_enough FROM n")
def minimum_length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(F.max("end_s").alias("seconds"))
    return audio.withColumn("long_enough", chunks.long_enough(F.col("seconds")))


_CUES = """, b AS (SELECT *, CASE WHEN word_idx = 0 OR lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM words WINDOW w AS (PARTITION BY transcript_id ORDER BY word_idx)),
r AS (SELECT *, sum(b) OVER (PARTITION BY transcript_id ORDER BY word_idx) AS run FROM b),
q AS (SELECT *, (row_number() OVER (PARTITION BY transcript_id, run ORDER BY word_idx) - 1) // 3 AS k FROM r),
cues AS (SELECT transcript_id, run, k, min(speaker) AS speaker, arg_min(start_s, word_idx) AS start_s, arg_max(end_s, word_idx) AS end_s, string_agg(CASE WHEN text = '[REDACTED]' THEN '______' ELSE text END, ' ' ORDER BY word_idx) AS text, min(word_idx) AS first_word FROM q GROUP BY 1, 2, 3)"""


@query(_WORDS + _CUES + " SELECT transcript_id, speaker, start_s, end_s, text, first_word FROM cues")
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators.cues import subtitle_cues as cues

    return cues(fixtures.words(spark, sf_dir)).select("transcript_id", "speaker", "start_s", "end_s", "text", "first_word")


# --- speech segments ------------------------------------------------------------------------------

_VAD = (
    f"WITH {fixtures.oracle('words', 'vad')}"
    + """, v1 AS (SELECT *, end_s - start_s AS d, start_s - lag(end_s) OVER w AS g, lag(end_s - start_s) OVER w AS p, lag(end_s) OVER w AS pe FROM vad WINDOW w AS (PARTITION BY transcript_id ORDER BY start_s, end_s)),
v2 AS (SELECT *, CASE WHEN g IS NULL THEN 1 WHEN g < 0.5::DOUBLE THEN 0 WHEN g >= 5 THEN 1 WHEN (p < 0.5::DOUBLE OR d < 0.5::DOUBLE) AND p + d >= 1 THEN 0
  WHEN g < 2 AND ((p < 3 AND d < 3) OR g < (p + d) / 2 * 0.5::DOUBLE) THEN 0 ELSE 1 END AS b FROM v1),
v AS (SELECT *, sum(b) OVER (PARTITION BY transcript_id ORDER BY start_s, end_s) AS grp FROM v2)"""
)


@query(_VAD + ' SELECT transcript_id, CAST(grp AS BIGINT) AS "group", min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_segments FROM v GROUP BY 1, 2')
def vad_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.combined(fixtures.speech(spark, sf_dir))


_SCORES = (
    _VAD
    + """, x AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER g0 AS n, start_s - lag(end_s) OVER w AS gap, min(start_s) OVER g0 AS gs, max(end_s) OVER g0 AS ge FROM v
  WINDOW w AS (PARTITION BY transcript_id, grp ORDER BY start_s, end_s), g0 AS (PARTITION BY transcript_id, grp)),
y AS (SELECT *, lag(gap) OVER w AS gp, lead(gap) OVER w AS gn, start_s - gs AS l, ge - start_s AS r FROM x WINDOW w AS (PARTITION BY transcript_id, grp ORDER BY start_s, end_s)),
z AS (SELECT transcript_id, CAST(grp AS BIGINT) AS "group", CAST(idx AS INT) AS idx, gap, l, r, 0.4::DOUBLE * least(l, r) / greatest(l, r) + 0.3::DOUBLE * least(gap / 1.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * greatest(0.0::DOUBLE,
  CASE WHEN idx > 1 THEN 0.1::DOUBLE * (gap - gp) ELSE 0 END + CASE WHEN idx < n - 1 THEN 0.1::DOUBLE * (gap - gn) ELSE 0 END) AS score FROM y WHERE idx > 0)"""
)


@query(_SCORES + ' SELECT transcript_id, "group", idx, round(gap, 6) AS gap, round(score, 6) AS score FROM z')
def vad_split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = vad.split_scores(vad.combine(fixtures.speech(spark, sf_dir)))
    return scores.select("transcript_id", "group", "idx", F.round("gap", 6).alias("gap"), F.round("score", 6).alias("score"))


_LONG_SCORES = _SCORES.replace(fixtures.oracle("words", "vad"), fixtures.oracle("words", "long")).replace("FROM vad WINDOW", "FROM long WINDOW")


@query(
    _LONG_SCORES.replace("WITH", "WITH RECURSIVE", 1)
    + """, o AS (SELECT transcript_id, "group", idx, row_number() OVER (PARTITION BY transcript_id, "group" ORDER BY score DESC, idx) AS k FROM z WHERE gap >= 0.6::DOUBLE AND l >= 5 AND r >= 5),
t AS (SELECT transcript_id, "group", 0::BIGINT AS k, []::INT[] AS points FROM o WHERE k = 1
  UNION ALL SELECT o.transcript_id, o."group", o.k, CASE WHEN len(points) < 3 AND o.idx - coalesce(points[len(points)], 0) >= 2 THEN list_append(points, o.idx) ELSE points END
  FROM t JOIN o ON o.transcript_id = t.transcript_id AND o."group" = t."group" AND o.k = t.k + 1)
SELECT transcript_id, "group", array_to_string(arg_max(points, k), ',') AS points FROM t GROUP BY 1, 2"""
)
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vad.split_points(vad.split_scores(vad.combine(fixtures.long_speech(spark, sf_dir))))
    return points.select("transcript_id", "group", F.concat_ws(",", F.transform("points", lambda p: p.cast("string"))).alias("points"))


@query(_VAD + " SELECT transcript_id, pe AS from_s, start_s AS to_s, round(start_s - pe, 6) AS silence_s FROM v WHERE pe < start_s")
def non_speech_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.silences(fixtures.speech(spark, sf_dir))


@query(
    _VAD
    + """ SELECT transcript_id, count(*) AS n_segments, round(CAST(sum(CAST(end_s - start_s AS DECIMAL(18, 3))) AS DOUBLE), 3) AS speech_s, max(end_s) AS end_s,
  round(round(CAST(sum(CAST(end_s - start_s AS DECIMAL(18, 3))) AS DOUBLE), 3) / max(end_s) * 100, 1) AS speech_percent FROM v GROUP BY 1"""
)
def vad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.summary(fixtures.speech(spark, sf_dir))


# --- redaction ------------------------------------------------------------------------------------

_NAMED = "lower(trim(text, '.,!?;:')) IN ('maria')"
_REDACTED_WORDS = _WORDS + f", rw AS (SELECT *, {_NAMED} AS replaced, CASE WHEN {_NAMED} THEN '{REDACTED}' ELSE text END AS new_text FROM words)"


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_listed(fixtures.words(spark, sf_dir), spark.createDataFrame([("Maria",)], "name string"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _redacted(spark, sf_dir).withColumn("chunk", F.floor(F.col("word_idx") / 20))
    line = lambda c: segments.joined(F.collect_list(F.struct("word_idx", F.col(c).alias("text"))))
    return rows.groupBy("transcript_id", "chunk").agg(line("text").alias("original"), line("new_text").alias("processed"))


_PAIRS_SQL = _REDACTED_WORDS + """, pr AS (SELECT transcript_id, word_idx // 20 AS chunk, string_agg(text, ' ' ORDER BY word_idx) AS original, string_agg(new_text, ' ' ORDER BY word_idx) AS processed,
  count(*) AS n, count(*) FILTER (replaced) AS k FROM rw GROUP BY 1, 2)"""


def _odd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which some lose a word, change one, or undo a redaction."""
    rows = _pairs(spark, sf_dir).withColumn("kind", F.pmod(F.col("chunk"), F.lit(5)))
    given = F.when(F.col("kind") == 3, F.concat(F.lit("[REDACTED] "), F.col("original"))).otherwise(F.col("original"))
    out = F.when(F.col("kind") == 1, F.concat(F.col("processed"), F.lit(" more"))).when(F.col("kind") == 2, F.replace("processed", F.lit("wow"), F.lit("WOW!")))
    out = out.when(F.col("kind") == 3, F.concat(F.lit("back "), F.replace("processed", F.lit("[REDACTED]"), F.lit("x")))).when(F.col("kind") == 4, F.upper(F.replace("processed", F.lit("[REDACTED]"), F.lit("maria"))))
    return rows.withColumns({"original": given, "processed": out.otherwise(F.col("processed"))}).drop("kind")


_ODD_SQL = _PAIRS_SQL + """, op AS (SELECT transcript_id, chunk, n, k, chunk % 5 AS kind, contains(' ' || processed || ' ', ' wow ') AS has_wow FROM pr),
vd AS (SELECT *, CASE kind WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE k END AS after, CASE kind WHEN 3 THEN 1 ELSE 0 END AS before, CASE kind WHEN 3 THEN n + 1 ELSE n END AS n_words FROM op)"""


@query(
    _ODD_SQL
    + """ SELECT transcript_id, chunk, after AS redacted, CASE WHEN kind = 1 THEN 'word_count' WHEN after > n_words * 0.1::DOUBLE THEN 'too_many_redactions'
  WHEN kind = 3 OR kind = 2 AND has_wow THEN 'changed_words' ELSE 'ok' END AS reason,
  NOT (kind = 1 OR after > n_words * 0.1::DOUBLE OR kind = 3 OR kind = 2 AND has_wow) AS passed FROM vd"""
)
def redaction_validate_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact.validate_first_pass(_odd_pairs(spark, sf_dir))
    return out.select("transcript_id", "chunk", F.col("redacted").cast("long").alias("redacted"), "reason", "passed")


@query(
    _ODD_SQL
    + """ SELECT transcript_id, chunk, after - before AS new_redactions, CASE WHEN kind = 1 THEN 'word_count' WHEN after < before THEN 'lost_redactions'
  WHEN after - before > (n_words - before) * 0.02::DOUBLE THEN 'too_many_new' ELSE 'ok' END AS reason,
  NOT (kind = 1 OR after < before OR after - before > (n_words - before) * 0.02::DOUBLE) AS passed FROM vd"""
)
def redaction_validate_pass2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact.validate_second_pass(_odd_pairs(spark, sf_dir))
    return out.select("transcript_id", "chunk", F.col("new_redactions").cast("long").alias("new_redactions"), "reason", "passed")


@query(_PAIRS_SQL + " SELECT transcript_id, count(*) AS chunks, count(*) FILTER (k <= n * 0.1::DOUBLE) AS passed, count(*) FILTER (k > n * 0.1::DOUBLE) AS failed, round(count(*) FILTER (k <= n * 0.1::DOUBLE) / count(*) * 100, 1) AS pass_rate FROM pr GROUP BY 1")
def redaction_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.session_stats(redact.validate_first_pass(_pairs(spark, sf_dir)))


@query(_WORDS + " SELECT transcript_id, string_agg(text, ' ' ORDER BY word_idx) AS text FROM words GROUP BY 1")
def redaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = chunks.chunk_words(fixtures.words(spark, sf_dir), 100, 30, 50)
    text = placed.groupBy("transcript_id", "chunk").agg(segments.joined(F.collect_list(F.struct("i", "text"))).alias("text"))
    return redact.merge_chunks(text, overlap=30)


@query(_REDACTED_WORDS + " SELECT transcript_id, word_idx, speaker, text AS original, start_s FROM rw WHERE replaced")
def redaction_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.replacements(_redacted(spark, sf_dir))


@query(_REDACTED_WORDS + " SELECT transcript_id, word_idx, new_text, replaced FROM rw")
def positional_word_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _redacted(spark, sf_dir)
    text = rows.groupBy("transcript_id").agg(segments.joined(F.collect_list(F.struct("word_idx", F.col("new_text").alias("text")))).alias("text"))
    return redact.zip_words(fixtures.words(spark, sf_dir), text).select("transcript_id", "word_idx", "new_text", "replaced")


@query(_REDACTED_WORDS + " SELECT DISTINCT transcript_id, trim(text) AS name FROM rw WHERE replaced")
def discovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.discovered_names(redact.replacements(_redacted(spark, sf_dir)))


@query(
    _WORDS
    + """, k AS (SELECT * FROM words WHERE text <> 'data'), g AS (SELECT trim(lower(text)) AS norm_name, arg_min(trim(text), (transcript_id, word_idx)) AS name, arg_min(speaker, (transcript_id, word_idx)) AS source_speaker, count(*) AS occurrences FROM k GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY occurrences DESC, lower(name)) AS INT) AS rank FROM g"""
)
def global_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.global_names(fixtures.words(spark, sf_dir).where("text <> 'data'").withColumnRenamed("text", "original"))


@query(
    _WORDS
    + """, k AS (SELECT * FROM words WHERE text <> 'data'), g AS (SELECT arg_min(trim(text), (transcript_id, word_idx)) AS name, count(*) AS n FROM k GROUP BY trim(lower(text)))
SELECT string_agg('- ' || name || CASE WHEN n > 1 THEN ' (appeared ' || n || ' times)' ELSE '' END, chr(10) ORDER BY n DESC, lower(name)) AS prompt FROM g"""
)
def name_prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.prompt_list(redact.global_names(fixtures.words(spark, sf_dir).where("text <> 'data'").withColumnRenamed("text", "original")))


@query(_WORDS + " SELECT transcript_id, word_idx, CASE lower(text) WHEN 'maria' THEN 'MARIA' WHEN 'wow' THEN 'Wow' WHEN 'what' THEN 'WHAT' ELSE upper(text) || '!' END AS matched FROM words")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shouted = fixtures.words(spark, sf_dir).withColumn("text", F.concat(F.upper("text"), F.lit("!")))
    return redact.restore_names(shouted, spark.createDataFrame([("MARIA",), ("Wow",), ("WHAT",), ("Nobody",)], "name string")).select("transcript_id", "word_idx", "matched")


@query(
    _REDACTED_WORDS
    + """, x AS (SELECT *, coalesce(string_agg(text, ' ') OVER (PARTITION BY transcript_id ORDER BY word_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY transcript_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS r FROM rw)
SELECT transcript_id, word_idx, trim(l || ' >>>' || text || '<<< ' || r) AS context FROM x WHERE replaced"""
)
def redaction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.context(_redacted(spark, sf_dir))


@query(
    _REDACTED_WORDS
    + """, b AS (SELECT transcript_id, text FROM rw WHERE replaced UNION ALL SELECT transcript_id, text FROM words WHERE text = 'wow'), f AS (SELECT transcript_id, count(*) AS replaced, count(DISTINCT lower(text)) AS names FROM b GROUP BY 1),
t AS (SELECT transcript_id, count(*) AS n_words FROM words GROUP BY 1)
SELECT transcript_id, n_words, coalesce(replaced, 0) AS replaced, coalesce(names, 0) AS names, round(coalesce(replaced, 0) / n_words * 100, 2) AS rate FROM t LEFT JOIN f USING (transcript_id)"""
)
def redaction_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixtures.words(spark, sf_dir)
    second = words.where("text = 'wow'").withColumnRenamed("text", "original")
    return redact.audit_summary(redact.replacements(_redacted(spark, sf_dir)), second, words)


@query(_REDACTED_WORDS + " SELECT transcript_id, string_agg(printf('between(t,%.3f,%.3f)', start_s, end_s), '+' ORDER BY start_s, word_idx) AS mute FROM rw WHERE replaced GROUP BY 1")
def mute_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.mute_ranges(_redacted(spark, sf_dir))


# --- text and format ------------------------------------------------------------------------------


@query("SELECT conv_id, turn, trim(p) AS sentence, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(replace(text, chr(10), ' '), '([.!?])', '\\1\x01', 'g'), '\x01')) AS p FROM conversations) q WHERE trim(p) <> '' GROUP BY 1, 2, 3")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return rows.select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("sentence")).groupBy("conv_id", "turn", "sentence").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Unknown' WHEN turn % 4 = 1 THEN upper(role[1]) || lower(role[2:]) || ' One-two_3' ELSE upper(role[1]) || lower(role[2:]) END AS label FROM conversations"""
)
def speaker_label_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 4
    given = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit(" <"), F.upper("role"), F.lit(">  oNE-two_3 "))).otherwise(F.concat(F.lit(" "), F.col("role"), F.lit("!")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.speaker_label(given).alias("label"))


@query("SELECT conv_id, turn, replace('‘' || text || '…', '‘', '''').replace('…', '...') AS text FROM conversations")
def special_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.special_characters(F.concat(F.lit("‘"), F.col("text"), F.lit("…"))).alias("text"))


@query("SELECT conv_id, turn, 'said then ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' end' AS text FROM conversations")
def clean_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = F.concat(F.lit('user: “said” AI Assistant:\n then "'), F.col("text"), F.lit('"  ASSISTANT: end '))
    return rows.select("conv_id", "turn", tx.clean_transcript(given).alias("text"))


_STAMP = "printf('%02d:%02d:%02d{}%03d', CAST(floor(start_s) AS BIGINT) // 3600, CAST(floor(start_s) AS BIGINT) // 60 % 60, CAST(floor(start_s) AS BIGINT) % 60, CAST(round((start_s - floor(start_s)) * 1000) AS BIGINT))"


@query(_WORDS + f" SELECT transcript_id, word_idx, {_STAMP.format('.')} AS hms, {_STAMP.format(',')} AS srt, printf('%.2fs', start_s) AS seconds FROM words")
def timestamp_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("start_s")
    return fixtures.words(spark, sf_dir).select("transcript_id", "word_idx", fmt.timestamp(at).alias("hms"), fmt.timestamp(at, "srt").alias("srt"), fmt.timestamp(at, "seconds").alias("seconds"))


@query(
    """WITH d AS (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS t FROM events), p AS (SELECT event_id, t // 3600 AS h, t // 60 % 60 AS m, t % 60 AS s FROM d)
SELECT event_id, concat_ws(' ', CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h <> 1 THEN 's' ELSE '' END END, CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m <> 1 THEN 's' ELSE '' END END,
  CASE WHEN s > 0 OR (h = 0 AND m = 0) THEN s || ' second' || CASE WHEN s <> 1 THEN 's' ELSE '' END END) AS duration FROM p"""
)
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fmt.duration(F.floor(F.col("value") * 40).cast("double")).alias("duration"))


_SIM = """CASE WHEN x = y THEN 1.0::DOUBLE WHEN starts_with(x, y) OR starts_with(y, x) THEN 0.7::DOUBLE + 0.2::DOUBLE * least(length(x), length(y)) / greatest(length(x), length(y))
  WHEN greatest(length(x), length(y)) - least(length(x), length(y)) > greatest(length(x), length(y)) // 2 THEN 0 WHEN 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.6::DOUBLE THEN 1 - levenshtein(x, y) / greatest(length(x), length(y)) ELSE 0 END"""


@query(
    f"""WITH n AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS x, lower(regexp_replace(lag(c_name) OVER (ORDER BY c_custkey), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS y FROM customer)
SELECT c_custkey, round({_SIM}, 6) AS similarity FROM n WHERE y IS NOT NULL"""
)
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    before = rows.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return rows.join(before, "c_custkey").select("c_custkey", F.round(tx.word_similarity(F.col("c_name"), F.col("other")), 6).alias("similarity"))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS transcript_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, turn * 10.0::DOUBLE AS s FROM conversations),
u AS (SELECT transcript_id, len(w) AS n, s, unnest(w) AS word, unnest(range(len(w))) AS i FROM t)
SELECT transcript_id, CAST(i AS INT) AS word_idx, word, round(s + i * (30.0::DOUBLE / n), 6) AS start_s, round(s + i * (30.0::DOUBLE / n) + 30.0::DOUBLE / n, 6) AS end_s FROM u WHERE word <> ''"""
)
def even_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("transcript_id"), "text", (F.col("turn") * F.lit(10.0)).alias("start_s"), F.lit(30.0).alias("duration_s"))
    return align.even_alignment(given)


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, m AS (SELECT *, greatest(100.0::DOUBLE, length(text) / sum(length(text)) OVER (PARTITION BY transcript_id) * 60000.0::DOUBLE) AS ms FROM spoken),
e AS (SELECT *, sum(ms) OVER (PARTITION BY transcript_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS e FROM m)
SELECT transcript_id, word_idx, text, round((e - ms) / 1000 + 1e-9, 2) AS start_s, round(e / 1000 + 1e-9, 2) AS end_s FROM e"""
)
def proportional_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.proportional_alignment(fixtures.spoken_words(spark, sf_dir).withColumn("total_ms", F.lit(60000.0)))


@query(
    f"WITH {fixtures.oracle('words', 'vad')}"
    + """, g AS (SELECT transcript_id * 100000 + row_number() OVER w AS gap_id, lag(end_s) OVER w AS a, start_s AS b FROM vad WINDOW w AS (PARTITION BY transcript_id ORDER BY start_s, end_s)),
k AS (SELECT *, unnest(['a', 'b', 'c']) AS word, unnest([0, 1, 2]) AS i, CASE WHEN b - a > 0 THEN (b - a) / 3 ELSE 0.02::DOUBLE END AS step FROM g WHERE a IS NOT NULL)
SELECT gap_id, CAST(i AS INT) AS i, word, round(a + i * step, 6) AS start_s, round(a + i * step + step, 6) AS end_s FROM k"""
)
def interpolated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.speech(spark, sf_dir)
    gaps = rows.select((F.col("transcript_id") * 100000 + F.row_number().over(vad.by_time())).cast("long").alias("gap_id"), F.lag("end_s").over(vad.by_time()).alias("prev_end"), F.col("start_s").alias("next_start"))
    return align.interpolate(gaps.where("prev_end IS NOT NULL").withColumn("words", F.array(F.lit("a"), F.lit("b"), F.lit("c"))))


@query(
    _TURNS
    + """, o2 AS (SELECT *, min(start_s) OVER (PARTITION BY transcript_id) AS t0, max(end_s) OVER (PARTITION BY transcript_id) - min(start_s) OVER (PARTITION BY transcript_id) AS total FROM turns)
SELECT transcript_id, turn, round(greatest(0, least(100, (start_s - t0) / total * 100)), 3) AS left_percent, printf('%.1f%%', flow * 100) AS flow_percent FROM o2"""
)
def timeline_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.sources.writers import timeline_layout

    return timeline_layout(_turns(spark, sf_dir)).select("transcript_id", "turn", F.round("left_percent", 3).alias("left_percent"), fmt.percentage(F.col("flow")).alias("flow_percent"))


@query(
    _TURNS
    + f""", i AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn) AS i FROM turns)
SELECT transcript_id, turn, CAST(i AS VARCHAR) || chr(10) || {_STAMP.format(",")} || ' --> ' || {_STAMP.format(",").replace("start_s", "greatest(start_s, end_s)")} || chr(10) || speaker || ': ' || text || chr(10) AS line FROM i"""
)
def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.sources.writers import srt_blocks

    return srt_blocks(_turns(spark, sf_dir))


@query(_TURNS + f" SELECT transcript_id, turn, '[' || {_STAMP.format('.')} || '] ' || speaker || ': ' || text AS line FROM turns")
def timestamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.sources.writers import timestamped_lines as lines

    return lines(_turns(spark, sf_dir))


# --- folds: no SQL form ---------------------------------------------------------------------------


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = chunks.chunk_words(fixtures.words(spark, sf_dir), 60, 10, 20)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    return placed.groupBy("transcript_id", "chunk").agg(ordered.alias("words"))


def _heard_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations; what a chunk repeats of the one before is heard in other words here and there, differently by chunk."""
    placed = chunks.chunk_words(fixtures.spoken_words(spark, sf_dir), 60, 10, 20).where("NOT (chunk % 5 = 2 AND i = 4)")
    kind, again = F.col("chunk") % 5, (F.col("chunk") > 0) & (F.col("i") < 10)
    odd = F.when(again & (kind == 1) & (F.col("i") % 3 == 1), F.concat("text", F.lit("s"))).when(again & (kind == 2) & (F.col("i") < 3), F.lit("um")).when(again & (kind == 3) & (F.col("i") > 0), F.concat(F.lit("q"), F.reverse("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(odd, "text").alias("text")))), lambda x: x["text"])
    return placed.groupBy("transcript_id", "chunk").agg(ordered.alias("words"))


@query()
def stitch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.stitch_chunks(_heard_chunks(spark, sf_dir)).select("transcript_id", F.size("words").alias("n_words"), "skipped", F.array_join("words", " ").alias("text"))


@query()
def stitch_pair_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _heard_chunks(spark, sf_dir)
    pairs = parts.join(parts.select("transcript_id", (F.col("chunk") - 1).alias("chunk"), F.col("words").alias("right")), ["transcript_id", "chunk"]).withColumnRenamed("words", "left")
    return align.stitch_methods(pairs).select("transcript_id", "chunk", "n", "rule")


_IN_ORDER = f"WITH RECURSIVE {fixtures.oracle('words')}, wm AS MATERIALIZED (SELECT * FROM words)"


_REPAIRED = (
    _IN_ORDER
    + """, r AS (SELECT transcript_id, word_idx, text, start_s AS s, greatest(end_s, start_s + 0.02::DOUBLE) AS e, NULL::DOUBLE AS cut FROM wm WHERE word_idx = 0
  UNION ALL SELECT transcript_id, word_idx, text, coalesce(cut, start_s), greatest(end_s, coalesce(cut, start_s) + 0.02::DOUBLE), cut FROM (
    SELECT w.*, CASE WHEN w.start_s < r.e THEN CASE WHEN (w.start_s + r.e) / 2 >= r.s THEN (w.start_s + r.e) / 2 ELSE r.s + 0.01::DOUBLE END END AS cut
    FROM r JOIN wm w ON w.transcript_id = r.transcript_id AND w.word_idx = r.word_idx + 1) n),
rp AS (SELECT transcript_id, word_idx, text, s AS start_s, coalesce(lead(cut) OVER (PARTITION BY transcript_id ORDER BY word_idx), e) AS end_s FROM r)"""
)


@query(_REPAIRED + " SELECT * FROM rp")
def monotonic_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.repair_order(fixtures.words(spark, sf_dir))


@query(
    _IN_ORDER
    + """, r AS (SELECT transcript_id, word_idx, text, greatest(start_s, 0.0::DOUBLE) AS s, CASE WHEN end_s < start_s THEN start_s + 0.01::DOUBLE ELSE end_s END AS e FROM wm WHERE word_idx = 0
  UNION ALL SELECT w.transcript_id, w.word_idx, w.text, greatest(w.start_s, r.e), CASE WHEN w.end_s < greatest(w.start_s, r.e) THEN greatest(w.start_s, r.e) + 0.01::DOUBLE ELSE w.end_s END
  FROM r JOIN wm w ON w.transcript_id = r.transcript_id AND w.word_idx = r.word_idx + 1)
SELECT transcript_id, word_idx, text, s AS start_s, e AS end_s FROM r"""
)
def vad_stitch_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.clamp_order(fixtures.words(spark, sf_dir))


# Sentences ``s`` (numbered ``i``) of rows ``key``, packed to pieces of ``{limit}`` words.
_PACKED = """sn AS MATERIALIZED (SELECT key, s, row_number() OVER (PARTITION BY key ORDER BY pos) AS i, len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) AS n
  FROM (SELECT key, trim(unnest(p)) AS s, unnest(range(len(p))) AS pos FROM (SELECT key, string_split_regex(regexp_replace(text, '([.!?])', '\\1\x01', 'g'), '\x01') AS p FROM lines) a) b WHERE s <> ''),
pk AS (SELECT key, s, i, n AS total, 0 AS piece FROM sn WHERE i = 1
  UNION ALL SELECT sn.key, sn.s, sn.i, CASE WHEN pk.total + sn.n > {limit} THEN sn.n ELSE pk.total + sn.n END, CASE WHEN pk.total + sn.n > {limit} THEN pk.piece + 1 ELSE pk.piece END
  FROM pk JOIN sn ON sn.key = pk.key AND sn.i = pk.i + 1)"""


@query(
    "WITH RECURSIVE lines AS (SELECT conv_id * 10000 + turn AS key, text FROM conversations), "
    + _PACKED.format(limit=30)
    + " SELECT key // 10000 AS conv_id, key % 10000 AS turn, CAST(piece AS INT) AS piece, string_agg(s, ' ' ORDER BY i) AS text FROM pk GROUP BY key, piece"
)
def greedy_sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("sentences", tx.sentences(F.col("text")))
    return align.pack_sentences(rows, 30).select("conv_id", "turn", F.posexplode("pieces").alias("piece", "text"))


_CHUNKED = """n AS (SELECT transcript_id, count(*) AS n FROM words GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 60 THEN 0 ELSE greatest(0, CAST(floor((n - 80) / 50) AS INT) + 1) END AS last FROM n),
g AS (SELECT *, unnest(range(last + 1)) AS c FROM k),
pl AS (SELECT g.transcript_id, CAST(c AS INT) AS chunk, w.*, word_idx - c * 50 AS i FROM g JOIN words w ON w.transcript_id = g.transcript_id AND word_idx >= c * 50 AND word_idx < CASE WHEN c < last THEN c * 50 + 60 ELSE n END)"""


@query(
    f"WITH RECURSIVE {fixtures.oracle('words')}, {_CHUNKED}"
    + """, c0 AS MATERIALIZED (SELECT transcript_id, chunk, list(text ORDER BY i) AS o, list(CASE WHEN i % 7 = 3 THEN '<unk>' ELSE upper(text) END ORDER BY i) FILTER (i % 11 <> 5) AS a FROM pl GROUP BY 1, 2),
r AS (SELECT transcript_id, chunk, o, a, 0 AS k, 0 AS p, []::VARCHAR[] AS out FROM c0
  UNION ALL SELECT transcript_id, chunk, o, a, k + 1, p + CASE WHEN p < len(o) AND (a[k + 1] = '<unk>' OR lower(a[k + 1]) = lower(o[p + 1])) THEN 1 ELSE 0 END,
    list_append(out, CASE WHEN a[k + 1] = '<unk>' AND p < len(o) THEN o[p + 1] ELSE a[k + 1] END) FROM r WHERE k < len(a))
SELECT transcript_id, chunk, array_to_string(out, ' ') AS text FROM r WHERE k = len(a)"""
)
def unk_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.transform(F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["i"] % 11 != 5), lambda x: F.when(x["i"] % 7 == 3, "<unk>").otherwise(F.upper(x["w"])))
    rows = _chunked(spark, sf_dir).withColumn("aligned", heard)
    out = align.fill_unknown(rows.withColumn("original", F.col("words")))
    return out.select("transcript_id", "chunk", F.array_join("filled", " ").alias("text"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("transcript_id", "chunk", F.split("original", " ").alias("original"), F.split("processed", " ").alias("processed"))
    return align.word_diff(rows).select("transcript_id", "chunk", F.explode("diff").alias("d")).select("transcript_id", "chunk", "d.*")


from colloquy.plans import further, small, timed  # noqa: E402, F401  register their queries
