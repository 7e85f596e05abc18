"""Registered queries on attempts, outputs, and the small forms of texts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import format as fmt
from colloquy.functions import text as tx
from colloquy.operators import attempts, blocks, cues, mapping, redact, turns
from colloquy.operators.segments import joined
from colloquy.plans import fixtures
from colloquy.plans.further import _GRID
from colloquy.plans.queries import _ASSIGNED, _REDACTED_WORDS, _STAMP, _TURNS, _WORDS, ORACLE_SQL, _assigned, _flat, _redacted, _turns, query
from colloquy.sources import writers
from colloquy.work import new_path

# --- attempts -------------------------------------------------------------------------------------

_TRIED = (
    _WORDS
    + ", "
    + _GRID.format(1, "transcript_id", "words")
    + """, ch AS (SELECT w.transcript_id, c, count(*) AS n, min(word_idx) AS from_word, max(word_idx) AS to_word, count(*) FILTER (text = 'Maria') AS few, count(*) FILTER (text IN ('Maria', 'wow', 'what')) AS many
  FROM g1 JOIN words w ON w.transcript_id = g1.transcript_id AND word_idx >= c * 70 AND word_idx < CASE WHEN c < last THEN c * 70 + 100 ELSE n END GROUP BY ALL),
a4 AS (SELECT *, unnest([1, 2, 3, 4]) AS attempt FROM ch), av AS (SELECT *, CASE WHEN attempt < 3 AND c % 3 >= attempt THEN many ELSE few END AS redacted FROM a4),
ap AS (SELECT *, redacted <= n * 0.25::DOUBLE AS passed FROM av),
ar AS (SELECT *, coalesce(max(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id, c ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM ap)"""
)


def _tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewriter that redacts too much at first, by chunk."""

    def rewrite(placed: DataFrame, attempt: int) -> DataFrame:
        greedy = (F.lit(attempt) < 3) & (F.col("chunk") % 3 >= attempt)
        hit = (F.col("text") == "Maria") | greedy & F.col("text").isin("wow", "what")
        return placed.withColumn("new_text", F.when(hit, redact.REDACTED).otherwise(F.col("text")))

    return attempts.attempts(fixtures.words(spark, sf_dir), rewrite, lambda p: redact.validate_first_pass(p, 0.25), 1, 4, 100, 30, 50)


@query(
    _TRIED
    + """ SELECT 1 AS pass, transcript_id, CAST(c AS INT) AS chunk, CAST(attempt AS INT) AS attempt, from_word, to_word, CAST(n AS INT) AS input_words, CAST(n AS INT) AS output_words, passed,
  CASE WHEN passed THEN 'ok' ELSE 'too_many_redactions' END AS reason FROM ar WHERE closed = 0"""
)
def redaction_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a table by pass and chunk and read back."""
    rows, path = _tries(spark, sf_dir), new_path(spark, "attempts")
    attempts.write_attempts(rows, path)
    return attempts.read_attempts(rows, path).select("pass", "transcript_id", "chunk", "attempt", "from_word", "to_word", "input_words", "output_words", "passed", "reason")


@query(_TRIED + " SELECT 1 AS pass, transcript_id, CAST(c AS INT) AS chunk, CAST(max(attempt) AS INT) AS attempts, bool_or(passed) AS passed, CASE WHEN bool_or(passed) THEN max(redacted) FILTER (passed) ELSE 0 END AS redacted FROM ar WHERE closed = 0 GROUP BY transcript_id, c")
def redaction_attempts_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = attempts.last_words(_tries(spark, sf_dir))
    return last.select("pass", "transcript_id", "chunk", "attempts", "passed", F.size(F.filter(F.split("text", " "), lambda w: w == redact.REDACTED)).cast("long").alias("redacted"))


# --- outputs --------------------------------------------------------------------------------------


@query(
    _TURNS
    + f""", i AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn) AS i, CASE WHEN lag(speaker) OVER (PARTITION BY transcript_id ORDER BY turn) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM turns),
g AS (SELECT *, sum(b) OVER (PARTITION BY transcript_id ORDER BY turn) AS p FROM i), pg AS (SELECT transcript_id, p, min(speaker) || ': ' || string_agg(text, ' ' ORDER BY turn) AS t FROM g GROUP BY ALL)
SELECT transcript_id, 'timestamped-txt' AS format, string_agg('[' || {_STAMP.format('.')} || '] ' || speaker || ': ' || text, chr(10) ORDER BY turn) AS content FROM i GROUP BY 1
UNION ALL SELECT transcript_id, 'plain-txt', string_agg(t, chr(10) || chr(10) ORDER BY p) FROM pg GROUP BY 1
UNION ALL SELECT transcript_id, 'srt', string_agg(CAST(i AS VARCHAR) || chr(10) || {_STAMP.format(',')} || ' --> ' || {_STAMP.format(',').replace('start_s', 'greatest(start_s, end_s)')} || chr(10) || speaker || ': ' || text || chr(10), chr(10) ORDER BY turn) FROM i GROUP BY 1"""
)
def output_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.all_contents(_turns(spark, sf_dir), ["timestamped-txt", "plain-txt", "srt"])


@query(
    _TURNS
    + """, j AS (SELECT transcript_id, count(*) AS total_turns, CAST(sum(n_words) AS BIGINT) AS total_words, list(DISTINCT nullif(speaker, '') ORDER BY nullif(speaker, '')) AS speakers,
  list({'speaker': speaker, 'start': start_s, 'end': end_s, 'text': text} ORDER BY turn) AS turns FROM turns GROUP BY 1)
SELECT transcript_id, CAST(to_json({'metadata': {'total_turns': total_turns, 'total_words': total_words, 'speakers': speakers, 'format_version': '1.0'}, 'turns': turns}) AS VARCHAR) AS content FROM j"""
)
def turns_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.turns_json(_turns(spark, sf_dir))


@query(f"WITH {fixtures.oracle('spoken')} SELECT transcript_id, string_agg(text, ' ' ORDER BY word_idx) AS content FROM spoken WHERE trim(text) <> '' GROUP BY 1")
def word_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.word_text(fixtures.spoken_words(spark, sf_dir))


@query("SELECT conv_id AS transcript_id, i AS line, w AS word FROM (SELECT conv_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, list_filter(string_split_regex(string_agg(text, ' ' ORDER BY turn), '\\s+'), lambda x: x <> '') AS l FROM conversations GROUP BY 1) q) r")
def word_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "transcript_id")
    said = rows.groupBy("transcript_id").agg(joined(F.collect_list(F.struct("turn", "text"))).alias("text"))
    return writers.word_csv(said).withColumn("line", F.col("line").cast("long"))


# --- small forms ----------------------------------------------------------------------------------


@query(
    _ASSIGNED
    + """, r AS (SELECT *, CASE speaker WHEN 'SPEAKER_00' THEN 'Interviewer' ELSE speaker END AS who FROM t)
SELECT transcript_id, turn, arg_min(who, seg) FILTER (is_primary) AS speaker, coalesce(string_agg(who, ',' ORDER BY start_s, seg) FILTER (NOT is_primary), '') AS inner_speakers FROM r GROUP BY 1, 2"""
)
def renamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = mapping.rename_turns(_turns(spark, sf_dir), {"SPEAKER_00": "Interviewer", "SPEAKER_07": "Nobody"})
    return named.select("transcript_id", "turn", "speaker", F.array_join(F.transform("interjections", lambda x: x["speaker"]), ",").alias("inner_speakers"))


@query(_REDACTED_WORDS + " SELECT transcript_id, word_idx, CASE WHEN replaced THEN '______' ELSE text END AS shown FROM rw")
def displayed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).select("transcript_id", "word_idx", cues.shown(F.col("new_text")).alias("shown"))


@query(
    """WITH g AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN text || ', Make sure to include disfluencies. ' || text WHEN 1 THEN 'Can you transcribe the speech into a written format: ' || text WHEN 2 THEN text || ' . ,' ELSE text END AS said FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN trim(said) ELSE trim(rtrim(text, ' .,' || chr(10) || chr(9))) END AS text FROM g"""
)
def prompt_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("turn") % 4, F.col("text")
    said = F.when(kind == 0, F.concat(text, F.lit(", Make sure to include disfluencies. "), text)).when(kind == 1, F.concat(F.lit("Can you transcribe the speech into a written format: "), text)).when(kind == 2, F.concat(text, F.lit(" . ,"))).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.strip_prompt(said).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(trim(regexp_replace('Don''t -- ' || text || chr(10) || 'end!', '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}'' ]', '', 'g') AS text FROM conversations")
def aligner_normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.aligner_text(F.concat(F.lit("Don't -- "), "text", F.lit("\nend!"))).alias("text"))


@query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'SPEAKER_0' || turn WHEN 2 THEN upper(role[1]) || role[2:] || '-O''' || upper(role[1]) || role[2:] ELSE upper(role[1]) || role[2:] || ' Two' END AS shown FROM conversations"""
)
def displayed_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, role = F.col("turn") % 4, F.col("role")
    given = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit("speaker_0"), F.col("turn").cast("string"))).when(kind == 2, F.concat(role, F.lit("-o'"), F.upper(role))).otherwise(F.concat(F.upper(role), F.lit(" tWO")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.display_speaker(given).alias("shown"))


@query(
    _ASSIGNED
    + """ SELECT transcript_id, CAST(seg AS BIGINT) AS seg, CASE itype WHEN 'acknowledgment' THEN '✓' WHEN 'question' THEN '?' WHEN 'reaction' THEN '!' ELSE '·' END AS symbol,
  CASE itype WHEN 'acknowledgment' THEN 'acknowledges' WHEN 'question' THEN 'questions' WHEN 'reaction' THEN 'reacts' ELSE 'interjects' END AS verb FROM t WHERE NOT is_primary"""
)
def interjection_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _assigned(spark, sf_dir).where("NOT is_primary")
    return inner.select("transcript_id", "seg", fmt.interjection_symbol(F.col("itype")).alias("symbol"), fmt.interjection_verb(F.col("itype")).alias("verb"))


# --- long transcripts in blocks -------------------------------------------------------------------


@query(ORACLE_SQL["speaker_segments"])
def speaker_segments_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.speaker_segments(fixtures.words(spark, sf_dir), 20.0).withColumn("duration_s", F.round("duration_s", 6))


@query(ORACLE_SQL["hierarchical_turns"])
def turns_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(turns.build_turns(blocks.assigned_segments(fixtures.words(spark, sf_dir), seconds=20.0, size=16)))


@query(ORACLE_SQL["turns_refined"])
def turns_refined_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(turns.refine_turns(blocks.assigned_segments(fixtures.words(spark, sf_dir), seconds=20.0, size=16, keep_words=True)))
