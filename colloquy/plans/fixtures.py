"""Transcript views over the test tables: words, long conversations, diarization and speech segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SAID = "CASE event_type WHEN 'click' THEN 'yeah' WHEN 'view' THEN 'what' WHEN 'error' THEN 'wow' WHEN 'signup' THEN 'data' ELSE 'Maria' END"

#: Words with jumping and overlapping times and many short runs; the same text runs in Spark and in the oracle.
WORDS = f"""
SELECT transcript_id, word_idx, {_SAID} AS text,
  CAST(start_ms AS DOUBLE) / 1000 AS start_s,
  CAST(start_ms + 100 + MOD(CAST(FLOOR(value) AS BIGINT), 600) AS DOUBLE) / 1000 AS end_s,
  CONCAT('SPEAKER_0', CAST(MOD(CAST(FLOOR(word_idx / 12.0) AS BIGINT) + CASE WHEN MOD(event_id, 9) = 0 THEN 1 ELSE 0 END, 2) AS STRING)) AS speaker
FROM (SELECT *, word_idx * 400 + MOD(event_id, 7) * 100 AS start_ms FROM (
  SELECT event_id, event_type, value, CAST(EXTRACT(DAY FROM ts) AS INT) AS transcript_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY EXTRACT(DAY FROM ts) ORDER BY ts, event_id) - 1 AS BIGINT) AS word_idx
  FROM events) a) b"""

_SPOKEN_SPARK = """
SELECT conv_id AS transcript_id, turn, role AS speaker, p.pos AS pos, p.col AS text FROM conversations
LATERAL VIEW posexplode(split(trim(text), '[ \\\\n\\\\t\\\\r]+')) p AS pos, col"""
_SPOKEN_SQL = """
SELECT conv_id AS transcript_id, turn, role AS speaker, UNNEST(RANGE(LEN(w))) AS pos, UNNEST(w) AS text FROM
  (SELECT *, string_split_regex(trim(text, E' \\n\\t\\r'), '[ \\n\\t\\r]+') AS w FROM conversations) q"""
_SPOKEN = """
SELECT transcript_id, speaker, text, word_idx,
  CAST(word_idx * 300 + 4000 * FLOOR((turn + 1) / 3.0) AS DOUBLE) / 1000 AS start_s,
  CAST(word_idx * 300 + 4000 * FLOOR((turn + 1) / 3.0) + 250 AS DOUBLE) / 1000 AS end_s
FROM (SELECT transcript_id, turn, speaker, text, CAST(ROW_NUMBER() OVER (PARTITION BY transcript_id ORDER BY turn, pos) - 1 AS BIGINT) AS word_idx FROM ({}) e) f"""

#: Segments of five seconds that overlap a little, three speakers in turn, every seventh left out.
DIAR = """
SELECT transcript_id, k, CAST(k * 4700 AS DOUBLE) / 1000 AS start_s, CAST(k * 4700 + 5000 AS DOUBLE) / 1000 AS end_s,
  CONCAT('S', CAST(MOD(k, 3) AS STRING)) AS speaker
FROM (SELECT DISTINCT transcript_id, CAST(FLOOR(start_s * 1000 / 4700) AS BIGINT) AS k FROM words) x WHERE MOD(k, 7) <> 6"""

#: Speech segments: runs of words with pauses of several lengths between them.
VAD = """
SELECT transcript_id, CAST(start_ms AS DOUBLE) / 1000 AS start_s, CAST(start_ms + len_ms AS DOUBLE) / 1000 AS end_s FROM (
  SELECT transcript_id, word_idx * 2600 + MOD(word_idx * 7, 11) * 90 + CAST(FLOOR(word_idx / 5.0) AS BIGINT) * 3100 AS start_ms,
    200 + MOD(word_idx * 13, 29) * 85 AS len_ms
  FROM words WHERE MOD(word_idx, 3) <> 1) v"""

#: Speech segments in groups of twelve that last over half a minute, with pauses of up to 1.2 seconds.
LONG = """
SELECT transcript_id, CAST(start_ms AS DOUBLE) / 1000 AS start_s, CAST(start_ms + len_ms AS DOUBLE) / 1000 AS end_s FROM (
  SELECT transcript_id, word_idx * 2600 + CAST(FLOOR(word_idx / 12.0) AS BIGINT) * 6000 AS start_ms, 1400 + MOD(word_idx * 13, 29) * 40 AS len_ms FROM words) v"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORDS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPOKEN.format(_SPOKEN_SPARK).replace("FROM conversations", "FROM {conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def diarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIAR.replace("FROM words", "FROM {words}"), words=words(spark, sf_dir))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VAD.replace("FROM words", "FROM {words}"), words=words(spark, sf_dir))


def long_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LONG.replace("FROM words", "FROM {words}"), words=words(spark, sf_dir))


def oracle(*views: str) -> str:
    """The ``WITH`` list of the named views in the oracle's dialect."""
    texts = {"words": WORDS, "spoken": _SPOKEN.format(_SPOKEN_SQL), "diar": DIAR, "vad": VAD, "long": LONG}
    return ", ".join(f"{v} AS ({texts[v]})" for v in views)
