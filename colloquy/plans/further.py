"""More registered queries: preparation of turns, redaction in two passes, audits, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import REDACTED
from colloquy.functions import text as tx
from colloquy.operators import align, chunks, passes, prepare, redact, segments, turns, vad
from colloquy.plans import fixtures
from colloquy.plans.queries import _ASSIGNED, _LONG_SCORES, _NAMED, _PACKED, _REDACTED_WORDS, _REPAIRED, _VAD, _WORDS, _assigned, _heard_chunks, _redacted, query

# --- preparation ----------------------------------------------------------------------------------


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.lit("  ‘Well’ – "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("…  "))
    return rows.select(F.col("conv_id").alias("transcript_id"), "turn", F.col("role").alias("speaker"), F.when(F.col("turn") % 6 == 5, F.lit(None).cast("string")).otherwise(text).alias("text"))


_TALK = """talk AS (SELECT conv_id AS transcript_id, turn, upper(role[1]) || lower(role[2:]) AS speaker,
  CASE WHEN turn % 6 = 5 THEN '' ELSE trim(regexp_replace('  ''Well'' - ' || replace(text, chr(10), ' ') || '...  ', '\\s+', ' ', 'g')) END AS text FROM conversations)"""


@query(f"WITH {_TALK} SELECT * FROM talk")
def prepared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_turns(_talk(spark, sf_dir), "advanced")


_SEGMENTED = f"WITH RECURSIVE {_TALK}, lines AS (SELECT transcript_id * 10000 + turn AS key, text FROM talk), {_PACKED.format(limit=40)}, sg AS (SELECT key // 10000 AS transcript_id, key % 10000 AS turn, CAST(piece AS INT) AS part, string_agg(s, ' ' ORDER BY i) AS text FROM pk GROUP BY key, piece)"


@query(_SEGMENTED + " SELECT transcript_id, turn, part, speaker || ': ' || sg.text AS segment FROM sg JOIN talk USING (transcript_id, turn)")
def prepared_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.turn_segments(prepare.prepare_turns(_talk(spark, sf_dir), "advanced"), 40)


@query(
    _SEGMENTED
    + """, a AS (SELECT transcript_id, count(*) AS turns, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM talk GROUP BY 1), b AS (SELECT transcript_id, count(*) AS made FROM sg GROUP BY 1)
SELECT transcript_id, turns AS original_turns, turns AS processed_turns, words AS words_processed, coalesce(made, 0) AS segments_created, coalesce(made, 0) - turns AS turns_split FROM a LEFT JOIN b USING (transcript_id)"""
)
def preparation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _talk(spark, sf_dir)
    ready = prepare.prepare_turns(given, "advanced")
    return prepare.preparation_stats(given, ready, prepare.turn_segments(ready, 40))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN '<|odd|> ' || trim(replace(text, chr(10), ' ')) ELSE trim(replace(text, chr(10), ' ')) END AS reply FROM conversations")
def final_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, kind = F.replace("text", F.lit("\n"), F.lit(" ")), F.col("turn") % 5
    thought = F.lit("<|channel|>analysis<|message|>not this<|end|><|start|>assistant")
    reply = (
        F.when(kind == 0, F.concat(thought, F.lit("<|channel|>final<|message|>\n"), text, F.lit(" <|return|>")))
        .when(kind == 1, F.concat(F.lit("  "), text, F.lit("\n")))
        .when(kind == 2, F.concat(thought, F.lit("<|message|> "), text, F.lit(" <|end|> behind")))
        .when(kind == 3, F.concat(F.lit("<|channel|>final<|message|>"), text))
        .otherwise(F.concat(F.lit("<|odd|> "), text))
    )
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", tx.final_channel(reply).alias("reply"))


# --- redaction in two passes ----------------------------------------------------------------------

_LIMITS = (0.25, 0.2)
_GRID = """n{0} AS (SELECT {1}, count(*) AS n FROM {2} GROUP BY ALL), k{0} AS (SELECT *, CASE WHEN n <= 100 THEN 0 ELSE greatest(0, CAST(floor((n - 150) / 70) AS INT) + 1) END AS last FROM n{0}),
g{0} AS (SELECT *, unnest(range(last + 1)) AS c FROM k{0})"""
_PASSES = (
    _WORDS
    + ", "
    + _GRID.format(1, "transcript_id", "words")
    + f""", p1 AS (SELECT w.*, c, word_idx - c * 70 AS i, {_NAMED} AND word_idx % 3 <> 0 AS hit FROM g1 JOIN words w ON w.transcript_id = g1.transcript_id AND word_idx >= c * 70 AND word_idx < CASE WHEN c < last THEN c * 70 + 100 ELSE n END),
v1 AS (SELECT transcript_id, c, count(*) FILTER (hit) <= count(*) * {_LIMITS[0]}::DOUBLE AS passed FROM p1 GROUP BY ALL),
f1 AS (SELECT transcript_id, word_idx, speaker, text AS original, start_s, end_s, c AS chunk, passed, passed AND hit AS replaced, CASE WHEN passed AND hit THEN '{REDACTED}' ELSE text END AS text FROM p1 JOIN v1 USING (transcript_id, c) WHERE c = 0 OR i >= 30),
nm AS (SELECT count(*) > 0 AS known FROM f1 WHERE replaced),
s1 AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, speaker ORDER BY word_idx) - 1 AS at FROM f1), """
    + _GRID.format(2, "transcript_id, speaker", "s1")
    + f""", p2 AS (SELECT s.*, c, s.at - c * 70 AS i, known AND lower(trim(text, '.,!?;:')) = 'maria' AS hit FROM g2 JOIN s1 s ON s.transcript_id = g2.transcript_id AND s.speaker = g2.speaker AND s.at >= c * 70 AND s.at < CASE WHEN c < last THEN c * 70 + 100 ELSE n END, nm),
v2 AS (SELECT transcript_id, speaker, c, count(*) FILTER (hit) <= (count(*) - count(*) FILTER (text = '{REDACTED}')) * {_LIMITS[1]}::DOUBLE AS ok FROM p2 GROUP BY ALL),
f2 AS (SELECT transcript_id, word_idx, speaker, CASE WHEN ok AND hit THEN '{REDACTED}' ELSE text END AS text, original, CASE WHEN replaced THEN 1 WHEN ok AND hit THEN 2 END AS pass FROM p2 JOIN v2 USING (transcript_id, speaker, c) WHERE c = 0 OR i >= 30)"""
)


def _forgetful(placed: DataFrame) -> DataFrame:
    """A rewriter that leaves every third word alone."""
    hit = F.lower(F.btrim("text", F.lit(".,!?;:"))).isin("maria") & (F.col("word_idx") % 3 != 0)
    return placed.withColumn("new_text", F.when(hit, REDACTED).otherwise(F.col("text")))


@query(_PASSES + " SELECT transcript_id, word_idx, speaker, text, original, replaced, chunk, passed FROM f1")
def redaction_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passes.first_pass(fixtures.words(spark, sf_dir), _forgetful, 100, 30, 50, _LIMITS[0])
    return out.select("transcript_id", "word_idx", "speaker", "text", "original", "replaced", "chunk", "passed")


@query(_PASSES + " SELECT * FROM f2")
def redaction_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.two_passes(fixtures.words(spark, sf_dir), _forgetful, 100, 30, 50, _LIMITS)


@query(_PASSES + " SELECT transcript_id, c AS chunk, count(*) FILTER (passed AND hit) AS replaced FROM p1 JOIN v1 USING (transcript_id, c) GROUP BY ALL HAVING count(*) FILTER (passed AND hit) > 0")
def text_pass_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = passes.text_pass(fixtures.words(spark, sf_dir), _forgetful, 100, 30, 50, _LIMITS[0])
    return found.groupBy("transcript_id", "chunk").agg(F.count("*").alias("replaced"))


_AUDIT = (
    _REDACTED_WORDS
    + """, x AS (SELECT *, coalesce(string_agg(text, ' ') OVER (PARTITION BY transcript_id ORDER BY word_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY transcript_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS r FROM rw),
al AS (SELECT transcript_id, word_idx, CASE WHEN word_idx % 4 = 0 THEN printf('[word_index: %d] [REDACTED] (word:"%s")', word_idx, text)
  ELSE printf('[%02d:%02d:%06.3f] [REDACTED] (word:"%s", word_index: %d, speaker: %s)', CAST(floor(start_s / 3600) AS INT), CAST(floor(start_s % 3600 / 60) AS INT), start_s % 60, text, word_idx, speaker) END AS line,
  '    Context: ' || trim(l || ' >>>' || text || '<<< ' || r) AS context FROM x WHERE replaced)"""
)


def _audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact.replacements(_redacted(spark, sf_dir))
    untimed = found.withColumn("start_s", F.when(F.col("word_idx") % 4 != 0, F.col("start_s")))
    return passes.audit_lines(untimed, fixtures.words(spark, sf_dir))


@query(_AUDIT + " SELECT * FROM al")
def redaction_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit_lines(spark, sf_dir)


@query(
    _AUDIT
    + """, b AS (SELECT transcript_id, count(*) AS n, string_agg(line || chr(10) || context, chr(10) ORDER BY word_idx) AS body FROM al GROUP BY 1), t AS (SELECT transcript_id, count(*) AS n_words FROM words GROUP BY 1)
SELECT transcript_id, concat_ws(chr(10), 'De-Identification Audit Log', repeat('=', 50), 'Total names replaced: ' || coalesce(n, 0), repeat('=', 50), coalesce(body, 'No names were replaced.'), repeat('=', 50), 'Summary:',
  '- Total words processed: ' || format('{:,}', n_words), '- Names replaced: ' || coalesce(n, 0), printf('- Replacement rate: %.2f%%', coalesce(n, 0) / n_words * 100.0)) AS content FROM t LEFT JOIN b USING (transcript_id)"""
)
def redaction_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = fixtures.words(spark, sf_dir).groupBy("transcript_id").agg(F.count("*").alias("n_words"))
    return passes.audit_log(_audit_lines(spark, sf_dir), totals)


# --- speech segments ------------------------------------------------------------------------------


@query(
    _VAD
    + """, d AS (SELECT DISTINCT transcript_id FROM words), kept AS (SELECT transcript_id, start_s, end_s FROM vad WHERE transcript_id % 3 <> 0)
SELECT * FROM kept UNION ALL SELECT transcript_id, 0.0::DOUBLE, 120.0::DOUBLE FROM d WHERE transcript_id NOT IN (SELECT transcript_id FROM kept)"""
)
def speech_or_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = fixtures.words(spark, sf_dir).select("transcript_id").distinct().withColumn("seconds", F.lit(120.0))
    return vad.speech_or_whole(fixtures.speech(spark, sf_dir).where("transcript_id % 3 <> 0"), audio)


_PIECE = "list_filter(range(1, hi - lo), lambda i: s[lo + i + 1] - e[lo + i] >= 0.6::DOUBLE AND s[lo + i + 1] - s[lo + 1] >= 5 AND e[hi] - s[lo + i + 1] >= 5)"
_PIECE_SCORE = """CASE WHEN greatest(s[lo + i + 1] - s[lo + 1], e[hi] - s[lo + i + 1]) > 0 THEN 0.4::DOUBLE * least(s[lo + i + 1] - s[lo + 1], e[hi] - s[lo + i + 1]) / greatest(s[lo + i + 1] - s[lo + 1], e[hi] - s[lo + i + 1]) ELSE 0 END
  + 0.3::DOUBLE * least((s[lo + i + 1] - e[lo + i]) / 1.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * greatest(0.0::DOUBLE, CASE WHEN i > 1 THEN 0.1::DOUBLE * (s[lo + i + 1] - e[lo + i] - (s[lo + i] - e[lo + i - 1])) ELSE 0 END
  + CASE WHEN i < hi - lo - 1 THEN 0.1::DOUBLE * (s[lo + i + 1] - e[lo + i] - (s[lo + i + 2] - e[lo + i + 1])) ELSE 0 END)"""


@query(
    _LONG_SCORES.replace("WITH", "WITH RECURSIVE", 1)
    + f""", gl AS MATERIALIZED (SELECT transcript_id, grp, list(start_s ORDER BY start_s, end_s) AS s, list(end_s ORDER BY start_s, end_s) AS e FROM v GROUP BY ALL),
pc AS (SELECT transcript_id, grp, 0::BIGINT AS lo, len(s) AS hi, false AS done FROM gl
  UNION ALL SELECT transcript_id, grp, unnest(b[:len(b) - 1]), unnest(b[2:]), len(b) = 2 FROM (
    SELECT transcript_id, grp, list_concat([lo], list_transform(CASE WHEN e[hi] - s[lo + 1] > 30 THEN list_reduce(list_transform(list_sort(list_transform({_PIECE}, lambda i: {{'k': -({_PIECE_SCORE}), 'i': i}})), lambda x: x.i),
      lambda acc, i: CASE WHEN len(acc) < 3 AND i - coalesce(acc[len(acc)], 0) >= 2 THEN list_append(acc, i) ELSE acc END, []::BIGINT[]) ELSE []::BIGINT[] END, lambda c: lo + c), [hi]) AS b
    FROM pc JOIN gl USING (transcript_id, grp) WHERE NOT done) q)
SELECT transcript_id, CAST(grp AS BIGINT) AS "group", CAST(row_number() OVER (PARTITION BY transcript_id, grp ORDER BY s[lo + 1], lo) - 1 AS INT) AS piece, s[lo + 1] AS start_s, list_max(e[lo + 1:hi]) AS end_s, CAST(hi - lo AS INT) AS n_segments
FROM pc JOIN gl USING (transcript_id, grp) WHERE done"""
)
def long_segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.split_long(vad.combine(fixtures.long_speech(spark, sf_dir)))


@query(
    _VAD
    + """, c AS (SELECT transcript_id, grp, min(start_s) AS s, max(end_s) AS e FROM v GROUP BY ALL), cb AS (SELECT *, lag(e) OVER (PARTITION BY transcript_id ORDER BY grp) AS before FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_s, end_s) AS i, row_number() OVER (PARTITION BY transcript_id, grp ORDER BY start_s, end_s) AS j FROM v)
SELECT transcript_id, CAST(grp AS BIGINT) AS "group", 0 AS place, printf('%.3f - %.3f (%.3fs)', s, e, e - s) AS combined, '' AS individual, CASE WHEN before IS NULL THEN '' ELSE printf('%.3fs', s - before) END AS gap FROM cb
UNION ALL SELECT transcript_id, CAST(grp AS BIGINT), CAST(j AS INT), '', i || printf(' - %.3f - %.3f (%.3fs)', start_s, end_s, end_s - start_s), CASE WHEN pe IS NULL THEN '' ELSE printf('%.3fs', start_s - pe) END FROM m"""
)
def vad_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.audit_rows(vad.combine(fixtures.speech(spark, sf_dir)))


# --- lookups and small forms ----------------------------------------------------------------------


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, w AS (SELECT transcript_id, list(text ORDER BY word_idx) AS w FROM spoken GROUP BY 1)
SELECT transcript_id, CAST(greatest(len(w) - 100, 0) AS INT) AS n_before, array_to_string(w[greatest(len(w) - 100, 0) + 1:], ' ') AS tail FROM w"""
)
def stitch_tail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]).alias("w"))
    before, tail = align.tail_window(F.col("w"))
    return rows.select("transcript_id", F.size(before).alias("n_before"), F.array_join(tail, " ").alias("tail"))


@query("SELECT conv_id AS transcript_id, turn, role AS speaker, CASE WHEN length(text) > 50 THEN text[:50] || '...' ELSE text END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) q WHERE n <= 10")
def turn_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return segments.previews(rows.select(F.col("conv_id").alias("transcript_id"), "turn", F.col("role").alias("speaker"), "text"))


@query(_VAD + " SELECT transcript_id, CAST(grp AS BIGINT) AS chunk, start_s, CASE WHEN grp % 4 <> 0 THEN transcript_id || '-' || grp || '.wav' END AS audio FROM v")
def chunk_audio_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vad.combine(fixtures.speech(spark, sf_dir)).withColumnRenamed("group", "chunk")
    sounds = rows.where("chunk % 4 <> 0").select("transcript_id", "chunk", F.concat(F.col("transcript_id").cast("string"), F.lit("-"), F.col("chunk").cast("string"), F.lit(".wav")).alias("audio")).distinct()
    return segments.chunk_audio(rows, sounds).select("transcript_id", "chunk", "start_s", "audio")


@query(_WORDS + " SELECT transcript_id, word_idx, (word_idx + start_s * 2 + 1) / 3 AS first_sample, (word_idx * 2 + end_s + 4) / 3 AS second_sample FROM words")
def mono_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s, e = F.col("word_idx").cast("double"), F.col("start_s"), F.col("end_s")
    channels = F.array(F.array(i, i * 2), F.array(s * 2, e), F.array(F.lit(1.0), F.lit(4.0)))
    mixed = fixtures.words(spark, sf_dir).withColumn("mono", segments.mono(channels))
    return mixed.select("transcript_id", "word_idx", F.col("mono")[0].alias("first_sample"), F.col("mono")[1].alias("second_sample"))


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT transcript_id, count(*) AS n FROM spoken GROUP BY 1)
SELECT transcript_id, CAST(n AS INT) AS n_words, CASE WHEN n <= 60 THEN 0 ELSE greatest(0, CAST(floor((n - 80) / 50) AS BIGINT) + 1) * 10 END AS skipped FROM n"""
)
def stitched_by_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = chunks.chunk_words(fixtures.spoken_words(spark, sf_dir), 60, 10, 20)
    word = F.struct("i", F.struct("text", "start_s", "end_s").alias("w"))
    parts = placed.groupBy("transcript_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    return align.stitch_chunks(parts).select("transcript_id", F.size("words").alias("n_words"), "skipped")


@query(
    _REPAIRED
    + """ SELECT transcript_id, word_idx, w.text, w.start_s, w.end_s, rp.start_s AS new_start_s, rp.end_s AS new_end_s, round(rp.start_s - w.start_s, 6) AS moved_s
FROM rp JOIN wm w USING (transcript_id, word_idx) WHERE w.start_s <> rp.start_s OR w.end_s <> rp.end_s"""
)
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixtures.words(spark, sf_dir)
    return align.repair_report(words, align.repair_order(words))


@query(_ASSIGNED + " SELECT transcript_id, count(*) AS segments, count(*) FILTER (is_interjection) AS interjections, count(*) FILTER (itype = 'unclear') AS unclear, count(*) FILTER (error) AS likely_errors, count(*) FILTER (is_primary) AS primary_segments, max(turn) AS turns FROM t GROUP BY 1")
def turn_build_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.build_audit(_assigned(spark, sf_dir))


@query(
    f"WITH {fixtures.oracle('spoken')}"
    + """, n AS (SELECT transcript_id, count(*) AS n FROM spoken GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 400 THEN 0 ELSE greatest(0, CAST(floor((n - 600) / 330) AS INT) + 1) END AS last FROM n),
g AS (SELECT *, unnest(range(last + 1)) AS c FROM k)
SELECT g.transcript_id, CAST(c AS INT) AS chunk, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_idx) AS text FROM g JOIN spoken s ON s.transcript_id = g.transcript_id AND word_idx >= c * 330 AND word_idx < CASE WHEN c < last THEN c * 330 + 400 ELSE n END GROUP BY 1, 2"""
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = segments.joined(F.collect_list(F.struct("word_idx", "text"))).alias("text")
    return chunks.chunk_texts(fixtures.spoken_words(spark, sf_dir).groupBy("transcript_id").agg(text))


@query()
def stitch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.stitch_steps(_heard_chunks(spark, sf_dir))
