"""Registered queries on aligner output: scans of its files with what they pass over, frames, and aligned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import align, chunks, frames, segments
from colloquy.plans import fixtures
from colloquy.plans.queries import _CHUNKED, _WORDS, _chunked, query
from colloquy.sources import checkpoint, textgrid
from colloquy.work import new_path

# --- files with faults ----------------------------------------------------------------------------
# Files are made of the words by Spark, one a transcript; what goes wrong in them follows from the words' numbers.


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TextGrids: some lines lack ``=``, some times are no numbers; every fifth has no phones and is cut off, every seventh has no words."""
    kind = F.col("word_idx") % 13
    text = F.when(kind == 9, '            text "x"').when(kind == 11, '            text = "sp"').when(kind == 3, '            text = "a=b"').otherwise(F.concat(F.lit('            text = "'), "text", F.lit('"')))
    xmin = F.when(kind == 5, F.lit("            xmin 1.0")).when(kind == 7, "            xmin = oops").otherwise(F.concat(F.lit("            xmin = "), F.col("start_s").cast("string")))
    xmax = F.when(kind == 6, F.lit("            xmax")).otherwise(F.concat(F.lit("            xmax = "), F.col("end_s").cast("string")))
    lines = F.concat_ws("\n", F.concat(F.lit("        intervals ["), (F.col("word_idx") + 1).cast("string"), F.lit("]:")), xmin, xmax, text)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", lines.alias("l")))), lambda x: x["l"]), "\n")
    name = F.when(F.col("transcript_id") % 7 == 3, "other").otherwise("words")
    head = F.concat(F.lit('File type = "ooTextFile"\nitem []:\n    item [1]:\n        name = "'), name, F.lit('"\n'))
    tail = F.when(F.col("transcript_id") % 5 == 2, "\n        intervals [9999]:\n            xmin = 3.0\n").otherwise('\n    item [2]:\n        name = "phones"\n        intervals [1]:\n            xmin = 0\n            xmax = 1\n            text = "W"\n')
    rows = fixtures.words(spark, sf_dir).groupBy("transcript_id").agg(body.alias("body"))
    return rows.select(F.concat(F.lit("t"), F.col("transcript_id").cast("string")).alias("path"), F.concat(head, "body", tail).alias("value"))


_KINDS = _WORDS + ", k AS (SELECT *, 't' || transcript_id AS path, word_idx % 13 AS kind FROM words WHERE transcript_id % 7 <> 3)"


@query(
    _KINDS
    + """ SELECT path, count(*) FILTER (kind NOT IN (5, 6, 7, 9)) AS kept, CAST(max(CASE WHEN transcript_id % 5 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS cut_off, count(*) FILTER (kind = 5) AS xmin,
  count(*) FILTER (kind = 6) AS xmax, count(*) FILTER (kind = 9) AS text, count(*) FILTER (kind = 7) AS number FROM k GROUP BY 1"""
)
def textgrid_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgrid.scan_report(textgrid.scan_textgrids(_files(spark, sf_dir)))


_ORIGINAL = "CASE word_idx % 3 WHEN 0 THEN upper(text) WHEN 1 THEN upper(text[1]) || text[2:] || ',' ELSE text END"


def _originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("word_idx") % 3
    form = F.when(k == 0, F.upper("text")).when(k == 1, F.concat(F.initcap("text"), F.lit(","))).otherwise(F.col("text"))
    return fixtures.words(spark, sf_dir).select(F.concat(F.lit("t"), F.col("transcript_id").cast("string")).alias("path"), "word_idx", form.alias("text"))


_FORMS = (
    _KINDS
    + f""", o AS (SELECT 't' || transcript_id AS path, word_idx, {_ORIGINAL} AS form, lower(text) AS norm, count(*) OVER (PARTITION BY transcript_id, lower(text)) AS n,
  row_number() OVER (PARTITION BY transcript_id, lower(text) ORDER BY word_idx) - 1 AS nth FROM words),
h AS (SELECT *, CASE WHEN kind = 3 THEN '{{0}}' ELSE text END AS heard FROM k WHERE kind NOT IN (5, 6, 7, 9, 11)),
g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY word_idx) - 1 AS place, row_number() OVER (PARTITION BY path, lower(heard) ORDER BY word_idx) - 1 AS nth FROM h),
c AS (SELECT DISTINCT path, norm, n FROM o),
f AS (SELECT g.path, g.place AS word_idx, coalesce(o.form, g.heard) AS text, start_s, end_s FROM g LEFT JOIN c ON c.path = g.path AND c.norm = lower(heard)
  LEFT JOIN o ON o.path = g.path AND o.norm = lower(heard) AND o.nth = g.nth % c.n)"""
)


@query(_FORMS.format("a") + " SELECT path, word_idx, text, floor(start_s * 100 + 0.5::DOUBLE) / 100 AS start_s, floor(end_s * 100 + 0.5::DOUBLE) / 100 AS end_s FROM f")
def textgrid_aligner_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where(F.contains("value", F.lit('"words"')))
    return textgrid.aligner_words(files, _originals(spark, sf_dir)).select("path", "word_idx", "text", "start_s", "end_s")


@query(
    _FORMS.format("a=b")
    + f""" SELECT path, word_idx, text, start_s + 10 AS start_s, end_s + 10 AS end_s FROM f
UNION ALL SELECT 't' || transcript_id, word_idx, {_ORIGINAL}, 10 + word_idx * 0.5::DOUBLE, 10 + (word_idx + 1) * 0.5::DOUBLE FROM words WHERE transcript_id % 7 = 3"""
)
def textgrid_fallback_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgrid.fallback_words(_files(spark, sf_dir), _originals(spark, sf_dir), 10.0)


@query(
    _WORDS
    + """ SELECT transcript_id, count(*) FILTER (word_idx % 11 NOT IN (4, 6)) AS kept, count(*) FILTER (word_idx % 11 = 4) AS blank, count(*) FILTER (word_idx % 11 = 6) AS pattern,
  round(sum(CASE WHEN word_idx % 11 NOT IN (4, 6) THEN round(start_s * 1000) END) / 1000, 3) AS starts_s FROM words GROUP BY 1"""
)
def wts_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ms = F.col("word_idx") % 11, lambda c: F.round(F.col(c) * 1000).cast("long").cast("string")
    line = F.when(kind == 4, "  \t").when(kind == 6, "[12] -> [15] odd").otherwise(F.concat(F.lit(" ["), ms("start_s"), F.lit("]  --> ["), ms("end_s"), F.lit("]  "), "text", F.lit(" ")))
    scanned = textgrid.scan_wts(fixtures.words(spark, sf_dir).select("transcript_id", line.alias("value")))
    count = lambda rule, name: F.count(F.when(rule, 1)).alias(name)
    problem = F.col("problem")
    return scanned.groupBy("transcript_id").agg(count(problem.isNull(), "kept"), count(problem == "blank", "blank"), count(problem == "pattern", "pattern"), F.round(F.sum((F.col("start_s") * 1000).cast("decimal(38,3)")).cast("double") / 1000, 3).alias("starts_s"))


@query(
    _WORDS
    + """, k AS (SELECT 't' || transcript_id AS path, word_idx % 17 AS kind FROM words WHERE transcript_id % 9 NOT IN (4, 5))
SELECT path, count(*) FILTER (kind NOT IN (4, 6, 8)) AS kept, 0::BIGINT AS json, 0::BIGINT AS words, count(*) FILTER (kind = 4) AS text, count(*) FILTER (kind = 6) AS start, count(*) FILTER (kind = 8) AS end FROM k GROUP BY 1
UNION ALL SELECT DISTINCT 't' || transcript_id, 0::BIGINT, CASE WHEN transcript_id % 9 = 5 THEN 1 ELSE 0 END::BIGINT, CASE WHEN transcript_id % 9 = 4 THEN 1 ELSE 0 END::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM words WHERE transcript_id % 9 IN (4, 5)"""
)
def checkpoint_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("word_idx") % 17
    lost = lambda k, c: F.when(kind != k, F.col(c)).alias(c)
    words = fixtures.words(spark, sf_dir).select("transcript_id", "word_idx", lost(4, "text"), lost(6, "start_s"), lost(8, "end_s"), "speaker")
    docs = checkpoint.checkpoint_json(words)
    case = F.col("transcript_id") % 9
    value = F.when(case == 4, '{"transcript_id": 1, "words": []}').when(case == 5, "{broken").otherwise(F.col("json"))
    given = docs.select(F.concat(F.lit("t"), F.col("transcript_id").cast("string")).alias("path"), value.alias("value"))
    return textgrid.scan_report(checkpoint.scan_checkpoints(given), ("json", "words", "text", "start", "end"))


@query(_KINDS + " SELECT path, row_number() OVER (PARTITION BY path ORDER BY word_idx) - 1 AS word_idx, CASE WHEN kind = 3 THEN 'a=b' ELSE text END AS text, start_s + 2.5::DOUBLE AS start_s, end_s + 2.5::DOUBLE AS end_s FROM k WHERE kind NOT IN (5, 6, 7, 9, 11)")
def textgrid_engine_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgrid.parse_textgrids(_files(spark, sf_dir), offset_s=2.5)


@query(_WORDS + " SELECT transcript_id, text || ' ' || word_idx AS text, round(start_s * 1000) / 1000 AS start_s, round(end_s * 1000) / 1000 AS end_s FROM words WHERE word_idx % 11 <> 6")
def wts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").cast("string")
    said = F.concat("text", F.lit(" "), F.col("word_idx").cast("string"))
    line = F.when(F.col("word_idx") % 11 == 6, "12 -> 15 odd").otherwise(F.concat(F.lit("["), ms("start_s"), F.lit("] --> ["), ms("end_s"), F.lit("]  "), said))
    return textgrid.parse_wts(fixtures.words(spark, sf_dir).select("transcript_id", line.alias("value")))


@query(_WORDS + " SELECT transcript_id, word_idx, text, start_s, end_s, speaker, 'combined_audio' AS mode FROM words")
def checkpoint_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written as checkpoints, a file each, and read back."""
    path = new_path(spark, "checkpoints")
    checkpoint.checkpoint_json(fixtures.words(spark, sf_dir), "combined_audio").repartition("transcript_id").write.partitionBy("transcript_id").text(path)
    return checkpoint.read_checkpoints(spark, f"{path}/*")


# --- frames ---------------------------------------------------------------------------------------

_CODE = "CASE text WHEN 'yeah' THEN 1 WHEN 'what' THEN 2 WHEN 'wow' THEN 3 WHEN 'data' THEN 4 ELSE 5 END"
#: Two to four frames a word, a blank one behind most; some begin with a label that no token has, some words have no frames.
_WIDTHS = f"""SELECT transcript_id, word_idx, {_CODE} AS code, CASE WHEN MOD(word_idx, 97) = 50 THEN 0 ELSE 2 + MOD(word_idx, 3) END AS spoken,
  CASE WHEN MOD(word_idx, 97) = 50 THEN 0 ELSE 2 + MOD(word_idx, 3) + CASE WHEN MOD(word_idx, 4) = 0 THEN 0 ELSE 1 END END AS width FROM words"""
_PLACED = "SELECT *, SUM(width) OVER (PARTITION BY transcript_id ORDER BY word_idx) - width AS first FROM ({}) w"
_FRAMES = "SELECT transcript_id, CAST(first + p AS BIGINT) AS frame, CAST(CASE WHEN p >= spoken THEN 0 WHEN p = 0 AND MOD(word_idx, 17) = 3 THEN 9 ELSE code END AS INT) AS label FROM ({}) x"
_FRAMES_SPARK = _FRAMES.format(f"SELECT * FROM ({_PLACED.format(_WIDTHS)}) v LATERAL VIEW explode(sequence(0, width - 1)) q AS p WHERE width > 0")
_FRAMES_SQL = f"fr AS ({_FRAMES.format(f'SELECT *, unnest(range(width)) AS p FROM ({_PLACED.format(_WIDTHS)}) v')}), tk AS (SELECT transcript_id, word_idx AS token_idx, {_CODE} AS token FROM words)"


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = fixtures.words(spark, sf_dir)
    return spark.sql(_FRAMES_SPARK.replace("FROM words", "FROM {words}"), words=words), words.selectExpr("transcript_id", "word_idx AS token_idx", f"{_CODE} AS token")


_SPANS = (
    _WORDS.replace("WITH", "WITH RECURSIVE", 1)
    + f""", {_FRAMES_SQL}, ch AS (SELECT *, lag(label) OVER w IS DISTINCT FROM label AS new FROM fr WINDOW w AS (PARTITION BY transcript_id ORDER BY frame)),
rn AS (SELECT transcript_id, label, frame, lead(frame, 1, n) OVER (PARTITION BY transcript_id ORDER BY frame) AS stop FROM (SELECT *, count(*) OVER (PARTITION BY transcript_id) AS n FROM ch) q WHERE new),
ru AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY frame) AS r FROM rn WHERE label <> 0),
tm AS MATERIALIZED (SELECT * FROM tk),
wk AS (SELECT DISTINCT transcript_id, 0::BIGINT AS r, 0::BIGINT AS cur, NULL::BIGINT AS hit, NULL::BIGINT AS frame, NULL::BIGINT AS stop FROM tm
  UNION ALL SELECT wk.transcript_id, ru.r, wk.cur + CASE WHEN tm.token = ru.label THEN 1 ELSE 0 END, CASE WHEN tm.token = ru.label THEN wk.cur END, ru.frame, ru.stop
  FROM wk JOIN ru ON ru.transcript_id = wk.transcript_id AND ru.r = wk.r + 1 LEFT JOIN tm ON tm.transcript_id = wk.transcript_id AND tm.token_idx = wk.cur),
sp AS (SELECT wk.transcript_id, hit AS token_idx, token, frame * 20.0::DOUBLE AS start_ms, stop * 20.0::DOUBLE AS end_ms FROM wk JOIN tm ON tm.transcript_id = wk.transcript_id AND token_idx = hit)"""
)


@query(_SPANS + " SELECT * FROM sp")
def frame_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_spans(*_frames(spark, sf_dir))


@query(
    _SPANS
    + """, z AS (SELECT t.transcript_id, t.k, coalesce(f.m, 0) AS m, coalesce(f.e, 0.0::DOUBLE) AS e, n.total FROM (SELECT transcript_id, count(*) AS k FROM tm GROUP BY 1) t
  JOIN (SELECT transcript_id, count(*) * 20.0::DOUBLE AS total FROM fr GROUP BY 1) n USING (transcript_id) LEFT JOIN (SELECT transcript_id, count(*) AS m, max(end_ms) AS e FROM sp GROUP BY 1) f USING (transcript_id)),
l AS (SELECT tm.*, e + (token_idx - m) * ((total - e) / (k - m)) AS s, (total - e) / (k - m) AS step FROM tm JOIN z USING (transcript_id) WHERE token_idx >= m AND m < k AND total > e)
SELECT transcript_id, token_idx, token, round(start_ms, 6) AS start_ms, round(end_ms, 6) AS end_ms FROM sp UNION ALL SELECT transcript_id, token_idx, token, round(s, 6), round(s + step, 6) FROM l"""
)
def frame_token_spans_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frames.frame_spans(*_frames(spark, sf_dir), fill=True)
    return spans.select("transcript_id", "token_idx", "token", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))


_SCORE = "((frame * 7919 + {0} * 104729 + w.transcript_id * 31) % 1009)"


@query(
    _WORDS
    + f""", {_FRAMES_SQL}, n AS (SELECT transcript_id, count(*) AS n FROM fr GROUP BY 1), k AS (SELECT transcript_id, count(*) AS k FROM tk GROUP BY 1),
w AS (SELECT tk.*, greatest(CAST(floor(token_idx * (n / k)) - floor(n / k) AS BIGINT), 0) AS a, least(CAST(floor(token_idx * (n / k)) + floor(2 * (n / k)) AS BIGINT), n) - 1 AS b FROM tk JOIN n USING (transcript_id) JOIN k USING (transcript_id))
SELECT w.transcript_id, token_idx, token, max_by(frame, ({_SCORE.format("token")}, -frame)) * 20.0::DOUBLE AS start_ms, (max_by(frame, ({_SCORE.format("token")}, -frame)) + 1) * 20.0::DOUBLE AS end_ms
FROM w JOIN fr ON fr.transcript_id = w.transcript_id AND fr.frame BETWEEN a AND b GROUP BY 1, 2, 3"""
)
def frame_token_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, tokens = _frames(spark, sf_dir)
    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda v: F.pmod(F.col("frame") * 7919 + v * 104729 + F.col("transcript_id") * 31, F.lit(1009)).cast("float"))
    return frames.peak_spans(labels.withColumn("scores", scores).drop("label"), tokens)


# --- aligned words --------------------------------------------------------------------------------


def _pair_sql(lists: str) -> str:
    """Anti-diagonals of the alignment of lists ``s`` and ``t`` of each ``key``, and the way back; ``{lists}`` gives ``key, s, t``."""
    pair = f"list_transform(s, lambda p: list_transform(t, lambda q: {_lambda_similarity()}))"
    return f"""li AS MATERIALIZED ({lists}), ms AS MATERIALIZED (SELECT key, s, t, len(s) AS n, len(t) AS m, {pair} AS w FROM li),
dg AS (SELECT key, 0 AS k, [CASE WHEN i = 0 THEN 0.0::DOUBLE END FOR i IN range(0, n + 1)] AS newest, [NULL::DOUBLE FOR i IN range(0, n + 1)] AS older, []::INT[] AS moves FROM ms
  UNION ALL SELECT key, k, list_transform(c, lambda y: y.v), newest, list_transform(c, lambda y: y.d) FROM (
    SELECT dg.key, dg.k + 1 AS k, newest, list_transform(range(0, n + 1), lambda i: CASE WHEN i > dg.k + 1 OR dg.k + 1 - i > m THEN {{'v': NULL::DOUBLE, 'd': NULL::INT}}
      WHEN i = 0 THEN {{'v': (dg.k + 1) * -0.5::DOUBLE, 'd': 2}} WHEN i = dg.k + 1 THEN {{'v': (dg.k + 1) * -0.5::DOUBLE, 'd': 1}}
      ELSE {{'v': greatest(older[i] + w[i][dg.k + 1 - i], newest[i] - 0.5::DOUBLE, newest[i + 1] - 0.5::DOUBLE),
        'd': CASE WHEN older[i] + w[i][dg.k + 1 - i] >= greatest(newest[i], newest[i + 1]) - 0.5::DOUBLE THEN 0 WHEN newest[i] >= newest[i + 1] THEN 1 ELSE 2 END}} END) AS c
    FROM dg JOIN ms ON ms.key = dg.key WHERE dg.k < n + m) q),
dm AS MATERIALIZED (SELECT key, k, moves FROM dg),
bk AS (SELECT key, n AS i, m AS j, NULL::INT AS source_idx, NULL::INT AS target_idx FROM ms
  UNION ALL SELECT key, CASE WHEN d = 2 THEN i ELSE i - 1 END, CASE WHEN d = 1 THEN j ELSE j - 1 END, CASE WHEN d = 2 THEN -1 ELSE i - 1 END, CASE WHEN d = 1 THEN -1 ELSE j - 1 END
  FROM (SELECT bk.key, i, j, moves[i + 1] AS d FROM bk JOIN dm ON dm.key = bk.key AND dm.k = i + j WHERE i + j > 0) q),
al AS MATERIALIZED (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i + j) - 1 AS INT) AS pos, source_idx, target_idx FROM bk WHERE source_idx IS NOT NULL)"""


def _lambda_similarity() -> str:
    """Similarity of the words ``p`` and ``q`` of two lists, which hold letters and digits only but for case."""
    x, y = "lower(p)", "lower(q)"
    long, short = f"greatest(length({x}), length({y}))", f"least(length({x}), length({y}))"
    ratio = f"1.0::DOUBLE - levenshtein({x}, {y}) / {long}"
    return f"""CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN starts_with({x}, {y}) OR starts_with({y}, {x}) THEN 0.7::DOUBLE + 0.2::DOUBLE * {short} / {long}
      WHEN {long} - {short} > {long} // 2 THEN 0.0::DOUBLE WHEN {ratio} >= 0.6::DOUBLE THEN {ratio} ELSE 0.0::DOUBLE END"""


_LISTS = "SELECT transcript_id * 1000 + chunk AS key, list(text ORDER BY i) AS s, list(text ORDER BY i) FILTER (i % 9 <> 4) AS t FROM pl GROUP BY 1"
_ALIGNED = f"WITH RECURSIVE {fixtures.oracle('words')}, {_CHUNKED}, {_pair_sql(_LISTS)}"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("transcript_id", "chunk", F.col("words").alias("source"), F.filter("words", lambda w, i: i % 9 != 4).alias("target"))


_ASCII = "regexp_replace(text, '[^\\x01-\\x7F]', '', 'g')"  # the oracle measures distances in bytes
_MISHEARD = "CASE i % 7 WHEN 2 THEN a || 's' WHEN 5 THEN a[2:] WHEN 6 THEN 'x' || a[1:3] ELSE a END"
_NORM = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_MISHEARD_LISTS = f"""SELECT transcript_id * 1000 + chunk AS key, list({_NORM.format("a")} ORDER BY i) FILTER (a <> '') AS s,
  list({_NORM.format("heard")} ORDER BY i) FILTER (i % 9 <> 4 AND heard <> '') AS t FROM (SELECT *, {_MISHEARD} AS heard FROM (SELECT *, {_ASCII} AS a FROM pl) x) y GROUP BY 1"""


@query(f"WITH RECURSIVE {fixtures.oracle('spoken').replace('spoken AS', 'words AS')}, {_CHUNKED}, {_pair_sql(_MISHEARD_LISTS)} SELECT key // 1000 AS transcript_id, CAST(key % 1000 AS INT) AS chunk, pos, source_idx, target_idx FROM al")
def aligned_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations, without letters beyond ASCII, against what was misheard of them."""
    k, plain = F.col("i") % 7, F.col("plain")
    heard = F.when(k == 2, F.concat(plain, F.lit("s"))).when(k == 5, F.substring(plain, 2, 1 << 20)).when(k == 6, F.concat(F.lit("x"), F.substring(plain, 1, 3))).otherwise(plain)
    placed = chunks.chunk_words(fixtures.spoken_words(spark, sf_dir), 60, 10, 20).withColumn("plain", F.regexp_replace("text", r"[^\x01-\x7F]", "")).withColumn("heard", heard)
    rows = placed.groupBy("transcript_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "plain", "heard"))).alias("w"))
    source = F.transform(F.filter("w", lambda x: x["plain"] != ""), lambda x: x["plain"])
    target = F.transform(F.filter("w", lambda x: (x["i"] % 9 != 4) & (x["heard"] != "")), lambda x: x["heard"])
    return align.aligned_pairs(rows.select("transcript_id", "chunk", source.alias("source"), target.alias("target")))


_TIMED_LISTS = "SELECT transcript_id * 1000 + chunk AS key, list(text ORDER BY i) FILTER (again = 0) AS s, list(upper(text) ORDER BY i, again) FILTER (i % 9 <> 4) AS t FROM tw GROUP BY 1"


@query(
    f"WITH RECURSIVE {fixtures.oracle('words')}, {_CHUNKED}, tw AS MATERIALIZED (SELECT *, unnest(CASE WHEN i % 13 = 6 THEN [0, 1] ELSE [0] END) AS again FROM pl), {_pair_sql(_TIMED_LISTS)}"
    + """, hd AS (SELECT transcript_id * 1000 + chunk AS key, start_s, end_s, row_number() OVER (PARTITION BY transcript_id, chunk ORDER BY i, again) - 1 AS j FROM tw WHERE i % 9 <> 4),
sg AS (SELECT transcript_id * 1000 + chunk AS key, min(start_s) AS lo, max(end_s) AS hi FROM pl GROUP BY 1),
p1 AS (SELECT al.*, hd.start_s, hd.end_s, source_idx >= 0 AND target_idx >= 0 AS hit, sum(CASE WHEN source_idx >= 0 AND target_idx >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY al.key ORDER BY pos) AS g
  FROM al JOIN ms ON ms.key = al.key AND n <> m LEFT JOIN hd ON hd.key = al.key AND j = target_idx),
p2 AS (SELECT *, sum(CASE WHEN target_idx < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key, g ORDER BY pos) AS alone FROM p1),
gr AS (SELECT p2.key, g, coalesce(arg_max(end_s, pos) FILTER (g > 0 AND (hit OR source_idx < 0 AND alone = 0)), min(lo)) AS e, count(*) FILTER (target_idx < 0) AS k,
  min(start_s) FILTER (hit) AS s, min(hi) AS hi FROM p2 JOIN sg ON sg.key = p2.key GROUP BY ALL),
gn AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY key ORDER BY g), hi) AS nx FROM gr),
gx AS (SELECT *, CASE WHEN nx > e THEN (nx - e) / k ELSE 0.02::DOUBLE END AS step FROM gn),
tm AS (SELECT ms.key, source_idx, start_s, end_s FROM (SELECT key, j AS source_idx, start_s, end_s FROM hd) d JOIN ms ON ms.key = d.key AND n = m
  UNION ALL SELECT p2.key, source_idx, start_s, e FROM p2 JOIN gx ON gx.key = p2.key AND gx.g = p2.g WHERE hit
  UNION ALL SELECT p2.key, source_idx, e + (alone - 1) * step, e + alone * step FROM p2 JOIN gx ON gx.key = p2.key AND gx.g = p2.g WHERE target_idx < 0)
SELECT CAST(tm.key AS INT) AS transcript_id, CAST(source_idx AS INT) AS word_idx, s[source_idx + 1] AS text, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM tm JOIN ms ON ms.key = tm.key"""
)
def original_text_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose aligned words miss some originals and hold some twice."""
    placed = chunks.chunk_words(fixtures.words(spark, sf_dir), 60, 10, 20)
    heard = placed.where("i % 9 <> 4").withColumn("again", F.explode(F.sequence(F.lit(0), F.when(F.col("i") % 13 == 6, 1).otherwise(0))))
    item = F.struct("i", "again", F.struct(F.upper("text").alias("text"), "start_s", "end_s").alias("w"))
    aligned = heard.groupBy("transcript_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["w"]).alias("aligned"))
    text = placed.groupBy("transcript_id", "chunk").agg(segments.joined(F.collect_list(F.struct("i", "text"))).alias("original"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    rows = text.join(aligned, ["transcript_id", "chunk"]).withColumn("transcript_id", F.col("transcript_id") * 1000 + F.col("chunk"))
    return align.with_original_text(rows).select("transcript_id", "word_idx", "text", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(_ALIGNED + " SELECT CAST(key // 1000 AS INT) AS transcript_id, CAST(key % 1000 AS INT) AS chunk, CAST(count(*) FILTER (source_idx >= 0 AND target_idx >= 0) AS INT) AS matched, CAST(count(*) FILTER (target_idx < 0) AS INT) AS source_gaps, CAST(count(*) FILTER (source_idx < 0) AS INT) AS target_gaps FROM al GROUP BY key")
def dp_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.dp_alignment(_halves(spark, sf_dir)).select("transcript_id", "chunk", "matched", "source_gaps", "target_gaps")
