"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from colloquy.llm.chat_format import ChatTemplate
from colloquy.llm.merkle_manifest import FAN_OUT
from colloquy.llm.minhash_dedup import NearDedup
from colloquy.llm.product_codes import ProductCodes
from colloquy.llm.quality_rules import RepetitionRules

_WORD = r"[^\x20\x09-\x0D]+"


def near_duplicates(how: NearDedup = NearDedup()) -> str:
    """All pairs of classes of equal word sequences by their shared shingles, and the smallest doc_id that links reach."""
    n = how.words
    return f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_WORD}') AS ws FROM documents),
        k AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS class FROM w),
        s AS (
          SELECT class, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(list_slice(ws, i, i + {n} - 1), ' '))) END) AS shingle
          FROM k WHERE doc_id = class),
        c AS (SELECT class, count(*) AS n FROM s GROUP BY class),
        p AS (SELECT a.class AS a, b.class AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.class < b.class GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c x ON x.class = a JOIN c y ON y.class = b WHERE 100 * n_both >= {how.percent} * (x.n + y.n - n_both)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT class AS a, class AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        m AS (SELECT a AS class, min(b) AS component FROM r GROUP BY a)
        SELECT k.doc_id, coalesce(c.n, 0) AS n_shingles, CASE WHEN c.n IS NULL THEN k.doc_id ELSE m.component END AS component_id,
          c.n IS NULL OR k.doc_id = m.component AS kept
        FROM k LEFT JOIN c USING (class) LEFT JOIN m USING (class)"""


def chat_format(template: ChatTemplate = ChatTemplate()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = "replace({}, '\\', '\\\\')"
    for mark in template.control():
        escaped = f"replace({escaped}, {quoted(mark)}, {quoted(mark[0] + chr(92) + mark[1:])})"
    around = f"{len(template.other_open) + len(template.other_close)} + length({escaped.format('role')})"
    for role, r in template.roles.items():
        around = f"CASE WHEN role = {quoted(role)} THEN {len(r.before) + len(r.after)} ELSE {around} END"
    loss = ", ".join(quoted(role) for role, r in template.roles.items() if r.loss)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' {order}) AS roles,
            string_agg(role || chr(10) || text || chr(10), '' {order}) AS said,
            coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text END, '' {order}), '') AS loss,
            sum({around} + length({escaped.format("text")}) + {len(template.end)}) AS formatted_chars
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, regexp_full_match(roles, 's?(ua)+') AS valid_order, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
          sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM g"""


def quality_rules(rules: RepetitionRules = RepetitionRules()) -> str:
    """Word windows as strings; a word is covered at n by a window that an earlier one of its text equals."""
    lengths = sorted(rules.ngram_limits)
    gram = lambda n: f"CASE WHEN n{n - 1} IS NOT NULL THEN concat_ws(' ', word, {', '.join(f'n{k}' for k in range(1, n))}) END AS g{n}"
    following = ", ".join(f"lead(word, {k}) OVER o AS n{k}" for k in range(1, lengths[-1]))
    again = lambda n: f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS a{n}"
    covered = lambda n: f"max(a{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
    share = lambda n: f"coalesce(sum(n_chars) FILTER (c{n}), 0)::DOUBLE / greatest(sum(n_chars), 1) AS dup_{n}gram_coverage"
    each = lambda f: ", ".join(f(n) for n in lengths)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        w AS (SELECT doc_id, i, word, {following} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, length(word) AS n_chars, {gram(3)}, {each(gram)} FROM w),
        a AS (SELECT doc_id, i, n_chars, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS a3, {each(again)} FROM g),
        c AS (SELECT doc_id, n_chars, {covered(3)}, {each(covered)} FROM a),
        m AS (SELECT doc_id, count(*) AS n_words, sum(n_chars) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {each(share)} FROM c GROUP BY doc_id),
        o AS (
          SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) > 1 AS later
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d)
          WHERE regexp_matches(line, '{_WORD}')),
        l AS (SELECT doc_id, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(length(line)) FILTER (later), 0)::DOUBLE / sum(length(line)) AS dup_line_coverage FROM o GROUP BY doc_id),
        r AS (
          SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_coverage, 0.0) AS dup_line_coverage,
            {each(lambda n: f"coalesce(dup_{n}gram_coverage, 0.0) AS dup_{n}gram_coverage")}
          FROM d LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)),
        v AS (
          SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed,
            dup_line_coverage > {rules.line_limit}::DOUBLE OR n_symbols > {rules.symbol_limit}::DOUBLE * word_chars OR
            {" OR ".join(f"dup_{n}gram_coverage > {x}::DOUBLE" for n, x in sorted(rules.ngram_limits.items()))} AS repetition_failed
          FROM r)
        SELECT *, NOT base_failed AND NOT repetition_failed AS kept FROM v"""


def merkle_manifest(fan_out: int = FAN_OUT) -> str:
    """Levels by a recursive query, siblings by windows over runs, the fold of tampered leaves by another one."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lower = f"CASE WHEN tampered THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END"
    table = [reduce(lambda r, _: r >> 1 ^ 0xEDB88320 * (r & 1), range(8), byte) for byte in range(256)]  # of crc32, a byte a step
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, strlen(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"
    levels = lambda name, start: f"""{name} AS (
          SELECT grp, 0 AS level, pos, n, digest FROM {start}
          UNION ALL
          SELECT grp, level + 1, pos // {fan_out}, (n + {fan_out - 1}) // {fan_out}, sha256(string_agg(digest, '' ORDER BY pos))
          FROM {name} WHERE n > 1 GROUP BY grp, level, pos // {fan_out}, n)"""  # noqa: E731
    steps = lambda name, of: f"""{name} AS (
          SELECT grp, level, pos, coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM {of} WHERE n > 1 WINDOW r AS (PARTITION BY grp, level, pos // {fan_out} ORDER BY pos))"""  # noqa: E731
    return f"""
        WITH RECURSIVE i AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, coalesce('=' || source, '') AS grp FROM documents),
        t AS (SELECT *, coalesce({crc} % 5 = 0, false) AS tampered FROM i),
        d AS (SELECT doc_id, grp, {leaf("text")} AS digest, {leaf(lower)} AS found FROM t),
        a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
        {levels("x", "a")},
        s AS (SELECT '' AS grp, grp AS of, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM x WHERE n = 1),
        {levels("y", "s")},
        {steps("xs", "x")},
        {steps("ys", "y")},
        p AS (
          SELECT a.grp, a.pos, level, before, after FROM a JOIN xs ON xs.grp = a.grp AND xs.pos = a.pos // CAST(power({fan_out}, level) AS BIGINT)
          UNION ALL
          SELECT a.grp, a.pos, 1000 + level, before, after FROM a JOIN s ON s.of = a.grp JOIN ys ON ys.pos = s.pos // CAST(power({fan_out}, level) AS BIGINT)),
        l AS (SELECT grp, pos, list(before ORDER BY level) AS b, list(after ORDER BY level) AS e FROM p GROUP BY ALL),
        f AS (
          SELECT grp, pos, 0 AS k, found FROM a
          UNION ALL SELECT f.grp, f.pos, k + 1, sha256(b[k + 1] || found || e[k + 1]) FROM f JOIN l USING (grp, pos) WHERE k < len(b)),
        g AS (SELECT grp, pos, arg_max(found, k) AS folded_root FROM f GROUP BY ALL)
        SELECT a.doc_id, a.digest AS leaf, s.digest AS subroot, y.digest AS root,
          sha256(coalesce(array_to_string(list_transform(range(1, len(b) + 1), lambda k: b[k] || e[k]), ''), '')) AS proof_sha256,
          folded_root, folded_root = y.digest AS verified
        FROM a JOIN s ON s.of = a.grp JOIN y ON y.n = 1 JOIN g ON g.grp = a.grp AND g.pos = a.pos LEFT JOIN l ON l.grp = a.grp AND l.pos = a.pos"""


def product_codes(how: ProductCodes = ProductCodes()) -> str:
    """Every part against every entry of its codebook, round by round; all in integers."""
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    nearest = lambda k: f"""a{k} AS MATERIALIZED (
          SELECT r, vec_id, label, part, x, struct_extract(m, 'e') AS e, struct_extract(m, 'far') AS far FROM (
            SELECT v.r, v.vec_id, v.label, v.part, v.x, min(struct_pack(far := CAST({far} AS BIGINT), e := c.e)) AS m
            FROM v JOIN c{k} c ON c.part = v.part GROUP BY ALL))"""  # noqa: E731
    moved = lambda k: f"""s{k} AS (
          SELECT part, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
            SELECT part, e, i, sum(y) AS total, count(*) AS n FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
        c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.e = c.e)"""  # noqa: E731
    steps = ",\n        ".join(f"{nearest(k)},\n        {moved(k)}" for k in range(how.rounds))
    return f"""
        WITH k AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (
            SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor({how.scale} * y::DOUBLE) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)),
        v AS MATERIALIZED (
          SELECT r, vec_id, label, p AS part, list_slice(x, p * (len(x) // {how.parts}) + 1, (p + 1) * (len(x) // {how.parts})) AS x
          FROM k, (SELECT unnest(range({how.parts})) AS p)),
        c0 AS (SELECT part, r - 1 AS e, x FROM v WHERE r <= {how.entries}),
        {steps},
        {nearest(how.rounds)},
        f AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{how.rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM c{how.rounds}) AS codebooks_sha256
        FROM f"""


ORACLE_SQL = {"op4_minhash_dedup": near_duplicates(), "op5_chat_format": chat_format(), "op8_quality_rules": quality_rules(), "op11_merkle_manifest": merkle_manifest(), "op13_product_codes": product_codes()}
