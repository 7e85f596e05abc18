"""Per-document operators against plain Python over whole texts."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from colloquy.llm import bpe_words, license_scan, quality_rules, token_orc
from colloquy.llm.queries import BYTE_RANKS, WORD_TOKENIZER
from colloquy.llm.shared import new_path

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_rules(odd_docs, odd_texts):
    def expected(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)

    got = quality_rules.quality_rules(odd_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = {r[0]: r for r in got.collect()}
    assert got.count() == odd_docs.count()
    for i, text in enumerate(odd_texts):
        assert tuple(found[i])[1:7] == expected(text or ""), i
        assert not (found[i]["kept"] and found[i]["base_failed"])
    assert found[11]["kept"] and not found[7]["kept"]


def test_coverage_counts_characters_in_repeated_windows(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dddd eeeee f " * 2 + "g h")], "doc_id long, text string")
    r = quality_rules.quality_rules(docs).first()
    assert r["dup_5gram_coverage"] == pytest.approx(16 / 34) and r["dup_6gram_coverage"] == pytest.approx(16 / 34) and r["dup_7gram_coverage"] == 0


def test_license_scan(odd_docs, odd_texts):
    phrases = [(p.split(), label) for p, label in license_scan.BASE_PHRASES.items()]
    found = {r["doc_id"]: r for r in license_scan.license_scan(odd_docs).collect()}
    for i, text in enumerate(odd_texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = [(k, label) for k in range(len(words)) for p, label in phrases if words[k : k + len(p)] == p]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), i
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_licence_expressions():
    postfix, whole = license_scan.parse_expression("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")
    assert whole and postfix == ["mit", "apache-2.0", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]
    assert license_scan.normal_form(postfix) == "(mit | apache-2.0) & gpl-2.0-only with classpath-exception-2.0"
    assert license_scan.satisfied(postfix, {"mit", "gpl-2.0-only"}) and not license_scan.satisfied(postfix, {"mit", "apache-2.0"})
    assert not license_scan.parse_expression("MIT OR (")[1] and not license_scan.parse_expression(") MIT")[1]
    scanned = license_scan.scan(b"// SPDX-License-Identifier: MIT OR Apache-2.0\nint main")
    assert scanned[5] == "apache-2.0,mit" and scanned[6] == 1.0 and scanned[7] == ["mit | apache-2.0"]


def test_byte_bpe_equals_the_tokenizer(odd_docs, odd_texts):
    path = public_tokenizers.path(BYTE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = [encoding.encode_ordinary(t or "") for t in odd_texts]
    for kind in ({}, {"batch_rows": 3, "batch_bytes": 1 << 14}):
        found = {r["doc_id"]: r for r in bpe_words.byte_bpe(odd_docs, path, public_tokenizers.PATTERN, **kind).collect()}
        hashed = {r["doc_id"]: r for r in bpe_words.byte_bpe_digest(odd_docs, path, public_tokenizers.PATTERN, **kind).collect()}
        assert len(found) == len(hashed) == len(odd_texts) + 1
        for i, ids in enumerate(expected):
            raw = (odd_texts[i] or "").encode()
            assert list(found[i]["ids"]) == ids and bytes(found[i]["decoded"]) == raw, i
            assert hashed[i]["n_tokens"] == len(ids) and hashed[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
            assert hashed[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_a_very_long_pre_token_round_trips(spark):
    text = "ab" * ((1 << 23) + 50) + " end"
    (row,) = bpe_words.byte_bpe(spark.createDataFrame([(1, text)], "doc_id long, text string"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN).collect()
    assert bytes(row["decoded"]).decode() == text


def test_packed_numbers_of_any_size():
    for numbers in ([], [0], [2**24, 2**24 + 5, 7], [2**40, 1]):
        assert bpe_words._unpack(bpe_words._pack(np.array(numbers, np.int64))).tolist() == numbers


def test_token_orc_round_trip(spark, odd_docs, odd_texts):
    from tokenizers import Tokenizer

    path = new_path(spark, "tokens")
    docs = odd_docs.where("doc_id IS NOT NULL AND key IS NULL AND words IS NOT NULL")
    token_orc.write_token_orc(docs, path, public_tokenizers.path(WORD_TOKENIZER), end_id=1, parts=3)
    rows = token_orc.read_token_orc(spark, path)
    found = {r["doc_id"]: r for r in token_orc.with_checksum(rows).collect()}
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER)), 0
    for i, text in enumerate(odd_texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    plan = rows.where("doc_id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan  # reaches the reader's row index and Bloom filter


def test_token_orc_files_have_bloom_filters_and_row_indexes(spark, odd_docs):
    path = new_path(spark, "tokens")
    token_orc.write_token_orc(odd_docs.where("doc_id IS NOT NULL"), path, public_tokenizers.path(WORD_TOKENIZER), end_id=1, parts=1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    assert any("BLOOM" in stripe.getStreams(i).getKind().toString() for i in range(stripe.getStreamsCount()))


def test_empty_tables(spark, no_docs):
    assert quality_rules.quality_rules(no_docs).count() == license_scan.license_scan(no_docs).count() == 0
    assert bpe_words.byte_bpe(no_docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN).count() == 0
    path = new_path(spark, "tokens")
    token_orc.write_token_orc(no_docs, path, public_tokenizers.path(WORD_TOKENIZER), end_id=1)
    assert token_orc.with_checksum(token_orc.read_token_orc(spark, path)).count() == 0


def test_long_and_unlisted_licence_expressions():
    pairs = [f"(LicenseRef-a{i} OR LicenseRef-b{i})" for i in range(20)]
    scanned = license_scan.scan(f"// SPDX-License-Identifier: {' AND '.join(pairs)}\nint main".encode())
    wanted = {f"licenseref-{x}{i}" for i in range(20) for x in "ab"}
    assert set(scanned[5].split(",")) == wanted and wanted == set(re.findall(r"[\w-]+", scanned[7][0]))
    for name in ("GPL-2.0+", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-3.0-or-later", "BSL-1.0", "OFL-1.1"):
        scanned = license_scan.scan(f"SPDX-License-Identifier: {name}".encode())
        assert scanned[5:] == (name.lower(), 1.0, [name.lower()])
    assert license_scan.scan(b"SPDX-License-Identifier: see the file")[5:] == ("", 0.0, [])
    assert license_scan.scan(b"/* SPDX-License-Identifier: NCSA */")[5] == "ncsa"


def test_expressions_of_a_thousand_terms_and_deep_brackets():
    terms = [f"LicenseRef-x{i}" for i in range(1000)]
    for text in (" OR ".join(terms), " AND ".join(terms), " AND (".join(" OR (".join(terms[i : i + 2]) for i in range(0, 1000, 2)) + ")" * 999):
        scanned = license_scan.scan(f"SPDX-License-Identifier: {text}".encode())
        assert len(scanned[5].split(",")) == 1000 and len(re.findall(r"[\w-]+", scanned[7][0])) == 1000
    assert "isc" in license_scan.scan(f"SPDX-License-Identifier: ISC OR {' OR '.join(['MIT'] * 150)} OR Zlib".encode())[5] and "zlib" in license_scan.scan(f"SPDX-License-Identifier: ISC OR {' OR '.join(['MIT'] * 150)} OR Zlib".encode())[5]


def test_scanning_takes_linear_time():
    notice = b"Permission under the MIT license and the Apache License or nothing\n"
    scanned = license_scan.scan(notice * (10_000_000 // len(notice)))
    n = 10_000_000 // len(notice)
    assert scanned[:4] == (n * 11, n * 2, 3, (n - 1) * 11 + 7)


def test_brackets_of_the_normal_form_keep_the_meaning():
    import itertools
    import random

    rng = random.Random(6)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice("abcd")
        return f"({made(depth - 1)} {rng.choice(['OR', 'AND'])} {made(depth - 1)})"

    for _ in range(200):
        first, whole = license_scan.parse_expression(made(4))
        again, _ = license_scan.parse_expression(license_scan.normal_form(first).replace("|", "OR").replace("&", "AND"))
        assert whole
        for n in range(5):
            for some in itertools.combinations("abcd", n):
                assert license_scan.satisfied(first, set(some)) == license_scan.satisfied(again, set(some))


def test_rows_of_a_hot_word_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from colloquy.llm import bpe_words

    tasks, each, groups = 4000, 5, 16
    batches = spark.range(tasks).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.shiftleft(F.col("id"), bpe_words._TASK_BITS) + i)).alias("batch"))
    sizes = [r["count"] for r in batches.groupBy(bpe_words._group_of(F.col("batch"), groups * bpe_words._WORD_ROWS).alias("g")).count().collect()]
    assert len(sizes) == groups and max(sizes) < 1.2 * tasks * each / groups
