"""Near copies and shared passages against all pairs of a small corpus."""

import itertools
import random
import re

import numpy as np
import pytest

from colloquy.llm import minhash_dedup, substring_dedup
from colloquy.llm.minhash_dedup import NearDedup
from colloquy.llm.shared import materialise
from tests.llm.conftest import prose


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    return out


def components_of(texts, percent):
    sets = sets_of(texts)
    group = {i: i for i in texts}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in texts}


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(3)
    texts = {}
    for _ in range(25):
        base = prose(rng, rng.randint(30, 400))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = "".join(prose(rng, 2))
            texts[len(texts)] = " ".join(copy)
            base = copy if rng.random() < 0.4 else base  # chains: a copy of a copy
    return texts | {900: "one two three", 901: "One  two\nthree", 902: "", 903: None, 904: "one two three four"}


@pytest.mark.parametrize("how", [NearDedup(), NearDedup(block=4, block_shingles=300, hub_group=2), NearDedup(percent=80, margin=0.1, rows=6, bands=42)])
def test_near_duplicates_equal_all_pairs(spark, near_texts, how):
    docs = spark.createDataFrame(list(near_texts.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, how).collect()}
    assert found == components_of(near_texts, how.percent)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[12]["component_id"] == 11 and by[15]["component_id"] == 4 and by[0]["kept"] and by[1]["kept"]
    kept = minhash_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == set(by) - {12, 15}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0 and minhash_dedup.drop_near_duplicates(no_docs).count() == 0


def test_estimate_follows_true_similarity(spark, near_texts):
    how = NearDedup()
    signed = minhash_dedup.signatures(spark.createDataFrame(list(near_texts.items()), "doc_id long, text string"), how).where("n_shingles > 0")
    a, b = (signed.selectExpr(f"doc_id AS {x}", f"signature AS s{x}") for x in "ab")
    sets = sets_of(near_texts)
    for r in a.join(b, a["a"] < b["b"]).where("b < 40").select("a", "b", minhash_dedup.estimate(a["sa"], b["sb"], how).alias("e")).collect():
        true = len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])
        assert abs(r["e"] - true) < 0.16


def test_planted_passages_are_found_and_cut(spark):
    rng = random.Random(11)
    passage = prose(rng, 70)
    short = prose(rng, 30)
    edited = list(passage)
    edited[20], edited[45] = "changed", "word"
    texts = {i: prose(rng, 150) for i in range(12)}
    for i, p in ((1, passage), (4, passage), (7, edited), (9, short), (10, short)):
        texts[i][60:60] = p
    docs = spark.createDataFrame([(i, " ".join(w), "x", len(" ".join(w))) for i, w in texts.items()], "doc_id long, text string, lang string, n_chars long")
    found = {r["doc_id"]: r for r in substring_dedup.find_passages(docs).collect()}
    assert set(found) == {4, 7}  # the first holder keeps it; what is under 50 words stays
    for r in found.values():
        assert (r["source_doc_id"], r["source_start_word"]) == (1, r["start_word"]) and abs(r["start_word"] - 60) <= 2 and abs(r["end_word"] - 130) <= 2
    assert found[4]["identity"] == 1.0 and found[7]["identity"] < 1.0
    cut = {r["doc_id"]: r for r in substring_dedup.cut_passages(docs, substring_dedup.find_passages(docs)).collect()}
    for i, words in texts.items():
        left = cut[i]["text"].split()
        assert left == words if i not in found else abs(len(left) - 150) <= 4
        assert cut[i]["n_chars"] == len(cut[i]["text"]) and cut[i]["lang"] == "x"


def test_longest_common_subsequence_and_chains():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
        assert substring_dedup.common(a, b) == row[-1]
    runs = [(0, 10, 100, 10), (12, 20, 112, 8), (15, 25, 500, 10), (30, 40, 130, 10)]
    assert substring_dedup.chains(runs, 0.25)[0] == [0, 1, 3]


def test_passages_of_odd_rows(odd_docs, no_docs):
    found = substring_dedup.find_passages(odd_docs)
    assert {r["doc_id"] for r in found.collect()} == {12}
    cut = substring_dedup.cut_passages(odd_docs, found)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[12] in ("end", "")
    assert substring_dedup.find_passages(no_docs).count() == 0 and substring_dedup.cut_passages(no_docs, substring_dedup.find_passages(no_docs)).count() == 0


def test_passages_around_a_differing_middle_are_both_found(spark):
    rng = random.Random(31)
    head, tail = prose(rng, 100), prose(rng, 100)
    texts = [[*prose(rng, 20), *head, *prose(rng, 80), *tail, *prose(rng, 20)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = sorted((r["start_word"], r["end_word"]) for r in substring_dedup.find_passages(docs).collect())
    assert len(found) == 2
    assert all(abs(got - want) <= 2 for r, w in zip(found, [(20, 120), (200, 300)], strict=True) for got, want in zip(r, w, strict=True))


def test_passage_whose_phrases_stand_alone_in_earlier_documents(spark):
    rng = random.Random(37)
    passage = prose(rng, 60)
    texts = [[*prose(rng, 30), *passage[i : i + 8], *prose(rng, 30)] for i in range(53)]
    texts += [[*prose(rng, 40), *passage, *prose(rng, 40)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    (found,) = substring_dedup.find_passages(docs).collect()
    assert (found["doc_id"], found["source_doc_id"]) == (54, 53)
    assert abs(found["start_word"] - 40) <= 2 and abs(found["end_word"] - 100) <= 2


@pytest.mark.parametrize("phrases", [False, True])
@pytest.mark.parametrize(("identity", "recall"), [(0.8, 0.9), (0.85, 0.9), (0.9, 1.0)])
def test_recall_of_edited_passages(spark, identity, recall, phrases):
    """Of 60 words with edits; with ``phrases``, eight words of each passage stand alone in six earlier documents too."""
    rng = random.Random(41)
    texts, planted = [], 40
    for _ in range(planted):
        first = prose(rng, 60)
        again = list(first)
        for i in rng.sample(range(60), round(60 * (1 - identity))):
            again[i] = f"edit{rng.randrange(10**9)}"
        assert substring_dedup.common(first, again) >= 60 * identity  # what brute force finds
        texts += [[*prose(rng, 60), *p, *prose(rng, 60)] for p in (first, again)]
    if phrases:
        early = [[*prose(rng, 20), *texts[2 * i][60 + a : 68 + a], *prose(rng, 20)] for i in range(planted) for a in range(2, 52, 9)]
        texts = [*early[: len(early) // 2 * 2], *texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"] for r in substring_dedup.find_passages(docs).collect() if r["start_word"] < 120 and r["end_word"] > 60 and r["source_doc_id"] == r["doc_id"] - 1}
    assert len(found) >= recall * planted, len(found)


def test_edited_passage_whose_phrases_stand_in_many_earlier_documents(spark):
    """Every twelfth word is edited, so no long seed links the two holders; each phrase has an earlier first holder."""
    rng = random.Random(43)
    first = prose(rng, 200)
    again = [f"edit{i}" if i % 12 == 11 else w for i, w in enumerate(first)]
    texts = [(i, [*prose(rng, 30), *first[12 * i : 12 * i + 11], *prose(rng, 30)]) for i in range(17)]
    texts += [(1000, [*prose(rng, 40), *first, *prose(rng, 40)]), (1001, [*prose(rng, 40), *again, *prose(rng, 40)])]
    (found,) = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")).collect()
    assert (found["doc_id"], found["source_doc_id"]) == (1001, 1000)
    assert abs(found["start_word"] - 40) <= 2 and abs(found["end_word"] - 240) <= 3


def _plain_links(rows):
    by = {}
    for seed, doc, pos in rows:
        by.setdefault(seed, {}).setdefault(doc, []).append(pos)
    return {
        (seed, d, o, p, docs[o][min(r, len(docs[o]) - 1)], o != min(docs))
        for seed, docs in by.items() for i, d in enumerate(sorted(docs)) if i
        for o in {min(docs), sorted(docs)[i - 1]} for r, p in enumerate(docs[d])
    }


@pytest.mark.parametrize("parts", [1, 2, 13, 64])
def test_links_do_not_depend_on_partitions_or_batches(spark, parts):
    rng = random.Random(3)
    rows = sorted({(rng.choice([5, 5, 5, 7, rng.randrange(60)]), d, rng.randrange(1000)) for d in range(300) for _ in range(rng.randint(1, 12))})
    given = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000" if parts == 2 else "37"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        found = [tuple(r) for r in substring_dedup.seed_matches(spark.createDataFrame(rows, "seed long, doc_id long, pos int").repartition(3)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == len(set(found)) and set(found) == _plain_links(rows)


def test_long_chains_are_aligned_in_linear_time():
    """A match of fifty words in every hundred: one chain of 40,000 words, under the identity all over."""
    import time

    rng = np.random.default_rng(5)
    n = 40_000
    a, b = (rng.integers(0, 1 << 31, n, dtype=np.uint32) for _ in range(2))
    pieces = [(i, i + 50, i) for i in range(0, n, 100)]
    for s, e, _ in pieces:
        b[s:e] = a[s:e]
    began = time.perf_counter()
    found = substring_dedup.parts_alike(a, b, pieces, substring_dedup.PassageSearch())
    assert time.perf_counter() - began < 10  # about half a second where nothing else runs
    assert [(s, e) for s, e, *_ in found] == [(s, e) for s, e, _ in pieces]


def family(n: int, seed: int) -> list[list[str]]:
    """Copies of copies, each with a few words changed: many pairs lie about the limit."""
    rng = random.Random(seed)
    texts = [prose(rng, 100)]
    while len(texts) < n:
        copy = list(rng.choice(texts))
        for i in rng.sample(range(100), rng.choice([1, 1, 2, 3])):
            copy[i] = f"w{rng.randrange(10**6)}"
        texts.append(copy)
    return texts


def test_rows_that_leave_a_large_group_grow_with_its_members(spark, monkeypatch):
    made = {}

    def counting(df, name, codec="zstd"):
        out = materialise(df, name, codec)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash_dedup, "materialise", counting)
    monkeypatch.setattr("colloquy.llm.components.materialise", counting)
    for n in (200, 2000):
        texts = {i: " ".join(w) for i, w in enumerate(family(n, 5))}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect()}
        if n == 200:
            assert found == components_of(texts, 85)
        assert made["inner-links"] < n, made
        assert max(made[k] for k in ("salted-pairs", "star-links", "open-members", "near-members")) <= NearDedup().bands * n, made


def test_seed_links_equal_plain_python(spark):
    rng = random.Random(17)
    rows = sorted({(rng.choice([1, 1, 1, 2, 5, 9]), rng.randrange(30), rng.randrange(60)) for _ in range(400)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        given = spark.createDataFrame(rows, "seed long, doc_id long, pos int").repartition(4)
        found = {(r["seed"], r["doc_id"], r["owner"], r["pos"], r["opos"]) for r in substring_dedup.seed_matches(given).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    places = {}
    for s, d, p in rows:
        places.setdefault((s, d), []).append(p)
    at_borders = 0
    for (s, d), own in places.items():
        earlier = [x for t, x in places if t == s and x < d]
        linked = {o for t, x, o, _, _ in found if (t, x) == (s, d)}
        assert linked <= set(earlier) and (not earlier or linked)
        assert s % 2 == 0 or not earlier or max(earlier) in linked  # a long seed: the document before it
        for i, p in enumerate(own if earlier and s % 2 else []):
            theirs = places[s, max(earlier)]
            if (s, d, max(earlier), p, theirs[min(i, len(theirs) - 1)]) not in found:
                at_borders += 1  # across partitions only the two places at the border are linked
    assert at_borders <= 12


def test_passage_whose_long_pieces_stand_alone_in_earlier_documents(spark):
    rng = random.Random(43)
    passage = prose(rng, 80)
    texts = [[*prose(rng, 30), *passage[i : i + 25], *prose(rng, 30)] for i in range(0, 56)]
    texts += [[*prose(rng, 40), *passage, *prose(rng, 40)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substring_dedup.find_passages(docs).collect()}
    assert found[57]["source_doc_id"] == 56 and abs(found[57]["start_word"] - 40) <= 2 and abs(found[57]["end_word"] - 120) <= 2


def test_recall_of_shared_passages_against_all_pairs(spark):
    """Every exact passage of 50 words or more that two documents share, found by comparing all pairs of windows."""
    rng = random.Random(53)
    passages = [prose(rng, rng.randint(50, 120)) for _ in range(12)]
    common = [prose(rng, rng.randint(6, 12)) for _ in range(30)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += prose(rng, rng.randint(10, 60))
            words += rng.choice(passages) if rng.random() < 0.3 else rng.choice(common)
        texts.append(words + prose(rng, 10))
    first: dict[tuple, int] = {}
    wanted = []  # document and first word of each window of 50 words that an earlier document has
    for i, words in enumerate(texts):
        own = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        wanted += [(i, k) for k, w in enumerate(own) if first.get(w, i) < i]
        for w in own:
            first.setdefault(w, i)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = [(r["doc_id"], r["start_word"], r["end_word"]) for r in substring_dedup.find_passages(docs).collect()]
    hit = sum(any(d == i and s <= k + 1 and k + 49 <= e for d, s, e in found) for i, k in wanted)
    assert wanted and hit >= 0.98 * len(wanted), (hit, len(wanted))
    clean = {i for i in range(120)} - {i for i, _ in wanted}
    assert not {d for d, _, _ in found} & clean


def test_stretches_of_many_groups_are_found_at_once(spark):
    """Equal to a plain walk along each diagonal, for many groups and for none."""
    rng = random.Random(8)
    rows = [(g, *x) for g in range(300) for x in {(p, p + rng.choice([0, 0, 0, 7, 90])) for p in (rng.randrange(400) for _ in range(rng.choice([1, 1, 2, 9, 40])))}]
    group, pos, opos = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    for reach in (5, 48):
        plain = []
        for g in range(300):
            runs = {}
            for p, o in sorted((p, o) for h, p, o in rows if h == g):
                own = runs.setdefault(p - o, [])
                if own and p - own[-1][-1] <= reach:
                    own[-1].append(p)
                else:
                    own.append([p])
            plain += sorted((g, r[0], r[-1] + 5, r[0] - d, 5 + sum(min(y - x, 5) for x, y in itertools.pairwise(r))) for d, own in runs.items() for r in own)
        assert list(zip(*(x.tolist() for x in substring_dedup.runs_of_groups(group, pos, opos, 5, reach)), strict=True)) == plain
    assert [len(x) for x in substring_dedup.runs_of_groups(*[np.zeros(0, np.int64)] * 3, 5, 48)] == [0] * 5


def test_links_are_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(substring_dedup, "materialise", lambda df, name, codec="zstd": names.append(name) or materialise(df, name, codec))
    passage = " ".join(prose(random.Random(4), 80))
    docs = spark.createDataFrame([(1, passage), (2, "a b c " + passage)], "doc_id long, text string")
    assert [(r["doc_id"], r["start_word"], r["n_words"]) for r in substring_dedup.find_passages(docs).collect()] == [(2, 3, 80)]
    assert "links" not in names and names.count("seed-links") == 1


def test_open_links_of_a_common_seed_are_looked_up_and_not_joined_apart(spark, monkeypatch):
    rows = [(7, d, p) for d in range(3000) for p in (1, 9)] + [(s, 5, s) for s in range(20, 60)]
    written = {}

    def noted(df, name, *codec):
        written[name] = materialise(df, name, *codec)
        return written[name]

    monkeypatch.setattr(substring_dedup, "materialise", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = substring_dedup.seed_matches(spark.createDataFrame(rows, "seed long, doc_id long, pos int").repartition(3))
        assert set(map(tuple, links.collect())) == _plain_links(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(written) == {"seed-links", "edges"}  # links of open places were joined and written apart
    assert written["seed-links"].where("seed = 7").select("part").distinct().count() > 2
    assert written["seed-links"].where(written["seed-links"]["kind"] == substring_dedup._TO_LAST).count() <= 16  # two documents with two places in each of 4 partitions
