"""Chat formatting, page text, test items, the quality classifier and the pipeline."""

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from colloquy.llm import chat_format, decontaminate, html_extract, quality_classifier
from colloquy.llm.html_dom import Matching, parse, skeleton
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


# chat formatting

ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>\\", "<s>", "<\\/s>", "[ROLE]x[/ROLE]", "", None, " <<SYS>> \n<</SYS>>", "<<s>s></s></s>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None, "</s>"]), rng.choice(ODD)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, None, "user", "b"), (100, None, "user", "a"), (100, 1, "assistant", "c"), (100, 1, "assistant", "c"), (None, 0, "user", "d")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": chat_format.F.lit(1), "turns": chat_format.F.lit("x")})
    expected = {}
    for c, turn, role, text in rows:
        expected.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    assert set(found) == set(expected)
    for c, turns in expected.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [t[2:] for t in turns]
        assert "".join(s["text"] for s in found[c]["segments"]) == found[c]["formatted"]
        assert found[c]["formatted"].count("</s>") == len(turns)
        loss = [s["text"] for s in found[c]["segments"] if s["loss"]]
        assert [chat_undone(x) for x in loss] == [t[3] for t in turns if t[2] == "assistant"]


def chat_undone(text):
    import re

    return re.sub(r"\\(\\?)", r"\1", text)


@pytest.mark.parametrize("roles, valid", [("user assistant", True), ("system user assistant user assistant", True), ("user user assistant", False), ("assistant", False), ("user", False), ("system assistant", False)])
def test_turn_order(spark, roles, valid):
    rows = [(1, i, r, "t") for i, r in enumerate(roles.split())]
    assert chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["valid_order"] is valid


def test_chat_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    plan = chat_format.read_back(chat_format.format_chats(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat_format.format_chats(rows.limit(0)).count() == 0


# page text

PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div>"
    "<article><h1>Head &amp; tail</h1><p>First <b>bold</b>\n  text&nbsp;here &#233;.</p><p>{}</p></article><aside>More</aside><div class='comments'>Nice!</div><form><input></form><footer>&copy; x</footer></body></html>"
)


def test_page_text(spark):
    rows = [(i, "https://a.example/" + str(i), PAGE.replace("<p>{}</p>", f"<p>Body {i}.</p>")) for i in range(5)]
    rows += [(10, None, None), (11, "http://b.example/x", ""), (12, "http://b.example/y", "plain <b>words</b> only"), (None, "http://a.example/0", "<p>cut off"), (0, "https://a.example/0", PAGE.replace("<p>{}</p>", "<p>Body 0.</p>"))]
    found = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_extract.F.lit("clash")))
    by = {}
    for r in found.collect():
        by.setdefault(r["page_id"], []).append(r["text"])
    for i in range(5):
        assert set(by[i]) == {f"Head & tail\nFirst bold text here é.\nBody {i}."}
    assert len(by[0]) == 2 and by[10] == by[11] == [""] and by[12] == ["plain words only"] and by[None] == ["cut off"]
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_drops_what_pages_of_a_host_share(spark):
    body = "<html><body><section><p>Welcome to our site of many words</p></section><div><p>Own text number {0} of this page, with detail {0}.</p></div><center><p>Always the same closing line</p></center></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(6)]
    for size in (16 << 20, 0):  # wrappers broadcast, or joined by host
        for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=size).collect():
            assert r["text"] == f"Own text number {r['page_id']} of this page, with detail {r['page_id']}."


def random_page(rng, depth=0):
    if depth == 4:
        return ""
    return "".join(f"<{t}>{random_page(rng, depth + 1)}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randint(0, 3)))


def test_simple_tree_matching_equals_plain_recursion():
    rng = random.Random(8)
    for _ in range(150):
        one, two = (skeleton(parse(random_page(rng))) for _ in range(2))

        def best(x, y, one=one, two=two):
            if one.signature[x] != two.signature[y]:
                return 0
            p, q = one.kids[x], two.kids[y]
            rows = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i in range(len(p)):
                for j in range(len(q)):
                    rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + best(p[i], q[j]))
            return 1 + rows[-1][-1]

        aligned = Matching(one, two).aligned()
        assert len(aligned) == best(0, 0)
        assert all(one.signature[k] == two.signature[n] for k, n in aligned)


def test_runs_of_equal_siblings_are_one_node():
    one, two = (skeleton(parse(f"<ul>{'<li>b</li>' * n}</ul>")) for n in (1, 5))
    assert one.shape == two.shape and len(two.members[-1]) == 5


def test_template_texts_decide_inside_articles_too(spark):
    body = "<html><body><div class='q1'><p>Menu words that never change at all</p></div><article><h2>Title {0}</h2><p>Own text number {0} of this page, longer than the rest of it {0}.</p><p>Read more of our stories every day</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.extract_main_text(pages).collect():
        i = r["page_id"]
        assert r["text"] == f"Title {i}\nOwn text number {i} of this page, longer than the rest of it {i}."
    host = html_extract.induce_wrappers(pages).first()["references"]
    shape, marks = html_extract._read(host[0]["reference"])
    every = [(shape, marks, dict(enumerate(marks)))]  # all texts of the reference declared template
    assert html_extract.extract(rows[0][2], every) == "" and html_extract.extract(rows[0][2], []).count("\n") == 2


def test_slots_of_pages_without_known_names(spark):
    body = "<html><body><div class='zq1'><ul><li><a href='/'>Start {1}</a></li><li><a href='/x'>Other {1}</a></li></ul></div><div class='zq2'><h1>Head {0}</h1><p>Text of page {0}, all its own {0}.</p><div>Terms of use apply</div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(i, i % 3)) for i in range(7)]
    for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"] == "Head {0}\nText of page {0}, all its own {0}.".format(r["page_id"])


def test_copies_of_a_page_do_not_make_it_template(spark):
    body = "<article><h1>Same title</h1><p>The very same text on many pages of one host.</p></article>"
    rows = [(i, f"http://h.example/{i}", body) for i in range(6)] + [(9, "http://h.example/9", body.replace("many", "more"))]
    found = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("Same title\nThe very same text") for r in found)


@pytest.mark.parametrize("tag", ["div", "span", "b", "ul"])
def test_deep_pages(tag):
    page = f"<body>{('<' + tag + '>') * 5000}deep words{('</' + tag + '>') * 5000}</body>"
    shape = skeleton(parse(page))
    reference = html_extract._read(html_extract._written(shape, html_extract.own_texts(parse(page))))
    assert html_extract.extract(page, [(*reference, {})]) == "deep words"
    assert len(Matching(reference[0], shape).aligned()) == len(shape.shape)
    assert list(html_extract.evidence(page, [(*reference, {})], 0.7)) == []


def test_names_inside_articles_count_whole():
    page = "<article><h2 id='related-work'>Related</h2><p class='side-note'>Kept</p><div class='related'>Gone</div></article><article class='comment'>Gone</article>"
    assert html_extract.extract(page, []) == "Related\nKept"


# test items

def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        before, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 20))) for _ in range(2))
        assert decontaminate.myers(a, b)[0] == edits(a, b)


def test_items_within_the_budget_are_found(spark, odd_docs):
    rng = random.Random(9)
    items = {i: " ".join(prose(rng, 30)) for i in range(8)}
    rows = []
    for i in range(80):
        k = rng.randrange(8)
        text = list(items[k])
        for _ in range(rng.randint(0, 14)):
            p = rng.randrange(len(text))
            text[p : p + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        rows.append((i, " ".join(prose(rng, 20)) + " \n" + "".join(text).upper() + "  " + " ".join(prose(rng, 20))))
    rows += [(90, "before X1  y2\nz3, after"), (91, "before xx1 y2 z3 after")]  # a short item: whole words only
    items[52] = "x1 y2 z3"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items() if i != 52] + [(50, None, 1), (51, "short", 1), (52, "x1 y2 z3", 1)], "item_id long, text string, doc_id int")
    for bits in (26, 8):  # a bit map that lets most windows through gives the same rows
        found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(docs, bench, bits=bits).collect()}
        for d, text in rows:
            for k, item in items.items():
                least = edits(decontaminate.normal(item), decontaminate.normal(text))
                near = d == 90 if k == 52 else least <= int(0.05 * len(item))
                assert ((d, k) in found) == near, (d, k, least)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert decontaminate.find_items(odd_docs, bench).count() == 0 and decontaminate.drop_contaminated(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0 and decontaminate.find_items(docs.limit(0), bench).count() == 0


def test_hits_are_all_windows_that_are_pieces(spark, monkeypatch):
    rng = random.Random(15)
    bench = spark.createDataFrame([(i, " ".join(prose(rng, n))) for i, n in enumerate((1, 2, 12, 40, 300))], "item_id long, text string")
    items = decontaminate._items(bench, 0.05)
    pieces = decontaminate._pieces(items)
    known = {r["item"]: r for r in items.collect()}
    at = {(known[r["item"]]["text"][r["at"] : r["at"] + r["length"]]) for r in pieces.collect()}
    assert all("".join(known[k]["text"][r["at"] : r["at"] + r["length"]] for r in sorted(pieces.where(f"item = {k}").collect(), key=lambda r: r["at"])) == known[k]["text"] for k in known)
    text = " ".join(prose(rng, 50)) + " ß北 ".join(known[k]["text"] for k in sorted(known)) + " ".join(prose(rng, 5))
    texts = [text, "", text[5:], "x"]
    wanted = {(k, len(p), i) for k, t in enumerate(texts) for p in at for i in range(len(t)) if t.startswith(p, i)}
    for segment in (1 << 21, 64):
        monkeypatch.setattr(decontaminate, "_SEGMENT", segment)
        found = {(k, n, i) for k, own in enumerate(decontaminate._Filter(pieces, 26).hits(texts)) for _, n, i in own}
        assert wanted <= found and len(found - wanted) <= 4


# quality classifier

def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    kinds = len(quality_classifier.LABELLERS)
    bad = rng.random(6000) < 0.25
    votes = np.where(rng.random((6000, kinds)) < 0.9, 1, 0).astype(np.int8)
    own = rng.integers(0, kinds, 6000)
    hit = bad & (rng.random(6000) < 0.95)
    votes[hit, own[hit]] = -1
    noise = ~bad & (rng.random(6000) < 0.01)
    votes[noise, own[noise]] = -1
    _, p = quality_classifier.fit_accuracies(votes, np.zeros(6000, np.int64), np.ones(6000), 60)
    assert ((p > 0.5) == bad).mean() > 0.95


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality_classifier.fit_quality(docs, fit)
    rows = quality_classifier.score_documents(docs, model).join(held, "doc_id").select("kept", "quality", "toxic").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    toxic = [r["kept"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.02 and np.mean(toxic) < 0.1


def test_classifier_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, None, None), (None, 0, 1), (77, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), None):
        model = quality_classifier.fit_quality(odd_docs, given)
        scored = quality_classifier.score_documents(odd_docs, model)
        by = {r["doc_id"]: r for r in scored.collect()}
        assert scored.count() == odd_docs.count() and all(not by[i]["kept"] and by[i]["score"] == 1.0 for i in (0, 1, 2))
        kept = quality_classifier.keep_good(odd_docs, model)
        assert kept.columns == odd_docs.columns and kept.count() == scored.where("kept").count()
    model = quality_classifier.fit_quality(no_docs, labels)
    assert quality_classifier.score_documents(no_docs, model).count() == quality_classifier.keep_good(no_docs, model).count() == 0


def plain_votes(text, stems, known, how):
    """The labellers' votes on one text in plain Python, and its distinct features' stems."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if n < 3000 else None
    letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    bangs, symbols = text.count("!"), len(re.findall(r"[#*$%&|<>]", text))
    plain = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    wn, length = len(plain), sum(map(len, plain))
    function = sum(w in set(quality_classifier.FUNCTION_WORDS) for w in plain)
    hits = sum(any(len(w) >= k and w[:k] in stems for k in (4, 5, 6)) for w in plain)
    many, pw, let, w = n >= 20, max(wn, 1), max(letters, 1), max(n, 1)
    vote = lambda keep, reject: -1 if reject else 1 if keep else 0
    votes = [
        vote(symbols < 0.05 * w, symbols > 0.30 * w), vote(upper < 0.12 * let, upper > 0.35 * let and many), vote(bangs < 0.05 * w, bangs > 0.25 * w),
        None if inside is None else vote(len(inside) < 0.15 * w, len(inside) > 0.40 * w and many),
        vote(function > 0.10 * pw, function < 0.02 * pw and many), vote(3.8 * pw < length < 6.3 * pw, (length < 3.0 * pw or length > 7.5 * pw) and many),
        vote(len(set(plain)) > 0.35 * pw, len(set(plain)) < 0.15 * pw and wn >= 60), vote(False, hits > 0 and known.evidence(hits, wn) >= how.stem_evidence),
    ]
    return votes, {w[:k] for w in plain for k in (4, 5) if len(w) >= k}, n


def test_votes_and_scores_equal_plain_python(spark, odd_texts):
    import math

    rng = random.Random(12)
    texts = odd_texts[:12] + ["ABC DEF! " * 15, "# * $ % " * 30, "pre" * 40 + " words" * 25, "badly badword badness good " * 9, "und der die das ist wort " * 8] + [" ".join(prose(rng, rng.randint(5, 200))) for _ in range(40)]
    stems = ["badw", "badne", "kelimo", "numi"]
    how = quality_classifier.QualityModel(bits=12)
    known = quality_classifier.Stems(quality_classifier._hash_list(stems), 0.2, 0.01)
    weights = np.random.default_rng(5).normal(size=(1 << how.bits) + 1).astype(np.float32)
    model = quality_classifier.FittedQuality(how, known, weights, {})
    rows = {r["doc_id"]: r for r in quality_classifier.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    k = len(quality_classifier.LABELLERS)
    for i, text in enumerate(texts):
        votes, own, n = plain_votes(text, set(stems), known, how)
        given = ["r-k".index(v) - 1 for v in rows[i]["votes"]]
        votes = [g if v is None else v for v, g in zip(votes, given, strict=True)]
        assert given == votes, (i, given, votes)
        places = {max(int(quality_classifier._hash_list([s])[0]) >> (64 - how.bits), 3 * k) for s in own}
        z = sum(weights[3 * j + v + 1] for j, v in enumerate(votes)) + sum(weights[p] for p in places) / math.sqrt(len(places) + k) + weights[-1]
        assert rows[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)) if n else 1.0, abs=1e-4), i


# pipeline and registry

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.materialise(stage(spark, step, SMALL), name)
        assert step.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in step.collect()}
        assert ids <= set(before) and len(ids) > 0.5 * len(before)
    texts = {r["doc_id"]: r["text"] or "" for r in step.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(out) == set(texts)
    for i, r in out.items():
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_pipeline_stages_on_odd_rows_equal_plain_python(spark, odd_docs, monkeypatch):
    """Null, repeated, clashing and very long rows through every stage; near copies, items and ids against plain Python."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from tests.llm.test_dedup import components_of, family

    rng = random.Random(3)
    copies = [(100 + i, " ".join(w), None, "x", i) for i, w in enumerate(family(40, 21))]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    copies += [(200, f"{' '.join(prose(rng, 30))} {item} {' '.join(prose(rng, 30))}", None, "x", 1), (201, " ".join(prose(rng, 50_000)), None, "x", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(copies, odd_docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SMALL)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} <= {r["doc_id"] for r in docs.collect()}
    alone = stages["near_dedup"](spark, docs, SMALL)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL AND NOT (doc_id = 3 AND text = 'one' AND key IS NULL AND n IS NULL)").collect()}
    wanted = {i for i, (_, _, kept) in components_of(texts, 80).items() if kept}
    assert {r["doc_id"] for r in alone.where("doc_id IS NOT NULL").collect()} == wanted and alone.where("doc_id IS NULL").count() == 1
    cut = stages["substring_dedup"](spark, alone, SMALL)
    assert cut.columns == docs.columns and cut.count() == alone.count()
    clean = stages["decontamination"](spark, cut, SMALL)
    assert {r["doc_id"] for r in cut.collect()} - {r["doc_id"] for r in clean.collect()} == {200}
    ranks = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, Path(public_tokenizers.path(corpus_pipeline.BYTE_RANKS)).read_bytes().splitlines()))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    for r in stages["byte_bpe"](spark, clean, SMALL).collect():
        assert list(r["ids"]) == encoding.encode_ordinary(left[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_pipeline_of_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), name)
        assert docs.count() == 0


def test_registry_names_each_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "colloquy"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "colloquy.llm" in p.read_text()]


@pytest.mark.parametrize("name", ["op4_minhash_dedup", "op5_chat_format", "op8_quality_rules"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from colloquy.llm import queries

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())


def test_page_query_equals_plain_extraction(spark):
    """The pages of the test tables all have one article of headings and paragraphs; tags are cut out of it by pattern."""
    import html
    import re

    from colloquy.llm import queries

    expected = {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|article|body|html|footer)\b[^>]*>", article[1] if article else "")
        text = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        expected[r["page_id"]] = "\n".join(filter(None, text))
    found = {r["page_id"]: r for r in queries.op6_html_extract(spark, SMALL).collect()}
    assert {k: r["text"] for k, r in found.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_slots_with_a_long_constant_opening_are_kept(spark):
    opening = "The same standing introduction of this series " * 6
    body = "<html><body><div class='x'>{0} own end {1}</div><center>Always the same closing line</center></body></html>"
    rows = [(i, "http://h/x", body.format(opening, f"number {i}")) for i in range(6)]
    found = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].endswith(f"own end number {r['page_id']}") for r in found)
