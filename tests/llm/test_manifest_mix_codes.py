"""The Merkle manifest, the mix of sources and the compressed vectors against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import entropy_mix, merkle_manifest, product_codes, queries

SMALL = "/root/testdata/sf0.001"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# manifest


def _tree(nodes: list[str], fan_out: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, for each node, what stands before and after it on every level."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, above_owners = [], []
        for a in range(0, len(level), fan_out):
            run = level[a : a + fan_out]
            for k in range(len(run)):
                for i in owners[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(_sha("".join(run)))
            above_owners.append([i for o in owners[a : a + fan_out] for i in o])
        level, owners = above, above_owners
    return level[0], paths


def _plain_manifest(rows, fan_out):
    leaf = lambda r: _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan_out) for s in names}
    root, over = _tree([trees[s][0] for s in names], fan_out)
    out = []
    for s, above in zip(names, over):
        for (_, _, digest, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((r[0], digest, trees[s][0], root, _sha("".join(b + a for b, a in path + above))))
    return out


@pytest.mark.parametrize("fan_out", [2, 16])
def test_manifest_equals_plain_trees(spark, fan_out):
    rng = random.Random(fan_out)
    sources = [None, "", "hot", "ü", "z", "Z", "one"]
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(sources[:-1]), rng.choice([None, "en", ""]), rng.choice([None, i]), rng.choice([None, "", "Ä B", f"Text {i}"])) for i in range(333)]
    rows += [rows[5], rows[5], (None, "hot", None, None, "no id"), (7, "one", "en", 1, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"pos": F.lit(1), "grp": F.lit("x"), "run": F.lit(2)})
    found = merkle_manifest.merkle_manifest(merkle_manifest.document_leaves(docs.repartition(5)), fan_out)
    found = found.select("key", "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("proof"), merkle_manifest.folded("leaf").alias("again")).collect()
    assert all(r["again"] == r["root"] for r in found)
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(_plain_manifest(rows, fan_out), key=str)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle_manifest.merkle_manifest(merkle_manifest.document_leaves(docs)).first()
    assert r["leaf"] == r["subroot"] == r["root"] == _sha("1:1----") and r["path"] == []
    assert merkle_manifest.merkle_manifest(merkle_manifest.document_leaves(docs.limit(0))).count() == 0


def test_changed_documents_do_not_verify(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op11_merkle_manifest(spark, SMALL).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] is (not changed)


# mix


def _plain_targets(sizes: dict, cap: int) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in names if s not in full)
        share = {s: (total - sum(cap * sizes[f] for f in full)) * weight[s] / left for s in names if s not in full}
        over = {s for s in share if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def _mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("x"), "key": F.lit(1), "target": F.lit(None).cast("int")})
    return entropy_mix.entropy_mix(docs.repartition(6), **options).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, "tiny"][: 4 + (i % 50 == 1)]), rng.choice([None, "", " \n"]) if i % 40 == 0 else "w " * max(1, int(rng.lognormvariate(4, 1)))) for i in range(3000)]
    rows += [rows[7], rows[7]]
    found = _mixed(spark, rows)
    sizes, source_sizes = Counter(), Counter()
    for i, s, t in rows:
        source_sizes[s] += len((t or "").split())
        sizes[i, len((t or "").split())] += 1
    assert Counter((r["doc_id"], r["size"]) for r in found) == sizes
    wanted = _plain_targets(source_sizes, 3)
    assert wanted["tiny"] == 3 * source_sizes["tiny"]  # its share is above the cap
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == source_sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["copies"] >= 0
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 5 + 0.001 * wanted[s] for s in wanted), [(s, taken[s], wanted[s]) for s in wanted]
    assert sorted(map(str, _mixed(spark, rows))) == sorted(map(str, found))


def test_rates_solve_the_dual(spark):
    """Rates are min(cap, exp(tilt * size)) with one tilt a source, and weigh to the target before they are rounded."""
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], "w " * rng.randint(1, 400)) for i in range(500)]
    by = defaultdict(list)
    for r in _mixed(spark, rows):
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-8)
        tilt = {round(math.log(r["rate"]) / r["size"], 9) for r in own if r["rate"] < 3}
        assert len(tilt) == 1


@pytest.mark.parametrize("rows", [[(1, None, None)], [(1, "a", "x y z")], [(1, "a", ""), (2, "b", "")], [(1, "a", "x"), (2, "b", "x " * 5000), (None, "b", "y")]])
def test_mix_of_odd_tables(spark, rows):
    found = _mixed(spark, rows)
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    if len({s for _, s, _ in rows}) == 1:
        assert all(r["taken"] == r["size"] for r in found)


def test_mix_of_nothing(spark):
    assert _mixed(spark, []) == []


def test_rounding_stays_near_and_within_the_cap():
    rng = random.Random(4)
    for _ in range(300):
        sizes = np.array(sorted(rng.sample(range(1, 3000), rng.randint(1, 12)), reverse=True))
        docs = np.array([rng.randint(1, 4) for _ in sizes])
        rate = rng.uniform(0, 3)
        copies = entropy_mix.round_classes(sizes, docs, np.full(len(sizes), rate), rate * (sizes * docs).sum(), 3)
        assert ((copies >= 0) & (copies <= 3 * docs)).all()
        assert abs((copies * sizes).sum() - rate * (sizes * docs).sum()) <= sizes[0] / 2 + 1e-6


# codes


def _plain_codes(rows, how):
    """All of it with nested loops over lists of integers."""
    kept = [(i, [math.floor(np.float32(x) * np.float64(how.scale)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // how.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[: how.entries]] for p in range(how.parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(how.rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for r in kept:
                held[near(cut(r[1], p), book)[1]].append(cut(r[1], p))
            for k, own in held.items():
                book[k] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(how.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = _sha(",".join(str(x) for book in books for e in book for x in e))
    return sorted((i, code, error, by_label[label], digest) for i, code, error, label in out)


@pytest.mark.parametrize("grid", [0.25, 1e-3])
def test_codes_equal_plain_loops(spark, grid):
    """A coarse grid has many ties and equal entries."""
    rng = random.Random(9)
    vector = lambda: [round(rng.uniform(-1, 1) / grid) * grid for _ in range(16)]
    rows = [(i, vector(), None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] + [0.0] * 15, 1), (903, [float("inf")] + [0.0] * 15, None), (904, rows[4][1], 2), (904, rows[4][1], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "error": F.lit(1), "n": F.lit(2)})
    codes, books = product_codes.compress_vectors(table.repartition(5))
    found = [(r["id"], r["code"], r["error"], r["label_error"], product_codes.codebook_digest(books)) for r in product_codes.with_label_error(codes).collect()]
    assert sorted(found) == _plain_codes(rows, product_codes.ProductCodes())


def test_codes_of_few_odd_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    codes, books = product_codes.compress_vectors(spark.createDataFrame([(3, [1e30] * 8, None), (1, [-1e30] * 8, None), (2, [0.0] * 9, 1), (5, [], 1), (None, [0.5] * 8, 1)], kind))
    assert [(r["id"], r["code"], r["error"]) for r in codes.orderBy("id").collect()] == [(None, "02" * 8, 0), (1, "00" * 8, 0), (3, "01" * 8, 0)]
    assert books.shape == (8, 3, 1)
    none, _ = product_codes.compress_vectors(spark.createDataFrame([(1, None, 1)], kind))
    assert product_codes.with_label_error(none).count() == 0


def test_tree_finds_the_lowest_nearest_index():
    rng = np.random.default_rng(3)
    for leaf in (1, 2, 5):
        for _ in range(60):
            entries = rng.integers(-4, 5, (rng.integers(1, 17), 3))
            vectors = rng.integers(-5, 6, (200, 3))
            far = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
            index, best = product_codes.KdTree(entries, leaf).nearest(vectors)
            assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


# SQL


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_product_codes"])
def test_new_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(found.columns)
    assert sorted(cursor.fetchall()) == sorted(tuple(r[c] for c in names) for r in found.collect())
