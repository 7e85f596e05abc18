"""Near-duplicate documents by b-bit MinHash: bands find candidates, bit counts estimate, full sets confirm.

1. One pass over the texts takes the minima of ``bands * rows`` hash functions over each document's shingles. Of each
   minimum only the low 4 bits are kept, packed 16 to a long; the full minima only make the band keys.
2. Documents with the same words in the same order are one class, known by its smallest doc_id; only classes go on.
3. Classes that share a band key share a bucket. Each class is first compared with one hub, the class in its buckets that
   lies in most and largest buckets (of a text and its edited copies, that is the text itself). The estimate drops the
   clearly different, full shingle sets confirm the rest, and confirmed links join to components.
4. Buckets whose members are not all joined by then are compared inside by counts of equal bits, in numpy. What leaves a
   task is one row per member that is near a member of another component, with a name of its cluster: never the pairs.
5. Each member of such a cluster goes once, with its whole text, to the group of its cluster, where full sets are
   compared. A group's links are joined as they are found, and only the links that joined something leave the task:
   at most one per member, however many pairs are alike.
6. Components over all confirmed links; a document's component is the smallest doc_id in it.

Groups are bounded: a bucket of more than ``block`` members, and a cluster of more than ``block_shingles`` shingles, is
dealt over several tasks. Its members that are joined already (its largest component) need no comparison with each
other: they go to one block each, and the others, which are few after step 3, meet every block. Only if most of a group is
still apart after step 3 do copies of rows grow, with the group's size by the block's.

The estimate takes the share of equal 4-bit values, less the 1/16 that agree by chance. Its margin and the bands are
set so that a pair at the limit is missed with a chance of about 1e-5. Confirmation uses whole sets and whole texts.

Edge cases: null or empty texts and texts without words have an empty set and are linked with nothing; fewer words
than a shingle are one shingle; rows that repeat a doc_id count as one document for linking and are all returned; rows
with a null doc_id are linked with nothing, have a null component and are kept. Of the input only ``doc_id`` and
``text`` are read, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import textkernel as tk
from colloquy.llm.components import components
from colloquy.llm.shared import materialise, texts
from colloquy.llm.shingles import sets_of, shingle_blocks
from colloquy.llm.textkernel import mix


@dataclass(frozen=True)
class NearDedup:
    words: int = 5
    percent: int = 85  # linked if 100 * intersection >= percent * union
    bands: int = 36
    rows: int = 7
    margin: float = 0.10  # how far below the limit an estimate may lie
    block: int = 8192  # members of a bucket that one task compares
    block_shingles: int = 1 << 22  # shingles of a cluster that one task compares
    hub_group: int = 512  # rows that share one key of a join or a group

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.hashes // 16)


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8128)
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def _minima(grams: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """Least value of each of ``k`` hash functions over each run of shingles (one row per function)."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    times, plus = _functions(k)
    out = np.empty((k, len(begins)), np.uint32)
    value = np.empty_like(x)
    for i in range(k):
        np.multiply(x, times[i], out=value)
        value += plus[i]
        np.minimum.reduceat(value, begins, out=out[i])
    return out


def _packed(minima: np.ndarray, longs: int) -> np.ndarray:
    low = np.zeros((longs * 16, minima.shape[1]), np.uint64)
    low[: len(minima)] = minima & 15
    shift = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None]
    return np.bitwise_or.reduce(low.reshape(longs, 16, -1) << shift, axis=1)


def _band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, minima.shape[1]))
    each = minima.reshape(bands, rows, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + each[:, r])
    return acc


def signatures(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """``doc_id, n_shingles, key, key2, signature, bands`` per document; no keys and bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, where, keys in shingle_blocks(batch.column("text"), how.words):
                size = np.array([len(np.unique(grams[s:e])) for s, e in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)], np.int64)
                full = size > 0
                minima = _minima(grams, where[:-1][full], how.hashes) if full.any() else np.zeros((how.hashes, 0), np.uint32)
                lists = []
                for width, values in ((how.longs, _packed(minima, how.longs)), (how.bands, _band_keys(minima, how.bands, how.rows))):
                    offs = np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.ascontiguousarray(values.T).reshape(-1).view(np.int64))))
                cols = [batch.column("doc_id").slice(a, b - a), pa.array(size), *(pa.array(k.view(np.int64), mask=~full) for k in keys), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "key", "key2", "signature", "bands"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, key long, key2 long, signature array<long>, bands array<long>")


def estimate(a: Column, b: Column, how: NearDedup) -> Column:
    """Collision-corrected similarity of two packed signatures, from the count of equal 4-bit values."""
    ones = 0x1111111111111111

    def differing(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - different / F.lit(float(how.hashes)) * F.lit(16 / 15)


def confirm(pairs: DataFrame, docs: DataFrame, how: NearDedup) -> DataFrame:
    """The pairs ``a, b`` of documents whose full sets reach the limit; rows are ``a, b, salts``.

    Pairs are grouped by ``b``, whose set is built once per group; a ``b`` with many partners is spread over ``salts`` groups,
    and a task reads its groups as a stream.
    """
    salted = materialise(pairs.select("a", "b", F.pmod(F.xxhash64("a"), "salts").alias("salt")), "salted-pairs")
    heads = salted.select(F.col("b").alias("doc_id"), "b", "salt").distinct().withColumn("member", F.lit(False))
    members = salted.select(F.col("a").alias("doc_id"), "b", "salt").withColumn("member", F.lit(True))
    rows = texts(docs).dropDuplicates(["doc_id"]).join(heads.unionByName(members), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, None
        for batch in batches:
            bs, salts, flags, ids = (batch.column(c).to_pylist() for c in ("b", "salt", "member", "doc_id"))
            found = []
            for i, own in enumerate(sets_of(batch.column("text"), how.words)):
                if not flags[i]:
                    group, head = (bs[i], salts[i]), own
                elif (bs[i], salts[i]) == group:
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if both and 100 * both >= how.percent * (len(own) + len(head) - both):
                        found.append((ids[i], bs[i]))
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return dealt.mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, key: str, weight: Column, capacity: int) -> DataFrame:
    """Deals the members of each ``key`` over groups ``g`` so that each pair of different components meets in one of them.

    Adds ``g, side, across``: members of a group are to be compared if not ``across``, or on different sides. A group holds about
    twice ``capacity`` of ``weight`` at most (or two rows).
    """
    per = rows.groupBy(key, "component").agg(F.sum(weight).alias("w")).groupBy(key)
    sizes = per.agg(F.max_by("component", F.struct("w", "component")).alias("joined"), F.max("w").alias("w_joined"), F.sum("w").alias("w_all"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(capacity))).cast("int")
    whole = F.col("w_all") <= capacity
    plan = materialise(sizes.select(key, "joined", whole.alias("whole"), blocks(F.col("w_joined")).alias("p_joined"), blocks(F.col("w_all") - F.col("w_joined")).alias("p_other")), "block-plans")
    held = rows.join(plan, key).withColumn("is_joined", F.col("component") == F.col("joined"))
    mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("is_joined"), F.col("p_joined")).otherwise(F.col("p_other"))).cast("int")
    held = held.withColumn("mine", mine)
    place = lambda kind, p, q, side, across: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"), across.alias("across"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    me, no = F.col("mine"), F.lit(False)
    places = (
        F.when(F.col("whole"), F.array(place(0, F.lit(0), F.lit(0), F.lit(0), no)))
        .when(F.col("is_joined"), each("p_other", lambda q: place(1, me, q, F.lit(0), F.lit(True))))
        .otherwise(F.concat(each("p_joined", lambda p: place(1, p, me, F.lit(1), F.lit(True))), each("p_other", lambda q: place(2, F.least(q, me), F.greatest(q, me), F.when(me < q, 0).otherwise(1), q != me))))
    )
    held = held.withColumn("at", F.explode(places))
    g = F.xxhash64(key, "at.kind", "at.p", "at.q")
    return held.select(*rows.columns, g.alias("g"), F.col("at.side").alias("side"), F.col("at.across").alias("across"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups ``g`` of a stream that is sorted by ``g``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        g = batch.column("g").to_numpy()
        ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)).tolist() if len(g) else []
        for end in ends:
            if kept and kept[0].column("g")[0].as_py() != int(g[start]):
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept.append(batch.slice(start, end - start))
            start = end
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


class _Joined:
    """Disjoint sets over the rows of a group; rows of one component are one set from the start."""

    def __init__(self, component: np.ndarray) -> None:
        self.label = np.unique(component, return_inverse=True)[1].astype(np.int32)

    def join(self, x: int, y: int) -> bool:
        a, b = self.label[x], self.label[y]
        if a == b:
            return False
        self.label[self.label == b] = a
        return True


@dataclass
class _Group:
    """Members of one group with their signatures."""

    ids: np.ndarray
    component: np.ndarray
    hub: np.ndarray
    side: np.ndarray
    across: bool
    signature: np.ndarray
    bands: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, how: NearDedup) -> _Group:
        get = lambda c: rows.column(c).to_numpy()
        flat = lambda c, width: np.concatenate([x.flatten().to_numpy() for x in rows.column(c).chunks]).view(np.uint64).reshape(-1, width)
        return cls(get("doc_id"), get("component"), get("hub"), get("side"), bool(rows.column("across")[0].as_py()), flat("signature", how.longs), flat("bands", how.bands))

    def near(self, i: int, label: np.ndarray, most_different: int) -> np.ndarray:
        """Rows behind row ``i`` under other labels that it is to be compared with, share a band and may reach the limit.

        A row and its hub were compared before.
        """
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if self.across:
            j = j[self.side[j] != self.side[i]]
        j = j[(self.hub[j] != self.ids[i]) & (self.ids[j] != self.hub[i])]
        d = self.signature[j] ^ self.signature[i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        j = j[np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1) <= most_different]
        return j[(self.bands[j] == self.bands[i]).any(axis=1)]


def _most_different(how: NearDedup) -> int:
    return int((1 - how.percent / 100 + how.margin) * 15 / 16 * how.hashes)


def clusters_inside(rows: DataFrame, how: NearDedup) -> DataFrame:
    """``a, b``: each member that is near a member of another component, with one member of its cluster in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            group = _Group.of(table, how)
            sets = _Joined(np.arange(len(group.ids)))
            flagged = np.zeros(len(group.ids), bool)
            for i in range(len(group.ids)):
                j = group.near(i, group.component, _most_different(how))
                if len(j):
                    flagged[i] = True
                    flagged[j] = True
                    for y in j[sets.label[j] != sets.label[i]].tolist():
                        sets.join(i, y)
            at = np.flatnonzero(flagged)
            head = np.zeros(len(group.ids), np.int64)
            head[sets.label[at[::-1]]] = at[::-1]  # the first flagged row of each set
            yield pa.RecordBatch.from_arrays([pa.array(group.ids[at]), pa.array(group.ids[head[sets.label[at]]])], names=["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def links_inside(rows: DataFrame, how: NearDedup) -> DataFrame:
    """``a, b``: confirmed links between the members of each group, as many as join its components and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            group = _Group.of(table, how)
            own = [s for part in table.column("text").chunks for s in sets_of(part, how.words)]
            size = np.fromiter(map(len, own), np.int64, len(own))
            begin = np.cumsum(size) - size
            names, flat = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_inverse=True)
            del own
            here = np.zeros(len(names), np.int32)
            joined = _Joined(group.component)
            found: list[tuple[int, int]] = []
            for i in range(len(size)):
                j = group.near(i, joined.label, _most_different(how))
                if not len(j):
                    continue
                mine = flat[begin[i] : begin[i] + size[i]]
                here[mine] = 1
                both = np.add.reduceat(here[flat[tk.expand(begin[j], size[j])]], np.cumsum(size[j]) - size[j])
                here[mine] = 0
                for y in j[100 * both >= how.percent * (size[i] + size[j] - both)].tolist():
                    if joined.join(i, y):
                        found.append((int(group.ids[i]), int(group.ids[y])))
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    signed = materialise(signatures(docs, how), "signatures")
    with_words = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(with_words.groupBy("key", "key2").agg(F.min("doc_id").alias("class_id")), "classes")
    chosen = with_words.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "key", "key2"], "left_semi").dropDuplicates(["doc_id"])

    members = chosen.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = materialise(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = materialise(members.join(sizes, "bucket"), "shared-buckets")
    density = materialise(shared.groupBy("doc_id").agg(F.sum("n").alias("weight")), "densities")
    hubs = shared.join(density, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", "weight").alias("hub"), F.max("weight").alias("weight"), F.max("n").alias("n"))
    salts = F.ceil(F.col("n") / how.hub_group).cast("int")
    hubs = materialise(hubs.select("bucket", "hub", "weight", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "hubs")
    upward = shared.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).join(hubs, ["bucket", "salt"]).groupBy("doc_id").agg(F.max_by(F.struct("hub", "weight"), "weight").alias("up"))
    upward = materialise(upward.select("doc_id", "up.hub", F.ceil(F.col("up.weight") / (4 * how.hub_group)).alias("salts")), "upward")

    signature = chosen.select("doc_id", "signature")
    star = upward.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"), "salts", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"))
    star = materialise(star.join(signature.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a"), "star")
    heads = star.select("b", "salt").distinct().join(signature.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
    near = star.join(materialise(heads, "star-heads"), ["b", "salt"]).where(estimate(F.col("sa"), F.col("sb"), how) >= how.percent / 100 - how.margin)
    star_links = materialise(confirm(near, docs, how), "star-links")
    first = components(star_links)

    labels = materialise(upward.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "hub", F.coalesce("component", "doc_id").alias("component")), "labels")
    labelled = materialise(shared.join(labels, "doc_id").select("bucket", "doc_id", "hub", "component"), "labelled-buckets")
    # of buckets with the same members one is enough
    same = F.struct(F.count("*"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("doc_id", F.lit(1))))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), same.alias("members")).where("lo < hi")
    opened = materialise(mixed.groupBy("members").agg(F.min("bucket").alias("bucket")).select("bucket"), "open-buckets")
    left = materialise(labelled.join(opened, "bucket"), "open-members")
    signed_left = chosen.select("doc_id", "n_shingles", "signature", "bands")
    near_members = clusters_inside(_dealt(left, "bucket", F.lit(1), how.block).join(signed_left, "doc_id"), how)
    clusters = materialise(components(materialise(near_members, "near-members")), "clusters").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))

    apart = materialise(clusters.join(labels, "doc_id").join(signed_left, "doc_id"), "apart")
    dealt = _dealt(apart, "cluster", F.col("n_shingles"), how.block_shingles)
    more_links = materialise(links_inside(dealt.join(texts(docs).dropDuplicates(["doc_id"]), "doc_id"), how), "inner-links")

    linked = components(star_links.unionByName(more_links)) if not more_links.isEmpty() else first
    named = classes.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").select("key", "key2", F.coalesce("component", "class_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "key", "key2").join(named, ["key", "key2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(own)
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """The rows of ``docs`` that represent their group, with all their columns; rows that repeat a doc_id stay once."""
    kept = near_duplicates(docs, how).where("kept AND doc_id IS NOT NULL").select("doc_id")
    known = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.where(F.col("doc_id").isNull()))
