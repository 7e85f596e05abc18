"""Main text of web pages by wrapper induction per host.

1. Every page gives its skeleton: its block elements, runs of equally shaped siblings as one node. The commonest
   skeletons of a host (``references`` of them, the page with the smallest id for each) are its reference trees; they are
   counted per batch first, and what is shuffled are skeletons with marks (hashes) of their texts, never pages.
2. Every page of the host is aligned with the references by simple tree matching. For each text of a reference
   node the pages count how often the node was matched and how often the aligned elements had the same text. A text that
   stays the same on ``constant_share`` of the pages is constant: template. Texts that vary are slots: content. A page most
   of whose text is the reference's own is a copy of it and tells nothing about what is constant, so it does not count.
   Counts are summed per batch before they are shuffled, so a host with a third of all pages is few rows per batch.
3. Each page is aligned once more: elements whose text is template are constant, the others slots. The content region is where
   slots are: within the page's article or main element, if it has one. Constant elements beside the region go, in
   articles too; constant ones among its slots stay, as section headings, standing sentences and bylines do. Names and elements that
   mean furniture (navigation, adverts, forms, comments) are left out, because such slots vary too. Outside an article,
   blocks that are links only are menus.

Wrappers are one row per host. They are sent to all executors when their measured size is under ``broadcast_bytes``,
else they are joined by host (Spark splits the pages of a hot host); the rows are the same.

Edge cases: null or empty html has an empty text; null urls are one host ""; a host with under ``min_pages`` pages, or
whose pages are all copies, has no constant nodes, only the rules on furniture apply; pages cut off anywhere end there;
pages nest as deep as they like; repeated pages are rows of their own; null page_ids get text too, they only can't be a
reference. Only ``page_id, url, html`` are read, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.html_dom import BLOCK, Matching, Node, Skeleton, parse, skeleton, words_of
from colloquy.llm.shared import materialise

_FURNITURE_TAGS = frozenset("nav footer header aside form button menu dialog head figure label".split())
_NAMES = (
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|comment-\w+|disqus|replies|reply|respond|footer|foot|masthead|header|login|signup|"
    r"newsletter|subscribe|search|pagination|pager|tags|toolbar|skip|copyright|complementary|contentinfo"
)
_PART_OF_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])")
_WHOLE_NAME = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:$|\s)")
_OF_READERS = re.compile(r"(?:^|\s)(?:comments?|reply|replies)(?:$|\s)")
_STRONG = frozenset(("article", "main"))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _furniture(node: Node, inside: bool) -> bool:
    """Whether an element is page furniture by its kind or names; inside an article only whole names count."""
    if node.tag in _FURNITURE_TAGS:
        return not (inside and node.tag in ("header", "figure"))
    if not node.name or node.tag == "body":
        return False
    if node.tag in _STRONG:
        return bool(_OF_READERS.search(node.name))
    if inside:
        return node.tag not in _HEADING and bool(_WHOLE_NAME.search(node.name))
    return bool(_PART_OF_NAME.search(node.name))


def _mark(text: str) -> str:
    """A short mark of a whole text."""
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def own_texts(root: Node) -> dict[int, str]:
    """Text of each block element with its inline elements, without the blocks below; by the element's identity."""
    parts: dict[int, list[str]] = {}
    stack = [(root, root)]
    while stack:
        node, block = stack.pop()
        if isinstance(node, str):
            parts.setdefault(id(block), []).append(node)
            continue
        if node.tag in BLOCK:
            block = node
        else:
            parts.setdefault(id(block), []).append(" ")
        stack += [(p, block) for p in reversed(node.parts)]
    return {k: text for k, v in parts.items() if (text := words_of("".join(v)))}


def _blocks(root: Node, template: set[int], inside: bool) -> list[str]:
    """Blocks of the content region below ``root`` in page order, without furniture.

    Blocks that are not in ``template`` are slots, and the region is where slots are. A template block stays if it stands among them: in an
    element that holds slots too (outside an article, within the one that holds most of the page's), between the first and the last one, or as
    a heading before the last. Template elements beside the region go, whatever is in them.
    """
    found: list[tuple[str, int | None, bool]] = []  # text, the parent of a template block, whether it is a heading
    held: dict[int, int] = {}  # characters of slots below an element
    run: list[str] = []
    linked = [True]  # whether all of the run stands in links
    open_blocks = [root]

    def flush() -> None:
        text = words_of("".join(run))
        run.clear()
        if text and (inside or not linked[0]):
            own = open_blocks[-1]
            constant = id(own) in template
            parent = open_blocks[-2] if len(open_blocks) > 1 else own
            found.append((text, id(parent) if constant else None, own.tag in _HEADING))
            if not constant:
                held[id(own)] = held.get(id(own), 0) + len(text)
        linked[0] = True

    stack = [(root, iter(root.parts), False)]
    while stack:
        node, parts, link = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node.tag in BLOCK:
                flush()
                if node is not root:
                    open_blocks.pop()
                    above = id(open_blocks[-1])
                    held[above] = held.get(above, 0) + held.get(id(node), 0)
        elif isinstance(part, str):
            run.append(part)
            linked[0] &= link or not part.strip()
        elif part.tag in ("br", "hr"):
            run.append(" ")
        elif _furniture(part, inside):
            if part.tag in BLOCK:
                flush()
            else:
                run.append(" ")
        elif part.tag in BLOCK:
            flush()
            open_blocks.append(part)
            stack.append((part, iter(part.parts), link))
        else:
            stack.append((part, iter(part.parts), link or part.tag == "a"))
    flush()
    slots = [i for i, (_, parent, _) in enumerate(found) if parent is None]
    if not slots:
        return []
    region = None if inside else _region(root, held)
    among = lambda i, parent, heading: held.get(parent, 0) and (region is None or parent in region) and (heading or i > slots[0]) and i < slots[-1]
    return [text for i, (text, parent, heading) in enumerate(found) if parent is None or among(i, parent, heading)]


def _region(root: Node, held: dict[int, int]) -> set[int]:
    """The elements in and below the outermost one, the body apart, that holds more than half of all slots; none if there is no such."""
    node, half = root, held.get(id(root), 0) / 2
    while node is root or node.tag in ("html", "body"):
        node = next((k for k in node.kids if held.get(id(k), 0) > half), None)
        if node is None:
            return set()
    out, stack = set(), [node]
    while stack:
        some = stack.pop()
        out.add(id(some))
        stack += some.kids
    return out


def _outermost(tree: Node, tags: frozenset[str] | tuple[str, ...]) -> list[Node]:
    """The outermost elements of those tags below ``tree`` that stand in no furniture, in page order."""
    found, stack = [], list(reversed(tree.kids))
    while stack:
        node = stack.pop()
        if _furniture(node, False):
            continue
        if node.tag in tags or "article" in tags and "articlebody" in node.name:
            found.append(node)
        else:
            stack += reversed(node.kids)
    return found


def _roots(tree: Node) -> list[Node]:
    """The article or main elements of a page; an article within main is the narrower choice."""
    found = []
    for node in _outermost(tree, _STRONG):
        found += (_outermost(node, ("article",)) if node.tag == "main" else []) or [node]
    return found


def content_of(tree: Node, template: set[int]) -> str:
    """Main text of a page, given the elements whose text is template."""
    out = [b for root in _roots(tree) for b in _blocks(root, template, True)]
    return "\n".join(out or _blocks(tree, template, False))


# A reference is kept as JSON: [signature, parent, marks of its texts] of each node.


def _written(shape: Skeleton, texts: dict[int, str]) -> str:
    rows = []
    for signature, parent, members in zip(shape.signature, shape.parent, shape.members, strict=True):
        rows.append([signature, parent, sorted({_mark(texts[id(m)]) for m in members if id(m) in texts})])
    return json.dumps(rows)


def _read(written: str) -> tuple[Skeleton, list[frozenset[str]]]:
    shape, marks = Skeleton(), []
    for signature, parent, own in json.loads(written):
        shape.add(signature, parent, [])
        marks.append(frozenset(own))
    shape.close()
    return shape, marks


class _References:
    """References of hosts, read once per task as far as they fit in ``keep`` entries."""

    def __init__(self, keep: int = 5000) -> None:
        self.keep, self.known = keep, {}

    def of(self, host: str, written: list | None) -> list:
        if host not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[host] = [(*_read(r["reference"]), _template(r["template"])) for r in written or []]
        return self.known[host]


def _template(entries: list[str] | None) -> dict[int, set[str]]:
    out: dict[int, set[str]] = {}
    for entry in entries or []:
        k, mark = entry.split(":")
        out.setdefault(int(k), set()).add(mark)
    return out


def extract(page: str, references: list) -> str:
    """The main text of one page, given its host's references and their template texts."""
    tree = parse(page)
    template: set[int] = set()
    if any(t for *_, t in references):
        shape, texts = skeleton(tree), own_texts(tree)
        for reference, _, constant in references:
            if constant:
                for k, n in Matching(reference, shape).aligned():
                    if k in constant:
                        template.update(id(m) for m in shape.members[n] if id(m) in texts and _mark(texts[id(m)]) in constant[k])
    return content_of(tree, template)


def evidence(page: str, references: list, copy_share: float) -> Iterator[tuple[int, int, list[str]]]:
    """``reference, node, marks of its texts that are the same`` of a page's aligned nodes; nothing for a copy."""
    tree = parse(page)
    shape, texts = skeleton(tree), own_texts(tree)
    free: list[Node] = [tree]
    total = 0
    counted: dict[int, int] = {}
    while free:  # text outside furniture decides what is a copy
        node = free.pop()
        counted[id(node)] = len(texts.get(id(node), ""))
        total += counted[id(node)]
        free += [k for k in node.kids if not _furniture(k, False)]
    for r, (reference, marks, _) in enumerate(references):
        rows, same = [], 0
        for k, n in Matching(reference, shape).aligned():
            if marks[k]:
                hits = [m for m in shape.members[n] if id(m) in texts and _mark(texts[id(m)]) in marks[k]]
                rows.append((r, k, sorted({_mark(texts[id(m)]) for m in hits})))
                same += sum(counted.get(id(m), 0) for m in hits)
        if same < copy_share * total:
            yield from rows


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit("")))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _with_hosts(pages: DataFrame, hosts: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Left join by host; ``hosts`` (``host, references``) is broadcast if its measured size allows."""
    size = hosts.select(F.sum(F.length(F.to_json("references")) + 64)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= broadcast_bytes else hosts, "host", "left")


def choose_references(pages: DataFrame, references: int) -> DataFrame:
    """``host, references``: of each host the commonest skeletons, with the marks of the texts of their first page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}

        def rows() -> pa.RecordBatch:
            cols = [[k[0] for k in seen], [k[1] - (1 << 63) for k in seen], *([v[i] for v in seen.values()] for i in range(3))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "shape", "n", "page_id", "reference"])

        for batch in batches:
            for page_id, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                tree = parse(page)
                shape = skeleton(tree)
                entry = seen.setdefault((host, shape.shape[0]), [0, None, ""])
                entry[0] += 1
                if entry[1] is None or page_id < entry[1]:
                    entry[1:] = page_id, _written(shape, own_texts(tree))
            if len(seen) > 2000:
                yield rows()
                seen.clear()
        yield rows()

    known = pages.where("page_id IS NOT NULL").select("page_id", "host", "html")
    shapes = known.mapInArrow(run, "host string, shape long, n long, page_id long, reference string")
    shapes = shapes.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.min("page_id").alias("page_id"), F.min_by("reference", "page_id").alias("reference"))
    # the greatest few of a list, kept small by the window's rank limit on both sides of its shuffle
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "page_id"))
    chosen = shapes.withColumn("rank", rank).where(F.col("rank") <= references)
    listed = F.sort_array(F.collect_list(F.struct("rank", "reference")))
    return chosen.groupBy("host").agg(F.transform(listed, lambda x: F.struct(x["reference"].alias("reference"), F.array().cast("array<string>").alias("template"))).alias("references"))


def induce_wrappers(pages: DataFrame, references: int = 2, constant_share: float = 0.8, copy_share: float = 0.7, min_pages: int = 3, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``host, references`` per host: its reference skeletons (JSON), each with its template texts ``node:mark``."""
    keyed = _keyed(pages)
    chosen = materialise(choose_references(keyed, references), "references")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, int, int, str], int] = {}
        loaded = _References()
        for batch in batches:
            for host, page, written in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "references")), strict=True):
                for r, k, same in evidence(page, loaded.of(host, written), copy_share):
                    for mark in ("", *same):  # the empty mark counts the pages
                        tally[host, r, k, mark] = tally.get((host, r, k, mark), 0) + 1
            if len(tally) > 50_000:
                yield _tally_rows(tally)
                tally = {}
        yield _tally_rows(tally)

    joined = _with_hosts(keyed.select("host", "html"), chosen, broadcast_bytes)
    texts = joined.mapInArrow(counts, "host string, ref int, node int, mark string, n long").groupBy("host", "ref", "node", "mark").agg(F.sum("n").alias("n"))
    texts = materialise(texts, "node-texts")
    matched = texts.where("mark = ''").select("host", "ref", "node", F.col("n").alias("matched"))
    constant = texts.where((F.col("mark") != "") & (F.col("n") >= min_pages)).join(matched, ["host", "ref", "node"]).where(F.col("n") >= constant_share * F.col("matched"))
    entry = F.struct("ref", F.concat_ws(":", F.col("node").cast("string"), "mark").alias("text"))
    template = constant.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("template"))
    own = lambda x, i: F.transform(F.filter(F.coalesce("template", F.array().cast("array<struct<ref:int,text:string>>")), lambda t: t["ref"] == i), lambda t: t["text"])
    filled = F.transform("references", lambda x, i: F.struct(x["reference"].alias("reference"), own(x, i).alias("template")))
    return materialise(chosen.join(template, "host", "left").select("host", filled.alias("references")), "wrappers")


def _tally_rows(tally: dict) -> pa.RecordBatch:
    cols = [[k[i] for k in tally] for i in range(4)] + [list(tally.values())]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "ref", "node", "mark", "n"])


def extract_main_text(pages: DataFrame, broadcast_bytes: int = 16 << 20, **wrapper_options) -> DataFrame:
    """``page_id, url, text`` of every page."""
    wrappers = induce_wrappers(pages, broadcast_bytes=broadcast_bytes, **wrapper_options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _References()
        for batch in batches:
            rows = [extract(page, loaded.of(host, written)) for host, page, written in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "references")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(rows, pa.string())], names=["page_id", "url", "text"])

    return _with_hosts(_keyed(pages), wrappers, broadcast_bytes).mapInArrow(run, "page_id long, url string, text string")
