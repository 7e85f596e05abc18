"""A small tolerant HTML tree for main-text extraction, and simple tree matching on it.

Edge cases: an empty page is a root without parts; what is not closed ends with its parent or the page; a closing tag without
its opening one is passed over; raw elements that never end swallow the rest; nothing here is recursive, so pages nest as deep
as they like; trees whose roots differ match nowhere.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title select object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    __slots__ = ("tag", "name", "parts", "kids")

    def __init__(self, tag: str, name: str) -> None:
        self.tag, self.name = tag, name
        self.parts: list = []  # texts and nodes in order
        self.kids: list[Node] = []


def parse(page: str) -> Node:
    """The tree of a page; raw elements and comments are left out, open elements end with the page."""
    root = Node("html", "")
    stack = [root]
    at = 0
    skip = ""
    for m in _TOKEN.finditer(page):
        tag = (m[2] or "").lower()
        if skip:
            if not (m[1] and tag == skip):
                at = m.end()
                continue
            skip, at = "", m.end()
            continue
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and all(n.tag != "p" for n in stack[1:]):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                skip = tag
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SAME[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE.get(tag, ()):
                    break
        node = Node(tag, " ".join(a or b or c for a, b, c in _NAME.findall(m[3])).lower() if m[3] else "")
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    if not skip and at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def words_of(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


@dataclass
class Skeleton:
    """The block elements of a page in document order, runs of equally shaped siblings as one node.

    Node ``k`` has a signature (tag and names), a hash of the shape at and below it, its parent, its children, the number of
    nodes at and below it, and the elements of the page that it stands for (none for a skeleton read back from a table).
    """

    signature: list[str] = field(default_factory=list)
    shape: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    members: list[list[Node]] = field(default_factory=list)

    def add(self, signature: str, parent: int, members: list[Node]) -> int:
        k = len(self.signature)
        self.signature.append(signature)
        self.parent.append(parent)
        self.kids.append([])
        self.members.append(members)
        if parent >= 0:
            self.kids[parent].append(k)
        return k

    def close(self) -> None:
        """Fills sizes and shapes from the leaves up; a child has a greater number than its parent."""
        n = len(self.signature)
        self.size, self.shape = [1] * n, [0] * n
        for k in range(n - 1, -1, -1):
            self.shape[k] = _shape(self.signature[k], [self.shape[c] for c in self.kids[k]])
            if self.parent[k] >= 0:
                self.size[self.parent[k]] += self.size[k]


def _shape(signature: str, kids: list[int]) -> int:
    return int.from_bytes(hashlib.blake2b(f"{signature}|{kids}".encode("utf-8", "replace"), digest_size=8).digest())


def _blocks_below(node: Node) -> list[Node]:
    return [k for k in node.kids if k.tag in BLOCK and k.tag not in VOID]


def skeleton(root: Node) -> Skeleton:
    """The skeleton of a page, without recursion: pages nest as deep as they like."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += _blocks_below(node)
    shape: dict[int, int] = {}
    runs: dict[int, list[list[Node]]] = {}
    for node in reversed(order):
        own: list[list[Node]] = []
        for kid in _blocks_below(node):
            if own and shape[id(own[-1][0])] == shape[id(kid)]:
                own[-1].append(kid)
            else:
                own.append([kid])
        runs[id(node)] = own
        shape[id(node)] = _shape(f"{node.tag}.{node.name}", [shape[id(r[0])] for r in own])
    out = Skeleton()
    waiting = [(-1, [root])]
    while waiting:
        parent, members = waiting.pop()
        k = out.add(f"{members[0].tag}.{members[0].name}", parent, members)
        below = [runs[id(m)] for m in members]  # of equal shape: as many runs each
        waiting += [(k, [n for r in below for n in r[j]]) for j in range(len(below[0]) - 1, -1, -1)]
    out.close()
    return out


class Matching:
    """Simple tree matching of two skeletons: the largest match of their nodes that keeps parents and order."""

    def __init__(self, a: Skeleton, b: Skeleton) -> None:
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}

    def _ends(self, x: list[int], y: list[int]) -> tuple[int, int]:
        """How many children of equal shape both lists begin and end with; matching those is never worse."""
        shape_a, shape_b = self.a.shape, self.b.shape
        n = min(len(x), len(y))
        i = next((i for i in range(n) if shape_a[x[i]] != shape_b[y[i]]), n)
        j = next((j for j in range(n - i) if shape_a[x[-1 - j]] != shape_b[y[-1 - j]]), n - i)
        return i, j

    def size(self, a: int, b: int) -> int:
        """Number of matched nodes at and below ``a`` and ``b``."""
        stack = [(a, b)]
        while stack:
            p, q = stack[-1]
            if (p, q) in self.known:
                stack.pop()
                continue
            if self.a.signature[p] != self.b.signature[q]:
                self.known[p, q] = 0
            elif self.a.shape[p] == self.b.shape[q]:
                self.known[p, q] = self.a.size[p]
            else:
                need = [(x, y) for x, y in self._open(p, q) if (x, y) not in self.known]
                if need:
                    stack += need
                    continue
                self.known[p, q] = 1 + sum(self.known[x, y] if (x, y) in self.known else self.a.size[x] for x, y in self.pairs(p, q))
            stack.pop()
        return self.known[a, b]

    def _open(self, p: int, q: int) -> list[tuple[int, int]]:
        x, y = self.a.kids[p], self.b.kids[q]
        i, j = self._ends(x, y)
        by: dict[str, list[int]] = {}
        for k in y[i : len(y) - j]:
            by.setdefault(self.b.signature[k], []).append(k)
        return [(k, m) for k in x[i : len(x) - j] for m in by.get(self.a.signature[k], ())]

    def pairs(self, p: int, q: int) -> list[tuple[int, int]]:
        """The pairs of children of ``p`` and ``q`` that the best match uses (the sizes below are known or equal)."""
        x, y = self.a.kids[p], self.b.kids[q]
        i, j = self._ends(x, y)
        out = list(zip(x[:i], y[:i], strict=True))
        u, v = x[i : len(x) - j], y[i : len(y) - j]
        if u and v:
            best = [[0] * (len(v) + 1)]
            for k in u:
                above, row = best[-1], [0]
                for n, m in enumerate(v):
                    row.append(max(above[n + 1], row[n], above[n] + self.known.get((k, m), 0)))
                best.append(row)
            middle, s, t = [], len(u), len(v)
            while s and t:
                if best[s][t] == best[s - 1][t]:
                    s -= 1
                elif best[s][t] == best[s][t - 1]:
                    t -= 1
                else:
                    s, t = s - 1, t - 1
                    middle.append((u[s], v[t]))
            out += reversed(middle)
        return out + list(zip(x[len(x) - j :], y[len(y) - j :], strict=True))

    def aligned(self) -> list[tuple[int, int]]:
        """All matched pairs of nodes, from the roots down."""
        if not self.size(0, 0):
            return []
        out, stack = [], [(0, 0)]
        while stack:
            p, q = stack.pop()
            out.append((p, q))
            if self.a.shape[p] == self.b.shape[q]:
                stack += zip(self.a.kids[p], self.b.kids[q], strict=True)
            else:
                stack += self.pairs(p, q)
        return out
