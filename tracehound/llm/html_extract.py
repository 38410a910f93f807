"""Operator 5, HTML extraction by minimum-cut labelling.

A page is cut into text blocks with their path in the DOM. A logistic block classifier gives
each block a cost of being content and a cost of being boilerplate; these are capacities
from the source and to the sink. Smoothness edges join neighbouring blocks (adjacency) and
blocks with a near common ancestor (DOM proximity). A maximum flow gives the minimum cut: the
blocks on the source side are the main text.

The classifier (logistic regression) is trained here on a bounded sample of pages: blocks
under explicit HTML roles (article, main against nav, header, footer, aside, form and
class names for adverts, menus, notices, comments) are the labelled ones. Every sampled block
is seen twice, with and without its role features, so that pages without roles are
judged by text features. Weights are fixed-size; each page is extracted by itself in one pass.

Defined results: null or empty html gives the empty text; text outside any recognised
element forms blocks of its parent; unclosed and stray tags are closed where HTML says
or at their parent's end; repeated rows are extracted each; an empty table gives no
rows; extra columns are not read. Nothing is dropped or capped but the blocks cut away.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_column_names

MAX_TRAIN_PAGES = 500
ADJACENT, NEAR = 0.35, 0.5  # smoothness capacities: neighbours, and siblings under one parent

_MARK = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SKIP = frozenset("script style noscript template iframe select textarea title head".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_ENDLESS = frozenset("script style textarea title".split())  # without an end they take the rest of the page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                    "pre section summary table tbody td tfoot th thead tr ul button option label").split())
#: A new element of the key closes an open element of the value.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_SCOPE = frozenset("table ul ol dl article section div body main nav aside header footer form".split())
_ROLE_TAGS = {"article": "main", "main": "main", "nav": "menu", "menu": "menu", "header": "head", "footer": "foot",
              "aside": "side", "form": "form", "button": "form", "label": "form", "dialog": "note"}
_ROLE_NAMES = [(re.compile(rf"(?:^|[^a-z])(?:{names})", re.I), role) for names, role in (
    ("comments?|replies|reply|respond|disqus|discussion", "talk"), ("ads?(?![a-z])|advert|sponsor|promo|banner", "advert"),
    ("navbar|navigation|nav(?![a-z])|menu|breadcrumb|crumbs|toc(?![a-z])|pagination|pager", "menu"),
    ("sidebar|side(?![a-z])|related|widget|aside|complementary|share(?![a-z])|social", "side"),
    ("footer|foot(?![a-z])|contentinfo|copyright|legal(?![a-z])", "foot"), ("header|masthead|topbar|site-title", "head"),
    ("cookie|notice|consent|popup|modal(?![a-z])|newsletter|subscribe|alert|gdpr", "note"),
    ("form(?![a-z])|login|signup|search", "form"),
    ("article|content|entry|post(?![a-z])|story|main(?![a-z])|body(?![a-z])", "main"))]
ROLES = ("main", "menu", "head", "foot", "side", "form", "note", "advert", "talk")


class Block:
    """A text block: ``depth`` block elements are open around it, ``parent`` is the number of the
    innermost one's parent, ``common`` of them are open since the block before."""
    __slots__ = ("text", "depth", "parent", "common", "tag", "roles", "linked")

    def __init__(self, text, depth, parent, common, tag, roles, linked):
        self.text, self.depth, self.parent, self.common = text, depth, parent, common
        self.tag, self.roles, self.linked = tag, roles, linked


class _Tags:
    """Finds tags in one pass: the marks that may end a tag are listed once, and a mark from which
    none ends is noted, so that many unfinished tags cost no more than one."""

    def __init__(self, source: str):
        self.source = source
        self.marks = [m.start() for m in _MARK.finditer(source)]
        self.same, seen = [0] * len(self.marks), {}   # the next mark of the same kind
        for k in range(len(self.marks) - 1, -1, -1):
            c = source[self.marks[k]]
            self.same[k] = seen.get(c, -1)
            seen[c] = k
        self.name_ends = None
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Where the tag with attributes from ``at`` on ends (its ``>``, outside quotes), or -1."""
        k, path = bisect_left(self.marks, at), []
        while 0 <= k < len(self.marks) and k not in self.dead:
            if self.source[self.marks[k]] == ">":
                return self.marks[k]
            path.append(k)
            k = self.same[k] + 1 if self.same[k] >= 0 else -1
        self.dead.update(path)
        return -1

    def name_end(self, at: int) -> int:
        if self.name_ends is None:
            self.name_ends = [m.start() for m in _NAME_END.finditer(self.source)]
        k = bisect_left(self.name_ends, at)
        return self.name_ends[k] if k < len(self.name_ends) else len(self.source)

    def next(self, pos: int):
        """The next tag: start, end, its name ("" for comments and declarations), whether it is an
        end tag, and its attributes; None if there is none."""
        s = self.source
        while (at := s.find("<", pos)) >= 0:
            c = s[at + 1:at + 2]
            if c == "!" or c == "?":
                close = s.find("-->", at + 4) + 2 if s.startswith("<!--", at) else s.find(">", at)
                return at, len(s) if close < at + 2 else close + 1, "", False, ""
            name = at + 2 if c == "/" else at + 1
            if "a" <= s[name:name + 1].lower() <= "z" and s[name:name + 1].isascii():
                stop = self.name_end(name + 1)
                close = self.end(stop)
                if close < 0:   # a quote inside the name
                    k = bisect_left(self.marks, name + 1)
                    close, stop = self.end(name + 1), min(stop, self.marks[k] if k < len(self.marks) else stop)
                if close >= 0:
                    return at, close + 1, s[name:stop].lower(), c == "/", s[stop:close]
            pos = at + 1
        return None


def _roles(tag: str, attrs: str, within_main: bool) -> tuple[str, ...]:
    out = []
    if tag in _ROLE_TAGS and not (tag == "header" and within_main):
        out.append(_ROLE_TAGS[tag])
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            for rx, role in _ROLE_NAMES:
                if rx.search(value):
                    out.append(role)
                    break
    return tuple(out)


def blocks(source: str | None) -> list[Block]:
    """The text blocks of a page in order. White space is one space, ends trimmed. The time is
    linear in the page, whatever its nesting and unfinished tags."""
    if not source:
        return []
    out: list[Block] = []
    stack: list[tuple[str, int, frozenset]] = [("", 0, frozenset())]  # tag, number, roles so far
    around: list[tuple[str, int]] = [("", 0)]                         # the block elements of it: tag, number
    opened: dict[str, list[int]] = {}                                 # tag -> where it is open in the stack
    text: list[str] = []
    linked = skip = count = anchor = 0
    low = 1   # the fewest block elements open since the last block
    unended: set[str] = set()   # raw elements that have no end from here on

    def flush():
        nonlocal linked, low
        joined = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            parent = around[-2][1] if len(around) > 1 else -1
            out.append(Block(joined, len(around), parent, min(low, len(around)), around[-1][0], stack[-1][2], min(1.0, linked / len(joined))))
            low = len(around)
        linked = 0

    def close(k: int):
        nonlocal skip, anchor, low
        for t, _, _ in stack[k:]:
            skip -= t in _SKIP
            anchor -= t == "a"
            opened[t].pop()
            if t in _BLOCK:
                around.pop()
        del stack[k:]
        low = min(low, len(around))

    def where(tag: str) -> int:
        at = opened.get(tag)
        return at[-1] if at else 0

    tags, pos, end = _Tags(source), 0, len(source)
    while pos < end:
        found = tags.next(pos)
        chunk = source[pos:found[0] if found else end]
        if chunk and not skip:
            text.append(chunk)
            if anchor:
                linked += len(chunk.strip())
        if not found:
            break
        _, pos, tag, ends, attrs = found
        if not tag:
            continue
        if ends:
            at = where(tag)
            if tag in _BLOCK or at and any(t in _BLOCK for t, _, _ in stack[at:]):
                flush()
            if at:
                close(at)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag in ("br", "wbr", "img", "input") else "")
            continue
        if tag in _BLOCK:
            flush()
            at = max(map(where, ("p", *_CLOSES.get(tag, ()))))
            if at > max(map(where, _SCOPE)):
                close(at)
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        stop = None
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, pos) if tag not in unended else None
            if not stop:
                unended.add(tag)
                if tag not in _ENDLESS:
                    continue   # its text is text of the page
        count += 1
        before = stack[-1][2]
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, count, before.union(_roles(tag, attrs, "main" in before))))
        if tag in _BLOCK:
            around.append((tag, count))
        skip += tag in _SKIP
        anchor += tag == "a"
        if tag in _RAW:
            pos = stop.start() if stop else end
    flush()
    return out


# --- the block classifier ----------------------------------------------------------------

N_TEXT = 8


def block_features(bs: list[Block]) -> np.ndarray:
    rows = []
    for k, b in enumerate(bs):
        n = b.text.count(" ") + 1
        ends = b.text[-1] in ".!?…:;»”\""
        rows.append([1.0, math.log1p(n) / 3, b.linked, float(ends), float(b.tag == "li"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()),
                     float(b.tag == "p"), 1.0 - abs(2 * (k + 0.5) / len(bs) - 1), *[float(r in b.roles) for r in ROLES]])
    return np.array(rows, float).reshape(len(rows), N_TEXT + len(ROLES))


def weak_label(b: Block) -> float | None:
    """1: content, 0: boilerplate, None: the page doesn't say."""
    if b.roles - {"main"}:
        return 0.0
    return 1.0 if "main" in b.roles else None


#: Used when no page in the sample marks any role: length, sentences and links decide.
PRIOR = np.array([-1.5, 2.0, -4.0, 1.0, -1.5, 0.5, 1.0, 0.5, 3.0, *[-6.0] * 8])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, trust: float = 20.0) -> np.ndarray:
    """Logistic regression by gradient steps from the prior, which also anchors it: it weighs as
    much as ``trust`` blocks, so a small sample can't overrule it."""
    if not len(y) or y.min() == y.max():
        return PRIOR.copy()
    x2 = x.copy()
    x2[:, N_TEXT:] = 0.0
    x, y = np.vstack([x, x2]), np.concatenate([y, y])
    w, ridge = PRIOR.copy(), trust / len(y)
    rate = 1.0 / (0.5 + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * (w - PRIOR))
    # roles stay evidence in the known direction whatever the sample holds
    w[N_TEXT] = max(w[N_TEXT], PRIOR[N_TEXT])
    w[N_TEXT + 1:] = np.minimum(w[N_TEXT + 1:], PRIOR[N_TEXT + 1:])
    return w


def train(pages: DataFrame, max_pages: int = MAX_TRAIN_PAGES) -> np.ndarray:
    """Weights from the ``max_pages`` pages with the smallest hash, chosen on narrow rows; the
    features are made where the pages are, and those of the bounded sample reach the driver."""
    ids = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).distinct()
    sample = pages.where("html is not null").join(F.broadcast(ids), "page_id", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for t in b.column("html"):
                bs = blocks(t.as_py())
                for f, blk in zip(block_features(bs), bs):
                    if (label := weak_label(blk)) is not None:
                        xs.append(f.tobytes())
                        ys.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.float64())], ["x", "y"])

    rows = sample.mapInArrow(run, "x binary, y double").orderBy("x", "y").collect()
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), N_TEXT + len(ROLES))
    return fit(x, np.array([r.y for r in rows]))


# --- the cut -----------------------------------------------------------------------------

def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut. ``gain`` > 0 is a node's net
    capacity from the source, < 0 its net capacity to the sink; edges hold both ways.
    Maximum flow by phases: distances from all supplies, then as many shortest paths at once as
    the distances allow; each phase passes over the edges once and makes the paths longer."""
    n, least = len(gain), 1e-12
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]   # edges of a node; edge e's reverse is e ^ 1
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    supply, demand = [max(g, 0.0) for g in gain], [max(-g, 0.0) for g in gain]
    while True:
        level = [0 if x > least else -1 for x in supply]
        queue, reach = [k for k in range(n) if level[k] == 0], None
        for u in queue:   # grows while it is read
            if reach is not None and level[u] >= reach:
                break
            if demand[u] > least:
                reach = level[u]
                break
            for e in out[u]:
                v = to[e]
                if cap[e] > least and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if reach is None:
            return [x >= 0 for x in level]
        at = [0] * n
        for root in range(n):
            while supply[root] > least:
                path, u = [], root   # edges taken; dead ends are left for good in this phase
                while demand[u] <= least:
                    edges_u = out[u]
                    while at[u] < len(edges_u) and not (cap[edges_u[at[u]]] > least and level[to[edges_u[at[u]]]] == level[u] + 1 and level[u] < reach):
                        at[u] += 1
                    if at[u] < len(edges_u):
                        path.append(edges_u[at[u]])
                        u = to[path[-1]]
                    elif path:
                        u = to[path.pop() ^ 1]
                        at[u] += 1
                    else:
                        u = -1
                        break
                if u < 0:
                    break
                flow = min([supply[root], demand[u], *[cap[e] for e in path]])
                supply[root] -= flow
                demand[u] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def smoothness(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacent blocks, weaker with the distance to their common ancestor; and each block
    with the next one under the same parent, wherever it stands."""
    edges, last = [], {}
    for k, b in enumerate(bs):
        if k:
            edges.append((k - 1, k, ADJACENT / (1 + max(bs[k - 1].depth, b.depth) - b.common)))
        if b.parent in last:
            edges.append((last[b.parent], k, NEAR))
        last[b.parent] = k
    return edges


def main_text(source: str | None, weights: np.ndarray) -> str:
    bs = blocks(source)
    if not bs:
        return ""
    costs = block_features(bs) @ weights  # log odds: cost of boilerplate less cost of content
    keep = min_cut(costs.tolist(), smoothness(bs))
    return "\n\n".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    p = with_column_names(pages, "page_id", "url", "html")
    w = train(p) if weights is None else weights
    shared = p.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), shared.value) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return p.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    """The registered query."""
    return extract(pages)
