"""Main text of web pages by a minimum cut over their blocks.

A tolerant tag scan turns a page into blocks of text, each with its path of elements. The graph's nodes are the blocks
and the elements that hold them directly. A block's terminal capacities are what a classifier of its own text says (length,
words, sentence marks, commas, digits, share of link text): a linear discriminant, fitted on a bounded
sample of pages (SAMPLE_PAGES, chosen by hash of the html). Its labels are weak ones: text inside article or main counts
as content, text in navigation, footers, sidebars, headers, hidden and noise-named elements as boilerplate; the classifier
sees none of that. An element's terminal capacities say what its mark (article, or noise) tells of the blocks in it.
Smoothness edges join each block to its element (DOM proximity), each element to the next one around it, and successive
blocks, all weaker across a mark's border. The maximum flow separates content from boilerplate: most blocks of an article
whose own text looks like boilerplate (titles, one-word paragraphs) stay with their article, and text-like adverts
do not. Blocks on the source side are joined in page order. Elements that never hold content (scripts, styles, forms, buttons,
dialogs) are hard terminals.

Defined results: null and empty html give an empty text. Unclosed and stray tags follow the usual rules (a new
block element closes an open paragraph, a stray end tag is ignored); a page may end anywhere. Text that no
block element surrounds is a block of its own. Pages that give no weak labels of either kind leave a fixed discriminant. Repeated rows are alike; an empty table gives no rows; other
columns pass through, an input column named like an output column is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import carried

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml select".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strong sub sup time tt u var wbr br object".split()) | MATH
#: Elements that a slash at the end of their tag closes.
CLOSABLE = MATH | {"svg", "annotation", "annotation-xml", "object"}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SECTION = frozenset("article main section aside nav header footer".split())
ROOTS = frozenset("article main body html".split())
NEVER = frozenset("form button head script style noscript template textarea iframe svg select option dialog".split())
BAD = frozenset("nav footer aside menu".split())
#: Words of class, id and role that mark what is not the article; and what is.
NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|consent|disqus|footer|header|menu|modal|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s])", re.IGNORECASE)
SIGNAL = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text)(?:$|[-_\s])", re.IGNORECASE)

HARD = 1e6
#: Pages that the classifier is fitted on, about; and the bound of what it may say of a block.
SAMPLE_PAGES, CLIP = 2000, 4.0
#: What a mark says of each block in its element: more than a block's own text can, so that marks decide where they are given.
ARTICLE, MAIN, OUTSIDE, MARKED_BAD = 6.0, 3.0, -4.0, -8.0
#: Capacities: block to marked and to unmarked element, element to the element around it for each block, successive blocks, any of the last two
#: across a mark's border.
TIE, LOOSE, AROUND, NEXT, BORDER = 6.0, 3.0, 1.0, 0.5, 0.1
LEAVES = (frozenset("p blockquote pre figcaption dd".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt td th".split()))
FEATURES = 7
#: Weights of a page set without weak labels: the discriminant of the features of features_of(), by hand.
FALLBACK = (-5.0, 0.9, 0.3, -4.0, 1.0, 2.0, -1.0)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/$")
_WHITE = re.compile(r"\s+")


class Element(NamedTuple):
    tag: str
    number: int
    bad: bool
    noise: bool
    good: bool


class Block(NamedTuple):
    path: tuple[Element, ...]
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, white space inside made single spaces, trimmed, none empty."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, links, number, at = 0, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = _WHITE.sub(" ", "".join(parts)).strip()
            if joined:
                out.append(Block(tuple(e for e in stack if e.tag not in INLINE), joined, linked))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop()
            links -= top.tag == "a"
            if top.tag == tag:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            text(m[1])
        if m[3] is None:
            continue
        tag, end = m[3].lower(), m[2] == "/"
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if end:
            # Only an element that is open, and not across a section, is closed.
            for e in reversed(stack):
                if e.tag == tag:
                    close(tag)
                    break
                if e.tag in SECTION and tag not in SECTION and tag not in ("body", "html"):
                    break
            continue
        if tag in CLOSES_P:
            # As in a browser's parser: a new block element ends an open paragraph, inline elements in it too.
            for e in reversed(stack):
                if e.tag == "p":
                    close("p")
                    break
                if e.tag not in INLINE:
                    break
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1].tag == tag:
            close(tag)
        if tag in CLOSABLE and m[4].endswith("/") and not _UNQUOTED.search(m[4]):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        number += 1
        names = " ".join(x for g in _NAMES.findall(m[4]) for x in g if x)
        bad = bool(_HIDDEN.search(m[4])) or tag in NEVER or tag in BAD
        stack.append(Element(tag, number, bad, bool(NOISE.search(names)), tag in ("article", "main") or bool(SIGNAL.search(names))))
        links += tag == "a"
    flush()
    return out


def layout_of(blocks: list[Block]) -> frozenset[int]:
    """Numbers of the elements around the page's article whose noise names speak of its surroundings ("with-sidebar").

    The article is the one (on a page without any, the main element) inside the fewest elements with such names; several are
    equal. Comments or related articles further in keep their marks.
    """
    for tag in ("article", "main"):
        around: dict[int, frozenset[int]] = {}
        for b in blocks:
            for i, e in enumerate(b.path):
                if e.bad and e.tag not in ROOTS:
                    break
                if e.tag == tag and e.number not in around:
                    around[e.number] = frozenset(x.number for x in b.path[:i] if x.noise and x.tag not in ROOTS)
        if around:
            fewest = min(map(len, around.values()))
            return frozenset().union(*(x for x in around.values() if len(x) == fewest))
    return frozenset()


def features_of(block: Block) -> list[float]:
    """Of the block's own text; no element, no name. The first is 1."""
    text = block.text
    words = text.count(" ") + 1
    return [
        1.0, math.log(len(text)), math.log(words), min(1.0, block.linked / len(text)), float(text[-1] in ".!?…。"), min(1.0, sum(map(text.count, ",;:")) / words),
        min(1.0, sum(map(text.count, "0123456789|©·")) / len(text)),
    ]


def marks_of(blocks: list[Block]) -> list[tuple[float, int]]:
    """(mark, its element's number) of each block: what sections and names around it say of it, 0 if nothing."""
    layout = layout_of(blocks)
    articles = any(e.tag == "article" for b in blocks for e in b.path)
    out = []
    for b in blocks:
        tags = [e.tag for e in b.path]
        # What is marked as noise inside an article (shares, comments) is noise; the article itself may have any name.
        bad = [e.number for e in b.path if (e.bad or e.noise and e.number not in layout) and e.tag not in ROOTS or e.tag == "header" and "article" not in tags]
        good = [(e.tag, e.number) for e in b.path if e.tag in ("article", "main")]
        if bad:
            out.append((MARKED_BAD, bad[0]))
        elif good:
            article = [n for t, n in good if t == "article"]
            out.append((ARTICLE, article[-1]) if article else (MAIN if articles else ARTICLE, good[-1][1]))
        else:
            out.append((OUTSIDE if articles else 0.0, 0))
    return out


def own_odds(block: Block, weights: np.ndarray) -> float:
    """What the classifier says of the block alone."""
    return max(-CLIP, min(CLIP, float(np.dot(weights, features_of(block)))))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays with the source: maximum flow by shortest augmenting paths and blocking flows."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, forward: float, back: float) -> None:
        for x, y, c in ((u, v, forward), (v, u, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, x in enumerate(odds):
        # The smaller cost flows straight through; only the difference matters to the cut.
        arc(source, i, max(0.0, x), 0.0)
        arc(i, sink, max(0.0, -x), 0.0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for a in out[u]:
                if room[a] > 1e-9 and level[to[a]] < 0:
                    level[to[a]] = level[u] + 1
                    queue.append(to[a])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[a] for a in path)
                for a in path:
                    room[a] -= flow
                    room[a ^ 1] += flow
                cut = next(i for i, a in enumerate(path) if room[a] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(out[u]):
                a = out[u][turn[u]]
                if room[a] > 1e-9 and level[to[a]] == level[u] + 1:
                    path.append(a)
                    u = to[a]
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                u = to[path.pop() ^ 1]
                turn[u] += 1


def graph_of(blocks: list[Block], own: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(terminal log-odds, edges) of the page's graph: first the blocks, then the elements that hold them."""
    marks = marks_of(blocks)
    hard = [any(e.tag in NEVER for e in b.path) for b in blocks]
    odds = [-HARD if h else x for h, x in zip(hard, own, strict=True)]
    edges: list[tuple[int, int, float]] = []
    node: dict[tuple[int, int], int] = {}
    held: dict[int, int] = {}
    around: dict[int, tuple[tuple[Element, ...], tuple[float, int]]] = {}
    for i, (b, mark) in enumerate(zip(blocks, marks, strict=True)):
        # A paragraph, a title or an item is held by what is around it, other blocks by their own element.
        inner = bool(b.path) and any(b.path[-1].tag in kind for kind in LEAVES)
        path = b.path[:-1] if inner and b.path[-1].number != mark[1] else b.path
        key = path[-1].number if path else 0, mark[1]
        if key not in node:
            node[key] = len(odds)
            odds.append(0.0)
            around[node[key]] = path, mark
        n = node[key]
        odds[n] += mark[0]
        held[n] = held.get(n, 0) + 1
        edges.append((i, n, TIE if mark[0] else LOOSE))
        if i:
            edges.append((i - 1, i, NEXT if marks[i - 1] == mark else BORDER))
    for n, (path, mark) in around.items():
        for e in reversed(path[:-1]):
            outer = node.get((e.number, mark[1]))
            if outer is not None:
                edges.append((n, outer, AROUND * held[n]))
                break
    return odds, edges


def main_text(page: str | None, weights: np.ndarray | tuple = FALLBACK) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    odds, edges = graph_of(blocks, [own_odds(b, np.asarray(weights)) for b in blocks])
    keep = min_cut(odds, edges)
    return " ".join(b.text for b, k in zip(blocks, keep, strict=False) if k)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each kind of weak label the number of blocks, and the sums and products of their features, in whole 1/4096."""
    for batch in batches:
        rows: dict[bool, list] = {True: [], False: []}
        for page in batch.column(0).to_pylist():
            blocks = blocks_of(page or "")
            for b, (mark, element) in zip(blocks, marks_of(blocks), strict=True):
                if element:
                    rows[mark > 0].append(features_of(b))
        for label, found in rows.items():
            x = np.rint(np.array(found, float).reshape(-1, FEATURES) * 64).astype(np.int64)
            total = np.concatenate(((x * 64).sum(axis=0), (x.T @ x).ravel()))
            yield pa.RecordBatch.from_pydict({"content": pa.array([label] * len(total)), "at": pa.array(range(len(total)), pa.int32()), "v": pa.array(total, pa.int64())})


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the discriminant, from about `sample` pages. What reaches the driver is one small matrix for each label."""
    share = min(1.0, sample / max(1, pages.count()))
    some = pages.select(F.col(html).alias("html")).filter(F.pmod(F.xxhash64(F.lit(3), html), F.lit(1_000_000)) < int(share * 1_000_000))
    got = some.mapInArrow(_sums, "content boolean, at int, v long").groupBy("content", "at").agg(F.sum("v").alias("v")).collect()
    table = {(r["content"], r["at"]): r["v"] / 4096 for r in got}
    n = {c: table.get((c, 0), 0.0) for c in (True, False)}
    if min(n.values()) < 1:
        return np.array(FALLBACK)
    mean = {c: np.array([table[c, i] for i in range(FEATURES)]) / n[c] for c in n}
    moment = {c: np.array([table[c, FEATURES + i] for i in range(FEATURES * FEATURES)]).reshape(FEATURES, FEATURES) / n[c] for c in n}
    spread = sum(n[c] * (moment[c] - np.outer(mean[c], mean[c])) for c in n) / sum(n.values())
    slope = np.linalg.solve(spread[1:, 1:] + 0.05 * np.eye(FEATURES - 1), (mean[True] - mean[False])[1:])
    # Both kinds count alike: how many blocks of a page are navigation says nothing of a text.
    return np.concatenate(([-slope @ (mean[True] + mean[False])[1:] / 2], slope))


def extract_main_text(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """pages with text and n_chars, its code points."""
    weights = fit(pages, html, sample)

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page, weights) for page in column.to_pylist()], pa.string())

    out = pages.select(*carried(pages, "text", "n_chars"), extract(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
