"""HTML extraction (operator 10): content and boilerplate separated by a minimum cut.

A page is split into text blocks. A classifier, trained on blocks of given pages inside and outside their ``article``, gives
the log-odds that a block of such shape is content; what the page declares (landmark elements, names of classes) adds to
them. They are the capacities of the block's edges to the two terminals. Neighbouring blocks, and blocks of one container,
are tied by edges that cost when the two are labelled differently, the less the farther apart they stand in the tree. The
minimum cut, found by maximum flow, is the cheapest labelling: a short line between paragraphs stays with them, a sentence
among links goes with these.

The project has no web pages among its records, so the operator is general: it works on tables of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, first_by_hash

TRAIN_PAGES = 400  # pages of the training sample
TRAIN_BLOCKS = 40_000  # blocks of it that are learnt from

# What a declaration adds to the log-odds of content; the trained part is held to +-SHAPE.
SHAPE, LANDMARK, NAMED, HINTED, MAIN = 3.0, 7.0, 7.0, 0.5, 4.0
UNDECLARED = 2.0  # for unlinked text of a page that declares nothing
# Ties of blocks that are next to each other, and of blocks of one container with others between them.
TIE, CONTAINER_TIE = 1.5, 0.75

_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = set("head title noscript template svg math object select option button dialog datalist audio video canvas".split())
_AWAY = set("nav footer aside menu search dialog".split())
_AWAY_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_AWAY_WORDS = set(
    "nav navbar navigation menu menus sidebar sidebars aside footer foot header masthead topbar banner banners ad ads advert adverts advertisement advertisements sponsor sponsored promo promos promotion"
    " cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations breadcrumb"
    " breadcrumbs pagination pager widget widgets comment comments commentlist reply replies respond disqus toolbar skip copyright legal disclaimer teaser teasers outbrain taboola".split()
)
_MAIN_WORDS = set("article content post entry story main body text hentry".split())
# Words that may stand beside such a word in one name without changing what it names.
_PLACES = set("site page section box block container wrapper wrap area list item items top left right bottom inner outer main global primary secondary posts links link bar content article post entry row col".split())
_AWAY_ARTICLES = {"comment", "comments", "reply", "related", "teaser", "promo"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# A paragraph, item or cell that opens ends an open one of the same kind.
_ENDS_OPEN = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_RAW = "script|style|textarea|iframe|noembed|noframes|xmp|plaintext"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Box:
    """An open element: its place in the tree and what its tag and attributes say about the text inside."""

    tag: str
    parent: "Box | None"
    away: bool = False  # in a landmark of boilerplate, with no landmark of content further in
    named: "Box | None" = None  # innermost element whose class or id names boilerplate, unless content is declared further in
    hints: int = 0  # class words of boilerplate that name nothing by themselves, as in "has-sidebar"
    never: bool = False  # in an element that shows no text
    main: bool = False  # in a landmark of content
    form: "Box | None" = None  # innermost form
    wraps: bool = False  # a form, or a named element, that holds landmarks of the page: it is no form to fill in, no advert
    depth: int = 0
    words: frozenset = frozenset()  # of its class and id

    def is_away(self) -> bool:
        return self.away or self.form is not None and not self.form.wraps

    def is_named(self) -> bool:
        return self.named is not None and not self.named.wraps


@dataclass
class Block:
    text: str
    box: Box
    linked: int = 0


def _judge(tag: str, attributes: str, parent: Box) -> Box:
    box = Box(tag, parent, parent.away, parent.named, parent.hints, parent.never, parent.main, parent.form, depth=parent.depth + 1)
    names: list[set[str]] = []
    role, hidden = "", False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += [set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())) for x in value.split()]
            elif key == "role":
                role = value.lower().strip()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                hidden = True
    words = set().union(*names)
    content = tag in ("article", "main") or role in ("main", "article")
    whole = tag == "main" or role == "main"
    landmark = content or tag in ("nav", "header", "footer")
    if tag in _NEVER or hidden:
        box.never = True
    elif tag == "form" or role == "form":
        box.form = box
    elif tag in ("html", "body"):
        pass
    elif whole or content and not any(n & _AWAY_ARTICLES and n <= _AWAY_WORDS | _PLACES for n in names) and not (parent.is_named() and _comments(parent.named)):
        # Declared content: nothing around it takes it away.
        box.away, box.named, box.hints, box.main = False, None, 0, True
    elif content or tag in _AWAY or role in _AWAY_ROLES or tag == "header" and not parent.main:
        box.away, box.main, landmark = True, False, landmark and not content
    elif tag not in _HEADINGS:
        naming = [n for n in names if n & _AWAY_WORDS and n <= _AWAY_WORDS | _PLACES]
        if naming and not (parent.main and words & _AWAY_WORDS <= {"header", "banner"}) and not words & _MAIN_WORDS - _PLACES:
            box.named, box.main = box, False
        else:
            box.hints += len(words & _AWAY_WORDS)
            if words & _MAIN_WORDS and not box.away and not box.is_named():
                box.main = landmark = True
    box.words = frozenset(words)
    if landmark:
        for kind in ("form", "named"):
            up = getattr(parent, kind)
            while up is not None and not up.wraps:
                up.wraps = whole or not (kind == "named" and _comments(up))
                up = getattr(up.parent, kind) if up.parent else None
    return box


def _comments(box: Box) -> bool:
    """Whether an element is named after reader comments, whose parts may be declared as articles, too."""
    return bool(box.words & {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "related", "recommended"})


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; markup, comments, scripts and styles are gone, character references decoded."""
    root = Box("", None)
    box, found, parts, linked, in_link = root, [], [], 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text and not box.never:
                found.append(Block(text, box, min(linked, len(text))))
            parts, linked = [], 0

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK or (not closing and tag not in _VOID and attributes and _ATTRIBUTE.search(attributes) and tag not in ("b", "i", "em", "strong", "span", "img", "u", "small", "code", "sub", "sup", "label", "font")):
            flush()
            in_link = 0 if tag in _BLOCK else in_link
            if closing:
                up = box
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    box = up.parent
            else:
                for open_tag in _ENDS_OPEN.get(tag, ()):
                    up = box
                    while up is not root and up.tag != open_tag and up.tag not in ("ul", "ol", "dl", "table", "div", "section", "article", "td", "th", "blockquote"):
                        up = up.parent
                    if up is not root and up.tag == open_tag:
                        box = up.parent
                if tag == "body":
                    while box is not root and box.tag == "head":
                        box = box.parent
                if tag not in _VOID:
                    box = _judge(tag, attributes or "", box)
        elif closing:
            up = box  # an inline element that was opened as a box because of its attributes
            for _ in range(3):
                if up is root or up.tag in _BLOCK:
                    break
                if up.tag == tag:
                    flush()
                    box = up.parent
                    break
                up = up.parent
    flush()
    return found


FEATURES = 11


def shape(block: Block) -> list[float]:
    """What a block looks like, without names of classes and without article and main."""
    size, tag = len(block.text), block.box.tag
    share = block.linked / max(size, 1)
    return [
        1.0, share, float(share > 0.5), min(np.log1p(size), 8.0) / 4, float(size < 25), float(size >= 80), float(block.text[-1] in ".!?:;…\"'”»)"),
        float(tag in ("p", "blockquote", "pre", "figcaption")), float(tag in _HEADINGS), float(tag in ("li", "td", "th", "dt", "dd")), float("©" in block.text[:80]),
    ]


# Weights for pages among which none has an article to learn from.
UNTRAINED = np.array([-0.6, -1.5, -1.0, 0.5, -0.5, 1.0, 0.6, 0.9, 0.8, -0.4, -1.5])


def block_odds(block: Block, weights: np.ndarray) -> float:
    """Log-odds that the block is content."""
    box = block.box
    odds = max(-SHAPE, min(SHAPE, float(np.dot(shape(block), weights))))
    if box.is_away():
        return odds - LANDMARK
    if box.is_named():
        return odds - NAMED
    return odds - HINTED * min(box.hints, 3) + (MAIN if box.main else 0.0)


def block_costs(block: Block, weights: np.ndarray = UNTRAINED, more: float = 0.0) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content), both at least 0; ``more`` is added to the log-odds."""
    odds = block_odds(block, weights) + more
    return max(odds, 0.0), max(-odds, 0.0)


def tree_distance(a: Box, b: Box) -> int:
    """Steps from one element to the other through the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Ties of neighbours and of blocks in one container; what the blocks are called plays no part."""
    ties = [(i, i + 1, TIE / (1 + max(0, tree_distance(a.box, b.box) - 2))) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        near = id(b.box.parent or b.box)
        if near in last and last[near] < i - 1:
            ties.append((last[near], i, CONTAINER_TIE))
        last[near] = i
    return ties


def minimum_cut(costs: list[tuple[float, float]], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``costs``: capacity from the source to a node and from the node to the sink; ``ties``: undirected edges. The flow
    straight through each node is taken first, then shortest augmenting paths in level graphs (Dinic).
    """
    n = len(costs)
    excess = [a - b for a, b in costs]
    if not any(e < -1e-12 for e in excess) or not any(e > 1e-12 for e in excess):
        return [e > 0 or e == 0 and all(x >= 0 for x in excess) for e in excess]
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, e in enumerate(excess):
        if e > 0:
            edge(s, i, e, 0.0)
        elif e < 0:
            edge(i, t, -e, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for v in queue:
            for e in head[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
            while place[v] < len(head[v]):
                e = head[v][place[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                place[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


def main_text(page: str, weights: np.ndarray = UNTRAINED) -> str:
    """The content blocks of a page, one line each."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    declares = any(b.box.main or b.box.is_away() or b.box.is_named() for b in blocks)
    plain = [0.0 if declares or 5 * b.linked > len(b.text) else UNDECLARED for b in blocks]
    labels = minimum_cut([block_costs(b, weights, more) for b, more in zip(blocks, plain, strict=True)], ties_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def training_blocks(page: str) -> list[list[float]]:
    """Shape and label (inside an article) of the blocks of a page that has both kinds."""
    rows = []
    for b in blocks_of(page):
        up = b.box
        while up is not None and up.tag != "article":
            up = up.parent
        if up is not None and b.box.is_away():
            continue  # a form or an aside in the article
        rows.append([*shape(b), float(up is not None)])
    return rows if {r[-1] for r in rows} == {0.0, 1.0} else []


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression in which both labels count alike, by Newton steps."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_blocks(pages: DataFrame) -> np.ndarray:
    """Weights of ``shape``, learnt from at most ``TRAIN_PAGES`` pages and ``TRAIN_BLOCKS`` of their blocks.

    The pages with the smallest hashes of url and id are taken; pages without blocks on both sides of an article teach
    nothing, and if there is no other page the weights are those of ``UNTRAINED``.
    """
    keyed = pages.select(F.xxhash64("url", "page_id").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    sample = first_by_hash(keyed.select("key").distinct(), "key", TRAIN_PAGES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "html"):
            for key, page in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows = training_blocks(page)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "place", "row"])

    found = keyed.join(F.broadcast(sample), "key").select("key", "html").mapInArrow(learn, "key bigint, place bigint, row array<double>")
    rows = found.orderBy(F.xxhash64("key", "place"), "row").limit(TRAIN_BLOCKS).select("row").toArrow().column("row").to_pylist()
    if not rows:
        return UNTRAINED
    data = np.array(rows)
    return logistic(data[:, :-1], data[:, -1])


def extract_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    ``text`` is the article: its blocks in page order, white space inside a block turned into single spaces, joined by a
    line break; empty for null or empty html. Repeated rows stay. A page is one row, whatever its length. ``weights``: of
    ``fit_blocks``, by default over the same pages.
    """
    learnt = fit_blocks(pages) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "html"):
            found = [main_text(x, learnt) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
