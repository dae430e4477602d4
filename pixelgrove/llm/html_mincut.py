"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks: stretches of text between block-level tags.  The graph of a page has a node for every block and for
every element that holds one.  Terminal capacities are classifier costs:

* a block's come from its own text only (length, sentence marks, share of links, kind of tag), through logistic
  weights that are fitted to blocks whose element tells what they are;
* an element's come from its tag and its class, id and role words; where these are plain (an article, a footer,
  a comment list) it is a seed, fixed to one side, and where they are doubtful ("related-work") a small cost.

Smoothness edges join neighbours: consecutive blocks (adjacency; more inside one parent), and every block and
element with its parent (DOM proximity; more inside a seed, and in proportion to the blocks below).  The minimum cut, found by
maximum flow, is the cheapest labelling of all nodes together: a long advert follows its container, a
two-word paragraph its article, and a list of links inside an article leaves it.

Before the flow, nodes whose own capacity exceeds all their edges together (seeds first, then what they
hold) are folded into their neighbours' terminals, since they have the same label in every minimum cut.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea svg math object canvas select button title xmp noembed noframes".split())
HARD_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
ITEM_TAGS = frozenset("li dt dd td th caption option".split())
CLOSED_BY = {"p": BLOCK_TAGS - {"html", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

# Words of class, id and role attributes that tell what a part of a page is for.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus footer gdpr header "
    "discussion login masthead menu modal nav navbar navigation newsletter notice pager pagination paging popup popular promo promoted promotion recommended related reply replies respond "
    "search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert toast overlay disclaimer legal complementary contentinfo "
    "dialog form".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post postcontent story text".split())
# Those of them that say it whatever words stand beside them ("user-comments", "gdpr-cookie-law").
SURE_WORDS = frozenset("comments commentlist consent cookie cookies disqus gdpr newsletter".split())
# Elements of running text, whose names are often their subject ("search", "related").
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
# Words that are the subject of a section as often as its purpose.
SUBJECT_WORDS = frozenset("form search legal share side social related popular tags skip reply widget widgets menu dialog notice alert subscription subscribe".split())
# Words that only say that something is a part of a page.
FRAME_WORDS = frozenset(
    "a area bar block bottom box button buttons center col column container global group holder icons inner item items left links list module outer page panel posts primary right row secondary "
    "section site slot thread top unit user reader wrap wrapper".split()
)

#: Features of a block's own text and the prior log-odds weights for content.
FEATURES = ("bias", "length", "marks", "links", "paragraph", "heading", "item", "notice")
PRIOR = (-0.8, 0.7, 0.8, -4.0, 0.9, 0.6, -0.8, -2.5)
#: The largest own cost of a block.
MOST = 4.5
#: Capacity of a doubtful element, and of a seed.
DOUBT, SEED = 2.5, 1e6
#: Capacities of adjacency edges (between parents, inside one) and, per block below, of parent edges: unmarked, inside content told by a word, by a tag, inside boilerplate.
NEXT, NEXT_SAME_PARENT, FREE, BY_WORD, BY_TAG, HELD = 0.3, 0.9, 0.4, 2.0, 3.5, 6.5
_HOLD = {0: FREE, 1: BY_WORD, 2: BY_TAG, -1: HELD}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s]*+)))?+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARK = re.compile(r"[.!?。！？…](?:\s|$)")
_NOTICE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
_SPACE = re.compile(r"\s+")


class _Node:
    """An element: region is -1 in boilerplate, 1 or 2 in content told by a word or a tag, else 0; own its cost."""

    __slots__ = ("tag", "up", "region", "own", "header", "index", "below")

    def __init__(self, tag: str, up: _Node | None, attributes: str) -> None:
        self.tag, self.up, self.index, self.below = tag, up, -1, 0
        region, self.header, self.own = (up.region, up.header, 0.0) if up is not None else (0, False, 0.0)
        plain = doubtful = good = hidden = False
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                for part in value.split():
                    words = {x.lower() for x in _NAME.findall(part)}
                    wrong = words & BAD_WORDS
                    if region > 0 or words & GOOD_WORDS:
                        wrong -= {"header"}  # of the article
                    if name == "id" and tag == "section" and words <= SUBJECT_WORDS:
                        doubtful = True  # an anchor
                    elif wrong:
                        plain |= tag not in TEXT_TAGS and (words <= BAD_WORDS | FRAME_WORDS or bool(words & SURE_WORDS))
                        doubtful = True
                    elif words and words <= GOOD_WORDS | FRAME_WORDS and words & GOOD_WORDS:
                        good = True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDING.search(value)):
                hidden = True
        if tag in ("html", "body"):
            plain = doubtful = good = False
        seed = 0
        if hidden or tag in HARD_TAGS or (plain and not good and tag != "main"):
            seed = -1
        elif tag in GOOD_TAGS and (region >= 0 or self.header):
            seed = 2
            self.header = False
        elif tag == "header" and region < 1:
            seed = -1
            self.header = region == 0
        elif good and region == 0 and not plain:
            seed = 1
        elif doubtful and region >= 0:
            self.own = -DOUBT
        if seed:
            self.own = SEED if seed > 0 else -SEED
            region = seed
            self.header &= tag == "header"
        self.region = region


class Block:
    """A stretch of text and what the classifier sees of it."""

    __slots__ = ("text", "node", "link_chars")

    def __init__(self, text: str, node: _Node, link_chars: int) -> None:
        self.text, self.node, self.link_chars = text, node, link_chars

    def features(self) -> tuple[float, ...]:
        n, tag = len(self.text), self.node.tag
        marks = min(3, len(_MARK.findall(self.text, 0, 2000)))
        notice = float(_NOTICE.match(self.text) is not None)
        return (1.0, min(3.0, n / 60), marks, min(1.0, self.link_chars / max(1, n)), float(tag == "p"), float(tag[:1] == "h" and tag[1:].isdigit()), float(tag in ITEM_TAGS), notice)

    def evidence(self, weights: tuple[float, ...] = PRIOR) -> float:
        """Cost of boilerplate minus cost of content, from the text alone."""
        return max(-MOST, min(MOST, sum(w * x for w, x in zip(weights, self.features()))))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; lenient about unclosed and stray tags, as browsers are.  Time is linear in the page."""
    out: list[Block] = []
    here = _Node("#", None, "")
    open_tags: dict[str, int] = {}
    never: set[str] = set()  # raw elements without an end tag further on
    parts: list[str] = []
    links, inner = 0, 0  # inside a link; chars of the parts that lie in links

    def close_block() -> None:
        nonlocal parts, inner
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, here, min(inner, len(text))))
            parts, inner = [], 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(text)
            if links:
                inner += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if name in RAW_TAGS and not closing:
            if attributes.endswith("/") or name in never:
                continue
            stop = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+>?", re.I).search(page, at)
            if stop or name in ("title", "script", "style"):
                at = stop.end() if stop else end
            else:
                never.add(name)
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK_TAGS:
            continue
        close_block()
        if closing:
            if open_tags.get(name):
                while here.tag != name:
                    open_tags[here.tag] -= 1
                    here = here.up
                open_tags[name] -= 1
                here = here.up
                links = 0
            continue
        if name in VOID_TAGS or name == "head":
            continue
        links = 0
        while here.tag in CLOSED_BY and name in CLOSED_BY[here.tag]:
            open_tags[here.tag] -= 1
            here = here.up
        here = _Node(name, here, attributes)
        open_tags[name] = open_tags.get(name, 0) + 1
    close_block()
    return out


def graph(blocks: list[Block], weights: tuple[float, ...] = PRIOR) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the nodes and edges (i, j, capacity); the first len(blocks) nodes are the blocks, then come elements."""
    costs = [b.evidence(weights) for b in blocks]
    elements: list[_Node] = []
    edges: list[tuple[int, int, float]] = []
    for j, b in enumerate(blocks):
        node = b.node
        while node is not None and node.index < 0:
            node.index = len(costs)
            costs.append(node.own)
            elements.append(node)
            node = node.up
        b.node.below += 1
        edges.append((j, b.node.index, _HOLD[b.node.region]))
        if j:
            a = blocks[j - 1].node
            edges.append((j - 1, j, NEXT_SAME_PARENT if a.up is b.node.up or a is b.node else NEXT))
    # children before parents: blocks below each element, and its edge to its parent
    left = {id(e): 0 for e in elements}
    for e in elements:
        if e.up is not None:
            left[id(e.up)] += 1
    ready = [e for e in elements if not left[id(e)]]
    while ready:
        e = ready.pop()
        if e.up is not None:
            edges.append((e.index, e.up.index, _HOLD[e.up.region] * e.below))
            e.up.below += e.below
            left[id(e.up)] -= 1
            if not left[id(e.up)]:
                ready.append(e.up)
    return costs, edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Per node: whether it is on the source's (content) side of a minimum cut.

    A node's cost e is a capacity of max(e, 0) from the source and max(-e, 0) to the sink.  Capacities are
    counted in thousandths.
    """
    n = len(costs)
    own = [round(1000 * x) for x in costs]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    total = [0] * n
    for i, j, c in edges:
        c = round(1000 * c)
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
        total[i] += c
        total[j] += c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # fold nodes whose label is certain
        i = todo.popleft()
        if side[i] is None and abs(own[i]) > total[i]:
            side[i] = own[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    own[j] += c if side[i] else -c
                    total[j] -= c
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        inside = _flow(left, own, near, side)
        for i in left:
            side[i] = i in inside
    return [bool(x) for x in side]


def _flow(left: list[int], own: list[int], near: list[dict[int, int]], side: list[bool | None]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow, by blocking flows over level graphs."""
    number = {x: k for k, x in enumerate(left)}
    s, t = len(left), len(left) + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, i in enumerate(left):
        if own[i] > 0:
            edge(s, k, own[i], 0)
        elif own[i] < 0:
            edge(k, t, -own[i], 0)
        for j, c in near[i].items():
            if i < j and side[j] is None:
                edge(k, number[j], c, c)
    while True:
        level = [-1] * (t + 1)
        level[t] = 0
        queue = deque([t])
        while queue:  # distances to the sink, so that every walk along falling levels can end there
            x = queue.popleft()
            for e in out[x]:
                if room[e ^ 1] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[s] < 0:
            break
        turn = [0] * (t + 1)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if not room[e] and not cut:
                        cut = k + 1
                x = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            mine, k = out[x], turn[x]
            while k < len(mine) and not (room[mine[k]] and level[to[mine[k]]] == level[x] - 1):
                k += 1
            turn[x] = k
            if k < len(mine):
                path.append(mine[k])
                x = to[mine[k]]
            elif x == s:
                break
            else:
                e = path.pop()
                x = to[e ^ 1]
                turn[x] += 1
    found = {s}
    queue = deque([s])
    while queue:
        x = queue.popleft()
        for e in out[x]:
            if room[e] and to[e] not in found:
                found.add(to[e])
                queue.append(to[e])
    return {left[k] for k in found if k < s}


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = minimum_cut(*graph(blocks, weights))
    return " ".join(b.text for b, x in zip(blocks, keep) if x)


def fit(pages: DataFrame, *, html_col: str = "html", fit_pages: int = 4000, rounds: int = 25) -> tuple[float, ...]:
    """Weights of the block classifier, from blocks inside seeds of some fit_pages pages (chosen by a hash of their html).

    Spark counts blocks by rounded features and by what their element says; the logistic fit with a normal
    prior around PRIOR uses these counts, in which all content weighs as 40 blocks and all boilerplate as 20 (its elements
    also hold text that reads like content), and no weight leaves 2/3 to 3/2 of its prior.  Without such blocks the weights are PRIOR.
    """
    source = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null")
    share = min(1.0, fit_pages / max(1, source.count()))
    chosen = source.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                for b in blocks_of(page):
                    if b.node.region:
                        rows.append((b.node.region > 0, [round(4 * x) for x in b.features()]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["good", "f"])

    counts = chosen.mapInArrow(run, "good boolean, f array<int>").groupBy("good", "f").count().orderBy("good", "f").collect()
    prior = np.array(PRIOR)
    if not counts:
        return PRIOR
    x = np.array([r["f"] for r in counts], float) / 4
    y = np.array([r["good"] for r in counts], float)
    weight = np.array([r["count"] for r in counts], float)
    for label, all_of_it in ((0.0, 20), (1.0, 40)):
        weight[y == label] *= all_of_it / max(1.0, weight[y == label].sum())
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (y - p)) - (w - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    w = np.clip(w, np.minimum(prior / 1.5, prior * 1.5), np.maximum(prior / 1.5, prior * 1.5))
    return tuple(float(v) for v in w)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages without the html column, with text_col: the main text of every row.  One pass, no shuffle; weights are fitted first if not given.

    Defined cases: null, empty or contentless html gives an empty text; markup may be cut off anywhere; repeated rows and further
    columns pass through; an own column named text_col is replaced; an empty table gives none.
    """
    weights = fit(pages, html_col=html_col) if weights is None else tuple(weights)
    columns = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    source = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{html_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x, weights) for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(text, pa.string())], [*columns, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(columns)])
    return source.mapInArrow(run, f"{fields + ', ' if fields else ''}`{text_col}` string")
