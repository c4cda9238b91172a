"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. Unary potentials come from a
logistic scorer on the node's tag, class words, text and links; parent-child potentials say how
often a child of some kind shares its parent's state. Sum-product messages go up and down the tree,
all pages of a batch at once, and give each node's content marginal. A page's text
is that of the blocks whose element is content more likely than not.

Both kinds of potentials are trained from labelled pages: a few pages written with labels, kept here,
and a sample of the given pages that mark their one article themselves.

Defined results: a null or empty page gives an empty text. Unclosed, unknown and
stray tags are kept as a browser would roughly keep them; a page without markup is one block. Texts
of any length are read whole. Repeated rows are rows of their own. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title textarea noscript template iframe select head".split())
# Tags that may stand in a head; any other, and text, ends it, and a later head tag counts for nothing.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
BLOCK = frozenset((
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot "
    "tr td th blockquote pre form fieldset legend figure figcaption address details summary hr dialog center").split())
# A start tag of the key ends an open element of these.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article section main nav aside header footer div ul ol dl table td th form blockquote figure".split())
KINDS = (
    frozenset(("p", "pre", "blockquote")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("li", "dt", "dd")), frozenset(("ul", "ol", "dl")),
    frozenset(("td", "th", "tr", "table", "tbody", "thead", "tfoot", "caption")), frozenset(("article", "main")), frozenset(("nav",)),
    frozenset(("aside",)), frozenset(("footer",)), frozenset(("header",)), frozenset(("form", "fieldset", "legend", "dialog")),
    frozenset(("section",)), frozenset(("html", "body")), frozenset(("figure", "figcaption")),
)
HINTS = (
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager skip".split()),
    frozenset("comment comments reply replies disqus respond discussion".split()),
    frozenset("sidebar aside related share social widget recommended popular trending tags".split()),
    frozenset("cookie cookies consent notice alert popup modal gdpr overlay disclaimer".split()),
    frozenset("form subscribe newsletter signup login search".split()),
    frozenset("footer header masthead copyright legal colophon top bottom site".split()),
    frozenset("article content post entry story text body main".split()),
)
NOT_CONTENT = 7  # hints before this one point away from content
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>=]")
SPACE, UNQUOTED = re.compile(r"\s*"), re.compile(r"[^\s>]*")
DEEP = 512  # elements nested deeper hang beside their parents, as browsers have them
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", re.I)
LETTERS = re.compile(r"[a-z]+")


MARKS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "depth", "hints", "chars", "linked", "words", "marks", "blocks", "items", "own", "start", "hidden", "label")

    def __init__(self, tag: str, parent: int, depth: int, hidden: bool):
        self.tag, self.parent, self.depth, self.hidden = tag, parent, depth, hidden
        self.hints: tuple[int, ...] = ()
        self.chars = self.linked = self.words = self.marks = self.blocks = self.items = self.own = 0
        self.start, self.label = 0, None


class Markup:
    """Finds the tags, comments and declarations of a page, each place visited once or so whatever is malformed."""

    def __init__(self, page: str):
        self.page, self.quotes, self.ended = page, True, page.rfind(">") + 1
        self.last = {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, tag or "" for a comment, attributes) of the first markup from at on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                empty = next((len(c) for c in ("<!-->", "<!--->") if page.startswith(c, start)), 0)
                end = page.find("-->", start + 4)
                return start, start + empty if empty else len(page) if end < 0 else end + 3, False, "", ""
            if start >= self.ended:
                return None  # no > ahead: the rest is text
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, page.find(">", start) + 1, False, "", ""
            name = NAME.match(page, start + 1)
            if name is not None:
                end = self._end(name.end())
                if end:
                    return start, end, bool(name[1]), name[2].lower(), page[name.end() : end - 1]
                # Its quotes reach the end of the page: from here on they count for nothing.
                self.quotes = False
                continue
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Place after the > that ends the tag whose name ends at at. A quote counts at the start of a value only, and when it is closed."""
        if not self.quotes:
            return self.page.find(">", at) + 1
        while (found := STOP.search(self.page, at)) is not None:
            if found[0] == ">":
                return found.end()
            at = SPACE.match(self.page, found.end()).end()
            quote = self.page[at : at + 1]
            if quote in self.last and quote and self.last[quote] > at:
                at = self.page.find(quote, at + 1) + 1
            else:
                at = UNQUOTED.match(self.page, at).end()
        return 0


def _above(scopes: list[int], at: int) -> Iterator[int]:
    """Places of open elements that bound a scope, from the innermost down to above at."""
    return itertools.takewhile(lambda k: k > at, reversed(scopes))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements as nodes, parents first, and blocks (node, text) in page order."""
    nodes, blocks = [Node("html", -1, 0, False)], []
    open_: list[tuple[str, int]] = [("html", 0)]  # every open element and the node that owns its text
    text: list[str] = []
    linked = links = total = 0

    def flush():
        nonlocal linked, total
        # References are decoded once a run of text is whole, since a tag cannot stand within one.
        block = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if block:
            node = open_[-1][1]
            blocks.append((node, block))
            n = nodes[node]
            n.own += len(block)
            n.chars += len(block)
            n.linked += min(linked, len(block))
            n.words += block.count(" ") + 1
            n.marks += len(MARKS.findall(block))
            n.blocks += 1
            total += len(block)
        linked = 0

    where: dict[str, list[int]] = {}  # places of a tag among the open elements
    scopes: list[int] = []

    def close(at: int):
        nonlocal links
        if any(tag in BLOCK for tag, _ in open_[at:]):
            flush()
        for tag, _ in open_[at:]:
            where[tag].pop()
            links -= tag == "a"
        del open_[at:]
        while scopes and scopes[-1] >= at:
            scopes.pop()

    def place(tag: str) -> int:
        """Of the innermost open element of that tag; 0 without one."""
        return where[tag][-1] if where.get(tag) else 0

    def end_head():
        nonlocal past_head
        past_head = True
        if i := place("head"):
            close(i)

    markup = Markup(page)
    at, skip, past_head = 0, None, False
    while True:
        if skip:  # inside a raw element only its end counts
            end = re.compile(rf"</{re.escape(skip)}[\s/>]", re.I).search(page, at)
            found, skip = end and markup.after(end.start()), None
            if found is None:
                break
            at = found[1]
            continue
        found = markup.after(at)
        piece = page[at : found[0]] if found else page[at:]
        if not past_head and piece.strip():
            end_head()
        if piece and not nodes[open_[-1][1]].hidden:
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if found is None:
            break
        _, at, closes, tag, attributes = found
        if not tag:
            continue
        if closes:
            past_head = past_head or tag == "head"
            i = place(tag)
            if i and (tag in BLOCK or not scopes or scopes[-1] <= i):
                close(i)
            continue
        if tag == "head" and past_head:
            continue
        if not past_head and tag not in HEAD:
            end_head()
        if tag in RAW:
            if not attributes.endswith("/"):
                skip = tag
            text.append(" ")
            continue
        if tag in BLOCK:
            ends = ENDS.get(tag, ())
            for ended in ends or (("p",) if tag != "html" else ()):
                i = place(ended)
                if i and all(open_[k][0] in ends for k in _above(scopes, i)):
                    close(i)
            flush()
            if tag in ("html", "body") and place(tag):
                continue
        if tag in VOID:
            text.append(" ")
            continue
        owner = open_[-1][1]
        if tag in BLOCK or tag in HIDDEN:
            hidden = nodes[owner].hidden or tag in HIDDEN
            if nodes[owner].depth >= DEEP:
                owner = nodes[owner].parent
            node = Node(tag, owner, nodes[owner].depth + 1, hidden)
            node.start = total
            if attributes:
                names = set(LETTERS.findall(" ".join("".join(x) for x in NAMED.findall(attributes)).lower()))
                node.hints = tuple(i for i, h in enumerate(HINTS) if names & h)
                if "data-content=" in attributes:  # the label of a page written for training
                    node.label = 'data-content="1"' in attributes
            nodes.append(node)
            owner = len(nodes) - 1
        links += tag == "a"
        where.setdefault(tag, []).append(len(open_))
        if tag in SCOPE:
            scopes.append(len(open_))
        open_.append((tag, owner))
    flush()
    for n in reversed(nodes[1:]):
        p = nodes[n.parent]
        p.chars, p.linked, p.words, p.blocks = p.chars + n.chars, p.linked + n.linked, p.words + n.words, p.blocks + n.blocks
        p.marks += n.marks
        p.items += n.items + (n.tag == "li")
    return nodes, blocks


def kind(tag: str) -> int:
    return next((i for i, k in enumerate(KINDS) if tag in k), len(KINDS))


SIZE = 7 + len(KINDS) + 1 + len(HINTS)


def node_features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), SIZE))
    whole = max(nodes[0].chars, 1)
    for i, n in enumerate(nodes):
        chars = max(n.chars, 1)
        x[i, :7] = (1, np.log1p(n.own) / 8, n.linked / chars, n.chars / whole, min(n.marks / max(n.words, 1), 1),
                     n.items / (1 + n.blocks), n.start / whole)
        x[i, 7 + kind(n.tag)] = 1
        for h in n.hints:
            x[i, 8 + len(KINDS) + h] = 1
    return x


def labels_of(nodes: list[Node]) -> np.ndarray | None:
    """A node is content when most of its text is. Labels are those written in the page, or else follow from the one
    article that the page marks: what is in it counts, but for parts marked as something else. None: nothing is marked."""
    if any(n.label is not None for n in nodes):
        state = [False] * len(nodes)
        for i, n in enumerate(nodes):
            state[i] = n.label if n.label is not None else i > 0 and state[n.parent]
    else:
        marked = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
        if len(marked) != 1:
            return None
        state = [False] * len(nodes)
        for i, n in enumerate(nodes):
            away = n.tag in ("nav", "aside", "footer", "header", "form") or any(h < NOT_CONTENT for h in n.hints)
            state[i] = i == marked[0] or (i > 0 and state[n.parent] and not away)
    good = np.array([n.own * s for n, s in zip(nodes, state, strict=True)], float)
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    return np.array([2 * g > n.chars for g, n in zip(good, nodes, strict=True)])


@dataclass(frozen=True)
class TreeModel:
    """weights: of the node features. share: log potentials [child kind, parent state, child state]."""

    weights: tuple[float, ...]
    share: np.ndarray

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Content marginal of every node of a forest; parent is -1 at roots."""
        g = (x * np.array(self.weights)).sum(1)  # row by row, so that a node's score does not hang on its batch
        belief = np.stack([-np.logaddexp(0, g), -np.logaddexp(0, -g)], 1)
        sent = np.zeros_like(belief)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))
        for rows in levels[:0:-1]:  # upward: leaves first
            sent[rows] = np.logaddexp.reduce(belief[rows][:, None, :] + self.share[kinds[rows]], axis=2)
            np.add.at(belief, parent[rows], sent[rows])
        for rows in levels[1:]:  # downward: what the rest of the page says to each child
            above = belief[parent[rows]] - sent[rows]
            above -= above.max(1, keepdims=True)
            belief[rows] += np.logaddexp.reduce(above[:, :, None] + self.share[kinds[rows]], axis=1)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def fit_tree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, parent: np.ndarray, kinds: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> TreeModel:
    """Node scorer by Newton steps, parent-child potentials from counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    k = len(KINDS) + 1
    counts = np.ones((k, 2, 2)) + 4 * np.eye(2)
    inner = parent >= 0
    np.add.at(counts, (kinds[inner], y[parent[inner]].astype(int), y[inner].astype(int)), weight[inner])
    # The log odds ratio of agreeing, split evenly: a child without evidence of its own tells its parent nothing.
    pull = np.log(counts[:, 0, 0] * counts[:, 1, 1] / counts[:, 0, 1] / counts[:, 1, 0]) / 4
    return TreeModel(tuple(w.tolist()), pull[:, None, None] * (2 * np.eye(2) - 1))


def _example_pages() -> list[str]:
    """Pages written with labels: the parts that sites put around an article, in the ways they are marked."""
    line = "The river rose in the night, and by morning the old bridge stood under water for the first time in years. "
    article = [
        f"<h1>The old bridge</h1><p>{line * 3}</p><p>{line}</p><p>Short end.</p>",
        f"<h2>Under water</h2><p>{line * 2}</p><ul><li>{line}</li><li>{line}</li></ul><blockquote>{line}</blockquote><p>{line * 4}</p>",
        "<h1>Gone</h1><p>The bridge is gone</p>",
        "<h2>Bridge Bridge Bridge</h2><p>Bridge Bridge Bridge Bridge Bridge</p><p>Bridge</p>",
        f"<h1>What to bring</h1><p>Yes.</p><p>{line}</p><table><tr><td>boots</td><td>two pairs</td></tr></table><pre>{line}</pre><p>{line}</p>",
    ]
    around = [
        '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<div class="menu"><a href="/">Home</a> <a href="/a">About us</a></div>',
        '<header><h1>The Valley Post</h1><p>News since 1901</p></header>', '<div class="ad">Buy two pairs of boots, pay one.</div>',
        f'<div class="sponsored banner"><p>{line}</p></div>', '<aside><h3>Related</h3><ul><li><a href="/x">The new bridge</a></li></ul></aside>',
        f'<div id="sidebar"><h3>About</h3><p>{line}</p></div>', '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>OK</button></div>',
        '<form action="/s"><label>Search</label><input><button>Go</button></form>', '<div class="newsletter"><p>Subscribe to our letter.</p></div>',
        f'<section id="comments"><h3>2 comments</h3><div class="comment"><p>{line}</p></div><div class="comment"><p>Well said, thank you!</p></div></section>',
        f'<div class="comments"><ol><li><p>{line}</p></li><li><p>I was there. {line}</p></li></ol></div>',
        '<footer>&copy; The Valley Post. All rights reserved. <a href="/p">Privacy</a></footer>', '<div class="footer"><p>Contact and imprint</p></div>',
        '<div class="share social"><a href="/f">Share</a> <a href="/m">Mail</a></div>', '<div class="breadcrumb"><a href="/">Home</a> / News</div>',
    ]
    frames = ["<article{}>{}</article>", "<main{}>{}</main>", '<div class="post-content"{}>{}</div>', "<div{}>{}</div>", '<section class="entry"{}>{}</section>']
    pages = []
    for i in range(120):
        picked = [around[(i * 5 + 7 * j) % len(around)] for j in range(5)]
        body = frames[i % len(frames)].format(' data-content="1"', article[i % len(article)])
        inside = around[(3 * i + 9) % len(around)]
        off = re.sub(r"^<(\w+)", r'<\1 data-content="0"', inside)
        if i % 3 == 0:  # a part that is none of the article, inside it
            body = re.sub(r"(</\w+>)$", lambda m, off=off: off + m[1], body)
        pages.append(f'<html><body data-content="0">{"".join(picked[:2])}{body}{"".join(picked[2:])}</body></html>')
    return pages


def _forest(pages: list[list[Node]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, depths, kinds) of all pages, one below the other."""
    starts = np.cumsum([0, *map(len, pages)])
    parent = np.array([n.parent + s if n.parent >= 0 else -1 for nodes, s in zip(pages, starts, strict=False) for n in nodes], np.int64)
    depth = np.array([n.depth for nodes in pages for n in nodes], np.int64)
    kinds = np.array([kind(n.tag) for nodes in pages for n in nodes], np.int64)
    return np.concatenate([np.zeros((0, SIZE)), *map(node_features, pages)]), parent, depth, kinds


def train(pages: DataFrame, sample: int = 1000, seed: int = 42) -> TreeModel:
    """Fit on the pages kept here and on about sample of the given pages, twice as many at most, that mark their article."""
    share = min(1.0, sample / max(pages.count(), 1))
    chosen = pages.filter(F.pmod(F.xxhash64(F.lit(seed), "page_id"), F.lit(1 << 20)) < share * (1 << 20)).filter("html is not null")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes, _ = parse(page)
                y = labels_of(nodes)
                if y is not None:
                    x, parent, _, kinds = _forest([nodes])
                    yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (x, y, parent, kinds)], ["x", "y", "parent", "kinds"])

    rows = chosen.select("html").mapInArrow(run, "x binary, y binary, parent binary, kinds binary").limit(2 * sample).collect()
    parts = [(np.frombuffer(r["x"]).reshape(-1, SIZE), np.frombuffer(r["y"], bool), np.frombuffer(r["parent"], np.int64), np.frombuffer(r["kinds"], np.int64), 1.0) for r in rows]
    written = [parse(p)[0] for p in _example_pages()]
    worth = max(1.0, len(rows) / len(written))  # both groups count alike
    for nodes in written:
        x, parent, _, kinds = _forest([nodes])
        parts.append((x, labels_of(nodes), parent, kinds, worth))
    starts = np.cumsum([0, *(len(p[0]) for p in parts)])
    parent = np.concatenate([np.where(p[2] >= 0, p[2] + s, -1) for p, s in zip(parts, starts, strict=False)])
    x, y, kinds = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    return fit_tree(x, y, np.concatenate([np.full(len(p[0]), p[4]) for p in parts]), parent, kinds)


def texts(model: TreeModel, pages: list[str], limit: float = 0.5) -> list[str]:
    """Main texts of pages, all in one forest."""
    parsed = [parse(p) for p in pages]
    x, parent, depth, kinds = _forest([nodes for nodes, _ in parsed])
    content = model.marginals(x, parent, depth, kinds) >= limit
    out, start = [], 0
    for nodes, blocks in parsed:
        out.append("\n".join(b for n, b in blocks if content[start + n]))
        start += len(nodes)
    return out


def extracted(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text), one row per row of pages."""
    fields = ", ".join([*(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")), "text string"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = texts(model, [p or "" for p in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, fields)
