"""Main-text extraction: boosted trees over DOM nodes, decoded along the hierarchy."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from levelscan.llm.common import bounded_sample

SAMPLE_PAGES = 400   # pages that the trees are fitted on, at most
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32
_RUN = 256           # pages whose nodes are scored at once

# HTML's void elements, elements whose content isn't text, block elements, and those that close an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template svg math iframe object canvas head select textarea button".split())
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th thead tbody tfoot caption nav header footer aside form fieldset figure figcaption address details summary hr center".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of tags, classes, ids and roles that tell content or the page around it.
CONTENT_WORDS = frozenset("article main content post entry story body text".split())
AROUND_WORDS = frozenset("nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsor cookie consent notice alert popup modal comment comments reply replies disqus share social related recommended breadcrumb pagination widget subscribe newsletter signup login search form toolbar copyright".split())
TAGS = ("body", "article", "main", "section", "div", "p", "h", "list", "li", "nav", "header", "footer", "aside", "form", "table", "quote", "link", "inline")
_KIND = {"ul": "list", "ol": "list", "dl": "list", "blockquote": "quote", "pre": "quote", "a": "link", "html": "body", "td": "table", "tr": "table", "th": "table", "dt": "li", "dd": "li"} | {f"h{i}": "h" for i in range(1, 7)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math")}


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "own", "children", "order")

    def __init__(self, tag: str, parent: int, depth: int, words: frozenset, order: int):
        self.tag, self.parent, self.depth, self.words, self.order = tag, parent, depth, words, order
        self.own = 0
        self.children: list[int] = []


def parse(source: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order, and pieces (element, text); text None is the border of a block.

    Open elements end where HTML ends them: a block ends an open p, an item its like, an end tag all that is open in it; what is
    open at the end of the page ends there.  Content of scripts, styles, comments and the head is no text.
    """
    nodes = [Node("html", -1, 0, frozenset(), 0)]
    pieces: list[tuple[int, str | None]] = []
    stack = [0]
    hidden = 0
    at, end = 0, len(source)

    def text(until: int) -> None:
        if until > at and not hidden:
            said = source[at:until]
            pieces.append((stack[-1], html.unescape(said) if "&" in said else said))

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            hidden -= tag in OPAQUE
            if tag in BLOCKS:
                pieces.append((stack[-1], None))

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(end)
            break
        text(m.start())
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    close(i)
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in ("br", "wbr", "hr"):
                pieces.append((stack[-1], None if tag == "hr" else "\n" if tag == "br" else ""))
            if tag in VOID or tag == "html":
                continue
            if tag == "body":
                close(1)
            ends = SIBLINGS.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag in ends or (open_tag == "p" and tag in CLOSES_P):
                    close(i)
                    break
                if open_tag in ("ul", "ol", "dl", "table", "body", "article", "main", "section", "nav", "aside", "form", "div", "td", "th"):
                    break
            words = {tag}
            for a in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
                words.update(_WORD.findall((a[2] or a[3] or a[4] or "").lower()))
            node = len(nodes)
            nodes.append(Node(tag, stack[-1], len(stack), frozenset(words), node))
            nodes[stack[-1]].children.append(node)
            if tag in BLOCKS:
                pieces.append((stack[-1], None))
            if m[0].endswith("/>") and tag not in BLOCKS:
                continue
            stack.append(node)
            hidden += tag in OPAQUE
            if tag in _RAW:
                over = _RAW[tag].search(source, at)
                close(len(stack) - 1)
                at = over.end() if over else end
    return nodes, pieces


def features(nodes: list[Node], pieces: list[tuple[int, str | None]]) -> np.ndarray:
    """One row per element: subtree text and its density, links, depth, siblings, tag, attribute words."""
    n = len(nodes)
    text, link, marks, tags = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    for owner, said in pieces:
        if said:
            size = len(" ".join(said.split()))
            text[owner] += size
            marks[owner] += said.count(".") + said.count(",")
            if nodes[owner].tag == "a":
                link[owner] += size
    own = text.copy()
    parent = np.array([x.parent for x in nodes])
    for i in range(n - 1, 0, -1):  # children follow their parents
        p = parent[i]
        text[p] += text[i]
        link[p] += link[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
    whole = max(text[0], 1.0)
    parent[0] = 0
    children = np.array([len(x.children) for x in nodes], float)
    place = np.zeros(n)
    for x in nodes:
        for i, c in enumerate(x.children):
            place[c] = (i + 0.5) / len(x.children)
    content = np.array([len(x.words & CONTENT_WORDS) for x in nodes], float)
    around = np.array([len(x.words & AROUND_WORDS) for x in nodes], float)
    above = np.zeros((n, 2))
    for i in range(1, n):
        above[i] = above[parent[i]] + (content[i] > 0, around[i] > 0)
    kinds = [_KIND.get(x.tag, x.tag) for x in nodes]
    hot = np.zeros((n, len(TAGS)))
    for i, kind in enumerate(kinds):
        hot[i, TAGS.index(kind) if kind in TAGS else len(TAGS) - 1] = 1
    share = text / np.maximum(text[parent], 1)
    numbers = [np.log1p(text), np.log1p(own), text / tags, link / np.maximum(text, 1), marks / np.maximum(text, 1), text / whole, np.array([x.depth for x in nodes], float), children, children[parent], place, share, content, around, above[:, 0], above[:, 1], np.arange(n) / n]
    return np.column_stack([*numbers, hot])


def weak_labels(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """1 for elements that belong to the main text or hold it, by the page's own landmarks; what the trees learn to tell without them.

    Below an article or main element all is content but what is named as around it; on a page without one, elements of
    much text and few links are.  An element that holds content is 1 too.
    """
    n = len(nodes)
    landmark = [bool(v.words & {"article", "main"}) and not v.words & AROUND_WORDS for v in nodes]
    any_landmark = any(landmark)
    state, out = np.zeros(n, int), np.zeros(n)
    for i, v in enumerate(nodes):
        before = state[v.parent] if i else 0
        if before < 0 or v.words & AROUND_WORDS or v.tag in OPAQUE:
            state[i] = -1
        elif landmark[i]:
            state[i] = 1
        elif any_landmark:
            state[i] = before
        else:
            state[i] = 1 if before == 1 or (i and v.tag not in ("body", "html") and x[i, 0] > np.log1p(80) and x[i, 3] < 0.3) else 0
        out[i] = state[i] == 1
    for i in range(n - 1, 0, -1):
        if out[i] and state[nodes[i].parent] >= 0:
            out[nodes[i].parent] = 1
    return out


class BoostedTrees:
    """Gradient boosting of the logistic loss with complete trees over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)])
        rate = min(max(y.mean(), 0.01), 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        self.feature = np.zeros((TREES, 2**DEPTH - 1), int)
        self.cut = np.full((TREES, 2**DEPTH - 1), np.inf)
        self.value = np.zeros((TREES, 2**DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), int)
            for level in range(DEPTH):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                chosen = np.zeros((width, 2), int)
                total_g, total_h = np.bincount(node, gradient, width), np.bincount(node, curvature, width)
                whole = total_g**2 / (total_h + 1)
                for f in range(x.shape[1]):
                    bins = len(self.cuts[f]) + 1
                    if bins < 2:
                        continue
                    key = node * bins + binned[:, f]
                    g = np.bincount(key, gradient, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                    h = np.bincount(key, curvature, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                    gain = g**2 / (h + 1) + (total_g[:, None] - g)**2 / (total_h[:, None] - h + 1) - whole[:, None]
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    chosen[better] = np.column_stack([np.full(width, f), at])[better]
                for i in range(width):
                    if best[i] > 1e-9:
                        self.feature[t, first + i] = chosen[i, 0]
                        self.cut[t, first + i] = self.cuts[chosen[i, 0]][chosen[i, 1]]
                node = node * 2 + (x[np.arange(len(y)), self.feature[t, first + node]] >= self.cut[t, first + node])
            self.value[t] = RATE * np.bincount(node, gradient, 2**DEPTH) / (np.bincount(node, curvature, 2**DEPTH) + 1)
            score += self.value[t, node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for t in range(TREES):
            node = np.zeros(len(x), int)
            for level in range(DEPTH):
                first = 2**level - 1
                node = node * 2 + (x[row, self.feature[t, first + node]] >= self.cut[t, first + node])
            score += self.value[t, node]
        return score


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The most likely set of kept elements in which no kept element has a dropped ancestor.

    Bottom up, the gain of keeping an element is its log-odds plus the gains of those children that are better kept; top down,
    an element is kept if its parent is and its gain is positive.  The root is kept.
    """
    gain = log_odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
    return kept


def text_of(pieces: list[tuple[int, str | None]], kept: np.ndarray) -> str:
    """Blocks of kept elements in page order, white space inside a block as one space, joined by a line feed."""
    blocks, open_block = [], []
    for owner, said in pieces:
        if said is None:
            blocks.append(open_block)
            open_block = []
        elif kept[owner]:
            open_block.append(said)
    blocks.append(open_block)
    return "\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> BoostedTrees | None:
    """Trees fitted on a bounded sample of pages, drawn by a seeded key; None without a page."""
    rows = bounded_sample(pages.select("page_id", "html").where("html is not null"), sample, "page_id", "html").collect()
    xs, ys = [], []
    for r in rows:
        nodes, pieces = parse(r["html"])
        x = features(nodes, pieces)
        xs.append(x)
        ys.append(weak_labels(nodes, x))
    return BoostedTrees(np.concatenate(xs), np.concatenate(ys)) if xs else None


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty pages have no text and 0 characters; repeated rows are worked on each; no rows give no rows; other columns are
    ignored.  The whole page is parsed.  No shuffle.
    """
    model = fit(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            sources = batch.column(2)
            for at in range(0, len(sources), _RUN):
                parsed = [parse(s or "") for s in sources.slice(at, _RUN).to_pylist()]
                x = [features(*p) for p in parsed]
                odds = np.split(model.log_odds(np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1])
                texts.extend(text_of(p, decode(n, o)) for (n, p), o in zip(parsed, odds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    if model is None:
        return pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
