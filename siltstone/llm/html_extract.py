"""HTML extraction with a tree-structured graphical model over the DOM.

Every block element is a variable: content or not. Its own features give it a potential, and each edge to its parent has one
for the four pairs of values, by the kind of the child (text block, plain container, marked as content or as something else). Sum-product messages, first from the leaves up and then from the root down, give each element's
exact marginal; the text of elements whose marginal is one half or more is the page's main text. The weights maximise the
likelihood of labelled pages.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm import scan
from siltstone.llm.html_pages import labelled_pages
from siltstone.llm.html_tree import Page, kept_text, parse

TAGS = {t: i for i, names in enumerate(["article", "main", "nav menu", "header", "footer", "aside", "form fieldset input button select option textarea dialog", "script style noscript template iframe svg math object", "head title", "ul ol dl", "li dt dd", "p blockquote pre figcaption", "h1 h2 h3 h4 h5 h6", "table tbody thead tr td th", "div section", "#root html body"]) for t in names.split()}
OTHER_TAG = len(set(TAGS.values()))
#: Words in class, id and role, as groups with a weight each.
MARKS = [
    r"article|content|post-?body|entry|story|main|body-?text|articlebody|prose",
    r"nav|menu|breadcrumb|toolbar|pagination|pager|toc",
    r"header|masthead|topbar|banner|logo",
    r"footer|colophon|copyright|legal",
    r"sidebar|side-?bar|aside|widget|rail|related|recommend|more-?stories|complementary",
    r"notice|cookie|consent|gdpr|alert|popup|modal|overlay|disclaimer|paywall|message",
    r"\bads?\b|advert|sponsor|promo|banner-?ad|\bad-|-ad\b|affiliate|outbrain|taboola",
    r"form|login|sign-?up|newsletter|subscribe|search",
    r"comment|disqus|repl(?:y|ies)|discussion|respond|reviews?",
    r"share|social|follow|tags?\b|byline|author-?box|meta",
]
_MARKS = [re.compile(m) for m in MARKS]
FEATURES = OTHER_TAG + 1 + len(MARKS) + 9
#: Parts of ``FEATURES`` after tags and marks.
_REST = OTHER_TAG + 1 + len(MARKS)


@lru_cache(4096)
def _of_marks(marks: str) -> tuple[int, ...]:
    return tuple(OTHER_TAG + 1 + i for i, m in enumerate(_MARKS) if m.search(marks))


def features(page: Page) -> list[tuple[int, ...]]:
    """For each node the numbers of its features (all are 0 or 1)."""
    nodes = page.nodes
    chars, links = [n.chars for n in nodes], [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    out = []
    for i, n in enumerate(nodes):
        own = (TAGS.get(n.tag, OTHER_TAG),) + (_of_marks(n.marks) if n.marks else ())
        dense = links[i] > 0.5 * chars[i] > 0
        own += (_REST if n.chars > 80 else _REST + 1 if n.chars > 20 else _REST + 2 if n.chars else _REST + 3,)
        if dense:
            own += (_REST + 4,)
        elif links[i] > 0.2 * chars[i]:
            own += (_REST + 5,)
        if n.hidden:
            own += (_REST + 6,)
        own += (_REST + 7 if n.depth < 3 else _REST + 8,)
        out.append(own)
    return out


#: Kinds of children for edges: text blocks, plain containers, what is marked as something else, what is marked as content.
TEXT_TAGS = frozenset("p blockquote pre figcaption h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tr td th".split())
CONTAINER_TAGS, CONTENT_TAGS = frozenset(("div", "section")), frozenset(("article", "main"))
EDGES = 4


def edge_kinds(page: Page) -> list[int]:
    """For each node the kind of the edge to its parent."""
    out = []
    for n in page.nodes:
        marks = _of_marks(n.marks) if n.marks else ()
        told = any(m != OTHER_TAG + 1 for m in marks) or n.hidden
        good = n.tag in CONTENT_TAGS or bool(marks)
        out.append(2 if told else 3 if good else 0 if n.tag in TEXT_TAGS else 1 if n.tag in CONTAINER_TAGS else 2)
    return out


class TreeModel:
    """``unary``: weight of each feature for content; ``edge``: for each kind of child the log potentials of (parent value, own
    value) = 00, 01, 10, 11."""

    def __init__(self, unary: list[float], edge: list[list[float]]):
        self.unary, self.edge = unary, edge
        self._edge = [tuple(math.exp(x) for x in row) for row in edge]

    def marginals(self, page: Page, found: list[tuple[int, ...]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Each node's probability of being content, and the joint probabilities of (parent, own) = 00, 01, 10, 11."""
        nodes, unary = page.nodes, self.unary
        n = len(nodes)
        kinds = edge_kinds(page)
        own = [math.exp(max(-30.0, min(30.0, sum(unary[f] for f in fs)))) for fs in found]  # odds; value 0 has potential 1
        below0, below1 = [1.0] * n, own[:]  # own potential times the messages of the children
        sent0, sent1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b = below0[i], below1[i]
            e00, e01, e10, e11 = self._edge[kinds[i]]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            s = m0 + m1
            m0, m1 = m0 / s, m1 / s
            sent0[i], sent1[i] = m0, m1
            p = nodes[i].parent
            x, y = below0[p] * m0, below1[p] * m1
            s = x + y
            below0[p], below1[p] = x / s, y / s
        prob = [0.0] * n
        joint = [(0.0, 0.0, 0.0, 0.0)] * n
        prob[0] = below1[0] / (below0[0] + below1[0])
        for i in range(1, n):
            q = prob[nodes[i].parent]
            # What the parent believes without this child, then across the edge, times what is below.
            up0, up1 = (1 - q) / sent0[i], q / sent1[i]
            a, b = below0[i], below1[i]
            e00, e01, e10, e11 = self._edge[kinds[i]]
            j00, j01, j10, j11 = up0 * e00 * a, up0 * e01 * b, up1 * e10 * a, up1 * e11 * b
            s = j00 + j01 + j10 + j11
            joint[i] = (j00 / s, j01 / s, j10 / s, j11 / s)
            prob[i] = (j01 + j11) / s
        return prob, joint


def fit(pages: list[tuple[str, list[int]]], *, steps: int = 90, rate: float = 0.15, decay: float = 2e-4) -> TreeModel:
    """Maximum likelihood by Adam; ``pages`` are (html, label of each node)."""
    ready = []
    for text, labels in pages:
        page = parse(text)
        assert len(page.nodes) == len(labels), "labels don't fit the page's nodes"
        ready.append((page, features(page), edge_kinds(page), labels))
    total = sum(len(labels) for *_, labels in ready)
    theta = np.zeros(FEATURES + 4 * EDGES)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)

    def model() -> TreeModel:
        return TreeModel(theta[:FEATURES].tolist(), theta[FEATURES:].reshape(EDGES, 4).tolist())

    for step in range(1, steps + 1):
        now, grad = model(), [0.0] * len(theta)
        for page, found, kinds, labels in ready:
            prob, joint = now.marginals(page, found)
            for i, fs in enumerate(found):
                d = labels[i] - prob[i]
                for f in fs:
                    grad[f] += d
                if i:
                    at = FEATURES + 4 * kinds[i]
                    grad[at + 2 * labels[page.nodes[i].parent] + labels[i]] += 1
                    for k, q in enumerate(joint[i]):
                        grad[at + k] -= q
        slope = np.array(grad) / total - decay * theta
        moment = 0.9 * moment + 0.1 * slope
        square = 0.95 * square + 0.05 * slope**2
        theta = theta + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
    return model()


@lru_cache(1)
def default_model() -> TreeModel:
    """Fitted on the built-in labelled pages."""
    return fit(labelled_pages())


def extract(text: str, model: TreeModel) -> str:
    """The main text of one page; empty for an empty page or one without content."""
    if not text:
        return ""
    page = parse(text)
    prob, _ = model.marginals(page, features(page))
    return kept_text(page, [p >= 0.5 for p in prob])


def extract_pages(pages: DataFrame, *, html_col: str = "html", text_col: str = "main_text", keep_html: bool = False, model: TreeModel | None = None) -> DataFrame:
    """``pages`` with the main text added as ``text_col``, a column so called replaced.

    Null and empty pages have an empty text, as have pages of which nothing is content. Text without any markup is content
    where it reads like a paragraph. Repeated rows get equal texts; nothing is shuffled; an empty table gives an empty result.
    """
    model = model or default_model()

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([extract(t, model) for t in scan.as_text(column)], pa.string())]

    return scan.add_columns(pages, [html_col], make, f"`{text_col}` string", drop=() if keep_html else (html_col,), rows=256)
