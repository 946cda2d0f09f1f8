"""A forgiving HTML reader: a flat tree of block elements with the text pieces that each holds directly."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--(.*?)(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup: everything up to the end tag is one piece of text.
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag closes an open element of these names first, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Block elements end an open paragraph.
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    marks: str = ""  # class, id and role, lower-cased
    hidden: bool = False
    chars: int = 0  # of direct text
    links: int = 0  # of these inside <a>
    pieces: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    pieces: list[tuple[int, str]]  # (node, text) in page order; "\n" pieces separate blocks


def parse(text: str) -> Page:
    """The page's block elements and inline ones that have a class, an id or a role; the root is node 0. Unclosed elements,
    stray end tags, a cut-off tag or comment at the end and unknown elements are all fine."""
    nodes = [Node("#root", -1, 0)]
    pieces: list[tuple[int, str]] = []
    open_tags: list[tuple[str, int]] = [("#root", 0)]  # (tag, its node or that of the block around it)
    in_link = 0
    at, size = 0, len(text)

    def say(raw: str) -> None:
        if not raw:
            return
        said = html.unescape(raw) if "&" in raw else raw
        node = open_tags[-1][1]
        pieces.append((node, said))
        n = len(said) if not said.isspace() else 0
        nodes[node].chars += n
        if in_link:
            nodes[node].links += n

    def close_to(depth: int) -> None:
        nonlocal in_link
        for tag, _ in open_tags[depth:]:
            in_link -= tag == "a"
            if tag not in INLINE:
                pieces.append((-1, "\n"))
        del open_tags[depth:]

    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            say(text[at:])
            break
        token = TOKEN.match(text, lt)
        if token is None:  # a "<" that starts no tag is text
            say(text[at : lt + 1])
            at = lt + 1
            continue
        say(text[at:lt])
        at = token.end()
        tag = token[3]
        if tag is None or not token[5]:  # comment, doctype, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if token[2]:
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth][0] == tag:
                    close_to(depth)
                    break
            continue
        if tag in ENDS_P:
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth][0] == "p":
                    close_to(depth)
                    break
                if open_tags[depth][0] not in INLINE:
                    break
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth][0] in bounds:
                    break
                if open_tags[depth][0] in names:
                    close_to(depth)
                    if tag != "tr":
                        break
        if tag in VOID:
            if tag not in INLINE:
                pieces.append((-1, "\n"))
            continue
        attributes = token[4]
        marks, hidden = "", False
        if attributes and not attributes.isspace():
            named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            marks = " ".join(named[k] for k in ("class", "id", "role", "itemprop") if k in named).lower()
            hidden = "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower() or named.get("aria-hidden") == "true"
        around = open_tags[-1][1]
        inline = tag in INLINE
        if not inline:
            pieces.append((-1, "\n"))
        if not inline or marks or hidden:
            nodes.append(Node(tag, around, nodes[around].depth + 1, marks, hidden))
            around = len(nodes) - 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
            stop = end.start() if end else size
            nodes[around].chars += stop - at
            at = end.end() if end else size
            continue
        if attributes.rstrip().endswith("/") and tag not in ENDS_P and inline:
            continue
        open_tags.append((tag, around))
        in_link += tag == "a"
    return Page(nodes, pieces)


def kept_text(page: Page, keep: list[bool]) -> str:
    """The text of the kept nodes: white space inside a block is one space, blocks are joined by one space."""
    return " ".join("".join(t if node < 0 or keep[node] else "" for node, t in page.pieces).split())
