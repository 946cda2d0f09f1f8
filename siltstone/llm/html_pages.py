"""Labelled pages for fitting the HTML model: varied invented layouts in which every element's label is known.

A page is written from a small tree; the label of an element (content or not) is set where it is made. The reader's nodes and
the written elements are the same, in the same order, as only block elements and marked inline ones are written as elements.
"""

from __future__ import annotations

import random

_SYLLABLES = "ta ne ri mo lu ke sa vo di pa no te ra mi lo ku se va do pi".split()
_INSIDE = ["article", "content", "post-body", "entry-content", "story", "main-content", "article-body", "body-text"]
_OUTSIDE = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination"],
    "header": ["header", "masthead", "topbar", "site-header", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal"],
    "aside": ["sidebar", "widget", "related", "right-rail", "recommended", "side"],
    "notice": ["notice", "cookie-banner", "consent", "alert", "popup", "gdpr", "disclaimer"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"],
    "form": ["form", "login", "newsletter", "subscribe", "search-box", "signup"],
    "comments": ["comments", "comment-list", "replies", "discussion", "comment"],
    "share": ["share", "social", "share-buttons", "tags"],
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], [0]

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize() + self.rng.choice([".", ".", ".", "", "!"])

    def open(self, tag: str, label: int, marks: str = "") -> None:
        self.labels.append(label)
        attribute = self.rng.choice(["class", "class", "id"])
        self.out.append(f'<{tag} {attribute}="{marks}">' if marks else f"<{tag}>")

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, label: int, text: str, marks: str = "") -> None:
        self.open(tag, label, marks)
        self.out.append(text)
        self.close(tag)

    def raw(self, tag: str) -> None:
        self.leaf(tag, 0, "x.y{z:0}" * self.rng.randint(1, 30))

    def links(self, n: int, label: int = 0) -> None:
        self.open("ul", label)
        for _ in range(n):
            self.leaf("li", label, f'<a href="/{self.word()}">{self.words(1, 3)}</a>')
        self.close("ul")

    def outside(self, kind: str) -> None:
        """A part of the page that is not content."""
        rng = self.rng
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = semantic[kind] if kind in semantic and rng.random() < 0.6 else rng.choice(["div", "div", "section"])
        marks = "" if tag == semantic.get(kind) and rng.random() < 0.5 else rng.choice(_OUTSIDE[kind])
        self.open(tag, 0, marks)
        shape = rng.random()
        if kind == "nav" or (kind in ("aside", "footer", "header") and shape < 0.4):
            if kind == "header":
                self.leaf("h1", 0, self.words(1, 4))
            self.links(rng.randint(2, 7))
        elif kind == "form":
            self.leaf("p", 0, self.words(3, 12))
            self.leaf("button", 0, self.words(1, 2))
        elif kind == "comments":
            self.leaf("h3", 0, self.words(1, 3))
            for _ in range(rng.randint(1, 5)):
                self.open("div", 0, rng.choice(["", "comment", "reply"]))
                self.leaf("p", 0, self.words(4, 50))
                self.close("div")
        elif shape < 0.65:
            self.out.append(self.words(2, 40))
        else:
            if rng.random() < 0.3:
                self.leaf(rng.choice(["h2", "h3", "h4"]), 0, self.words(1, 5))
            for _ in range(rng.randint(1, 2)):
                self.leaf("p", 0, self.words(2, 40))
        self.close(tag)

    def inside(self) -> None:
        """A block of the article."""
        rng = self.rng
        kind = rng.random()
        if kind < 0.7:
            text = self.words(1, 90)
            if rng.random() < 0.2:
                text = f"<b>{text}<br>" if rng.random() < 0.5 else f'{text} <a href="/{self.word()}">{self.word()}</a> {self.words(2, 9)}'
            self.leaf("p", 1, text)
        elif kind < 0.8:
            self.leaf(rng.choice(["h2", "h3", "h4"]), 1, self.words(1, 8))
        elif kind < 0.86:
            self.open("blockquote", 1)
            self.leaf("p", 1, self.words(5, 40))
            self.close("blockquote")
        elif kind < 0.92:
            self.open("ul", 1)
            for _ in range(rng.randint(2, 5)):
                self.leaf("li", 1, self.words(2, 20))
            self.close("ul")
        elif kind < 0.95:
            self.leaf("pre", 1, self.words(3, 20))
        elif kind < 0.97:
            self.open("table", 1)
            for _ in range(2):
                self.open("tr", 1)
                self.leaf("td", 1, self.words(1, 4))
                self.leaf("td", 1, self.words(1, 4))
                self.close("tr")
            self.close("table")
        else:
            self.open("div", 1)
            self.leaf("p", 1, self.words(5, 60))
            self.close("div")

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        self.out.append("<!DOCTYPE html>")
        self.open("html", 0)
        self.open("head", 0)
        self.leaf("title", 0, self.words(2, 8))
        for tag in ("style", "script"):
            if rng.random() < 0.7:
                self.raw(tag)
        self.close("head")
        self.open("body", 0)
        wrapped = rng.random() < 0.3
        if wrapped:
            self.open("div", 0, rng.choice(["", "wrapper", "page", "container"]))
        before = [k for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
        rng.shuffle(before)
        for kind in before:
            self.outside(kind)
        shape = rng.random()
        tag, marks = ("article", "") if shape < 0.5 else ("main", "") if shape < 0.65 else (rng.choice(["div", "section", "article"]), rng.choice(_INSIDE)) if shape < 0.92 else ("", "")
        outer = tag == "article" and rng.random() < 0.25
        if outer:
            self.open("main", 1)
        if tag:
            self.open(tag, 1, marks)
        if rng.random() < 0.8:
            self.leaf("h1", 1, self.words(1, 10))
        terse = bool(tag) and rng.random() < 0.25  # a poem, a transcript, a list of lines
        for _ in range(rng.randint(10, 50) if terse else rng.randint(1, 12)):
            if terse and rng.random() < 0.9:
                self.leaf("p", 1, self.words(1, 3))
            else:
                self.inside()
            if rng.random() < 0.08:
                self.outside(rng.choice(["ad", "aside", "form", "share", "notice", "nav"]))
        if tag and rng.random() < 0.15:
            self.outside(rng.choice(["comments", "share", "footer"]))
        if tag:
            self.close(tag)
        if outer:
            self.close("main")
        after = [k for k in ("aside", "comments", "share", "ad", "footer", "notice", "form") if rng.random() < 0.4]
        for kind in after:
            self.outside(kind)
        if rng.random() < 0.5:
            self.raw("script")
        if wrapped:
            self.close("div")
        self.close("body")
        self.close("html")
        return "".join(self.out), self.labels


def labelled_pages(n: int = 240, seed: int = 17) -> list[tuple[str, list[int]]]:
    """``n`` pages with a label for each of the reader's nodes."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]
