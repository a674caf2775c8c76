"""Labelled pages to train the extraction of main text: random layouts with known blocks."""

from __future__ import annotations

import random

_SYLLABLES = "an er in on re ti la de mo su ka vi no lo pa sch ei ou que ción ment".split()

# Containers by what they hold, as common page templates name them.
_ARTICLE = (
    "article", "main", "div class=content", "div id=main-content", "div class=post",
    "div class=entry-content", "section class=article-body", "div class=story", "div id=article",
    "div",
)
_OTHERS = {
    "menu": ("nav", "ul class=menu", "div class=navbar", "div id=navigation", "div class=breadcrumbs", "menu"),
    "header": ("header", "div id=header", "div class=masthead", "div class=top-bar"),
    "footer": ("footer", "div id=footer", "div class=site-footer", "div class=copyright"),
    "side": ("aside", "div class=sidebar", "div id=sidebar", "section class=related", "div class=widget"),
    "notice": ("div class=notice", "div class=cookie-banner", "div class=alert", "div role=alert",
               "div id=cookie-consent", "p class=disclaimer", "dialog"),
    "advert": ("div class=ad", "div class=advert", "div class=ads", "div class=sponsored",
               "aside class=promo", "div id=ad-banner", "div class=advertisement"),
    "form": ("form", "form class=newsletter", "form class=search", "div class=subscribe", "fieldset"),
    "comments": ("section id=comments", "div class=comments", "ol class=comment-list",
                 "div class=comment", "section class=reader-comments", "div id=respond"),
    "share": ("div class=share", "ul class=social", "div class=tags"),
}


class _Page:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.table = seed % 8 == 7
        self.parts: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.random
        word = lambda: "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
        text = " ".join(word() for _ in range(r.randint(low, high)))
        return text.capitalize()

    def sentences(self, low: int, high: int) -> str:
        if self.table:  # the rows of a table as text
            low, high = 2 * low, 3 * high
            return " | ".join(self.words(1, 3) for _ in range(self.random.randint(low, high)))
        return " ".join(self.words(2, 18) + "." for _ in range(self.random.randint(low, high)))

    def add(self, label: int, tag: str, text: str) -> None:
        name = tag.split()[0]
        close = "" if name in ("p", "li") and self.random.random() < 0.2 else f"</{name}>"
        self.parts.append(f"<{tag}>{text}{close}")
        self.labels.append(label)

    def linked(self, low: int, high: int) -> str:
        return f'<a href="/x">{self.words(low, high)}</a>'

    def other(self, kind: str) -> None:
        r, tag = self.random, self.random.choice(_OTHERS[kind])
        self.parts.append(f"<{tag}>")
        if kind == "menu" or kind in ("share", "side") and r.random() < 0.6:
            self.parts.append("<ul>")
            for _ in range(r.randint(2, 7)):
                self.add(0, "li", self.linked(1, 4))
            self.parts.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.add(0, r.choice(("label", "p", "button", "div")), self.words(1, 8))
        elif kind == "comments":
            for _ in range(r.randint(1, 4)):
                if r.random() < 0.5:
                    self.add(0, r.choice(("h3", "div", "p")), self.words(1, 4))
                self.add(0, r.choice(("p", "li", "div")), self.sentences(1, 5))
        elif kind == "footer" and r.random() < 0.5:
            self.parts.append("&copy; " + self.sentences(1, 2))
            self.labels.append(0)
        elif r.random() < 0.5:
            self.parts.append(self.sentences(1, 3))
            self.labels.append(0)
        else:
            for _ in range(r.randint(1, 3)):
                self.add(0, r.choice(("p", "div", "h3")), self.sentences(1, 3))
        self.parts.append(f"</{tag.split()[0]}>")

    def article(self) -> None:
        r = self.random
        outer = r.sample(_ARTICLE, r.choice((1, 1, 2)))
        self.parts.extend(f"<{tag}>" for tag in outer)
        if r.random() < 0.8:
            self.add(1, "h1", self.words(1, 12))
        for _ in range(r.choice((0, 1, 2, 4, 8, 16))):
            kind = r.random()
            if kind < 0.72:
                self.add(1, "p", self.sentences(1, r.choice((1, 3, 8))))
            elif kind < 0.78:
                self.add(1, r.choice(("h2", "h3")), self.words(1, 8))
            elif kind < 0.82:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.add(1, "li", self.sentences(1, 2))
                self.parts.append("</ul>")
            elif kind < 0.88:
                self.add(1, r.choice(("blockquote", "pre", "figcaption", "td")), self.sentences(1, 2))
            elif kind < 0.92:
                self.add(1, "p", "<b>" + self.words(1, 12) + "." + r.choice(("</b>", "<br>")))
            else:
                self.other(r.choice(("advert", "side", "share", "menu", "notice", "form")))
        if r.random() < 0.15:
            self.other("comments")
        self.parts.extend(f"</{tag.split()[0]}>" for tag in reversed(outer))

    def bare(self) -> None:
        """An article with nothing around it, often of a single paragraph."""
        r = self.random
        tag = r.choice(_ARTICLE)
        self.parts.append(f"<{tag}>")
        for _ in range(r.choice((1, 1, 2, 4))):
            attributes = r.choice(("", "", ' title="a > b"', " class=text"))
            self.add(1, r.choice(("p", "p", "p", "h1", "div")) + attributes, self.sentences(1, 3))
        self.parts.append(f"</{tag.split()[0]}>" * (r.random() < 0.8))


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page and, for each of its leaf blocks, whether it belongs to the main text."""
    page = _Page(seed)
    r = page.random
    page.parts.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    wrapped = r.random() < 0.4
    page.parts.append("<div id=page>" * wrapped)
    for kind in ("header", "menu", "notice", "advert", "side"):
        if r.random() < 0.5:
            page.other(kind)
    page.article()
    for kind in ("share", "side", "advert", "comments", "form", "notice", "menu", "footer"):
        if r.random() < (0.8 if kind == "footer" else 0.35):
            page.other(kind)
    page.parts.append("</div>" * wrapped + "</body></html>")
    return "".join(page.parts), page.labels


def bare_page(seed: int) -> tuple[str, list[int]]:
    """An article that stands alone, and its labels."""
    page = _Page(seed)
    page.bare()
    return "".join(page.parts), page.labels
