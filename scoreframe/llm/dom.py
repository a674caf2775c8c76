"""Leaf blocks of HTML pages with the tags above them, in one linear pass."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attributes>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"|</?(?P<odd>[a-zA-Z][^\s/<>]*+)[^<>]*+>"
    r"|<[!?/][^<>]*>"
    r"|</?[a-zA-Z][^<>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot "
    "th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN = {
    tag: re.compile(rf"</{tag}\b[^>]*>", re.I)
    for tag in ("script", "style", "template", "title", "noscript", "iframe", "svg")
}
# A start tag of the left ends an open element of the right, up to the element named last.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_ENDS_PARAGRAPH = BLOCKS - {"button", "label", "select", "option", "optgroup", "textarea"}


@dataclass(slots=True)
class Block:
    """A run of text without a block tag inside, white space collapsed."""

    text: str
    above: frozenset[str]
    parent: str
    linked: int


def _marks(tag: str, attributes: str) -> set[str]:
    found = {f"<{tag}>"}
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = _CAMEL.sub(" ", "".join(values)).lower()
        found.update(f"{name.lower()}={part}" for part in _PART.findall(value))
    return found


def blocks(page: str) -> Iterator[Block]:
    """The leaf blocks of a page in order; unclosed and stray tags are put up with."""
    nothing: frozenset[str] = frozenset()
    stack: list[tuple[str, frozenset[str]]] = []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def pop_to(place: int) -> None:
        while len(stack) > place:
            open_tags[stack.pop()[0]] -= 1

    def last(names: tuple[str, ...], stop: tuple[str, ...]) -> int:
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in names:
                return place
            if stack[place][0] in stop:
                break
        return -1

    def flush() -> Iterator[Block]:
        nonlocal linked
        if text:
            whole = "".join(text)
            whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if whole:
                holder = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
                yield Block(whole, stack[-1][1] if stack else nothing, holder, linked)
            text.clear()
        linked = 0

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            text.append(piece)
            if open_tags["a"] > 0:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or found["odd"] or "").lower()
        if not tag:
            continue
        if found["end"] or found[0].startswith("</"):
            if tag in BLOCKS:
                yield from flush()
            if open_tags[tag] > 0:
                pop_to(last((tag,), ()))
            continue
        if tag in UNSEEN:
            if not found[0].endswith("/>"):
                end = UNSEEN[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            yield from flush()
        elif tag in ("br", "img", "input"):
            text.append(" ")
        if tag in _ENDS_PARAGRAPH and open_tags["p"] > 0:
            pop_to(last(("p",), ()))
        names, stop = _CLOSES.get(tag, ((), ()))
        if any(open_tags[name] > 0 for name in names):
            place = last(names, stop)
            if place >= 0:
                pop_to(place)
        if tag not in VOID and not found[0].endswith("/>"):
            above = stack[-1][1] if stack else nothing
            own = _marks(tag, found["attributes"] or "")
            stack.append((tag, above if own <= above else above | own))
            open_tags[tag] += 1
    yield from flush()
