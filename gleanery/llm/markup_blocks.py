"""Leaf blocks of a page: text between block-level tags, with the path of open elements.

Unclosed paragraphs, list items and cells end where the next one begins. Scripts, styles,
templates and comments have no text; `<svg/>` is empty. Inline tags do not end a block,
`br` is white space; a custom element (with a hyphen) ends a block but not its paragraph.
Each expression reads on without going back, so a page costs linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Elements inside a line of text, without an end tag, and without text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr input link meta param source track".split())
# An opening tag of the left ends an open element of the right, up to the elements named last.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: float


def names_of(rest: str) -> list[str]:
    """Words of class, id and role attributes, each after a point."""
    if "=" not in rest:
        return []
    found = " ".join("".join(m) for m in _NAMES.findall(rest)).lower()
    return ["." + w for w in _WORD.findall(found)]


def leaves(html: str) -> list[Leaf]:
    """All blocks with text, in page order. White space inside is one space, references
    are decoded; `linked` is the share of characters inside links."""
    found: list[Leaf] = []
    stack: list[tuple[str, list[str]]] = []
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            path = tuple(name for tag, names in stack for name in (tag, *names))
            found.append(Leaf(path, text, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    def take(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            linked += len(text) if in_link else 0

    def close(tags, until=()):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    for match in _MARKUP.finditer(html):
        take(html[at : match.start()])
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        elif tag in INLINE:
            in_link = not match["end"] if tag == "a" else in_link
        else:
            flush()
            if tag in VOID:
                continue
            if match["end"]:
                in_link = False
                close((tag,))
                continue
            if tag in ENDS:
                close(*ENDS[tag])
            if stack and stack[-1][0] == "p" and "-" not in tag:
                stack.pop()
            stack.append((tag, names_of(match["rest"])))
    take(html[at:])
    flush()
    return found
