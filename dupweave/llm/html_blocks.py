"""Leaf blocks of HTML pages: a lenient scan that keeps the open elements on a stack.

Time and memory are linear in the page: elements are linked to their parents and never copied, and where an element of
some name is open is known without a search.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^"'>])*)>|</?[a-zA-Z][^>]*>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]+")

#: Fixed values of the HTML standard.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mfenced mstyle mpadded menclose semantics annotation svg g text tspan path circle ellipse line rect polygon polyline defs use".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BARRIERS = {"article", "aside", "body", "button", "div", "footer", "form", "header", "main", "nav", "section", "table", "td", "th", "ul", "ol", "li", "dl", "blockquote"}


@dataclass(slots=True)
class Element:
    """An open element. `own`: the features of its tag, class and id that no element around it has."""

    tag: str
    features: tuple[str, ...]
    own: list[str]
    parent: Element | None
    score: tuple[float, float] | None = None


@dataclass(slots=True)
class Block:
    """A leaf block: its text with single spaces, the innermost element, and how much of the text is in links."""

    text: str
    element: Element | None
    linked: int

    def path(self) -> list[Element]:
        """The open elements, innermost first."""
        out, e = [], self.element
        while e is not None:
            out.append(e)
            e = e.parent
        return out


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of `page` in order. Unclosed and misnested elements are closed as browsers do, roughly."""
    stack: list[Element] = []
    places: defaultdict[str, list[int]] = defaultdict(list)
    present: defaultdict[str, int] = defaultdict(int)
    blocks: list[Block] = []
    text: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(joined, stack[-1] if stack else None, linked))
            text.clear()
        linked = 0

    def close_from(place: int) -> None:
        while len(stack) > place:
            e = stack.pop()
            places[e.tag].pop()
            for f in e.features:
                present[f] -= 1

    def open_element(tag: str, attributes: str) -> None:
        parts = {p for a in ATTRIBUTE.finditer(attributes) for p in PART.findall((a[2] or a[3] or a[4] or "").lower())} if attributes else ()
        found = (f"t:{tag}", *(f"n:{p}" for p in sorted(parts)))
        own = [f for f in found if not present[f]]
        for f in found:
            present[f] += 1
        places[tag].append(len(stack))
        stack.append(Element(tag, found, own, stack[-1] if stack else None))

    at, end, lower = 0, len(page), None
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                plain = html.unescape(token) if "&" in token else token
                text.append(plain)
                linked += len(plain.strip()) if places["a"] else 0
            elif token.startswith("<![CDATA["):
                text.append(token[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in ("br", "hr"):
            text.append(" ")
            if name == "br":
                continue
        block = name not in INLINE
        if m.group(1):
            if block:
                end_block()
            if places[name]:
                close_from(places[name][-1])
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            close = lower.find(f"</{name}", at)
            at = end if close < 0 else (page.find(">", close) + 1 or end)
            continue
        if block:
            end_block()
        closes = CLOSES.get(name, ())
        if any(places[t] for t in closes):
            barrier = max((places[t][-1] for t in SCOPE.get(name, BARRIERS) if places[t]), default=-1)
            inside = [places[t][k] for t in closes if (k := bisect_right(places[t], barrier)) < len(places[t])]
            if inside:
                close_from(min(inside))
        if name not in VOID and not m.group(3).endswith("/"):
            open_element(name, m.group(3))
    end_block()
    return blocks


def path_features(b: Block) -> list[str]:
    return [f for e in b.path() for f in e.own] + [last_feature(b), "bias"]


def last_feature(b: Block) -> str:
    return f"last:{b.element.tag if b.element else ''}"


def text_features(b: Block, place: str) -> list[str]:
    text = b.text
    size = min((text.count(" ") + 1).bit_length(), 8)
    return [
        f"words:{size}",
        f"links:{round(b.linked / len(text) * 4)}",
        f"ends:{text[-1] in '.!?:'}",
        f"stops:{min(text.count('. ') + text.count(', '), 3)}",
        f"mark:{'©' in text}:{min(size, 4)}",
        place,
    ]


def places(n: int) -> list[str]:
    return ["place:first", *["place:mid"] * (n - 2), "place:last"][:n]


def features(blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block."""
    return [path_features(b) + text_features(b, place) for b, place in zip(blocks, places(len(blocks)), strict=True)]
