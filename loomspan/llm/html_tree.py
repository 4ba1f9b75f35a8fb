"""Pages as trees of blocks: a tolerant reader of html that keeps what block structure and text need."""

from __future__ import annotations

import html
import re
from functools import lru_cache

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Fixed values of html: elements without an end, elements whose text isn't markup, elements that don't break a line of
#: text, elements whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul body".split())

#: Start of an element -> open elements that it ends, and the elements past which it doesn't look.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}


class Block:
    """A block element: its tag, attributes, parent (an index), and what hangs on it in page order."""

    __slots__ = ("chars", "link_chars", "marks", "parent", "tag")

    def __init__(self, tag: str, marks: str, parent: int):
        self.tag, self.marks, self.parent, self.chars, self.link_chars = tag, marks, parent, 0, 0


@lru_cache(4096)
def marks_of(raw: str) -> tuple[str, str | None]:
    """The names that an element goes by (class, id, role, hidden), and its training label if it has one."""
    found, label = [], None
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            found.append((a or b or c).lower())
        elif name in ("hidden", "aria-hidden") and (a or b or c).lower() != "false":
            found.append("hidden")
        elif name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            found.append("hidden")
        elif name == "data-content":
            label = a or b or c
    return " ".join(found), label


def blocks(page: str | None) -> tuple[list[Block], list[tuple[int, str]], list[str | None]]:
    """The block elements of a page (the first is the page itself, parents before children), its runs of text as (block,
    text) in page order, and the blocks' training labels. White space in a run is one space; references are decoded;
    comments, scripts, styles and markup have no text."""
    nodes, labels = [Block("#page", "", -1)], [None]
    runs: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = [("#page", 0)]  # inline elements stay on the stack with their block's index
    held: list[str] = []
    links = 0  # depth in links
    at, size = 0, len(page or "")

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                runs.append((open_[-1][1], text))

    def leave(k: int) -> None:
        nonlocal links
        while len(open_) > k:
            links -= open_.pop()[0] == "a"

    def close(names: tuple[str, ...], past: tuple[str, ...]) -> None:
        k = len(open_) - 1
        while k > 0 and open_[k][0] not in past:
            if open_[k][0] in names:
                flush()
                leave(k)
            k -= 1

    match = _TOKEN.match
    while at < size and (m := match(page, at)) is not None:
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                held.append(text)
                node = nodes[open_[-1][1]]
                n = len(text.strip())
                node.chars += n
                if links:
                    node.link_chars += n
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            inline = tag in INLINE
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    if not inline:
                        flush()
                    leave(k)
                    break
                if inline and open_[k][0] not in INLINE:
                    break  # an inline end doesn't close a block
            continue
        raw = (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                links += tag == "a"
                open_.append((tag, open_[-1][1]))
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "li", "div", "article", "section", "aside", "blockquote", "button", "#page"))
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in VOID:
            continue
        while open_[-1][0] in INLINE:  # an inline element that is left open doesn't reach into the next block
            leave(len(open_) - 1)
        marks, label = marks_of(raw) if raw.strip() else ("", None)
        nodes.append(Block(tag, marks, open_[-1][1]))
        labels.append(label)
        open_.append((tag, len(nodes) - 1))
    flush()
    return nodes, runs, labels
