"""HTML to leaf blocks: the runs of text between block boundaries, with their open ancestors.

A forgiving scanner: unclosed and misnested tags, stray ends and cut-off pages
are read as browsers do in the respects that matter here.  Scripts, styles,
templates and comments have no text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that never have content, whose content is no text, and that do not end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An element of the first kind is ended by the start of one that follows in its set.
IMPLIED = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Element:
    tag: str
    marks: tuple[str, ...]  # words of class, id and role


@dataclass
class Block:
    """A leaf block: its text, its ancestors from the outside in, and how many of its characters are in links."""

    text: str
    path: tuple[Element, ...]
    linked: int


def _element(tag: str, rest: str) -> Element:
    if not rest or "=" not in rest:
        return Element(tag, ())
    marks = [w for m in _ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id", "role", "itemprop") for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return Element(tag, tuple(dict.fromkeys(marks)))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; white space is one space, and blocks without other text are left out."""
    out: list[Block] = []
    stack: list[Element] = []
    text: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, tuple(e for e in stack if e.tag not in INLINE), linked))
        text.clear()
        linked = 0

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
                linked += len(m[0]) if links else 0
            continue
        tag = name.lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    links = 0
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            flush()
            if depth is not None:
                del stack[depth:]
            continue
        if tag in RAW:
            if tag not in ("select", "title"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            else:
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in INLINE:
            links = 1 if tag == "a" else links
            continue
        flush()
        while stack and tag in IMPLIED.get(stack[-1].tag, ()):
            stack.pop()
        links = 0
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(_element(tag, m[3]))
    flush()
    return out
