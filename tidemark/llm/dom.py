"""A small HTML tree: enough of the parsing rules to find elements, their styles and their blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea select title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TEXT_ONLY = frozenset("script style textarea title".split())


@dataclass
class Node:
    tag: str
    names: frozenset[str]
    path: int
    above: tuple[int, ...]
    parent: int
    children: list[str] = field(default_factory=list)
    href: str = ""


#: Path hashes met before in this process; emptied when large.
_paths: dict[tuple[int, str], int] = {}


def path_of(parent: int, style: str) -> int:
    known = _paths.get((parent, style))
    if known is None:
        if len(_paths) > 200_000:
            _paths.clear()
        known = _paths[parent, style] = xxhash.xxh64_intdigest(f"{parent}/{style}") - (1 << 63)
    return known


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements, and (element, text) in page order with character references decoded; the text is None at a block edge.

    Elements that end tags or the next start tag close are closed; what is still open at the end closes there. End tags
    without a start are ignored. The contents of scripts, styles, titles and text areas are not markup.
    """
    nodes = [Node("", frozenset(), 0, (), -1)]
    runs: list[tuple[int, str | None]] = []
    open_ = [0]
    at, n = 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            raw = page[at:upto]
            runs.append((open_[-1], html.unescape(raw) if "&" in raw else raw))

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            if nodes[open_.pop()].tag not in INLINE:
                runs.append((open_[-1], None))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(m.start())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == "p":
                    close(k)
                    break
                if nodes[open_[k]].tag in ("table", "td", "button", "object"):
                    break
        elif tag in SIBLING:
            same, scope = SIBLING[tag]
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag in scope:
                    break
                if nodes[open_[k]].tag in same:
                    close(k)
                    break
        if tag == "br":
            runs.append((open_[-1], " "))
            continue
        names, href, style = frozenset(), "", tag
        rest = m[3] or m[6]
        if rest and "=" in rest:
            got = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(rest)}
            href = got.pop("href", "")
            if got:
                names = frozenset(re.split(r"[^a-z0-9]+", " ".join(got.values()).lower())) - {""}
                style = f"{tag}.{got.get('class', '')}#{got.get('id', '')}"
        parent = open_[-1]
        up = nodes[parent]
        node = Node(tag, names, path_of(up.path, style), (*up.above, up.path), parent, href=href)
        up.children.append(style)
        if tag not in INLINE:
            runs.append((parent, None))
        nodes.append(node)
        if tag in VOID or rest and rest.endswith("/") and tag in RAW:
            continue
        open_.append(len(nodes) - 1)
        if tag in TEXT_ONLY:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            close(len(open_) - 1)
    text(n)
    return nodes, runs
