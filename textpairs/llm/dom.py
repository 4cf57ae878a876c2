"""HTML to a forest of block nodes: a small tolerant parser for the extraction operator.

A node is a block-level element or a run of inline text inside one. Inline
markup disappears into the run; scripts, styles, comments, the head and other
parts that never show are skipped. Open elements are closed by their ancestors'
end tags, by the elements that end them implicitly, and by the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SKIPPED = frozenset("script style head title noscript template svg math iframe object select textarea canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
    html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    caption button
""".split())
#: Start tags that end an open element of the second set (up to the nearest block that bounds it).
ENDS = ({"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "tbody": {"tr", "td", "th", "thead", "tbody"}}
        | {t: {"p"} for t in BLOCK if t not in {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "html", "body", "button"}})
BOUNDS = frozenset("html body article section main div aside nav footer header form ul ol dl table blockquote td th figure fieldset details".split())
_CLOSES_OVER = {"tr": {"td", "th"}, "tbody": {"td", "th", "tr"}}


@dataclass
class Forest:
    """Nodes of many pages; a node's parent stands before it."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # runs only
    link_chars: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def add(self, page: int, parent: int, tag: str, attributes: str, text: str = "", link_chars: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.link_chars.append(link_chars)
        return len(self.parent) - 1


def _squeezed(pieces: list[str]) -> str:
    joined = "".join(pieces)
    return " ".join((entities.unescape(joined) if "&" in joined else joined).split())


def parse(forest: Forest, page: int, html: str) -> None:
    """Append the block nodes of one page."""
    root = forest.add(page, -1, "#page", "")
    open_blocks: list[tuple[str, int]] = [("#page", root)]
    run: list[str] = []
    linked: list[str] = []
    in_link = 0
    at = 0
    endless: set[str] = set()
    n_open: Counter[str] = Counter()  # of each tag among the open blocks

    def close(k: int) -> None:
        n_open.subtract(tag for tag, _ in open_blocks[k:])
        del open_blocks[k:]

    def end_run() -> None:
        nonlocal in_link
        if run:
            text = _squeezed(run)
            if text:
                forest.add(page, open_blocks[-1][1], "#run", "", text, min(len(text), len(_squeezed(linked))))
            run.clear()
            linked.clear()

    def text(piece: str) -> None:
        run.append(piece)
        if in_link:
            linked.append(piece)

    while True:
        m = TAG.search(html, at)
        if m is None:
            if at < len(html):
                text(html[at:])
            break
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1) or m.group(4))
        if name in SKIPPED:
            if not closing:
                # a kind without an end tag from here on has none further on either
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if end is None:
                    endless.add(name)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = len(html)
            continue
        if name == "a":
            in_link = max(0, in_link - 1) if closing else 1
        elif name == "br":
            text(" ")
        elif name in BLOCK:
            if closing:
                for k in range(len(open_blocks) - 1, 0, -1) if n_open[name] else ():
                    if open_blocks[k][0] == name:
                        end_run()
                        close(k)
                        break
                in_link = 0
                continue
            end_run()
            in_link = 0
            ended = ENDS.get(name)
            if ended:
                for k in range(len(open_blocks) - 1, 0, -1):
                    tag = open_blocks[k][0]
                    if tag in ended:
                        close(k)
                        if name not in _CLOSES_OVER:
                            break
                    elif tag in BOUNDS:
                        break
            if name in VOID:
                continue
            attributes = m.group(3) if m.group(2) else m.group(6)
            open_blocks.append((name, forest.add(page, open_blocks[-1][1], name, attributes or "")))
            n_open[name] += 1
    end_run()
