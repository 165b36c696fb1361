"""A small HTML tree: elements with parent and depth, texts in page order, blocks."""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br nobr ruby rt rp".split()
)
# A start tag of the key ends an open element of the value, unless a wall stands between.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "option": {"option"},
}
WALLS = {
    "li": {"ul", "ol", "menu"},
    "dt": {"dl"},
    "dd": {"dl"},
    "tr": {"table"},
    "td": {"tr", "table"},
    "th": {"tr", "table"},
    "tbody": {"table"},
    "option": {"select"},
    "p": {"button", "td", "th", "table", "object", "caption"},
}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")


def names(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    if "=" not in attrs:
        return ()
    found = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attrs))
    found = re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()
    return tuple(sorted(set(NAME.findall(found))))


class Page:
    """Elements (tag, attributes, parent, depth), the first of them the page itself, and its texts."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.depth = ["#page"], [""], [-1], [0]
        # Texts: element, block number and content; blocks end where block elements begin or end.
        self.text_of: list[int] = []
        self.block_of: list[int] = []
        self.text: list[str] = []
        # Open elements from the outermost on, and for each tag their places among them.
        self._open, self._block = [0], 0
        self._places: defaultdict[str, list[int]] = defaultdict(list)
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if not found:
                self._add_text(source[at:])
                return
            if found.start() > at:
                self._add_text(source[at : found.start()])
            at = found.end()
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                continue
            if found["end"] or found["end2"]:
                self._close(tag)
                continue
            attrs = found["attrs"] or found["attrs2"] or ""
            if tag not in RAW:
                self._start(tag, attrs)
            elif not attrs.endswith("/"):
                # What stands inside is no text of the page, and the element no part of the tree.
                close = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(source, at)
                at = close.end() if close else size

    def _add_text(self, text: str) -> None:
        if text and not text.isspace():
            self.text_of.append(self._open[-1])
            self.block_of.append(self._block)
            self.text.append(html.unescape(text))
        elif text and self.text and self.block_of[-1] == self._block:
            self.text[-1] += " "

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self._end_open({"p"}, WALLS["p"])
            self._block += 1
        if tag in ENDS:
            self._end_open(ENDS[tag], WALLS[tag])
        if tag == "br" and self.text and self.block_of[-1] == self._block:
            self.text[-1] += " "
        if tag not in VOID:
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.parent.append(self._open[-1])
            self.depth.append(len(self._open))
            self._places[tag].append(len(self._open))
            self._open.append(len(self.tag) - 1)

    def _innermost(self, tags: set[str]) -> int:
        """The place of the innermost open element with one of ``tags``; 0 if there is none."""
        return max(self._places[tag][-1] if self._places[tag] else 0 for tag in tags)

    def _end(self, place: int) -> None:
        """Close the open elements from ``place`` inwards."""
        while len(self._open) > place:
            self._places[self.tag[self._open.pop()]].pop()

    def _end_open(self, tags: set[str], walls: set[str]) -> None:
        outer = self._innermost(tags)
        if outer > self._innermost(walls):
            # Close the outermost of a run of such elements before a wall.
            while outer > 1 and self.tag[self._open[outer - 1]] in tags:
                outer -= 1
            self._end(outer)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._block += 1
        place = self._innermost({tag})
        if place:
            self._end(place)
