"""A page as a tree of blocks with the text runs in them, as the model of `extraction` reads it.

A block is an element that is not inline; a run is the text between two block boundaries, inline elements included.
Tags are read in one pass: elements that hold raw text end at their own end tag, paragraphs, list items and cells end where
the next one begins, end tags that open nothing are ignored, and what is left open ends with the page. Comments, scripts,
styles, controls and other elements without running text are left out. Time and memory grow with the length of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

_TOKEN = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))", re.S
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_SILENT = frozenset(("script style textarea title iframe noembed noframes noscript template svg canvas audio video object map select datalist button").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    ("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label mark math nobr q rp rt ruby s samp small span strike strong "
     "sub sup time tt u var wbr picture source area base link meta param track col").split()
)
_OUTER = frozenset(("html", "head", "body"))
_ENDS_P = frozenset(
    ("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu "
     "nav ol p pre search section summary table ul").split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# What a start tag ends besides, if open and not behind one of the elements of the second group.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_P_WALL = frozenset(("td", "th", "caption", "table", "button", "object", "template"))


@lru_cache(4096)
def names(attributes: str) -> tuple[tuple[str, ...], str]:
    """(words of class, id, role and itemprop, value of label) of the attributes of a tag."""
    words, label = [], ""
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "label":
            label = value
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.append("hidden")
        elif name != "style":
            words += [w.lower().rstrip("s") for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(words)), label


class Page:
    """Nodes in page order: parent, tag ('' for a run), words of names, label, text of a run, its characters inside links."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.words, self.label = [-1], ["body"], [()], [""]
        self.text, self.linked = [""], [0]
        self._tags, self._nodes, self._open, self._silent = ["body"], [0], Counter(), 0
        self._pieces: list[str] = []
        self._links = 0
        self._read(source)

    def _node(self, parent: int, tag: str, words: tuple[str, ...], label: str, text: str, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.label.append(label)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self._node(self._nodes[-1], "", (), "", text, min(self._links, len(text)))
            self._pieces, self._links = [], 0

    def _push(self, tag: str, attributes: str) -> None:
        node = self._nodes[-1]
        if tag not in _INLINE and tag not in _SILENT and (tag in _ENDS_P or tag in _ENDS or "-" in tag or tag in ("thead", "caption")):
            self._flush()
            words, label = names(attributes)
            node = self._node(node, tag, words, label, "", 0)
        self._tags.append(tag)
        self._nodes.append(node)
        self._open[tag] += 1
        self._silent += tag in _SILENT

    def _pop(self) -> None:
        tag, node = self._tags.pop(), self._nodes.pop()
        if node != self._nodes[-1]:
            own = self._nodes[-1]
            self._nodes[-1] = node  # the run still belongs to the block that ends
            self._flush()
            self._nodes[-1] = own
        self._open[tag] -= 1
        self._silent -= tag in _SILENT

    def _close(self, wanted: tuple[str, ...] | frozenset[str], walls: tuple[str, ...] | frozenset[str]) -> None:
        """End the nearest open element of `wanted`, and all that is open inside it, unless one of `walls` is nearer."""
        if not any(self._open[w] for w in wanted):
            return
        for k in range(len(self._tags) - 1, 0, -1):
            if self._tags[k] in wanted:
                while len(self._tags) > k:
                    self._pop()
                return
            if self._tags[k] in walls:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close(("p",), _P_WALL)
        if tag in _HEADINGS and self._tags[-1] in _HEADINGS:
            self._pop()
        for end in _ENDS.get(tag, ((),))[0]:
            self._close((end,), _ENDS[tag][1])
        if tag in _VOID:
            if tag == "br":
                self._pieces.append(" ")
            elif tag == "hr":
                self._flush()
            return
        self._push(tag, attributes)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at and not self._silent:
                text = source[at:stop]
                if "&" in text:
                    text = html.unescape(text)
                self._pieces.append(text)
                if self._open["a"]:
                    self._links += len(text)
            if not found:
                break
            at = found.end()
            tag = found[2]
            if tag is None or (tag := tag.lower()) in _OUTER:
                continue
            if found[1]:
                if tag == "br":
                    self._pieces.append(" ")
                elif tag in _HEADINGS:
                    self._close(_HEADINGS, ())
                else:
                    self._close((tag,), _P_WALL if tag == "p" else ("table",) if tag in _INLINE else ())
            else:
                self._start(tag, found[3])
                if tag in _RAW and self._tags[-1] == tag:
                    closing = _RAW[tag].search(source, at)
                    at = closing.start() if closing else end
        while len(self._tags) > 1:
            self._pop()
        self._flush()
