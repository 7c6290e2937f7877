"""Leaf blocks of web pages, with the features that tell main text from the rest.

A block is the text between two borders of block elements; inline elements don't end it.
The reader is lenient: end tags that fit nothing are passed over, elements that HTML closes
by itself are closed, and unclosed comments, scripts and tags go to the end of the page. One
pass over the page, whose cost doesn't depend on how deep it is nested.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("head noscript template svg math object audio video canvas".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
SCOPE = frozenset("ul ol dl table select".split())
NAMED = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label legend li main menu nav ol option p pre section select summary table td th tr ul".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_CLASS = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_CUE = re.compile(r"©|cookie|copyright|rights reserved|privacy|subscrib|newsletter|sign (?:in|up)|log ?in|password|comment|repl(?:y|ies)|share|advert|sponsor", re.IGNORECASE)
#: Names that are remembered at once, and the longest attributes; beyond that they are worked out again.
REMEMBERED, SHORT = 50_000, 200


class Block(NamedTuple):
    text: str
    around: frozenset  # of the elements around it: their names, and words of their classes, ids and roles
    parent: str
    linked: float  # share of the characters that are links
    apart: int = 0  # whether it stands among other elements than the block before, its own aside


def class_words(attributes: str) -> frozenset[str]:
    found = set()
    for a, b, c in _CLASS.findall(attributes):
        found.update(t.lower().removesuffix("s") for t in _TOKEN.findall(a or b or c))
    return frozenset(f"~{t}" for t in found)


class Reader:
    """Reads pages; of the words of classes and ids it keeps those in ``known``, or all."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known, self.words, self.sets, self.inner = known, {}, {}, {}

    def _features(self, name: str, attributes: str) -> frozenset[str]:
        key = (name, attributes)
        got = self.words.get(key) if len(attributes) <= SHORT else None
        if got is None:
            got = class_words(attributes) if "=" in attributes else frozenset()
            got = got if self.known is None else got & self.known
            got |= {f"<{name}"} if name in NAMED else frozenset()
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            if len(attributes) <= SHORT:
                self.words[key] = got
        return got

    def _joined(self, around: frozenset, more: frozenset) -> frozenset:
        """The union; of equal ones always the same object, and ``around`` itself if nothing is new."""
        if more <= around:
            return around
        out = around | more
        if len(self.sets) >= REMEMBERED:
            self.sets.clear()
        return self.sets.setdefault(out, out)

    def _within(self, around: frozenset, parent: str) -> frozenset:
        key = (around, parent)
        if (got := self.inner.get(key)) is None:
            if len(self.inner) >= REMEMBERED:
                self.inner.clear()
            got = self.inner[key] = around - {f"<{parent}"}
        return got

    def blocks(self, page: str) -> list[Block]:
        out: list[Block] = []
        stack: list[tuple[str, frozenset]] = []  # open elements, and what is around what follows their end
        open_count: dict[str, int] = {}
        around, silent, links, plain = frozenset(), 0, 0, False
        pieces: list[str] = []
        linked, at, n = 0, 0, len(page)

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    parent = next((name for name, _ in reversed(stack) if name not in INLINE), "")
                    within = self._within(around, parent)
                    out.append(Block(text, around, parent, min(1.0, linked / len(text)), int(bool(out) and within != self._within(out[-1].around, out[-1].parent))))
                pieces.clear()
            linked = 0

        def close():
            nonlocal around, silent, links
            name, before = stack.pop()
            open_count[name] -= 1
            if name in SILENT:
                silent -= 1
            elif name == "a":
                links -= 1
            around = before

        def close_to(name: str):
            while stack[-1][0] != name:
                close()
            close()

        while at < n:
            m = _OPEN.search(page, at)
            stop = m.start() if m else n
            if stop > at and not silent:
                piece = page[at:stop]
                piece = html.unescape(piece) if "&" in piece else piece
                pieces.append(piece)
                if links:
                    linked += len(piece.strip())
            if not m:
                break
            if page.startswith("<!--", stop):
                end = page.find("-->", stop + 4)
                at = n if end < 0 else end + 3
                continue
            if page[stop + 1] in "!?":
                end = page.find(">", stop)
                at = n if end < 0 else end + 1
                continue
            tag = None if plain else _TAG.match(page, stop)
            if tag:
                ends, name, attributes, at = bool(tag[1]), tag[2].lower(), tag[3], tag.end()
            elif named := _NAME.match(page, stop):
                plain = True  # a quote that never ends: from here on tags end at the next >
                end = page.find(">", stop)
                if end < 0:
                    break
                ends, name, attributes, at = page[stop + 1] == "/", named[1].lower(), page[named.end() : end], end + 1
            else:  # </ without a name
                end = page.find(">", stop)
                at = n if end < 0 else end + 1
                continue
            inline = name in INLINE
            if ends:
                if name == "br" and not silent:
                    pieces.append(" ")
                if not inline:
                    flush()
                if open_count.get(name):
                    close_to(name)
                continue
            if name == "br":
                if not silent:
                    pieces.append(" ")
                continue
            if inline and name == "a" and open_count.get("a"):
                close_to("a")
            if not inline:
                flush()
                if open_count.get("head") and name not in HEAD and name != "head":
                    close_to("head")
                if open_count.get("p") and name not in VOID and name not in RAW:
                    close_to("p")
                for other in CLOSED_BY.get(name, ()):
                    if open_count.get(other):
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in SCOPE:
                                break
                            if stack[k][0] == other:
                                while len(stack) > k:
                                    close()
                                break
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = n if not end else page.find(">", end.start()) + 1 or n
                continue
            if name in VOID or attributes.endswith("/") and (silent or name in SILENT):
                continue
            stack.append((name, around))
            open_count[name] = open_count.get(name, 0) + 1
            if name in SILENT:
                silent += 1
            elif name == "a":
                links += 1
            if not inline:
                around = self._joined(around, self._features(name, attributes))
        flush()
        return out


def text_features(b: Block) -> list[str]:
    """Features of a block's own text."""
    t = b.text
    out = [f"in {b.parent}", f"length {min(len(t), 4095).bit_length()}", f"links {int(b.linked * 3.999)}"]
    if t[-1] in ".!?…\"”»":
        out.append("sentence")
    if "," in t:
        out.append("comma")
    if len(t) < 400 and _CUE.search(t):
        out.append("cue")
    return out
