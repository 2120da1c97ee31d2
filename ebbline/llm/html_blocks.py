"""Cutting a page into leaf blocks of text with the path of containers they stand in."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.  A head is not one: what it may hold is silent of itself, anything else ends it.
SILENT = frozenset("button canvas datalist iframe math noscript object option script select style svg template textarea title".split())
#: Silent elements without markup inside: those that reach the end of the page unclosed, and those that then do not count.
RAW, LOOSE = frozenset("script style textarea title".split()), frozenset("iframe noscript".split())
#: Silent elements that end where the next of their kind begins; those whose inside knows no raw text; those that a close of what is around does not end.
SINGLE, FOREIGN, SCOPES = frozenset("button option select".split()), frozenset("math svg".split()), frozenset("object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of these.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: A quote opens a value only right after the equals sign, and only if it is closed somewhere; elsewhere it is a character like others.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\t\n\f\r >]++)"""
_ATTRIBUTE = rf"[\t\n\f\r /]*+[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+{_VALUE}?)?"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:{_ATTRIBUTE})*+[\t\n\f\r /]*+)(?:>|\Z)", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Slots that the tags and class words of a path are hashed to.
PATH_SLOTS = 96


class Container:
    """An open element: its tag and class words, what it stands in, and the slots of all of them as the bits of a number."""

    __slots__ = ("above", "slots", "tag", "words")

    def __init__(self, above: Container | None, tag: str, words: tuple[str, ...]):
        self.above, self.tag, self.words = above, tag, words
        self.slots = above.slots if above else 0
        for token in self.own():
            self.slots |= 1 << zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH_SLOTS

    def own(self) -> tuple[str, ...]:
        return self.tag, *(f".{w}" for w in self.words)


@dataclass
class Block:
    """Text of a leaf, the innermost container it stands in, and the characters in links."""

    text: str
    inside: Container | None
    linked: int

    @property
    def tag(self) -> str:
        return self.inside.tag if self.inside else ""

    @property
    def slots(self) -> int:
        return self.inside.slots if self.inside else 0

    @property
    def path(self) -> tuple[str, ...]:
        """The tags and class words around the text, from outside."""
        found, at = [], self.inside
        while at:
            found.append(at.own())
            at = at.above
        return tuple(token for own in reversed(found) for token in own)


def _silent_ends(page: str) -> dict[int, tuple[int, bool]]:
    """Where the silent element that opens at a place ends, and whether it is closed there.

    One that is not ends with what is around it, with the next of its kind, or with the page.
    """
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    open_: dict[str, list[int]] = {}
    never: set[str] = set()
    at = 0

    def pop_to(depth: int, stop: int) -> None:
        while len(stack) > depth:
            tag, start = stack.pop()
            open_[tag].pop()
            if tag in SILENT:
                ends[start] = stop, False

    while match := _TAG.search(page, at):
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if open_.get(tag):
                depth, start = open_[tag][-1], stack[open_[tag][-1]][1]
                if tag in SCOPES or all(not open_.get(s) or open_[s][-1] < depth for s in SCOPES):
                    pop_to(depth, match.start())
                    if tag in SILENT:
                        ends[start] = at, True
            continue
        if match[3].endswith("/") or tag in VOID or not (tag in SILENT or tag in BLOCKS):
            continue
        if tag in SINGLE and open_.get(tag):
            pop_to(open_[tag][-1], match.start())
        if (tag in RAW or tag in LOOSE) and not any(open_.get(f) for f in FOREIGN):
            end = None if tag in never else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None:
                never.add(tag)
            if end or tag in RAW:
                at = end.end() if end else len(page)
                ends[match.start()] = at, True
                continue
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, match.start()))
    pop_to(0, len(page))
    return ends


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; unclosed and cut-off markup is taken as a browser would.

    Inline elements and line breaks stay inside their block.  Character references are
    decoded, each between two tags, and white space becomes one space; blocks without text are left out.
    The time grows with the page, however deep its elements are nested.
    A silent element without its closing tag ends at the latest where a block begins or ends; only raw text goes on to the end of the page.
    """
    silent = _silent_ends(page)
    found: list[Block] = []
    stack: list[Container] = []
    open_: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = link = at = quiet = 0  # text before quiet is that of an unclosed silent element

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        parts, linked = [], 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag].pop()

    while at < len(page):
        match = _TAG.search(page, at)
        stop = match.start() if match else len(page)
        if stop > at and at >= quiet:
            parts.append(html.unescape(page[at:stop]))
            linked += (stop - at) * link
        if not match:
            break
        at = match.end()
        if match[2] is None:
            continue
        tag, closing = match[2].lower(), bool(match[1])
        if tag in SILENT and not closing:
            if match.start() in silent:
                end, closed = silent[match.start()]
                at, quiet = (end, quiet) if closed else (at, max(quiet, end))
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            link = quiet = 0
            if closing:
                if open_.get(tag):
                    pop_to(open_[tag][-1])
            elif tag not in VOID:
                ends = CLOSES.get(tag, {"p"})
                while stack and stack[-1].tag in ends:
                    pop_to(len(stack) - 1)
                words = tuple(w for m in _NAME.finditer(match[3]) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))
                open_.setdefault(tag, []).append(len(stack))
                stack.append(Container(stack[-1] if stack else None, tag, words))
    flush()
    return found
