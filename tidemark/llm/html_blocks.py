"""Cuts a web page into its leaf blocks: text between block-level tags, with the path of tags it stands in."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass

#: Elements that do not end a block (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page (fixed values).
SKIPPED = frozenset("script style noscript template title svg math iframe object canvas audio video textarea select datalist head".split())
#: Skipped elements whose content is never markup: without an end tag they reach to the end of the page (fixed values).
RAW = frozenset("script style textarea".split())
#: Elements that a slash at the end of their start tag closes; elsewhere it means nothing (fixed values).
FOREIGN = frozenset("svg math".split())
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these kinds (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option"}}
#: Elements that no implied end reaches beyond (fixed values).
FENCES = frozenset("table ul ol dl div article section main aside nav header footer form body html blockquote".split())

#: Steps of a path that a block keeps, the innermost ones: a path is a feature of the labeller, no text.
DEPTH = 32
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_EMPTY_COMMENT = re.compile("-?>")
_COMMENT_END = re.compile("--!?>")
_VALUE = re.compile(r""">|=\s*(["'])""")
_NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True, slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def names(tag: str, attributes: str) -> str:
    """A step of a path: the tag and the words of its class, id and role."""
    if not attributes.strip(" /"):
        return tag
    words = []
    for kind, a, b, c in _NAMED.findall(attributes):
        value, kind = a or b or c, kind.lower()
        if kind == "style":
            words += ["hidden"] if re.search(r"display\s*:\s*none", value, re.I) else []
        elif kind == "hidden":
            words.append("hidden")
        else:
            words += [x.lower() for x in _PARTS.findall(value)]
    return " ".join([tag, *words])


class Tags:
    """Finds the tags of a page one after the other, in time linear in the page: what is once not found is not sought again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, or -1; places asked for never go back."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: after the first > that no quoted value holds, or -1."""
        begin = at
        if self.find(">", at) < 0:
            return -1
        while found := _VALUE.search(self.page, at):
            if found[0] == ">":
                return found.end()
            close = self.find(found[1], found.end())
            # a quote that never closes is no quote
            at = close + 1 if close >= 0 else found.end()
        return self.page.find(">", begin) + 1

    def comment(self, at: int) -> int:
        """Where the comment ends whose text begins at ``at``: behind --> or --!>, or at once for > and ->; -1 without an end."""
        if "-->" in self.missing:
            return -1
        found = _EMPTY_COMMENT.match(self.page, at) or _COMMENT_END.search(self.page, at)
        if not found:
            self.missing.add("-->")
            return -1
        return found.end()

    def after(self, tag: str, at: int) -> int:
        """Where the content of a skipped element ends, after its end tag; -1 without one."""
        if tag in self.missing:
            return -1
        found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if not found:
            self.missing.add(tag)
        return found.end() if found else -1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space joined; empty ones are left out."""
    page = page or ""
    tags = Tags(page)
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    # where in the stack each kind of element is open, and where the fences are
    open_: defaultdict[str, list[int]] = defaultdict(list)
    fences: list[int] = []
    held: list[str] = []
    in_link = link_chars = 0
    at, begin, end = 0, 0, len(page)

    def close() -> None:
        nonlocal held, link_chars
        if held:
            text = " ".join("".join(held).split())
            if text:
                path = tuple(s for t, s in stack[-4 * DEPTH :] if t not in INLINE)[-DEPTH:]
                # blocks under one element share its path
                out.append(Block(text, out[-1].path if out and out[-1].path == path else path, min(link_chars, len(text))))
            held, link_chars = [], 0

    def text(piece: str) -> None:
        nonlocal link_chars
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if in_link:
                link_chars += len(piece.strip())

    def cut(size: int) -> None:
        nonlocal in_link
        for t, _ in reversed(stack[size:]):
            open_[t].pop()
            in_link -= t == "a"
        while fences and fences[-1] >= size:
            fences.pop()
        del stack[size:]

    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        at = start + 1
        if page.startswith("!--", at):
            stop = tags.comment(at + 3)
            text(page[begin:start])
            at = begin = stop if stop >= 0 else end
            continue
        if page[at : at + 1] in ("!", "?"):
            stop = tags.find(">", at)
            text(page[begin:start])
            at = begin = stop + 1 if stop >= 0 else end
            continue
        name = _NAME.match(page, at)
        stop = tags.end(name.end()) if name else -1
        if stop < 0:
            continue  # a < that begins no tag is text
        text(page[begin:start])
        tag, attributes = name[1].lower(), page[name.end() : stop - 1]
        at = begin = stop
        if page[start + 1] == "/":
            if tag not in INLINE:
                close()
            if open_[tag]:
                cut(open_[tag][-1])
            continue
        closed = attributes.rstrip().endswith("/")
        if tag in SKIPPED:
            if not (closed and tag in FOREIGN):
                # the content of a skipped element is passed over whole
                stop = tags.after(tag, at)
                at = begin = stop if stop >= 0 else end if tag in RAW else at
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            close()
            over = {"p"} | CLOSES.get(tag, set())
            fence = fences[-1] if fences else -1
            inside = [open_[t][bisect(open_[t], fence)] for t in over if open_[t] and open_[t][-1] > fence]
            if inside:
                cut(min(inside))
        if tag not in VOID and not closed:
            open_[tag].append(len(stack))
            if tag in FENCES:
                fences.append(len(stack))
            stack.append((tag, names(tag, attributes)))
            in_link += tag == "a"
    text(page[begin:])
    close()
    return out
