"""Leaf blocks of an HTML page, with what surrounds them."""

from __future__ import annotations

import html
import re

OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
STOP = re.compile(r"[>\"']")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed names of the HTML standard.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math", "canvas", "select", "video", "audio"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Form parts that stand in lines of text: what they say is no text of the page.
CONTROLS = {"button", "label"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Block:
    __slots__ = ("text", "around", "tag", "linked")

    def __init__(self, text: str, around: frozenset, tag: str, linked: int):
        self.text, self.around, self.tag, self.linked = text, around, tag, linked


class Tags:
    """The tags, comments and declarations of a page, found in one pass."""

    def __init__(self, page: str):
        self.page = page
        #: Whether quotes still count; they don't once one of them isn't closed within a tag.
        self.quoted = True

    def end(self, at: int) -> int:
        """Where the tag that starts before ``at`` ends, or -1 if no tag ends any more."""
        start = at
        while self.quoted:
            m = STOP.search(self.page, at)
            if m is None:
                self.quoted = False
            elif m.group() == ">":
                return m.end()
            else:
                close = self.page.find(m.group(), m.end())
                if close < 0:
                    self.quoted = False
                at = close + 1
        return self.page.find(">", start) + 1 or -1

    def next(self, at: int) -> tuple[int, int, bool] | None:
        """(start, end, whether it is an element's tag) of the next one from ``at`` on; what only looks like one is text."""
        while (start := self.page.find("<", at)) >= 0:
            following = self.page[start + 1 : start + 3]
            if following[:1] in ("!", "?") and following:
                return start, OTHER.match(self.page, start).end(), False
            letter = following[1:2] if following[:1] == "/" else following[:1]
            if letter.isascii() and letter.isalpha():
                end = self.end(start + 2)
                return (start, end, True) if end > 0 else None
            at = start + 1
        return None


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """The page's leaf blocks in order: text with references decoded and white space made single spaces.

    Inline elements and line breaks don't end a block. Raw elements (scripts, styles and the like) and form controls hold
    no text. Tags that are never closed, and closing tags that nothing opened, are tolerated as browsers do; a tag without
    an end is text. ``known``: names and words to keep of what is around a block. Every character is looked at a bounded
    number of times, and elements that add nothing share what is around them.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = start_link = 0
    in_link = False
    size = 0

    def end() -> None:
        nonlocal parts, linked, size, start_link
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][0], linked + (size - start_link if in_link else 0)))
        parts, linked, size, start_link = [], 0, 0, 0

    def close_to(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    tags = Tags(page)
    at, n = 0, len(page)
    unclosed: set[str] = set()
    while at < n:
        m = tags.next(at)
        if m is None:
            parts.append(page[at:])
            size += n - at
            break
        start, stop, element = m
        if start > at:
            parts.append(page[at:start])
            size += start - at
        at = stop
        if not element:
            continue
        tag = page[start:stop]
        name = NAME.match(tag).group(1).lower()
        closing = tag[1] == "/"
        if name in RAW or name in CONTROLS:
            if not closing and not tag.endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at) if name not in unclosed else None
                if close is not None:
                    at = page.find(">", close.end()) + 1 or n
                elif name in RAW:
                    at = n
                else:
                    unclosed.add(name)
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                if in_link:
                    linked += size - start_link
                in_link, start_link = not closing, size
            elif name in ("br", "img", "input", "wbr"):
                parts.append(" ")
            continue
        end()
        if closing:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close_to(k)
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    break
        if name in SELF_NESTING and opened.get(name):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close_to(k)
                    break
                if stack[k][0] in SELF_NESTING[name]:
                    break
        if tag.endswith("/>"):
            continue
        words = {w.lower() for a in ATTRIBUTE.findall(tag) for w in WORD.findall(" ".join(a))} | {"<" + name}
        around = stack[-1][1]
        if (new := (words if known is None else words & known) - around):
            around = around | new
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, around))
    end()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block: what is around it, its own tag, and the form of its text."""
    rows = []
    total = sum(len(b.text) for b in page) or 1
    done = 0
    for b in page:
        n = len(b.text.split())
        length = "w" + ("0" if n < 3 else "1" if n < 6 else "2" if n < 12 else "3" if n < 25 else "4" if n < 60 else "5")
        density = b.linked / max(len(b.text), 1)
        link = "l" + ("0" if density == 0 else "1" if density < 0.4 else "2" if density < 0.8 else "3")
        home = "article" if "<article" in b.around else "main" if "<main" in b.around else "none"
        row = ["bias", "tag " + b.tag, length, link, length + link, "home " + home, home + length, "tag " + b.tag + " " + home]
        row += ["in " + x for x in b.around]
        if b.text[-1] in ".!?…:;\"'”»)。":
            row.append("sentence")
        if "©" in b.text[:40]:
            row.append("copyright")
        if "@" in b.text:
            row.append("address")
        if not any(c.isalpha() for c in b.text):
            row.append("no letters")
        row.append("third %d" % min(2, 3 * done // total))
        done += len(b.text)
        rows.append(row)
    return rows
