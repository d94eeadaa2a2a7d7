"""A small tolerant HTML reader: tokens, a flat node table, text blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

NAME = re.compile(r"<(/)?([A-Za-z])")
NAME_END = re.compile(r"[\s/>]|\Z")
TAG_END = re.compile(r"""(?>[^>"']++|"[^"]*"|'[^']*'|["'])*+>""")  # a quote without its like is a character
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
# Start tags that end an open element of the second set.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "body"}
SCOPE = {"table", "ul", "ol", "dl", "div", "article", "section", "body", "html", "main", "aside", "nav", "td", "th", "li", "form", "header", "footer", "blockquote", "figure"}


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(text)} if text.strip(" /") else {}


class Tags:
    """Where the tags of one source end, in time that follows its length, whatever it leaves open."""

    def __init__(self, source: str):
        self.source, self.name_end = source, -1
        self.at: list[int] | None = None  # once a tag has been met that never ends: where angle brackets and quotes stand,
        self.end: list[int] = []  # and where a tag ends that goes on there, or -1

    def name(self, start: int) -> int:
        """Where the name that starts here ends. A name that goes on from where one was read ends where that did."""
        if not start <= self.name_end:
            self.name_end = NAME_END.search(self.source, start).start()
        return self.name_end

    def close(self, start: int) -> int:
        """Behind the bracket that ends the tag whose attributes start here, or -1."""
        if self.at is None:
            m = TAG_END.match(self.source, start)
            if m:
                return m.end()
            self._look_ahead()
        k = bisect_left(self.at, start)
        return self.end[k] if k < len(self.end) else -1

    def _look_ahead(self) -> None:
        self.at = [m.start() for m in re.finditer(r"""[>"']""", self.source)]
        self.end = [-1] * len(self.at)
        later = {'"': -1, "'": -1}  # of each quote, the next one
        for k in range(len(self.at) - 1, -1, -1):
            c = self.source[self.at[k]]
            if c == ">":
                self.end[k] = self.at[k] + 1
                continue
            go_on = later[c] + 1 if later[c] >= 0 else k + 1
            self.end[k] = self.end[go_on] if go_on < len(self.at) else -1
            later[c] = k


def events(source: str) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """("open", tag, attributes), ("close", tag, ""), ("text", text, ""), in order. Raw elements keep their text whole."""
    at = look = 0  # text is pending from at on
    n, tags = len(source), Tags(source)
    while (start := source.find("<", look)) >= 0:
        m, end, token = NAME.match(source, start), -1, None
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = n if end < 0 else end + 3
        elif m:
            name_end = tags.name(m.start(2))
            end = tags.close(name_end)
            token = source[m.start(2) : name_end].lower() if end >= 0 else None
        if end < 0 and source[start + 1 : start + 2] in ("!", "?", "/"):
            end = source.find(">", start) + 1 or n
        if end < 0:  # no markup
            look = start + 1
            continue
        if start > at:
            yield "text", source[at:start], ""
        at = look = end
        if not token:
            continue
        if m.group(1):
            yield "close", token, ""
            continue
        yield "open", token, attributes(source[name_end : end - 1])
        if token in RAW:
            over = re.compile(rf"</{re.escape(token)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            yield "text", source[at : over.start() if over else n], ""
            yield "close", token, ""
            at = look = over.end() if over else n
    if at < n:
        yield "text", source[at:], ""


class Page:
    """Nodes in document order: tag, attributes, parent, depth; and the flow of texts and breaks that belongs to them."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parent, self.depth = ["#root"], [{}], [-1], [0]
        self.flow: list[tuple[int, str | None]] = []  # (node, text), or (node, None) for the edge of a block
        stack = [0]
        opened: dict[str, list[int]] = {}  # of each tag, where it stands on the stack
        scopes: list[int] = []

        def pop_to(k: int) -> None:
            for node in reversed(stack[k:]):
                tag = self.tags[node]
                if tag not in INLINE:
                    self.flow.append((node, None))
                if node:
                    opened[tag].pop()
                    if tag in SCOPE:
                        scopes.pop()
            del stack[k:]

        for kind, what, more in events(source):
            if kind == "text":
                self.flow.append((stack[-1], html.unescape(what) if self.tags[stack[-1]] not in ("script", "style") and "&" in what else what))
            elif kind == "open":
                ends = ENDS.get(what, set()) | ({"p"} if what in BLOCKS_END_P else set())
                nearest = max((opened[t][-1] for t in ends if opened.get(t)), default=0)
                if nearest and nearest >= (scopes[-1] if scopes else 0):
                    pop_to(nearest)
                node = len(self.tags)
                self.tags.append(what)
                self.attrs.append(more)
                self.parent.append(stack[-1])
                self.depth.append(len(stack))
                if what not in INLINE:
                    self.flow.append((node, None))
                if what not in VOID:
                    opened.setdefault(what, []).append(len(stack))
                    if what in SCOPE:
                        scopes.append(len(stack))
                    stack.append(node)
            elif opened.get(what):
                pop_to(opened[what][-1])
        pop_to(0)

    def text(self, keep) -> str:
        """Text of kept nodes: white space inside a block is one space, blocks are joined by one space."""
        blocks, own = [], []
        for node, piece in self.flow:
            if piece is None:
                if own:
                    blocks.append(" ".join("".join(own).split()))
                    own = []
            elif keep[node]:
                own.append(piece)
        if own:
            blocks.append(" ".join("".join(own).split()))
        return " ".join(b for b in blocks if b)
