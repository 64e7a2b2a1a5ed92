"""Pages as flat arrays: elements in document order with their parent and the end of their range, texts beside them.

An element's descendants are the elements from the next one up to its end, and its texts are a range of the page's texts, so nothing
here recurses and a page may be nested as deeply as it likes. Elements whose end tag may be left out (list items, cells, paragraphs)
are ended by what must follow them, as browsers do. A selector is answered by one pass for each of its parts: an element lies inside
an earlier match when the furthest end of the matches before it lies behind it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser
from itertools import accumulate

#: Elements without content, without text for readers, attribute words of consent boxes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISY = {"script", "style", "nav", "footer", "aside", "noscript", "iframe", "svg", "form"}
BOXES = re.compile("cookie|consent|banner|popup|modal|gdpr", re.I)
#: What a start tag ends (tag -> the open elements it ends, the elements beyond which it doesn't look).
_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul"
).split()
_AROUND_P = ("button", "caption", "table", "td", "th", "template", "object", "marquee")
ENDS = {tag: (("p",), _AROUND_P) for tag in _BLOCKS} | {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}
_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


class Page(HTMLParser):
    """The arrays of a page; broken markup gives what can be read. Element 0 is the page itself."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end = [""], [{}], [-1], [0]
        self.texts: list[str] = []
        self.first, self.last = [0], [0]  # range of each element's texts
        self._open = [0]
        self._of: dict[str, list[int]] = {}  # tag -> places in the stack of open elements
        self.feed(html or "")
        self.close()
        self._close_from(0)
        shown = [t.strip() for t in self.texts]
        #: texts without blanks around them; how many of the first k are not blank; their length together
        self.shown = shown
        self.solid = [0, *accumulate(bool(t) for t in shown)]
        self.size = [0, *accumulate(map(len, shown))]

    # building

    def _close_from(self, place: int) -> None:
        """End the open elements from a place in the stack on."""
        while len(self._open) > place:
            i = self._open.pop()
            self.end[i], self.last[i] = len(self.tag), len(self.texts)
            if i:
                self._of[self.tag[i]].pop()

    def _place(self, tags) -> int:
        """The last place in the stack that one of these elements has, else -1."""
        return max((own[-1] for t in tags if (own := self._of.get(t))), default=-1)

    def handle_starttag(self, tag, attrs):
        rule = ENDS.get(tag)
        if rule:
            ended, around = rule
            limit = self._place(around)
            places = [own[k] for t in ended if (own := self._of.get(t)) and (k := bisect_left(own, limit + 1)) < len(own)]
            if places:
                self._close_from(min(places))
        i = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parent.append(self._open[-1])
        self.end.append(i + 1)
        self.first.append(len(self.texts))
        self.last.append(len(self.texts))
        if tag not in VOID:
            self._of.setdefault(tag, []).append(len(self._open))
            self._open.append(i)

    def handle_endtag(self, tag):
        own = self._of.get(tag)
        if own:
            self._close_from(own[-1])

    def handle_data(self, data):
        self.texts.append(data)

    # reading

    def children_after(self, i: int) -> int | None:
        """The next element with the same parent."""
        j = self.end[i]
        return j if 0 < j < len(self.tag) and self.parent[j] == self.parent[i] else None

    def length(self, i: int, sep: int = 0) -> int:
        """Characters of an element's text, its parts joined by a separator of `sep` characters."""
        a, b = self.first[i], self.last[i]
        return self.size[b] - self.size[a] + sep * max(0, self.solid[b] - self.solid[a] - 1)

    def strings(self, i: int, hidden=None):
        """The texts of an element, without those of hidden elements inside."""
        at, last = self.first[i], self.last[i]
        if hidden is not None:
            j = i + 1
            while j < self.end[i]:
                if hidden(self.node(j)):
                    yield from (t for t in self.shown[at : self.first[j]] if t)
                    at, j = self.last[j], self.end[j]
                else:
                    j += 1
        yield from (t for t in self.shown[at:last] if t)

    def node(self, i: int) -> Node:
        return Node(self, i)


class Node:
    """An element of a page."""

    __slots__ = ("page", "i")

    def __init__(self, page: Page, i: int):
        self.page, self.i = page, i

    def __eq__(self, other):
        return isinstance(other, Node) and self.page is other.page and self.i == other.i

    def __hash__(self):
        return hash((id(self.page), self.i))

    @property
    def tag(self) -> str:
        return self.page.tag[self.i]

    @property
    def attrs(self) -> dict:
        return self.page.attrs[self.i]

    @property
    def parent(self) -> Node | None:
        return Node(self.page, self.page.parent[self.i]) if self.i else None

    def walk(self):
        """All elements below, in document order."""
        for j in range(self.i + 1, self.page.end[self.i]):
            yield Node(self.page, j)

    def strings(self, hidden=None):
        """The texts inside, without those of hidden elements."""
        return self.page.strings(self.i, hidden)

    def length(self, sep: int = 0) -> int:
        """len(self.text(separator)) without making the text."""
        return self.page.length(self.i, sep)

    def text(self, sep: str = "", most: int | None = None) -> str:
        """The texts inside, joined; `most` characters of them."""
        if most is None:
            return sep.join(self.strings())
        out, size = [], 0
        for t in self.strings():
            out.append(t)
            size += len(t) + len(sep)
            if size > most + len(sep):
                break
        return sep.join(out)[:most]

    def next(self) -> Node | None:
        """The next element with the same parent."""
        j = self.page.children_after(self.i)
        return None if j is None else Node(self.page, j)


def parse(html: str | None) -> Node:
    """The page of a text."""
    return Node(Page(html), 0)


def hidden(node: Node) -> bool:
    """Whether readers don't see an element as part of the page's text."""
    a = node.attrs
    return node.tag in NOISY or bool(a) and (bool(BOXES.search(a.get("class", ""))) or bool(BOXES.search(a.get("id", ""))))


def fits(tag: str, attrs: dict, parts: list[tuple]) -> bool:
    """Whether an element fits a compound selector, as cut by _PART."""
    for own, name, cls, attr, op, value in parts:
        have = attrs.get(attr) if attr else None
        if (
            (own and own not in ("*", tag)) or (name and attrs.get("id") != name) or (cls and cls not in attrs.get("class", "").split())
            or (attr and have is None) or (op == "=" and have != value) or (op == "*=" and value not in have) or (op == "^=" and not have.startswith(value)) or (op == "$=" and not have.endswith(value))
        ):
            return False
    return True


def select(top: Node, css: str, most: int | None = None) -> list[Node]:
    """Elements below top, in document order, that any of the comma-separated selectors fits; a blank stands for any descendant. At most
    `most` of them."""
    page, found = top.page, set()
    for group in css.split(","):
        parts = [_PART.findall(p) for p in group.split()]
        if not parts:
            continue
        within = range(top.i + 1, page.end[top.i])
        for k, part in enumerate(parts):
            matched, reach, at = [], -1, 0
            for i in within if k == 0 else range(top.i + 1, page.end[top.i]):
                if k:
                    while at < len(within) and within[at] < i:
                        reach = max(reach, page.end[within[at]])
                        at += 1
                    if i >= reach:
                        continue
                if fits(page.tag[i], page.attrs[i], part):
                    matched.append(i)
                    if most is not None and k == len(parts) - 1 and len(matched) >= most:
                        break
            within = matched
        found.update(within)
    return [Node(page, i) for i in sorted(found)[:most]]


def holders(top: Node, value: str) -> list[tuple[int, Node]]:
    """(length of its text or content, element) for all elements below top that hold a value, in document order.

    The texts are joined by blanks once; an element holds a value that stands in its part of that line.
    """
    page = top.page
    solid = [k for k, t in enumerate(page.shown) if t]
    starts = list(accumulate((len(page.shown[k]) + 1 for k in solid), initial=0))
    line, spots, p = " ".join(page.shown[k] for k in solid), [], -1
    while (p := line.find(value, p + 1)) >= 0:
        spots.append(p)
    out = []
    for i in range(top.i + 1, page.end[top.i]):
        a, b = page.solid[page.first[i]], page.solid[page.last[i]]
        size = starts[b] - 1 - starts[a] if b > a else 0
        content = page.attrs[i].get("content", "")
        k = bisect_left(spots, starts[a])
        if b > a and k < len(spots) and spots[k] + len(value) <= starts[b] - 1 or value in content:
            out.append((size or len(content), Node(page, i)))
    return out
