"""One pass over the events of a page: blocks are captured as their tags open and close."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

#: Elements without an end tag, and elements whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript".split())
#: An opening tag ends an open element of the kinds on its right, within the nearest of the scopes.
ENDS = {
    "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
    **{t: {"p"} for t in "p div ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 section article nav header footer aside main form hr".split()},
}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
_INNER = {"div", "td", "th", "li", "section", "article", "main", "blockquote"}


def tidy(text: str) -> str:
    """White space squeezed, zero-width spaces dropped, none before punctuation."""
    return re.sub(r"\s+([:,.;!?])", r"\1", re.sub(r"\s+", " ", text).strip().replace("​", ""))


class Capture:
    """A block that is being read; ``parts`` are its pieces of text."""

    def __init__(self, tag: str, classes: list[str]):
        self.tag, self.classes, self.parts = tag, classes, []

    def opened(self, tag: str, parent: str, depth: int) -> None: ...

    def closed(self, tag: str, depth: int) -> None: ...

    def said(self, text: str) -> None:
        if text.strip():
            self.parts.append(text.strip())

    def text(self) -> str:
        return tidy(" ".join(self.parts))

    def block(self) -> dict | None:
        raise NotImplementedError


class Heading(Capture):
    def block(self):
        return {"type": "heading", "level": int(self.tag[1]), "text": self.text()}


class Paragraph(Capture):
    def block(self):
        return {"type": "paragraph", "text": self.text()} if self.text() else None


class Listing(Capture):
    """Items are the ``li`` that stand in the list itself; what is nested in one belongs to it."""

    def __init__(self, tag, classes):
        super().__init__(tag, classes)
        self.items: list[list[str]] = []
        self.depth = self.inside = 0

    def opened(self, tag, parent, depth):
        self.depth = self.depth or depth
        if tag == "li" and depth == self.depth:
            self.items.append([])
            self.inside = depth

    def closed(self, tag, depth):
        if depth == self.inside:
            self.inside = 0

    def said(self, text):
        if self.inside and text.strip():
            self.items[-1].append(text.strip())

    def block(self):
        return {"type": "list", "ordered": self.tag == "ol", "items": [tidy(" ".join(x)) for x in self.items]}


class Table(Capture):
    """A cell belongs to every open row, and its text to every open cell, so nested tables show in both."""

    def __init__(self, tag, classes):
        super().__init__(tag, classes)
        self.rows, self.open_rows, self.open_cells = [], [], []

    def opened(self, tag, parent, depth):
        if tag == "tr":
            self.open_rows.append([])
            self.rows.append(self.open_rows[-1])
        elif tag in ("td", "th"):
            self.open_cells.append([])
            for row in self.open_rows:
                row.append(self.open_cells[-1])

    def closed(self, tag, depth):
        if tag == "tr" and self.open_rows:
            self.open_rows.pop()
        elif tag in ("td", "th") and self.open_cells:
            self.open_cells.pop()

    def said(self, text):
        if text.strip():
            for cell in self.open_cells:
                cell.append(text.strip())

    def block(self):
        return {"type": "table", "rows": [[tidy(" ".join(c)) for c in row] for row in self.rows if row]}


class Code(Capture):
    """The first ``code`` element of a box, as it is; ``br`` is a line end."""

    def __init__(self, tag, classes):
        super().__init__(tag, classes)
        self.inside, self.done = 0, False

    def opened(self, tag, parent, depth):
        if tag == "code" and not self.done:
            self.inside += 1
        elif tag == "br" and self.inside:
            self.parts.append("\n")

    def closed(self, tag, depth):
        if tag == "code" and self.inside:
            self.inside -= 1
            self.done = not self.inside

    def said(self, text):
        if self.inside:
            self.parts.append(text)

    def block(self):
        language = next((c[len("language-") :] for c in self.classes if re.fullmatch(r"language-\S+", c)), None)
        return {"type": "code", "language": language, "tab_label": None, "text": "".join(self.parts).rstrip("\n")}


#: The capture that an element of the content begins.
CAPTURES: dict[str, type[Capture]] = {**{f"h{i}": Heading for i in range(1, 7)}, "p": Paragraph, "ul": Listing, "ol": Listing, "table": Table}


class PageReader(HTMLParser):
    """Events of a page with unclosed elements ended where the next begins.

    ``element_opened(tag, attrs, classes, depth)`` and ``element_closed(tag, depth)`` come in
    pairs, ``text_found`` gives shown text. Nothing recurses, so depth has no limit.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.counts: Counter[str] = Counter()

    def element_opened(self, tag: str, attrs: dict[str, str], classes: list[str], depth: int) -> None: ...

    def element_closed(self, tag: str, depth: int) -> None: ...

    def text_found(self, text: str) -> None: ...

    def cut(self, depth: int) -> None:
        while len(self.path) > depth:
            tag = self.path.pop()
            self.counts[tag] -= 1
            self.element_closed(tag, len(self.path))

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag)
        if ends and any(self.counts[t] for t in ends):
            scope = SCOPES.get(tag, _INNER)
            for i in range(len(self.path) - 1, -1, -1):
                if self.path[i] in ends:
                    self.cut(i)
                elif self.path[i] in scope:
                    break
        named = {k: v or "" for k, v in attrs}
        self.element_opened(tag, named, named.get("class", "").split(), len(self.path))
        if tag in VOID:
            self.element_closed(tag, len(self.path))
        else:
            self.path.append(tag)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.counts[tag]:
            self.cut(len(self.path) - 1 - self.path[::-1].index(tag))

    def handle_data(self, data):
        if not (self.path and self.path[-1] in HIDDEN):
            self.text_found(data)

    def read(self, html: str) -> PageReader:
        self.feed(html)
        self.close()
        self.cut(0)
        return self

