"""Main content of web pages, apart from site furniture, by two-pass block rules (problem 3).

A page is cut into blocks of text, each with the layout element it stands in (its place), its
length, its share of stop words and its link density. The first pass decides blocks by these
figures alone: link lists and legal marks are furniture, long text rich in stop words is
content, what is short stays open. Length is measured twice, on the block and on its place: a
place with little running text, set against the one that has most, is short as a whole, and
its blocks stay open too. In the second pass every open block takes the label of the nearest
decided block, where near means within the same place: a short place has no content in it, so
what stands there is furniture. Headings belong to what follows them.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed value: frequent words of running text in English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can could do does each for from had has have he her his how i if in "
    "into is it its may more most must my no not of on one only or other our out over she should so some such than that the their them then there "
    "these they this to two up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer es für ist im in mit nicht oder sich sie sind und von werden wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il la le les leur ne ou par pas pour qui que sa ses son sont sur un une vous "
    "al como con del el en es esta este la las los más no para pero por se sin son su sus un una y".split()
)
#: An unclosed comment ends with the page; a tag ends before the next one begins. Both keep the scan linear.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^<>]*)>", re.S)
_HIDDEN = frozenset("script style head noscript template".split())
_PLACES = frozenset("div section article main nav header footer aside td th body form dialog".split())
_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote dt dd figcaption caption".split())
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?…:;][\"”’')\]]*$")


class Block:
    """A piece of page text: its kind, the place where it stands, and the figures the rules use."""

    __slots__ = ("kind", "text", "key", "place", "linked", "words", "stops", "label")

    def __init__(self, kind: str, text: str, place: int, linked: int):
        self.kind, self.text, self.place = kind, text, place
        found = _WORD.findall(text.lower())
        self.words, self.stops = len(found), sum(map(STOP_WORDS.__contains__, found))
        self.key = "".join(found)
        self.linked = linked / max(1, len(text))
        self.label = ""


def page_blocks(html: str) -> list[Block]:
    """Blocks of a page in reading order; unclosed and crossed tags are mended on the way."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("body", 0)]  # open places: tag, number
    places, kind, buffer, linked, depth_a, at = 1, "", [], 0, 0, 0

    def flush() -> None:
        nonlocal buffer, linked
        text = "".join(buffer)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            # a cell with nothing but text belongs to the place around its table
            number = (stack[-2] if kind == "cell" and len(stack) > 1 else stack[-1])[1]
            out.append(Block(kind or "text", text, number, linked))
        buffer, linked = [], 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if depth_a:
                linked += len(text.strip())

    code, hidden = 0, ""
    ends: dict[str, int] = {}  # where the last end tag of each hidden element is
    for tag in _TAG.finditer(html):
        name, closing = (tag[2] or "").lower(), bool(tag[1])
        if hidden:  # nothing counts up to the end tag
            if closing and name == hidden:
                hidden, at = "", tag.end()
            continue
        put(html[at : tag.start()])
        at = tag.end()
        if not name:
            continue
        if name in _HIDDEN and not closing:
            if name not in ends:
                ends[name] = max((m.start() for m in re.finditer(f"</{name}\\b", html, re.I)), default=-1)
            if at <= ends[name]:
                hidden = name
            continue
        if name == "a":
            depth_a = 0 if closing else 1
        elif name == "br":
            flush() if kind == "pre" else buffer.append(" ")
        elif name == "pre":
            flush()
            code, kind = (0, "") if closing else (1, "pre")
        elif code:
            continue
        elif name in ("td", "th") and closing:
            flush()
            if stack[-1][0] == name:
                stack.pop()
            kind = ""
        elif name in _PLACES:
            flush()
            kind = "cell" if name in ("td", "th") else ""
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name != "body":
                stack.append((name, places))
                places += 1
        elif name in _BLOCKS:
            flush()
            kind = "" if closing else name
        elif name in ("ul", "ol", "table", "tr", "dl", "hr"):
            flush()
            kind = ""
    put(html[at:])
    flush()
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def decide(
    blocks: list[Block], *, long_words: int = 12, short_words: int = 4, stops_low: float = 0.2, stops_high: float = 0.3, link_density: float = 0.33, place_share: float = 0.3
) -> None:
    """First pass: good, bad, near (like content, but not long or dense enough) or open, by figures.

    Blocks of a place with under ``place_share`` of the running words of the place that has
    most are not long enough, whatever their own length.
    """
    runs = _item_runs(blocks)
    running: Counter[int] = Counter()
    for i, b in enumerate(blocks):
        density = b.stops / max(1, b.words)
        if b.linked > link_density or "©" in b.text[:20] or i in runs:
            b.label = "bad"
        elif b.kind in ("pre", "cell"):
            b.label = "near"
        elif b.kind in _HEADINGS or b.words < short_words:
            b.label = "open"
        elif density >= stops_high and b.words > long_words:
            b.label = "good"
        elif density >= stops_low and _SENTENCE.search(b.text):
            b.label = "near"
        else:
            b.label = "open"
        running[b.place] += b.words if b.label == "good" else b.words / 2 if b.label == "near" else 0
    most = max(running.values(), default=0)
    for b in blocks:
        if b.label in ("good", "near") and b.kind != "pre" and running[b.place] < place_share * most:
            b.label = "open"


def _item_runs(blocks: list[Block]) -> set[int]:
    """Items of lists most of whose items are no sentences: lists of links, marked as such or not."""
    out: set[int] = set()
    i = 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and blocks[j].kind == "li" and blocks[j].place == blocks[i].place:
            j += 1
        items = blocks[i:j]
        if items and sum(not _SENTENCE.search(b.text) and b.words <= 12 for b in items) * 2 > len(items):
            out.update(range(i, j))
        i = max(j, i + 1)
    return out


def inherit(blocks: list[Block]) -> None:
    """Second pass: what is open takes the label of the nearest decided block of its place.

    Of two at the same distance the content counts. Where nothing is decided, nothing is
    content. A heading takes the label of the next block of its place that is none, or of the
    next block of the page after a place of headings alone.
    """
    by_place: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        by_place[b.place].append(i)
    decided = {place: [i for i in members if blocks[i].label != "open"] for place, members in by_place.items()}
    labels = ["good" if b.label == "near" else b.label for b in blocks]
    for i, b in enumerate(blocks):
        if b.label == "open" and b.kind not in _HEADINGS:
            at = bisect(decided[b.place], i)
            beside = decided[b.place][max(0, at - 1) : at + 1]
            near = min(beside, key=lambda d: (abs(d - i), blocks[d].label == "bad"), default=None)
            labels[i] = "bad" if near is None else labels[near]
    bare = {place for place, members in by_place.items() if all(blocks[i].kind in _HEADINGS for i in members)}
    last = {place: max((i for i in members if blocks[i].kind not in _HEADINGS), default=-1) for place, members in by_place.items()}
    below: dict[int, str] = {}  # the label of the next block of a place, reading backwards
    following = "bad"
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.kind in _HEADINGS and b.label == "open":
            labels[i] = following if b.place in bare else below.get(b.place) or labels[last[b.place]]
        else:
            below[b.place] = following = labels[i]
    for b, label in zip(blocks, labels):
        b.label = label


def main_blocks(html: str) -> list[Block]:
    """Blocks of a page, labelled good or bad."""
    blocks = page_blocks(html)
    decide(blocks)
    inherit(blocks)
    return blocks


_MARK = re.compile(r"^\s*(?:#{1,6}\s+|[•*+-]\s+|\d+[.)]\s+|>\s*)")


def markdown_units(lines: list[str]) -> list[tuple[str, str, int] | None]:
    """(kind, text without its mark, place) of each line, None for blank ones. What stands
    before the first title is a place of its own."""
    out: list[tuple[str, str, int] | None] = []
    fence, place = False, int(any(x.startswith("# ") for x in lines))
    for line in lines:
        text = line.strip()
        if text.startswith("```"):
            fence = not fence
            out.append(("pre", text, place))
        elif fence:
            out.append(("pre", text, place) if text else None)
        elif not text:
            out.append(None)
        elif text[0] == "|":
            out.append(("cell", text, place))
        else:
            mark = _MARK.match(text)
            kind = "p" if not mark else f"h{min(6, mark[0].count('#'))}" if text[0] == "#" else "li"
            place = 0 if kind == "h1" else place
            out.append((kind, text[mark.end() :] if mark else text, place))
    return out


def furniture_lines(markdown: str, html: str | None) -> list[int]:
    """Numbers of the non-blank lines of an extraction that are not main content.

    Each line takes the label of the page's block with the same words, searched onward from
    the one matched before; lines without one (no page, or a changed one) are judged on the
    markdown alone. Fences and table rules go with what they enclose, and so does a label in
    bold before a fence.
    """
    units = markdown_units(markdown.split("\n"))
    where: dict[str, list[int]] = defaultdict(list)
    blocks = main_blocks(html) if html else []
    for i, b in enumerate(blocks):
        where[b.key].append(i)
    at, labels, alone = 0, {}, []
    for n, unit in enumerate(units):
        if unit is None:
            continue
        kind, text, _ = unit
        if kind == "pre":
            labels[n] = "good"
            continue
        cells = text.strip("|").split("|") if kind == "cell" else [text]
        key = next((k for k in ("".join(_WORD.findall(c.lower())) for c in cells) if k), "")
        found = where.get(key) if key else None
        if found:
            i = next((x for x in found if x >= at), found[0])
            at, labels[n] = i, blocks[i].label
        elif kind == "cell" and n and (n - 1) in labels:
            labels[n] = labels[n - 1]
        elif text.startswith("**") and next((u[0] for u in units[n + 1 :] if u), "") == "pre":
            labels[n] = "good"
        else:
            alone.append(n)
    if alone:
        own = [(n, Block(kind, text, place, 0)) for n, (kind, text, place) in ((n, u) for n, u in enumerate(units) if u)]
        decide([b for _, b in own])
        inherit([b for _, b in own])
        labels = {n: b.label for n, b in own} | labels
    return [n for n, label in sorted(labels.items()) if label == "bad"]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [furniture_lines(m, h) if m else [] for m, h in zip(batch.column("_markdown").to_pylist(), batch.column("_html").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_markdown"), pa.array(found, pa.list_(pa.int32()))], names=["_doc", "_markdown", "_lines"])


def _joined(extracted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(_doc, _markdown, _html, _lines): each distinct extraction with the latest page of its
    document (ties to the larger html) and the numbers of its furniture lines."""
    pages = fetched.where(F.col("html").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.max_by("html", F.struct("fetched_at", "html")).alias("_html"))
    rows = extracted.where(F.col("markdown_body").isNotNull()).select(F.col("doc_id").alias("_doc"), F.col("markdown_body").alias("_markdown"))
    both = rows.join(pages, "_doc", "left")
    return both.mapInArrow(_pages, f"_doc {extracted.schema['doc_id'].dataType.simpleString()}, _markdown string, _lines array<int>")


def site_lines(extracted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(doc_id, line_no): non-blank lines of markdown_body that are not main content.

    The latest fetched page of the document, if there is one, tells where each line stands.
    Null bodies have no lines, a document without a page is judged by its markdown. Repeated
    rows count once. Empty tables give no rows; other columns, whatever their names, are
    ignored; pages and bodies of any length are read whole.
    """
    return _joined(extracted, fetched).select(F.col("_doc").alias("doc_id"), F.explode("_lines").alias("line_no")).distinct()


def main_bodies(extracted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(doc_id, main_body, removed_lines): each extraction without its furniture lines.

    One row a row of ``extracted`` with a body; runs of blank lines left behind shrink to one.
    """
    lines = F.split("_markdown", "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("_lines", i), x)), lambda x: x.isNotNull())
    body = F.regexp_replace(F.array_join(left, "\n"), r"\n{3,}", "\n\n")
    return _joined(extracted, fetched).select(F.col("_doc").alias("doc_id"), F.trim(body, F.lit("\n")).alias("main_body"), F.size("_lines").alias("removed_lines"))


def page_texts(fetched: DataFrame) -> DataFrame:
    """(doc_id, fetched_at, main_text): the content blocks of each fetched page, one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(b.text for b in main_blocks(h) if b.label == "good") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fetched_at"), pa.array(texts, pa.string())], names=["doc_id", "fetched_at", "main_text"])

    rows = fetched.where(F.col("html").isNotNull()).select("doc_id", "fetched_at", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, fetched_at {kinds['fetched_at']}, main_text string")
