"""Fetched pages to typed blocks, title, date, hash and markdown."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltstone.functions.html import CAPTURES, Capture, Code, PageReader, tidy
from siltstone.functions.identity import canonical_url
from siltstone.functions.nodes import NODES, markdown

#: Marks of the site generator's article body, code boxes, tabs and date.
BODY, CODE_BOX, TABS, UPDATED = "theme-doc-markdown", "codeBlockContainer", "tabs-container", "theme-last-updated"
_FIELDS = ("type", "level", "text", "language", "tab_label", "ordered", "items", "rows")


class _Tabs:
    """A tab container: names of its tabs, the code blocks of each panel, where the open panel began."""

    def __init__(self, depth: int):
        self.depth, self.names, self.panels, self.panel_at, self.name_at = depth, [], [], None, None

    def label(self) -> None:
        if len(self.names) == len(self.panels):
            for name, blocks in zip(self.names, self.panels):
                for b in blocks:
                    b["tab_label"] = tidy(" ".join(name))


class ArticleReader(PageReader):
    """Blocks of the first article of a page: of its marked body, or of all of it where no body is marked."""

    def __init__(self):
        super().__init__()
        self.article_at = self.body_at = self.dated_at = self.date = None
        self.over = False
        self.blocks: list[dict] = []
        self.capture: Capture | None = None
        self.capture_at = 0
        self.tabs: list[_Tabs] = []

    def element_opened(self, tag, attrs, classes, depth):
        if self.dated_at is None and tag == "span" and UPDATED in classes:
            self.dated_at = depth
        elif self.dated_at is not None and tag == "time" and "datetime" in attrs and self.date is None:
            self.date = attrs["datetime"]
        if self.capture:
            self.capture.opened(tag, self.path[-1], depth)
        elif self.over:
            return
        elif self.article_at is None:
            self.article_at = depth if tag == "article" else None
        elif tag == "div" and BODY in classes and self.body_at is None:
            self.body_at, self.blocks, self.tabs = depth, [], []  # what came before is not the body
        else:
            self._within(tag, attrs, classes, depth)

    def _within(self, tag: str, attrs: dict, classes: list[str], depth: int) -> None:
        tabs = self.tabs[-1] if self.tabs else None
        role = attrs.get("role")
        if TABS in classes:
            self.tabs.append(_Tabs(depth))
        elif tabs and tabs.panel_at is None:
            if tag == "li" and role == "tab":
                tabs.names.append([])
                tabs.name_at = depth
            elif tag == "div" and role == "tabpanel":
                tabs.panels.append([])
                tabs.panel_at = depth
        else:
            boxed = tag == "div" and any(CODE_BOX in c for c in classes)
            kind = Code if boxed else CAPTURES.get(tag)
            if kind:
                self.capture, self.capture_at = kind(tag, classes), depth

    def element_closed(self, tag, depth):
        if self.dated_at == depth:
            self.dated_at = None
        if self.capture and depth > self.capture_at:
            self.capture.closed(tag, depth)
            return
        if self.capture:
            block = self.capture.block()
            self.capture = None
            if block:
                self.blocks.append(block)
                if block["type"] == "code" and self.tabs:
                    self.tabs[-1].panels[-1].append(block)
        if self.tabs:
            tabs = self.tabs[-1]
            if depth == tabs.name_at:
                tabs.name_at = None
            if depth == tabs.panel_at:
                tabs.panel_at = None
            if depth == tabs.depth:
                self.tabs.pop().label()
        if depth == (self.article_at if self.body_at is None else self.body_at):
            self.over = True

    def text_found(self, text):
        if self.capture:
            self.capture.said(text)
        elif self.tabs and self.tabs[-1].name_at is not None and text.strip():
            self.tabs[-1].names[-1].append(text.strip())


def _extracted(html: str) -> tuple:
    """Of a page: title, date, blocks, hash, error. No page, however broken, stops the job."""
    try:
        page = ArticleReader().read(html)
    except Exception as e:  # noqa: BLE001
        return None, None, None, None, f"{type(e).__name__}: {e}"
    title = next((b["text"] for b in page.blocks if b["type"] == "heading" and b["level"] == 1), None)
    if title is None:
        return None, None, None, None, "no title in the article" if page.body_at is not None else "no article body"
    digest = hashlib.sha256(json.dumps(page.blocks, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return title, page.date, [{k: b.get(k) for k in _FIELDS} for b in page.blocks], digest, None


def extract_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, title, source_last_updated, nodes, source_content_hash, markdown_body, error) of each page.

    ``pages``: doc_id, html. Unclosed paragraphs, items and cells are ended where the next
    begins. A page without an article body or title has an ``error`` and nulls; a null html
    gives no row. Parsing is Python in Arrow batches; the markdown is rendered by SQL functions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *_extracted(h)) for d, h in zip(frame["doc_id"], frame["html"])]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "source_last_updated", "nodes", "source_content_hash", "error"])

    schema = f"doc_id string, title string, source_last_updated string, nodes {NODES}, source_content_hash string, error string"
    found = pages.where(F.col("html").isNotNull()).select("doc_id", "html").mapInPandas(run, schema)
    return found.withColumn("markdown_body", F.when(F.col("error").isNull(), markdown(F.col("nodes"))))


def document_shells(fetched: DataFrame) -> DataFrame:
    """(doc_id, requested_url, canonical_url, status, http_status, error_message) of pages that brought no content.

    A page that was not found is ``removed``; any other failure, an answer without html or an
    address among them, is ``fetch_failed``. Title, date, hash and version are unknown then.
    """
    came = (F.col("outcome") == "ok") & (F.length("html") > 0) & (F.length("resolved_url") > 0)
    status = F.when(F.col("outcome") == "not_found", "removed").otherwise("fetch_failed").alias("status")
    failed = fetched.where(~F.coalesce(came, F.lit(False)))
    return failed.select("doc_id", "requested_url", canonical_url(F.col("requested_url")).alias("canonical_url"), status, "http_status", "error_message")
