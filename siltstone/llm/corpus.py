"""Views of the tables that several problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def current(chunks: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``chunks`` whose (doc_id, document_version) occurs in ``documents``, with
    the named ``columns`` of the document. Rows of ``documents`` count once."""
    keys = documents.select("doc_id", "document_version", *columns).distinct()
    return chunks.join(keys, ["doc_id", "document_version"])
