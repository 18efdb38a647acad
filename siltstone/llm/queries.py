"""The queries of the training-text problems over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import boilerplate, leakage, mixing, near_duplicates, neighbours, reading, repeated_lines, splitting
from siltstone.llm.corpus import current
from siltstone.llm.groups import connected
from siltstone.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, at, "rag_chunks"), table(spark, at, "rag_documents")


def _pages(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, at, "extracted_docs"), table(spark, at, "fetch_results")


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return repeated_lines.repeated_lines(*_chunks(spark, at), wildcards=False)


def p1_clean_chunks(spark: SparkSession, at: str) -> DataFrame:
    chunks, documents = _chunks(spark, at)
    found = repeated_lines.repeated_lines(chunks, documents, wildcards=False)
    cleaned = repeated_lines.without_lines(chunks.select("chunk_id", "doc_id", "document_version", "chunk_text").distinct(), found)
    return cleaned.select("chunk_id", "doc_id", "document_version", "clean_text", "removed_lines")


def p1_templates(spark: SparkSession, at: str) -> DataFrame:
    return repeated_lines.line_templates(*_chunks(spark, at))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return boilerplate.site_lines(*_pages(spark, at))


def p3_main_bodies(spark: SparkSession, at: str) -> DataFrame:
    return boilerplate.main_bodies(*_pages(spark, at))


def p3_page_texts(spark: SparkSession, at: str) -> DataFrame:
    return boilerplate.page_texts(table(spark, at, "fetch_results"))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(table(spark, at, "rag_chunk_embeddings"), k=5, least=0.8))


def p4_neighbours(spark: SparkSession, at: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, at, "rag_chunk_embeddings"), k=5)


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    pieces = splitting.oversized_pieces(table(spark, at, "rag_chunks"), table(spark, at, "extracted_docs"))
    return pieces.select("item_kind", "item_id", "item_no").distinct()


def p5_pieces(spark: SparkSession, at: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, at, "rag_chunks"), table(spark, at, "extracted_docs"))


def p5_rebuilt(spark: SparkSession, at: str) -> DataFrame:
    """Every oversized unit put together from its pieces, as a digest, and whether they keep the limits."""
    units = splitting.rebuilt_units(p5_pieces(spark, at))
    kept = (F.col("longest") <= splitting.LIMIT) & (F.col("most_overlap") <= splitting.OVERLAP) & (F.col("pieces") > 1)
    return units.select("item_kind", "item_id", "item_no", "unit_no", F.md5(F.encode("text", "UTF-8")).alias("digest"), kept.alias("kept")).distinct()


def _similar(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    chunks, documents = _chunks(spark, at)
    members, links = near_duplicates.near_duplicates(chunks, id_col="chunk_id", text_col="chunk_text", keep=["doc_id", "document_version"], width=3, threshold=0.6)
    return current(members, documents, "canonical_url").distinct(), links


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(*_similar(spark, at), id_col="chunk_id", apart="doc_id")


def p6_groups(spark: SparkSession, at: str) -> DataFrame:
    """One row a current chunk that has a near duplicate or a copy: its class, group and links to other classes."""
    members, links = _similar(spark, at)
    present = members.select("class_id").distinct()
    links = links.join(present.withColumnRenamed("class_id", "class_a"), "class_a", "left_semi").join(present.withColumnRenamed("class_id", "class_b"), "class_b", "left_semi")
    groups = connected(links, "class_a", "class_b")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    copies = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    rows = members.join(copies, "class_id").join(degree, "class_id", "left").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    return rows.where((F.col("copies") > 1) | F.col("links").isNotNull()).select(
        "chunk_id", "doc_id", "canonical_url", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )


def p7_leaks(spark: SparkSession, at: str) -> DataFrame:
    return leakage.leaked_items(table(spark, at, "documents"), table(spark, at, "eval_items"))


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return p7_leaks(spark, at).where(F.col("shared_words") >= 13).select("item_id", "doc_id")


def p8_mix(spark: SparkSession, at: str) -> DataFrame:
    counted = mixing.counted_documents(table(spark, at, "documents"))
    return mixing.mix_sources(counted, table(spark, at, "mix_targets"))[0]


def p8_shares(spark: SparkSession, at: str) -> DataFrame:
    counted = mixing.counted_documents(table(spark, at, "documents"))
    return mixing.mix_sources(counted, table(spark, at, "mix_targets"))[1]


def p9_levels(spark: SparkSession, at: str) -> DataFrame:
    return reading.reading_levels(table(spark, at, "documents"), table(spark, at, "reading_labels"), keep=["lang"])


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    """English documents, as the problem has it, of the levels of all documents."""
    return p9_levels(spark, at).where((F.col("lang") == "en") & (F.col("reading_level") >= 4)).select("doc_id").distinct()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_clean_chunks, p1_templates, p3_found, p3_main_bodies, p3_page_texts, p4_found, p4_neighbours, p5_found, p5_pieces, p5_rebuilt,
        p6_found, p6_groups, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_levels,
    )
}

_LINES = r"""
WITH cur AS (SELECT DISTINCT c.chunk_id, c.doc_id, c.document_version, c.chunk_text, d.category
             FROM rag_chunks c JOIN (SELECT DISTINCT doc_id, document_version, category FROM rag_documents) d USING (doc_id, document_version)),
lines AS (SELECT chunk_id, doc_id, category, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(chunk_text, chr(10)) AS l FROM cur)),
forms AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '[0-9]+', '#', 'g') AS form FROM lines),
fit AS (SELECT * FROM forms WHERE regexp_matches(form, '\p{L}\P{L}+\p{L}+\P{L}+\p{L}')),
covered AS (SELECT category, form, count(DISTINCT doc_id) AS docs FROM fit GROUP BY ALL),
sizes AS (SELECT category, count(DISTINCT doc_id) AS all_docs FROM cur GROUP BY ALL),
found AS (SELECT DISTINCT f.chunk_id, CAST(f.line_no AS INTEGER) AS line_no
          FROM fit f JOIN covered c ON f.form = c.form AND f.category IS NOT DISTINCT FROM c.category
          JOIN sizes s ON f.category IS NOT DISTINCT FROM s.category WHERE c.docs >= 4 AND c.docs >= 0.08 * s.all_docs)
"""

_TEMPLATES = (
    _LINES
    + r""", tok AS (SELECT coalesce('=' || f.category, '') AS source, doc_id, chunk_id, line_no, string_split(form, ' ') AS t, len(string_split(form, ' ')) AS n, s.least
            FROM fit f JOIN (SELECT category, greatest(4, ceil(round(0.08 * all_docs, 6))) AS least FROM sizes) s ON f.category IS NOT DISTINCT FROM s.category),
levels AS (SELECT source, n, list(k) AS kept FROM (
             SELECT source, n, k FROM (SELECT source, n, least, unnest(list_transform(range(1, least(n, 4) + 1), lambda i: i || ' ' || t[i])) AS k FROM tok)
             GROUP BY source, n, k, least HAVING count(*) >= least) GROUP BY ALL),
pathed AS (SELECT *, list_filter(path, lambda x: x <> '<*>') AS named FROM (
             SELECT tok.*, list_transform(range(1, least(n, 4) + 1), lambda i: CASE WHEN list_contains(kept, i || ' ' || t[i]) THEN t[i] ELSE '<*>' END) AS path FROM tok JOIN levels USING (source, n))),
inside AS (SELECT * FROM pathed WHERE 2 * len(named) >= len(path)),
leaves AS (SELECT source, n, path, list(k) AS kept FROM (
             SELECT source, n, path, k FROM (SELECT source, n, path, least, unnest(list_transform(range(5, n + 1), lambda i: i || ' ' || t[i])) AS k FROM inside)
             GROUP BY source, n, path, k, least HAVING count(*) >= least) GROUP BY ALL),
whole AS (SELECT i.*, path || list_transform(range(5, n + 1), lambda i: CASE WHEN list_contains(coalesce(kept, []), i || ' ' || t[i]) THEN t[i] ELSE '<*>' END) AS shape
          FROM inside i LEFT JOIN leaves USING (source, n, path)),
shaped AS (SELECT DISTINCT source, doc_id, chunk_id, line_no, least, array_to_string(shape, ' ') AS template, len(list_filter(shape, lambda x: x = '<*>')) AS slots FROM whole
           WHERE 2 * len(list_filter(shape, lambda x: x = '<*>')) <= n)
"""
)

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

ORACLES: dict[str, str] = {
    "p1_found": _LINES + "SELECT chunk_id, line_no FROM found",
    "p1_clean_chunks": _LINES
    + """, whole AS (SELECT DISTINCT chunk_id, doc_id, document_version, chunk_text FROM rag_chunks),
    parts AS (SELECT chunk_id, doc_id, document_version, chunk_text, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(chunk_text, chr(10)) AS l FROM whole)),
    kept AS (SELECT p.*, f.line_no IS NOT NULL AS gone FROM parts p LEFT JOIN found f ON p.chunk_id = f.chunk_id AND p.line_no = f.line_no)
    SELECT chunk_id, doc_id, document_version, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS clean_text,
           CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed_lines
    FROM kept GROUP BY chunk_id, doc_id, document_version, chunk_text""",
    "p1_templates": _TEMPLATES
    + """SELECT nullif(substr(source, 2), '') AS source, template, CAST(slots AS INTEGER) AS slots, count(*) AS lines, count(DISTINCT doc_id) AS docs
    FROM shaped GROUP BY source, template, slots, least HAVING count(DISTINCT doc_id) >= least""",
    "p5_found": """
    SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id, CAST(0 AS INTEGER) AS item_no FROM rag_chunks WHERE length(chunk_text) > 1600
    UNION
    SELECT DISTINCT 'node', doc_id, CAST(i - 1 AS INTEGER) FROM (
      SELECT doc_id, unnest(range(1, len(nodes) + 1)) AS i, unnest(nodes) AS n FROM extracted_docs)
    WHERE (n.type IN ('paragraph', 'code') AND length(n.text) > 1600)
       OR (n.type = 'list' AND len(list_filter(n.items, lambda x: length(x) > 1600)) > 0)
       OR (n.type = 'table' AND length(array_to_string(list_transform(n.rows, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '')), ' | ')), chr(10))) > 1600)""",
    "p5_rebuilt": """
    WITH n AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS item_no, n FROM (SELECT doc_id, unnest(range(1, len(nodes) + 1)) AS i, unnest(nodes) AS n FROM extracted_docs)),
    u AS (SELECT 'chunk' AS item_kind, chunk_id AS item_id, CAST(0 AS INTEGER) AS item_no, CAST(0 AS INTEGER) AS unit_no, chunk_text AS t FROM rag_chunks
          UNION ALL SELECT 'node', doc_id, item_no, 0, n.text FROM n WHERE n.type IN ('paragraph', 'code')
          UNION ALL SELECT 'node', doc_id, item_no, CAST(k - 1 AS INTEGER), x FROM (SELECT doc_id, item_no, unnest(range(1, len(n.items) + 1)) AS k, unnest(n.items) AS x FROM n WHERE n.type = 'list')
          UNION ALL SELECT 'node', doc_id, item_no, 0, array_to_string(list_transform(n.rows, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '')), ' | ')), chr(10)) FROM n WHERE n.type = 'table')
    SELECT DISTINCT item_kind, item_id, item_no, unit_no, md5(t) AS digest, TRUE AS kept FROM u WHERE length(t) > 1600""",
    "p7_leaks": rf"""
    WITH d AS (SELECT doc_id, {_WORDS.format("replace(replace(text, chr(8203), ''), chr(173), '')")} AS w FROM documents),
    e AS (SELECT item_id, {_WORDS.format("replace(replace(passage, chr(8203), ''), chr(173), '')")} AS w FROM eval_items),
    n AS (SELECT item_id, len(w) AS n FROM e WHERE len(w) >= 5),
    ds AS (SELECT DISTINCT doc_id, i AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
    es AS (SELECT DISTINCT item_id, i AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM e)),
    met AS (SELECT item_id, doc_id, ds.pos - es.pos AS shift, es.pos FROM es JOIN ds USING (g)),
    runs AS (SELECT item_id, doc_id, count(*) + 4 AS len FROM (
               SELECT *, pos - row_number() OVER (PARTITION BY item_id, doc_id, shift ORDER BY pos) AS run FROM met) GROUP BY item_id, doc_id, shift, run)
    SELECT item_id, doc_id, CAST(max(len) AS INTEGER) AS shared_words, max(len) / n AS item_share FROM runs JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING max(len) >= least(13, n)""",
    "p7_found": rf"""
    WITH d AS (SELECT doc_id, {_WORDS.format("replace(replace(text, chr(8203), ''), chr(173), '')")} AS w FROM documents),
    e AS (SELECT item_id, {_WORDS.format("replace(replace(passage, chr(8203), ''), chr(173), '')")} AS w FROM eval_items),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
    eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM e))
    SELECT DISTINCT item_id, doc_id FROM eg JOIN dg USING (g)""",
}
