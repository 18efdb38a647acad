"""Splitting oversized items at natural boundaries, with overlap (problem 5).

A text is cut by one regular expression with bounded quantifiers. Its alternatives are
ordered by the strength of the boundary: each takes as much as the limit allows and ends at
a blank line, a line end, a sentence end, a comma or bracket, a blank, or, failing all, at
the limit itself. Stronger boundaries are taken only in the second half of a piece, so
pieces stay large. All of it is SQL array functions on the executors' JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.nodes import heading_path, node_units

LIMIT, OVERLAP = 1600, 240


def piece_pattern(most: int) -> str:
    """Consecutive matches cover the whole text, each at most ``most`` code points long."""
    half, least = most // 2, max(1, most // 4)
    ends = [
        rf".{{{half},{most - 2}}}\n\n",
        rf".{{{half},{most - 1}}}\n",
        rf".{{{half},{most - 3}}}(?:[.!?…][\"'”’)\]]?\s|[。！？])",
        rf".{{{least},{most - 2}}}(?:[,;:)\]}}]\s|[，；：、])",
        rf".{{{least},{most - 1}}}\s",
        rf".{{1,{most}}}",
    ]
    # what is left and fits stays whole
    return rf"(?sU).{{1,{most}}}\z|" + "|".join(ends)


def split_pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<piece_no, start, overlap, piece>>: ``piece`` is at most ``limit`` code points.

    ``start`` is the offset of the piece in the text, and its first ``overlap`` code points
    repeat the end of the piece before, from a word boundary on where there is one. Without the
    overlaps the pieces are the text, nothing left out. A text within the limit is one piece;
    an empty one none, a null one null.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    core = F.regexp_extract_all(text, F.lit(piece_pattern(limit - overlap)), F.lit(0))
    parts = F.when(F.length(text) <= limit, F.filter(F.array(text), lambda t: F.length(t) > 0)).otherwise(core)

    def starts(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        )["starts"]

    def piece(parts: Column, begun: Column, p: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        tail = F.substring(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap))
        # from the first word that begins in the lookback on
        shared = F.when((i > 0) & (F.lit(overlap) > 0), F.coalesce(F.nullif(F.regexp_extract(tail, r"(?sU)^\S*\s+(\S.*)$", 1), F.lit("")), tail)).otherwise("")
        return F.struct(
            i.alias("piece_no"), (F.get(begun, i) - F.length(shared)).alias("start"), F.length(shared).alias("overlap"), F.concat(shared, p).alias("piece")
        )

    # arrays of one, so that the parts and their offsets are bound once a text and not worked out again for each piece
    bound = F.transform(F.array(parts), lambda x: F.struct(x.alias("parts"), starts(x).alias("begun")))
    return F.get(F.transform(bound, lambda b: F.transform(b["parts"], lambda p, i: piece(b["parts"], b["begun"], p, i))), F.lit(0))


def oversized_units(chunks: DataFrame, extracted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_kind, item_id, item_no, unit_no, heading_path, text) of every unit over ``limit`` code points.

    ``chunk``: a chunk_text, item_no and unit_no 0. ``node``: a unit of a node, item_no the
    node's index in its document and unit_no the unit's in the node. Null texts are no units;
    identical units of the same place count once.
    """
    of_chunks = chunks.where(F.length("chunk_text") > limit).select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit(0).alias("item_no"), F.lit(0).alias("unit_no"), "heading_path", F.col("chunk_text").alias("text")
    )
    nodes = extracted.select("doc_id", "nodes", F.posexplode("nodes").alias("item_no", "node"))
    units = nodes.select("doc_id", "nodes", "item_no", F.posexplode(node_units(F.col("node"))).alias("unit_no", "text")).where(F.length("text") > limit)
    of_nodes = units.select(F.lit("node").alias("item_kind"), F.col("doc_id").alias("item_id"), "item_no", "unit_no", heading_path(F.col("nodes"), F.col("item_no")).alias("heading_path"), "text")
    return of_chunks.unionByName(of_nodes)


def oversized_pieces(chunks: DataFrame, extracted: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id, item_no, unit_no, heading_path, piece_no, start, overlap, piece).

    All pieces of all oversized units, see ``oversized_units`` and ``split_pieces``. Nothing is
    shuffled but to drop repeated rows, which are compared by a hash of their text first. Empty
    tables give no rows; a null id stays null; other columns, whatever their names, are ignored.
    """
    units = oversized_units(chunks, extracted, limit).dropDuplicates(["item_kind", "item_id", "item_no", "unit_no", "heading_path", "text"])
    return units.select("item_kind", "item_id", "item_no", "unit_no", "heading_path", F.inline(split_pieces(F.col("text"), limit, overlap)))


def rebuilt_units(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id, item_no, unit_no, pieces, longest, most_overlap, text): the units put together again
    from their pieces, each without what it repeats. A unit's pieces are no more than the unit."""
    unit = ["item_kind", "item_id", "item_no", "unit_no"]
    own = F.expr("substring(piece, overlap + 1)")
    each = F.array_sort(F.collect_list(F.struct("start", own.alias("own"))))
    sizes = [F.count("*").alias("pieces"), F.max(F.length("piece")).alias("longest"), F.max("overlap").alias("most_overlap")]
    return pieces.groupBy(*unit, "heading_path").agg(*sizes, F.array_join(each["own"], "").alias("text")).drop("heading_path")
