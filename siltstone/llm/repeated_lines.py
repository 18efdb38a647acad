"""Lines repeated across the documents of one source (problem 1).

Lines are parsed into templates through a token tree of fixed depth: by source, by number of
tokens, then one level for each of the first ``depth`` tokens. A token that the lines of too
few documents have at its position becomes a wildcard slot, so bylines that differ in a name
share a path. The leaf at its end keeps, position by position, the tokens that enough
documents share there; the others are slots too. What is left is the line's template.

The tree of a partition is a set of counts of documents by (source, path, position, token),
and the trees of all partitions merge by adding them up. So a template does not depend on the
order of lines, as it would if they were grouped greedily within a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import squeeze
from siltstone.runtime import settle

#: At least three runs of letters, in a line already in lower case.
_THREE_RUNS = r"\p{L}\P{L}+\p{L}+\P{L}+\p{L}"
#: Fixed value: white space of any script but the line end.
_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WILDCARD = "<*>"


def template(line: Column) -> Column:
    """The form under which lines are the same: lower case, white space squeezed, digit runs as ``#``."""
    return F.regexp_replace(squeeze(F.lower(line)), "[0-9]+", "#")


def line_forms(text: Column) -> Column:
    """array<string>: the form of each line of a text, worked out in one pass over it."""
    folded = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), _BLANKS, " " * len(_BLANKS)), " {2,}", " "), "[0-9]+", "#")
    return F.transform(F.split(folded, "\n"), lambda line: F.trim(line))


def _shared_tokens(lines: DataFrame, place: list[str], tokens: Column, sizes: DataFrame) -> DataFrame:
    """(place, _kept): for each position of ``tokens``, the tokens that enough lines of the source have there.

    Lines are counted by token with partial sums, tokens compared by hash; a line of a chunk
    row that is given n times counts 1 / n each time. All lines of a place have the same number
    of tokens, so ``_kept`` has an entry a position.
    """
    hashed = F.transform(tokens, lambda t, i: F.struct(i.alias("_i"), F.xxhash64(t).alias("_t")))
    counts = lines.select(*place, "_part", F.inline(hashed)).groupBy(*place, "_i", "_t").agg(F.sum("_part").alias("_lines")).join(sizes, "_source")
    shared = counts.groupBy(*place, "_i").agg(F.collect_set(F.when(F.round("_lines", 6) >= F.col("_least"), F.col("_t"))).alias("_ts"))
    return shared.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_i", "_ts")))["_ts"].alias("_kept"))


def _with_slots(tokens: Column) -> Column:
    """``tokens`` with those not kept at their position as slots."""
    return F.transform(tokens, lambda t, i: F.when(F.array_contains(F.get("_kept", i), F.xxhash64(t)), t).otherwise(WILDCARD))


def _constants(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != WILDCARD))


def templates(
    chunks: DataFrame,
    documents: DataFrame,
    *,
    id_col: str = "chunk_id",
    text_col: str = "chunk_text",
    source_col: str = "category",
    least_docs: int = 4,
    least_share: float = 0.08,
    enough_docs: int | None = None,
    depth: int = 4,
    least_constant: float = 0.5,
) -> DataFrame:
    """(_id, _doc, _source, line_no, template, slots): lines whose template covers many documents of their source.

    ``documents`` has doc_id, document_version and the source; chunks of other versions and
    unknown documents are not current and take no part, neither as lines nor as documents.
    Lines with fewer than three runs of letters take no part. A template covers enough
    documents with at least ``least_docs`` and ``least_share`` of the source's documents that
    have current chunks (``enough_docs``, if given, are enough whatever the share). A token
    stays in the tree if as many lines have it in its place, so a line that is repeated word
    by word in enough documents keeps all its tokens: its template is the line itself, with 0
    ``slots``, and the documents it covers are exactly those that have the line. At
    least ``least_constant`` of a template's tokens, in the path and as a whole, must be no
    slots, else unlike lines would share it.

    Each level prunes the next: of lines whose path is mostly slots no tokens are counted.
    ``_source`` is "=" and the source, or empty for null, which is a source of its own, and
    ``_doc`` a hash of the document.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    version = F.when(F.col("doc_id").isNotNull() & F.col("document_version").isNotNull(), F.xxhash64("doc_id", "document_version")).alias("_version")
    # what lines are joined with is written down, so that its size is known when Spark chooses the join
    keys = settle(documents.select(version, source.alias("_source")).where(F.col("_version").isNotNull()).distinct(), "keys")
    current = chunks.select(version, "doc_id").distinct().join(keys, "_version")
    share = F.ceil(F.round(F.lit(least_share) * F.count_distinct("doc_id"), 6))
    least = F.greatest(F.lit(least_docs), share if enough_docs is None else F.least(share, F.lit(enough_docs)))
    sizes = settle(current.groupBy("_source").agg(least.alias("_least")), "sizes")

    each = F.transform(line_forms(F.col(text_col)), lambda form, i: F.struct(i.alias("line_no"), form.alias("form")))
    parsed = F.filter(each, lambda x: x["form"].rlike(_THREE_RUNS))
    row = F.xxhash64(F.col(id_col), "doc_id", "document_version", F.col(text_col)).alias("_row")
    again = settle(chunks.select(row).groupBy("_row").agg(F.count("*").alias("_times")).where(F.col("_times") > 1), "again")
    rows = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64("doc_id").alias("_doc"), version, row, parsed.alias("_lines"))
    part = F.coalesce(1 / F.col("_times"), F.lit(1.0)).alias("_part")
    lines = settle(rows.join(keys, "_version").join(again, "_row", "left").select("_id", "_doc", "_source", part, F.inline("_lines")), "lines")

    tokens = F.split("form", " ")
    lines = lines.select("_id", "_doc", "_source", "_part", "line_no", tokens.alias("_tokens")).withColumn("_n", F.size("_tokens"))
    head, rest = F.slice("_tokens", 1, depth), F.slice("_tokens", depth + 1, F.greatest(F.col("_n") - depth, F.lit(0)))
    levels = settle(_shared_tokens(lines, ["_source", "_n"], head, sizes), "levels")
    # half of the first tokens are the least that a path must share
    pathed = lines.join(levels, ["_source", "_n"]).withColumn("_path", _with_slots(head)).drop("_kept")
    pathed = pathed.where(_constants(F.col("_path")) >= least_constant * F.size("_path")).withColumn("_leaf", F.xxhash64("_n", "_path"))
    leaves = settle(_shared_tokens(pathed.where(F.col("_n") > depth), ["_source", "_leaf"], rest, sizes), "leaves")
    whole = pathed.join(leaves, ["_source", "_leaf"], "left").select("_id", "_doc", "_source", "line_no", "_n", F.concat("_path", _with_slots(rest)).alias("_template"))
    whole = whole.withColumn("slots", F.col("_n") - _constants(F.col("_template"))).where(F.col("_n") - F.col("slots") >= least_constant * F.col("_n"))
    parsed_lines = settle(whole.select("_id", "_doc", "_source", "line_no", F.array_join("_template", " ").alias("template"), "slots"), "templates")

    place = ["_source", "template", "slots"]
    covered = parsed_lines.select(*place, "_doc").distinct().groupBy(*place).agg(F.count("*").alias("_docs")).join(sizes, "_source").where(F.col("_docs") >= F.col("_least"))
    return parsed_lines.join(settle(covered.select(*place), "covered"), place, "left_semi")


def repeated_lines(chunks: DataFrame, documents: DataFrame, *, id_col: str = "chunk_id", wildcards: bool = True, **options) -> DataFrame:
    """(chunk_id, line_no) of lines whose template covers many documents of their source, see ``templates``.

    Without ``wildcards`` only lines that are the same word by word (but for digits) in so many
    documents: those of templates without slots. Lines count from 0.

    A null source is a source of its own. Null texts have no lines; empty texts one line, which
    is never a case. Repeated rows, and repeats of a line within a document, count once.
    Empty tables give no rows. Texts of any length are read whole. Other columns, whatever
    their names, are ignored.

    Every text is parsed once, and its lines are written down. A line in a third of all chunks
    is reduced by partial aggregates before each exchange of counts, and lines meet the tree's
    levels and the templates found in joins with small sides, which Spark broadcasts or, if
    skewed, splits.
    """
    found = templates(chunks, documents, id_col=id_col, **options)
    if not wildcards:
        found = found.where(F.col("slots") == 0)
    return found.select(F.col("_id").alias(id_col), F.col("line_no").cast("int").alias("line_no")).distinct()


def without_lines(chunks: DataFrame, found: DataFrame, *, id_col: str = "chunk_id", text_col: str = "chunk_text") -> DataFrame:
    """Every chunk row with ``clean_text``, its text without the found lines, and ``removed_lines``.

    All rows and columns stay, repeated rows too; a null text stays null, and a text of which
    all lines were found becomes empty.
    """
    gone = found.groupBy(F.col(id_col).alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone"))
    left = F.filter(F.transform(F.split(text_col, "\n"), lambda line, i: F.when(~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i), line)), lambda x: x.isNotNull())
    return (
        chunks.join(gone, chunks[id_col] == gone["_gone_id"], "left")
        .withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
        .withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0)))
        .drop("_gone", "_gone_id")
    )


def line_templates(chunks: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """(source, template, slots, lines, docs): the templates found in each source, slots shown as ``<*>``.

    ``lines`` counts chunk lines, repeated rows of a chunk once; ``docs`` the documents covered.
    """
    found = templates(chunks, documents, **options).distinct()
    one = found.groupBy("_source", "template", "slots", "_doc").agg(F.count("*").alias("_lines"))
    shown = one.groupBy("_source", "template", "slots").agg(F.sum("_lines").alias("lines"), F.count("*").alias("docs"))
    source = F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)).alias("source")
    return shown.select(source, "template", "slots", "lines", "docs")
