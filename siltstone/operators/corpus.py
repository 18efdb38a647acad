"""Relational operators over documents, chunks and cached vectors. DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CURRENT = ("ok", "pending_snapshot")
VERSION = ["doc_id", "document_version"]


def current_chunks(chunks: DataFrame, documents: DataFrame, statuses: tuple[str, ...] = CURRENT) -> DataFrame:
    """Chunks of the current version of documents in use, identical rows once."""
    keys = documents.where(F.col("status").isin(*statuses)).select(*VERSION)
    return chunks.join(keys, VERSION, "left_semi").distinct()


def ordered_chunks(chunks: DataFrame, documents: DataFrame, statuses: tuple[str, ...] = CURRENT) -> DataFrame:
    """Current chunks in the order of document, version and position, as an index is built from
    them; that there are none is an error."""
    found = current_chunks(chunks, documents, statuses)
    if not found.limit(1).count():
        raise ValueError("no chunk is current")
    return found.orderBy(*VERSION, "position", "chunk_id")


def missing_embeddings(chunks: DataFrame, vectors: DataFrame, model: str, revision: str) -> DataFrame:
    """Chunks without a cached vector of this model and revision."""
    cached = vectors.where((F.col("embedding_model") == model) & (F.col("embedding_revision") == revision)).select("chunk_id")
    return chunks.join(cached, "chunk_id", "left_anti")


def embedding_gaps(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model, revision, chunk_id) of chunks that lack a vector, for every vector space in the cache.

    The spaces, one a model and revision, are listed on the driver.
    """
    spaces = vectors.select("embedding_model", "embedding_revision").distinct().collect()
    each = F.array(*[F.struct(F.lit(m).alias("embedding_model"), F.lit(r).alias("embedding_revision")) for m, r in spaces]).cast("array<struct<embedding_model:string,embedding_revision:string>>")
    wanted = chunks.select("chunk_id").distinct().select(F.inline(each), "chunk_id")
    cached = vectors.select("embedding_model", "embedding_revision", "chunk_id")
    return wanted.join(cached, ["embedding_model", "embedding_revision", "chunk_id"], "left_anti")


def chunk_vectors(chunks: DataFrame, vectors: DataFrame, model: str, revision: str, dimension: int) -> DataFrame:
    """Each chunk with its latest vector and ``problem``: missing, dimension, or null if it can be used."""
    own = vectors.where((F.col("embedding_model") == model) & (F.col("embedding_revision") == revision))
    last = own.groupBy("chunk_id").agg(F.max_by("vector", F.struct("created_at", "vector")).alias("vector"))
    joined = chunks.join(last, "chunk_id", "left")
    problem = F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != dimension, "dimension")
    return joined.withColumn("problem", problem)


def neighbours(chunks: DataFrame, anchors: DataFrame, radius: int = 1) -> DataFrame:
    """(anchor_id, chunk_id, position): chunks of the anchor's document version at most ``radius`` away, itself included.

    A band join by equality: each chunk is placed in the buckets its band touches, so that a
    document with a third of all chunks is not joined with itself.
    """
    width = 2 * radius + 1
    keyed = anchors.select(F.col("chunk_id").alias("anchor_id"), *VERSION, F.col("position").alias("_at"))
    low, high = F.floor((F.col("_at") - radius) / width), F.floor((F.col("_at") + radius) / width)
    left = keyed.withColumn("_bucket", F.explode(F.sequence(low, high)))
    right = chunks.select("chunk_id", *VERSION, "position").withColumn("_bucket", F.floor(F.col("position") / width))
    near = F.abs(F.col("position") - F.col("_at")) <= radius
    return left.join(right, [*VERSION, "_bucket"]).where(near).select("anchor_id", "chunk_id", "position")


def read_in_order(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of ``chunks`` by request (request_id, ids): the requested order, unknown ids dropped, repeats repeated."""
    asked = requests.select("request_id", F.posexplode("ids").alias("ord", "chunk_id"))
    return asked.join(chunks, "chunk_id")


def documents_scan(documents: DataFrame) -> DataFrame:
    """The columns a refresh works on, one row a document: origins joined by ``|``, no count is 0."""
    named = [
        "doc_id", "requested_url", "canonical_url", "title", "category", "source_last_updated", "source_content_hash", "document_version", "status",
        "indexed_content_hash", "indexed_source_last_updated", "chunked_content_hash", "chunked_source_last_updated", "chunked_document_version", "error_message",
    ]
    misses = F.coalesce("consecutive_404_count", F.lit(0)).alias("consecutive_404_count")
    return documents.select(*named, misses, F.array_join("source_origins", "|").alias("origins")).distinct()


CHECKPOINTS = ("indexed_content_hash", "indexed_source_last_updated", "chunked_content_hash", "chunked_source_last_updated")


def clear_checkpoints(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleared, counted): all rows with null checkpoints, so that the next refresh takes every
    page for changed; and one row with how many rows had one (``cleared``)."""
    return documents.withColumns({c: F.lit(None).cast("string") for c in CHECKPOINTS}), documents.agg(F.count("indexed_content_hash").alias("cleared"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source``, and those of ``target`` whose key is not among them."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_where_in(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti")


def latest_rows(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """``keys`` and ``columns`` of the last row of each key by ``at``; a null ``at`` is oldest, ties go to the larger values."""
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("_m")).select(*keys, f"_m.{at}", *[f"_m.{c}" for c in columns])


def save_vectors(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """The cache after vectors were saved: those of the same chunk, model and revision make way
    for the incoming ones, of which the latest counts. Saving the same rows again changes nothing."""
    keys = ["chunk_id", "embedding_model", "embedding_revision"]
    return upsert(cache, latest_rows(incoming, keys, "created_at", ["embedding_dimension", "vector"]), keys)


def materialised(documents: DataFrame) -> DataFrame:
    """All rows; those whose snapshot was pending have what is indexed set to what is stored,
    and are ok and published. Doing it again changes nothing."""
    pending = F.coalesce(F.col("status") == "pending_snapshot", F.lit(False))
    new = {
        "indexed_content_hash": F.col("source_content_hash"), "indexed_source_last_updated": F.col("source_last_updated"),
        "status": F.lit("ok"), "last_run_action": F.lit("published"),
    }
    return documents.withColumns({c: F.when(pending, v).otherwise(F.col(c)) for c, v in new.items()})


def without_removed(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks but for those of documents that were removed."""
    return delete_where_in(chunks, documents.where(F.col("status") == "removed"), ["doc_id"])


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, vectors) that are left without the documents of ``gone`` (doc_id), their chunks and those chunks' vectors."""
    pieces = chunks.join(gone.select("doc_id"), "doc_id", "left_semi")
    return delete_where_in(documents, gone, ["doc_id"]), delete_where_in(chunks, gone, ["doc_id"]), delete_where_in(vectors, pieces, ["chunk_id"])


def superseded(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): chunks of other versions than the document's present one are pruned; chunks of unknown documents stay."""
    known = documents.select("doc_id", F.col("document_version").alias("_v")).distinct()
    joined = chunks.join(known, "doc_id", "left")
    stale = F.col("_v").isNotNull() & (F.col("_v") != F.col("document_version"))
    return joined.where(~stale).drop("_v"), joined.where(stale).drop("_v")


def delete_category(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(category, documents, chunks, documents_left, chunks_left): what deleting each category would remove and leave."""
    docs = documents.select("doc_id", "category").distinct()
    pieces = chunks.select("chunk_id", "doc_id").distinct()
    per_doc = docs.groupBy("category").agg(F.count("*").alias("documents"))
    per_chunk = pieces.join(docs, "doc_id").groupBy("category").agg(F.count("*").alias("chunks"))
    totals = docs.agg(F.count("*").alias("_d")).crossJoin(pieces.agg(F.count("*").alias("_c")))  # one row each
    joined = per_doc.join(per_chunk, "category", "left").fillna(0, ["chunks"]).crossJoin(totals)
    return joined.select("category", "documents", "chunks", (F.col("_d") - F.col("documents")).alias("documents_left"), (F.col("_c") - F.col("chunks")).alias("chunks_left"))


def in_path_family(pages: DataFrame, roots: DataFrame, path: Column, host: Column) -> DataFrame:
    """Pages of the host and under the path prefixes of roots (root_id, host, prefix), one row a page and root.

    A page is in if its host is the root's and its path is the prefix without a slash at its
    end, or begins with the prefix. Pages are joined by equality on their host and leading
    characters, cut at the lengths that prefixes have, so no nested loop over roots is needed.
    """
    lengths = sorted({r["n"] for r in roots.select(F.length("prefix").alias("n")).distinct().collect()})  # few: a length each
    if not lengths:
        return pages.join(roots.drop("host", "prefix"), F.lit(False))
    heads = F.array_distinct(F.concat(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)), F.array(F.concat(path, F.lit("/")))))
    exploded = pages.withColumns({"_host": host, "_prefix": F.explode(heads)})
    named = roots.withColumnsRenamed({"host": "_host", "prefix": "_prefix"})
    return exploded.join(named, ["_host", "_prefix"]).drop("_host", "_prefix").distinct()


def first_seen(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def merge_sources(discovered: DataFrame, curated: DataFrame) -> DataFrame:
    """(doc_id, url, category, scope): of several roots the last (by ``root_order``) wins; a curated row
    replaces it, with the scopes of both, sorted and joined by ``|``."""
    last = F.max(F.struct("root_order", "url", "category", "scope"))  # ties go to the larger values
    latest = discovered.groupBy("doc_id").agg(last.alias("_m")).select("doc_id", F.struct("_m.url", "_m.category", "_m.scope").alias("_d"))
    both = latest.join(curated.select("doc_id", F.struct("url", "category", "scope").alias("_c")), "doc_id", "full_outer")
    scopes = F.array_sort(F.array_union(F.coalesce(F.split("_d.scope", r"\|"), F.array()), F.coalesce(F.split("_c.scope", r"\|"), F.array())))
    chosen = F.coalesce("_c", "_d")
    scope = F.when(F.col("_c").isNull(), F.col("_d.scope")).otherwise(F.array_join(F.filter(scopes, lambda x: x != ""), "|"))
    return both.select("doc_id", chosen["url"].alias("url"), chosen["category"].alias("category"), scope.alias("scope"))


def corpus_fingerprint(documents: DataFrame) -> DataFrame:
    """(documents, fingerprint): equal for equal sets of (doc_id, version, date) of documents in use.

    The digests of the rows are added up word by word, so that it is one partial aggregate and
    no task holds the corpus; a sorted list of all rows would be one group.
    """
    used = documents.where(F.col("status").isin(*CURRENT) & F.col("document_version").isNotNull()).select("doc_id", "document_version", "source_last_updated").distinct()
    digest = F.sha2(F.to_json(F.struct("doc_id", "document_version", "source_last_updated"), {"ignoreNullFields": "false"}), 256)
    words = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)) for i in range(8)]
    hexed = F.concat_ws("", *[F.lpad(F.lower(F.hex(F.pmod(w, F.lit(1 << 32)))), 8, "0") for w in words])
    return used.agg(F.count("*").alias("documents"), hexed.alias("fingerprint"))


def validate_vectors(vectors: DataFrame) -> DataFrame:
    """(model, revision, rows, chunks, wrong_dimension, valid) of every vector space."""
    wrong = F.count_if(F.size("vector") != F.col("embedding_dimension"))
    return vectors.groupBy("embedding_model", "embedding_revision").agg(
        F.count("*").alias("rows"), F.count_distinct("chunk_id").alias("chunks"), wrong.alias("wrong_dimension"),
        ((F.count("*") == F.count_distinct("chunk_id")) & (wrong == 0)).alias("valid"),
    )
