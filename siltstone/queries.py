"""Registered queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions import citations, identity as ids
from siltstone.functions.vectors import norm, normalised
from siltstone.operators import chunking, corpus, embedding, evidence, extract, history, search
from siltstone.operators.snapshots import snapshot_changes
from siltstone.plans.refresh import change_counts, plan_refresh
from siltstone.plans.tables import snapshot_rows
from siltstone.runtime import table
from siltstone.streaming.pages import latest_pages

Query = Callable[[SparkSession, str], DataFrame]


def p2_changes(spark: SparkSession, at: str) -> DataFrame:
    return snapshot_changes(table(spark, at, "rag_document_snapshots"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return p2_changes(spark, at).select("snapshot_no", "doc_id", "change")


# The reference's own operators, over whole tables.


def _chunks(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, at, "rag_chunks"), table(spark, at, "rag_documents")


def _current(spark: SparkSession, at: str, *columns: str) -> DataFrame:
    """Current chunks with only these columns and their version, so that no others are shuffled."""
    chunks, documents = _chunks(spark, at)
    return corpus.current_chunks(chunks.select("doc_id", "document_version", *columns), documents)


def fn_urls(spark: SparkSession, at: str) -> DataFrame:
    url = ids.canonical_url(F.col("requested_url"))
    rows = table(spark, at, "rag_documents").select("doc_id", url.alias("url")).distinct()
    return rows.select("doc_id", "url", ids.doc_id(F.col("url")).alias("url_id"), ids.slug(F.col("url")).alias("slug"))


def fn_chunk_ids(spark: SparkSession, at: str) -> DataFrame:
    own = ids.chunk_id(F.col("doc_id"), F.col("document_version"), F.col("position"))
    return table(spark, at, "rag_chunks").select("chunk_id", own.alias("computed_id")).distinct()


def fn_titles(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", ids.history_title(F.col("text")).alias("label"))


def fn_query_keys(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", F.sha2(ids.query_key(F.col("text")), 256).alias("key_hash"))


def fn_terms(spark: SparkSession, at: str) -> DataFrame:
    words = ids.terms(F.col("chunk_text"))
    return table(spark, at, "rag_chunks").select("chunk_id", F.size(words).cast("long").alias("terms"), F.array_join(F.array_sort(words), " ").alias("term_list")).distinct()


def fn_clean_text(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", ids.clean_text(F.col("text")).alias("clean"))


def fn_hash_embedding(spark: SparkSession, at: str) -> DataFrame:
    vector = ids.hash_embedding(F.col("chunk_text"))
    return table(spark, at, "rag_chunks").select("chunk_id", F.posexplode(vector).alias("i", "x")).select("chunk_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x")).distinct()


def join_current_chunks(spark: SparkSession, at: str) -> DataFrame:
    return _current(spark, at, "chunk_id", "position").select("chunk_id", "doc_id", "document_version", "position")


def join_embedding_gaps(spark: SparkSession, at: str) -> DataFrame:
    return corpus.embedding_gaps(_current(spark, at, "chunk_id"), table(spark, at, "rag_chunk_embeddings"))


def join_chunk_vectors(spark: SparkSession, at: str) -> DataFrame:
    chunks = _current(spark, at, "chunk_id").select("chunk_id").distinct()
    joined = corpus.chunk_vectors(chunks, table(spark, at, "rag_chunk_embeddings"), "tess-embed-small", "v1", 64)
    return joined.select("chunk_id", "problem")


def join_neighbours(spark: SparkSession, at: str) -> DataFrame:
    chunks = table(spark, at, "rag_chunks").select("chunk_id", "doc_id", "document_version", "position").distinct()
    return corpus.neighbours(chunks, chunks)


def join_path_families(spark: SparkSession, at: str) -> DataFrame:
    pages = table(spark, at, "rag_documents").select("doc_id", "canonical_url", "category").distinct()
    path = ids.url_path(F.col("canonical_url"))
    host = F.lit("docs.tessoria.example").alias("host")
    roots = pages.select(F.concat(F.lit("/aws/en/"), "category", F.lit("/")).alias("prefix"), host, F.col("category").alias("root_id")).distinct()
    return corpus.in_path_family(pages.select("doc_id", "canonical_url"), roots, path, ids.url_host(F.col("canonical_url"))).select("doc_id", "root_id")


def set_first_seen(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "rag_documents").select(ids.canonical_url(F.col("requested_url")).alias("url"), "doc_id", "requested_url").distinct()
    return corpus.first_seen(rows, ["url"], [F.col("doc_id"), F.col("requested_url")])


def set_origins(spark: SparkSession, at: str) -> DataFrame:
    kept = F.array_sort(F.filter("source_origins", lambda x: x != ""))
    return table(spark, at, "rag_documents").select("doc_id", F.array_join(kept, "|").alias("scope")).distinct()


def _incoming(spark: SparkSession, at: str) -> DataFrame:
    last = table(spark, at, "rag_document_snapshots").where(F.col("doc_id").isNotNull())
    newest = F.max(F.struct("snapshot_no", "retrieved_at", "title", "category", "status")).alias("_m")
    return last.groupBy("doc_id").agg(newest).select("doc_id", "_m.title", "_m.category", "_m.status")


def dml_upsert(spark: SparkSession, at: str) -> DataFrame:
    target = table(spark, at, "rag_documents").select("doc_id", "title", "category", "status").distinct()
    return corpus.upsert(target, _incoming(spark, at), ["doc_id"])


def dml_prune_versions(spark: SparkSession, at: str) -> DataFrame:
    chunks, documents = _chunks(spark, at)
    return corpus.superseded(chunks.select("chunk_id", "doc_id", "document_version").distinct(), documents)[0]


def dml_save_embeddings(spark: SparkSession, at: str) -> DataFrame:
    """The first vectors of all keys are in the cache; those made again are saved over them."""
    vectors = table(spark, at, "rag_chunk_embeddings")
    keys = ["chunk_id", "embedding_model", "embedding_revision"]
    begun = vectors.groupBy(*keys).agg(F.min("created_at").alias("_first"))
    dated = vectors.join(begun, keys).withColumn("_old", F.col("created_at") == F.col("_first"))
    old = corpus.latest_rows(dated.where("_old"), keys, "created_at", ["embedding_dimension", "vector"])
    saved = corpus.save_vectors(old, dated.where("not _old"))
    first = F.get("vector", F.lit(0)).cast("double")
    return saved.select(
        *keys, F.unix_micros("created_at").alias("created_us"), "embedding_dimension", F.size("vector").cast("long").alias("numbers"),
        F.when(~F.isnan(first), F.round(first, 6)).alias("first"),
    )


def _documents(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "rag_documents").distinct()


def dml_materialise(spark: SparkSession, at: str) -> DataFrame:
    done = corpus.materialised(_documents(spark, at))
    return done.select("doc_id", "canonical_url", "status", "last_run_action", "indexed_content_hash", "indexed_source_last_updated")


def dml_drop_removed(spark: SparkSession, at: str) -> DataFrame:
    chunks, documents = _chunks(spark, at)
    return corpus.without_removed(chunks.select("chunk_id", "doc_id", "document_version", "position"), documents).distinct()


def dml_replace_chunks(spark: SparkSession, at: str) -> DataFrame:
    """The chunks of the current versions make way for all chunks their documents had."""
    chunks = table(spark, at, "rag_chunks").select("chunk_id", "doc_id", "document_version", "position").distinct()
    fresh = chunks.join(table(spark, at, "rag_documents").select("doc_id", "document_version"), ["doc_id", "document_version"], "left_semi")
    return corpus.upsert(chunks, fresh, ["doc_id"])


def dml_delete_documents(spark: SparkSession, at: str) -> DataFrame:
    """What is left in three tables without the documents that failed or were removed."""
    documents, chunks, vectors = _documents(spark, at), table(spark, at, "rag_chunks").select("chunk_id", "doc_id").distinct(), table(spark, at, "rag_chunk_embeddings")
    left = corpus.delete_documents(documents.where(F.col("status").isin("removed", "fetch_failed")), documents, chunks, vectors.select("chunk_id", "embedding_model", "embedding_revision").distinct())
    names = ("documents", "chunks", "vectors")
    rows = [d.select(F.lit(n).alias("part"), F.col("doc_id" if n == "documents" else "chunk_id").alias("id")) for n, d in zip(names, left)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("part", "id").agg(F.count("*").alias("n"))


def dml_clear_rows(spark: SparkSession, at: str) -> DataFrame:
    cleared = corpus.clear_checkpoints(_documents(spark, at))[0]
    return cleared.select("doc_id", "canonical_url", "status", *corpus.CHECKPOINTS, "chunked_document_version")


def fn_categories(spark: SparkSession, at: str) -> DataFrame:
    """Categories of pages by path: two families, one page of its own, else what the table has."""
    rules = [("at", "/aws/en/compute", "overview"), ("under", "/aws/en/compute", "aws-compute"), ("under", "/gcp/en/", "gcp")]
    rows = table(spark, at, "rag_documents").select("doc_id", "canonical_url", "category").distinct()
    return rows.select("doc_id", ids.path_category(F.col("canonical_url"), rules, F.col("category")).alias("page_category")).distinct()


def set_merged(spark: SparkSession, at: str) -> DataFrame:
    """Pages of the deliveries as discovered ones, the current ones as a curated list."""
    last = table(spark, at, "rag_document_snapshots").where(F.col("doc_id").isNotNull())
    found = last.select("doc_id", F.col("canonical_url").alias("url"), "category", F.concat(F.lit("delivery-"), "snapshot_no").alias("scope"), F.col("snapshot_no").alias("root_order"))
    listed = table(spark, at, "rag_documents").where(F.col("status") == "ok").groupBy("doc_id").agg(F.max(F.struct(F.col("requested_url").alias("url"), "category")).alias("_m"))
    return corpus.merge_sources(found, listed.select("doc_id", "_m.url", "_m.category", F.lit("curated").alias("scope")))


def src_curated(spark: SparkSession, at: str) -> DataFrame:
    """The table's pages as a list of entries, status as reason, checked."""
    from siltstone.sources.pages import checked_list

    entries = table(spark, at, "rag_documents").select(F.col("requested_url").alias("url"), "category", F.col("error_message").alias("reason")).distinct()
    return checked_list(entries, {"compute", "glossary", "sql"}).select("url", "canonical_url", "category", "reason", "problem")


def ext_shells(spark: SparkSession, at: str) -> DataFrame:
    return extract.document_shells(table(spark, at, "fetch_results").distinct()).distinct()


def join_owned_turns(spark: SparkSession, at: str) -> DataFrame:
    """Orders as turns of their customers' conversations, which customers' nations own; those
    of suppliers ask for the conversations of their number, most of them not theirs."""
    customers = table(spark, at, "customer").select(F.col("c_nationkey").alias("owner_user_id"), F.col("c_custkey").alias("conversation_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("closed").alias("status"))
    asked = table(spark, at, "supplier").select(F.col("s_nationkey").alias("owner_user_id"), F.col("s_suppkey").alias("conversation_id"))
    turns = table(spark, at, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("turn_id"))
    requests = customers.select("owner_user_id", "conversation_id").unionByName(asked)
    return history.owned_turns(requests, turns, customers).select("owner_user_id", "conversation_id", "turn_id")


def top_conversations(spark: SparkSession, at: str) -> DataFrame:
    orders = table(spark, at, "orders").groupBy(F.col("o_custkey").alias("conversation_id")).agg(F.max("o_orderdate").alias("updated_at"))
    customers = table(spark, at, "customer").select(F.col("c_nationkey").alias("owner_user_id"), F.col("c_custkey").alias("conversation_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("closed").alias("status"))
    newest = history.newest_conversations(customers.join(orders, "conversation_id"))
    return newest.select("owner_user_id", F.col("place").cast("long").alias("place"), "conversation_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def ret_read(spark: SparkSession, at: str) -> DataFrame:
    """For each document the chunks 1, 0, one that is unknown, and 1 again, in that order."""
    asked = table(spark, at, "rag_documents").where(F.col("document_version").isNotNull()).select("doc_id", "document_version").distinct()
    wanted = F.array(*[ids.chunk_id(F.col("doc_id"), F.col("document_version"), F.lit(i)) for i in (1, 0, -1, 1)])
    chunks = table(spark, at, "rag_chunks").select("chunk_id", "position").distinct()
    read = corpus.read_in_order(asked.select(F.concat_ws("/", "doc_id", "document_version").alias("request_id"), wanted.alias("ids")), chunks)
    return read.select("request_id", F.col("ord").cast("long").alias("ord"), "chunk_id", "position")


def dml_delete_category(spark: SparkSession, at: str) -> DataFrame:
    return corpus.delete_category(*_chunks(spark, at))


def dml_latest_pages(spark: SparkSession, at: str) -> DataFrame:
    pages = table(spark, at, "fetch_results").select("doc_id", "fetched_at", "outcome", "http_status")
    return latest_pages(pages).select("doc_id", F.unix_micros("fetched_at").alias("fetched_us"), "outcome", "http_status")


def dml_turn_numbers(spark: SparkSession, at: str) -> DataFrame:
    """Events as turns of their users: purchases are in the history already, the others go on from there."""
    events = table(spark, at, "events").select("event_id", "user_id", "event_type", "ts")
    old = events.where(F.col("event_type") == "purchase")
    start = old.limit(0).withColumn("turn_number", F.lit(0))
    done = history.numbered_turns(old, start, key="user_id", order=["ts", "event_id"])
    more = history.numbered_turns(events.where(F.col("event_type") != "purchase"), done, key="user_id", order=["ts", "event_id"])
    return done.unionByName(more).select("event_id", "user_id", "turn_number")


def win_last_turns(spark: SparkSession, at: str) -> DataFrame:
    turns = history.last_turns(table(spark, at, "events"), key="user_id", order=["ts", "event_id"], texts={"event_type": 900, "props": 1200})
    return turns.select("user_id", F.array_join(F.transform("turns", lambda x: F.concat_ws(": ", x["event_type"], x["props"])), "\n").alias("turns"))


def agg_run(spark: SparkSession, at: str) -> DataFrame:
    """The fetches of all pages as one run: how many, how many failed, and over how many seconds."""
    rows = table(spark, at, "fetch_results").select("doc_id", "outcome", "fetched_at").distinct()
    span = F.max(F.unix_micros("fetched_at")) - F.min(F.unix_micros("fetched_at"))
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.col("outcome") != "ok", F.lit(True))).alias("failed"), F.round(span / 1e6, 3).alias("seconds"))


def agg_fingerprint(spark: SparkSession, at: str) -> DataFrame:
    return corpus.corpus_fingerprint(table(spark, at, "rag_documents"))


def agg_categories(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "rag_documents").distinct()
    return rows.groupBy("category").agg(
        F.count("*").alias("documents"), F.count("indexed_content_hash").alias("indexed"), F.count_if(F.col("last_run_action") == "changed").alias("changed"),
        F.count_if(F.col("http_status") != 200).alias("not_ok"), F.max("consecutive_404_count").alias("most_404"),
    )


def agg_errors(spark: SparkSession, at: str) -> DataFrame:
    """A row for each outcome and message, however many messages there are."""
    rows = table(spark, at, "fetch_results").select("doc_id", "outcome", "error_message").distinct()
    return rows.groupBy("outcome", "error_message").agg(F.count("*").alias("pages"))


def agg_vector_spaces(spark: SparkSession, at: str) -> DataFrame:
    return corpus.validate_vectors(table(spark, at, "rag_chunk_embeddings"))


def snp_normalise(spark: SparkSession, at: str) -> DataFrame:
    unit = table(spark, at, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("_u"))
    return unit.select("vec_id", F.round(norm(F.col("_u")), 6).alias("length"), F.round(F.get("_u", F.lit(0)), 6).alias("first"))


def ret_semantic(spark: SparkSession, at: str) -> DataFrame:
    """The vectors whose id is divisible by 100, against all."""
    rows = table(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return search.semantic_search(rows, asked, k=10).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def _searched(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = _current(spark, at, "chunk_id", "source_title", "source_url", "chunk_text").select("chunk_id", "source_title", "source_url", "chunk_text")
    indexed = chunks.withColumn("vector", ids.hash_embedding(F.col("chunk_text")))
    items = table(spark, at, "eval_items").select(F.col("item_id").alias("query_id"), "question", "expected_source_url")
    asked = items.withColumn("vector", ids.hash_embedding(F.col("question")))
    return search.hybrid_search(indexed, asked, k=10), items, chunks


def ret_hybrid(spark: SparkSession, at: str) -> DataFrame:
    found = _searched(spark, at)[0]
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def evl_metrics(spark: SparkSession, at: str) -> DataFrame:
    found, items, chunks = _searched(spark, at)
    return search.retrieval_metrics(search.first_hits(found, items.select("query_id", "expected_source_url"), chunks))


def prj_cards(spark: SparkSession, at: str) -> DataFrame:
    found = _searched(spark, at)[0]
    return evidence.evidence_cards(found, table(spark, at, "rag_chunks")).withColumn("rank", F.col("rank").cast("long"))


def prj_opened(spark: SparkSession, at: str) -> DataFrame:
    return evidence.opened_cards(_searched(spark, at)[0], table(spark, at, "rag_chunks"))


def _supports(found: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """The question's terms that a result's text holds, where there are any, as what it supports."""
    asked = items.select("query_id", ids.terms(F.col("question")).alias("_terms"))
    met = found.select("query_id", "chunk_id").join(asked, "query_id").join(chunks.select("chunk_id", F.lower("chunk_text").alias("_text")), "chunk_id")
    held = F.array_sort(F.filter("_terms", lambda x: F.col("_text").contains(x)))
    return met.select("query_id", "chunk_id", held.alias("supports")).where(F.size("supports") > 0).distinct()


def grd_prompts(spark: SparkSession, at: str) -> DataFrame:
    found, items, chunks = _searched(spark, at)
    supports = _supports(found, items, chunks)
    return evidence.prompts(items.select("query_id", "question"), found, chunks.withColumn("heading_path", F.array().cast("array<string>")), supports, instructions="Answer from the excerpts alone and cite them.")


def grd_checks(spark: SparkSession, at: str) -> DataFrame:
    """Answers made of the results' titles and labels, the last first, and of one label that no result has."""
    found, items, chunks = _searched(spark, at)
    titles = chunks.select("chunk_id", F.coalesce("source_title", F.lit("")).alias("_title")).distinct()
    odd = found.join(titles, "chunk_id").where(F.length("_title") > 30)
    part = F.struct((-F.col("rank")).alias("r"), F.concat("_title", F.lit(" [S"), F.col("rank").cast("string"), F.lit(", S1]")).alias("t"))
    told = odd.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(part))["t"], ". ").alias("_told"))
    counts = found.groupBy("query_id").agg(F.count("*").cast("int").alias("_n"), F.max("score").alias("_best"))
    rows = items.select("query_id").join(counts, "query_id", "left").join(told, "query_id", "left")
    answer, n = F.concat(F.coalesce("_told", F.lit("Nothing")), F.when(F.col("_told").isNotNull(), " [S99]").otherwise(".")), F.coalesce("_n", F.lit(0))
    return rows.select(
        "query_id", F.array_join(citations.cited_labels(answer), ",").alias("labels"), citations.grounding(answer, F.round("_best", 6), n, 0.55).alias("reason"), citations.renumbered(answer, n).alias("answer")
    )


def ret_within(spark: SparkSession, at: str) -> DataFrame:
    """Each page searched for its own title."""
    chunks = _current(spark, at, "chunk_id", "source_title", "source_url", "chunk_text").select("chunk_id", "source_title", "source_url", "chunk_text")
    pages = chunks.where(F.col("source_url").isNotNull()).groupBy("source_url").agg(F.coalesce(F.max("source_title"), F.lit("")).alias("question")).withColumn("query_id", F.col("source_url"))
    found = search.search_within(chunks.withColumn("vector", ids.hash_embedding(F.col("chunk_text"))), pages.withColumn("vector", ids.hash_embedding(F.col("question"))), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def snp_rows(spark: SparkSession, at: str) -> DataFrame:
    """The current chunks that have a vector of one space, as a snapshot of it."""
    chunks = _current(spark, at, "chunk_id", "chunk_text").select("chunk_id", "chunk_text").distinct()
    vectors = table(spark, at, "rag_chunk_embeddings")
    rows = snapshot_rows(chunks, vectors, model="tess-embed-small", revision="v1", dimension=64)[0]
    return rows.select("chunk_id", "problem", F.size("vector").cast("long").alias("numbers"), F.when(F.col("problem").isNull(), F.round(norm(F.col("vector")), 4)).alias("length"))


def snp_facts(spark: SparkSession, at: str) -> DataFrame:
    chunks = _current(spark, at, "chunk_id", "chunk_text").select("chunk_id", "chunk_text").distinct()
    return snapshot_rows(chunks, table(spark, at, "rag_chunk_embeddings"), model="tess-embed-small", revision="v1", dimension=64)[1].select("rows", "ids", "unusable", "valid")


def _sessions(spark: SparkSession, at: str) -> DataFrame:
    """The questions about one page as the searches of one session."""
    found, items, _ = _searched(spark, at)
    asked = items.select("query_id", F.col("expected_source_url").alias("session_id"))
    return found.join(asked, "query_id").select("session_id", F.col("query_id").alias("search_no"), "rank", "chunk_id", "score")


def win_labels(spark: SparkSession, at: str) -> DataFrame:
    return evidence.source_labels(_sessions(spark, at)).withColumn("score", F.round("score", 6))


def set_novelty(spark: SparkSession, at: str) -> DataFrame:
    return evidence.novelty(_sessions(spark, at))


def emb_missing(spark: SparkSession, at: str) -> DataFrame:
    """Vectors of the current chunks that a space lacks, by the provider for dry runs."""
    lacking = corpus.missing_embeddings(_current(spark, at, "chunk_id", "chunk_text"), table(spark, at, "rag_chunk_embeddings"), "tess-embed-small", "v1")
    made = embedding.embedded(lacking, embedding.digest_vectors, model="tess-embed-small", revision="v1")
    return made.select("chunk_id", "embedding_dimension", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("vector", F.lit(15)).cast("double"), 6).alias("last"))


def src_documents(spark: SparkSession, at: str) -> DataFrame:
    return corpus.documents_scan(table(spark, at, "rag_documents"))


def dml_clear_checkpoints(spark: SparkSession, at: str) -> DataFrame:
    return corpus.clear_checkpoints(table(spark, at, "rag_documents").distinct())[1]


def _extracted(spark: SparkSession, at: str) -> DataFrame:
    return extract.extract_pages(latest_pages(table(spark, at, "fetch_results").where(F.col("html").isNotNull()).select("doc_id", "fetched_at", "html")))


def ext_pages(spark: SparkSession, at: str) -> DataFrame:
    return _extracted(spark, at).select("doc_id", "title", "source_last_updated", F.size("nodes").alias("nodes"), "source_content_hash", "markdown_body", "error")


def chk_split(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "documents").select("doc_id", F.posexplode(chunking.split_text(F.col("text"))).alias("piece_no", "piece"))
    return rows.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), "piece")


def chk_documents(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "extracted_docs").select("doc_id", F.concat_ws(":", "source_content_hash", F.lit("v1")).alias("document_version"), "nodes").distinct()
    return chunking.chunk_documents(rows)


def _refresh(spark: SparkSession, at: str) -> DataFrame:
    previous = table(spark, at, "rag_documents").where(F.col("doc_id").isNotNull())
    fetched = table(spark, at, "extracted_docs").groupBy("doc_id").agg(F.max(F.struct("source_content_hash", "source_last_updated")).alias("_m")).select("doc_id", "_m.*")
    return plan_refresh(previous, fetched, "v1")


def ref_plan(spark: SparkSession, at: str) -> DataFrame:
    return _refresh(spark, at)


def ref_counts(spark: SparkSession, at: str) -> DataFrame:
    return change_counts(_refresh(spark, at))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p2_found, p2_changes, fn_urls, fn_chunk_ids, fn_titles, fn_query_keys, fn_terms, fn_clean_text, fn_hash_embedding, join_current_chunks, join_embedding_gaps,
        join_chunk_vectors, join_neighbours, join_path_families, set_first_seen, set_origins, dml_upsert, dml_prune_versions, dml_save_embeddings, dml_delete_category,
        dml_latest_pages, dml_turn_numbers, win_last_turns, agg_fingerprint, agg_categories, agg_errors, agg_run, agg_vector_spaces, snp_normalise, ret_semantic, ret_hybrid,
        evl_metrics, prj_cards, win_labels, set_novelty, emb_missing, src_documents, dml_clear_checkpoints, ext_pages, chk_split, chk_documents, ref_plan, ref_counts,
        dml_materialise, dml_drop_removed, dml_replace_chunks, dml_delete_documents, dml_clear_rows, fn_categories, set_merged, src_curated, ext_shells, join_owned_turns,
        top_conversations, ret_read, ret_within, prj_opened, grd_prompts, grd_checks, snp_rows, snp_facts,
    )
}

_SNAPSHOTS = r"""
WITH folded AS (
  SELECT snapshot_no, doc_id, retrieved_at,
         nullif(lower(trim(status, e' \t\n\r')), '') AS s, nullif(lower(trim(source_content_hash, e' \t\n\r')), '') AS h, nullif(upper(trim(source_last_updated, e' \t\n\r')), '') AS t
  FROM rag_document_snapshots),
timed AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN epoch_us(CAST(t || ' 00:00:00+00' AS TIMESTAMPTZ)) ELSE epoch_us(CAST(t AS TIMESTAMPTZ)) END AS u FROM folded),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, doc_id ORDER BY retrieved_at DESC NULLS LAST, s DESC NULLS LAST, h DESC NULLS LAST, u DESC NULLS LAST) AS r FROM timed) WHERE r = 1),
nos AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM rag_document_snapshots)),
new AS (SELECT one.*, nos.before FROM one JOIN nos USING (snapshot_no) WHERE nos.before IS NOT NULL),
old AS (SELECT one.*, n.snapshot_no AS next FROM one JOIN nos n ON n.before = one.snapshot_no)
"""

_STOPS = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'difference', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'what', 'with')"


def _bytes(text: str) -> str:
    return f"list_transform(range(16), lambda i: (CAST(('0x' || substr(sha256(coalesce({text}, '')), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) - 127.5) / 127.5)"


_SEARCH = f"""
WITH c AS (SELECT DISTINCT chunk_id, source_title, source_url, chunk_text FROM rag_chunks k JOIN rag_documents d ON k.doc_id = d.doc_id AND k.document_version = d.document_version
           WHERE d.status IN ('ok', 'pending_snapshot')),
corpus AS (SELECT chunk_id, lower(coalesce(source_title, '') || ' ' || coalesce(chunk_text, '')) AS t, {_bytes("chunk_text")} AS v FROM c),
q AS (SELECT item_id AS query_id, expected_source_url, {_bytes("question")} AS e, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM eval_items),
asked AS (SELECT *, list_distinct(list_filter(w, lambda x: length(x) > 2 AND x NOT IN {_STOPS})) AS terms,
                 list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM q),
met AS (SELECT query_id, chunk_id, list_sum(list_transform(list_zip(v, e), lambda p: p[1] * p[2])) AS sem,
               CASE WHEN len(terms) = 0 THEN 0.0 ELSE least(1.0, round(0.75 * len(list_filter(terms, lambda x: contains(t, x))) / len(terms)
                 + 0.25 * len(list_filter(pairs, lambda x: contains(t, x))) / greatest(len(pairs), 1), 12)) END AS lex FROM corpus, asked),
pooled AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, chunk_id) <= 60 AS inside FROM met),
scored AS (SELECT query_id, chunk_id, 0.65 * CASE WHEN inside THEN sem ELSE 0 END + 0.35 * lex AS score FROM pooled WHERE inside OR lex > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10)
"""

_URLS = r"""
    WITH parts AS (SELECT DISTINCT doc_id, requested_url, trim(requested_url) AS u FROM rag_documents),
    cut AS (SELECT doc_id, requested_url, lower(regexp_extract(u, '^([^:/?#]+):', 1)) AS scheme, lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
                   regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query FROM parts),
    kept AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN
               ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'source'))) AS q FROM cut),
    urls AS (SELECT DISTINCT doc_id, requested_url, scheme || '://' || host || CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END
               || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END AS url FROM kept)
"""

_REFRESH = """
WITH p AS (SELECT DISTINCT doc_id, document_version AS v, indexed_content_hash AS h, indexed_source_last_updated AS d, chunked_content_hash AS ch, chunked_source_last_updated AS cd, chunked_document_version AS cv, TRUE AS p FROM rag_documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, source_content_hash AS nh, source_last_updated AS nd, TRUE AS f FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_content_hash DESC NULLS LAST, source_last_updated DESC NULLS LAST) AS r FROM extracted_docs) WHERE r = 1),
j AS (SELECT coalesce(p.doc_id, f.doc_id) AS doc_id, v, h, d, ch, cd, cv, p.p, nh, nd, f.f, concat_ws(':', nh, 'v1') AS nv FROM p FULL JOIN f ON p.doc_id = f.doc_id),
plan AS (SELECT *, CASE WHEN f IS NULL THEN 'missing' WHEN nh IS NULL THEN 'failed' WHEN p IS NULL THEN 'added'
           WHEN nh IS DISTINCT FROM h OR nv IS DISTINCT FROM v THEN 'changed' WHEN nd IS NOT NULL AND nd IS DISTINCT FROM d THEN 'dated' ELSE 'unchanged' END AS change FROM j)
"""

_SNAPSHOT = """
WITH c AS (SELECT DISTINCT chunk_id, chunk_text FROM rag_chunks c JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version WHERE d.status IN ('ok', 'pending_snapshot')),
v AS (SELECT chunk_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, vector DESC) AS r FROM rag_chunk_embeddings
      WHERE embedding_model = 'tess-embed-small' AND embedding_revision = 'v1') WHERE r = 1),
rows AS (SELECT c.chunk_id, len(vector) AS n, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> 64 THEN 'dimension' END AS problem,
                sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS length FROM c LEFT JOIN v USING (chunk_id))
"""

_CHUNKS = "change IN ('added', 'changed') AND NOT (ch IS NOT DISTINCT FROM nh AND cd IS NOT DISTINCT FROM nd AND cv IS NOT DISTINCT FROM nv)"

ORACLES: dict[str, str] = {
    "p2_found": _SNAPSHOTS
    + """SELECT coalesce(a.snapshot_no, b.next) AS snapshot_no, coalesce(a.doc_id, b.doc_id) AS doc_id,
         CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM new a FULL JOIN old b ON a.snapshot_no = b.next AND a.doc_id = b.doc_id
  WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.s IS DISTINCT FROM b.s OR a.h IS DISTINCT FROM b.h OR a.u IS DISTINCT FROM b.u""",
    "p2_changes": _SNAPSHOTS
    + """SELECT coalesce(a.snapshot_no, b.next) AS snapshot_no, coalesce(a.doc_id, b.doc_id) AS doc_id,
         CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
         CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN list_filter([CASE WHEN a.s IS DISTINCT FROM b.s THEN 'status' END,
           CASE WHEN a.h IS DISTINCT FROM b.h THEN 'source_content_hash' END, CASE WHEN a.u IS DISTINCT FROM b.u THEN 'source_last_updated' END], lambda x: x IS NOT NULL) END AS changed_columns
  FROM new a FULL JOIN old b ON a.snapshot_no = b.next AND a.doc_id = b.doc_id
  WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.s IS DISTINCT FROM b.s OR a.h IS DISTINCT FROM b.h OR a.u IS DISTINCT FROM b.u""",
    "chk_split": r"""
    WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT doc_id, t, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS b, CASE WHEN length(t) <= 1600 THEN length(t) WHEN strpos(reverse(substr(t, 1, 1600)), ' ') BETWEEN 1 AND 799 THEN 1601 - strpos(reverse(substr(t, 1, 1600)), ' ') ELSE 1600 END AS e
          FROM t WHERE t <> ''
          UNION ALL
          SELECT doc_id, t, no + 1, e - 240, CASE WHEN length(t) <= e + 1360 THEN length(t) WHEN strpos(reverse(substr(t, e - 239, 1600)), ' ') BETWEEN 1 AND 799 THEN e + 1361 - strpos(reverse(substr(t, e - 239, 1600)), ' ') ELSE e + 1360 END
          FROM w WHERE e < length(t))
    SELECT doc_id, no AS piece_no, trim(substr(t, b + 1, e - b)) AS piece FROM w""",
    "fn_urls": _URLS
    + r""",
    named AS (SELECT *, trim(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT DISTINCT doc_id, url FROM urls))
    SELECT doc_id, url, substr(sha256(url), 1, 16) AS url_id,
           CASE WHEN t = '' THEN 'index' ELSE t END AS slug
    FROM (SELECT *, CASE WHEN starts_with(s, 'aws-en-') THEN substr(s, 8) WHEN starts_with(s, 'gcp-en-') THEN substr(s, 8) WHEN starts_with(s, 'api-workspace-') THEN substr(s, 15) ELSE s END AS t FROM named)""",
    "set_first_seen": _URLS
    + "SELECT url, doc_id, requested_url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id NULLS FIRST, requested_url NULLS FIRST) AS r FROM urls) WHERE r = 1",
    "fn_chunk_ids": "SELECT DISTINCT chunk_id, substr(sha256(doc_id || ':' || document_version || ':' || position), 1, 24) AS computed_id FROM rag_chunks",
    "fn_titles": r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS x FROM documents)
    SELECT doc_id, CASE WHEN x = '' THEN 'New conversation' WHEN length(x) <= 88 THEN x
           WHEN contains(substr(x, 1, 85), ' ') THEN regexp_extract(substr(x, 1, 85), '^(.*) ', 1) || '…' ELSE substr(x, 1, 85) || '…' END AS label FROM t""",
    "fn_query_keys": "SELECT doc_id, sha256(array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ' ')) AS key_hash FROM documents",
    "fn_terms": r"""
    WITH t AS (SELECT DISTINCT chunk_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(chunk_text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN
      ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'difference', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'what', 'with')))) AS w FROM rag_chunks)
    SELECT DISTINCT chunk_id, CAST(len(w) AS BIGINT) AS terms, array_to_string(w, ' ') AS term_list FROM t""",
    "fn_clean_text": r"""SELECT doc_id, regexp_replace(replace(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), chr(8203), ''), '[\s\x{85}\p{Z}]+([:,.;!?])', '\1', 'g') AS clean FROM documents""",
    "fn_hash_embedding": """
    WITH t AS (SELECT DISTINCT chunk_id, sha256(coalesce(chunk_text, '')) AS h FROM rag_chunks), e AS (SELECT *, unnest(range(16)) AS i FROM t)
    SELECT DISTINCT chunk_id, i, round((CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) - 127.5) / 127.5, 9) AS x FROM e""",
    "join_current_chunks": """SELECT DISTINCT chunk_id, c.doc_id, c.document_version, position FROM rag_chunks c
    JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version WHERE d.status IN ('ok', 'pending_snapshot')""",
    "join_embedding_gaps": """
    WITH c AS (SELECT DISTINCT chunk_id FROM rag_chunks c JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version WHERE d.status IN ('ok', 'pending_snapshot')),
    s AS (SELECT DISTINCT embedding_model, embedding_revision FROM rag_chunk_embeddings)
    SELECT embedding_model, embedding_revision, chunk_id FROM s, c
    EXCEPT SELECT embedding_model, embedding_revision, chunk_id FROM rag_chunk_embeddings""",
    "join_chunk_vectors": """
    WITH c AS (SELECT DISTINCT chunk_id FROM rag_chunks c JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version WHERE d.status IN ('ok', 'pending_snapshot')),
    v AS (SELECT chunk_id, len(arg_max(vector, created_at)) AS n FROM rag_chunk_embeddings WHERE embedding_model = 'tess-embed-small' AND embedding_revision = 'v1' GROUP BY chunk_id)
    SELECT c.chunk_id, CASE WHEN n IS NULL THEN 'missing' WHEN n <> 64 THEN 'dimension' END AS problem FROM c LEFT JOIN v USING (chunk_id)""",
    "snp_rows": _SNAPSHOT + "SELECT chunk_id, problem, CAST(n AS BIGINT) AS numbers, CASE WHEN problem IS NULL THEN round(CASE WHEN length = 0 OR isnan(length) THEN length ELSE 1.0 END, 4) END AS length FROM rows",
    "snp_facts": _SNAPSHOT
    + "SELECT count(*) AS rows, count(DISTINCT chunk_id) AS ids, count(problem) AS unusable, count(*) > 0 AND count(DISTINCT chunk_id) = count(*) AND count(problem) = 0 AS valid FROM rows",
    "join_neighbours": """
    WITH c AS (SELECT DISTINCT chunk_id, doc_id, document_version, position FROM rag_chunks)
    SELECT a.chunk_id AS anchor_id, b.chunk_id, b.position FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.document_version = b.document_version AND b.position BETWEEN a.position - 1 AND a.position + 1""",
    "join_path_families": r"""
    WITH p AS (SELECT DISTINCT doc_id, regexp_extract(canonical_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM rag_documents
          WHERE lower(regexp_extract(canonical_url, '^[^:/?#]+://([^/?#]*)', 1)) = 'docs.tessoria.example'),
    r AS (SELECT DISTINCT '/aws/en/' || category || '/' AS prefix, category AS root_id FROM rag_documents)
    SELECT DISTINCT doc_id, root_id FROM p JOIN r ON path = rtrim(prefix, '/') OR starts_with(path, prefix)""",
    "set_origins": "SELECT DISTINCT doc_id, array_to_string(list_sort(list_filter(source_origins, lambda x: x <> '')), '|') AS scope FROM rag_documents",
    "dml_upsert": """
    WITH s AS (SELECT doc_id, title, category, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot_no DESC, retrieved_at DESC NULLS LAST, title DESC NULLS LAST, category DESC NULLS LAST, status DESC NULLS LAST) AS r
               FROM rag_document_snapshots WHERE doc_id IS NOT NULL) WHERE r = 1)
    SELECT * FROM s UNION ALL SELECT DISTINCT doc_id, title, category, status FROM rag_documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
    "dml_prune_versions": """
    SELECT DISTINCT c.chunk_id, c.doc_id, c.document_version FROM rag_chunks c LEFT JOIN (SELECT DISTINCT doc_id, document_version FROM rag_documents) d ON c.doc_id = d.doc_id
    WHERE d.document_version IS NULL OR d.document_version = c.document_version""",
    "dml_save_embeddings": """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, embedding_model, embedding_revision ORDER BY created_at DESC, embedding_dimension DESC, vector DESC) AS r FROM rag_chunk_embeddings)
    SELECT chunk_id, embedding_model, embedding_revision, epoch_us(created_at) AS created_us, embedding_dimension, len(vector) AS numbers,
           CASE WHEN NOT isnan(vector[1]) THEN round(CAST(vector[1] AS DOUBLE), 6) END AS first FROM r WHERE r = 1""",
    "dml_materialise": """SELECT doc_id, canonical_url, CASE WHEN status = 'pending_snapshot' THEN 'ok' ELSE status END AS status,
      CASE WHEN status = 'pending_snapshot' THEN 'published' ELSE last_run_action END AS last_run_action,
      CASE WHEN status = 'pending_snapshot' THEN source_content_hash ELSE indexed_content_hash END AS indexed_content_hash,
      CASE WHEN status = 'pending_snapshot' THEN source_last_updated ELSE indexed_source_last_updated END AS indexed_source_last_updated FROM (SELECT DISTINCT * FROM rag_documents)""",
    "dml_drop_removed": """SELECT DISTINCT chunk_id, doc_id, document_version, position FROM rag_chunks c
      WHERE NOT EXISTS (SELECT 1 FROM rag_documents d WHERE d.doc_id = c.doc_id AND d.status = 'removed')""",
    "dml_replace_chunks": """
    WITH f AS (SELECT DISTINCT c.chunk_id, c.doc_id, c.document_version, c.position FROM rag_chunks c JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version)
    SELECT chunk_id, doc_id, document_version, position FROM f
    UNION ALL SELECT DISTINCT chunk_id, doc_id, document_version, position FROM rag_chunks c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id)""",
    "dml_delete_documents": """
    WITH g AS (SELECT DISTINCT doc_id FROM rag_documents WHERE status IN ('removed', 'fetch_failed')), c AS (SELECT DISTINCT chunk_id, doc_id FROM rag_chunks)
    SELECT 'documents' AS part, doc_id AS id, count(*) AS n FROM (SELECT DISTINCT * FROM rag_documents) d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id) GROUP BY ALL
    UNION ALL SELECT 'chunks', chunk_id, count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id) GROUP BY ALL
    UNION ALL SELECT 'vectors', chunk_id, count(*) FROM (SELECT DISTINCT chunk_id, embedding_model, embedding_revision FROM rag_chunk_embeddings) v
      WHERE NOT EXISTS (SELECT 1 FROM c JOIN g ON g.doc_id = c.doc_id WHERE c.chunk_id = v.chunk_id) GROUP BY ALL""",
    "dml_clear_rows": """SELECT doc_id, canonical_url, status, CAST(NULL AS VARCHAR) AS indexed_content_hash, CAST(NULL AS VARCHAR) AS indexed_source_last_updated,
      CAST(NULL AS VARCHAR) AS chunked_content_hash, CAST(NULL AS VARCHAR) AS chunked_source_last_updated, chunked_document_version FROM (SELECT DISTINCT * FROM rag_documents)""",
    "fn_categories": r"""
    WITH p AS (SELECT DISTINCT doc_id, category, regexp_replace(regexp_extract(trim(canonical_url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS path FROM rag_documents)
    SELECT DISTINCT doc_id, CASE WHEN path = '/aws/en/compute' THEN 'overview' WHEN starts_with(path, '/aws/en/compute') THEN 'aws-compute' WHEN starts_with(path, '/gcp/en/') THEN 'gcp' ELSE category END AS page_category FROM p""",
    "set_merged": """
    WITH f AS (SELECT doc_id, canonical_url AS url, category, 'delivery-' || snapshot_no AS scope FROM (
                 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot_no DESC, canonical_url DESC NULLS LAST, category DESC NULLS LAST) AS r FROM rag_document_snapshots WHERE doc_id IS NOT NULL) WHERE r = 1),
    c AS (SELECT doc_id, requested_url AS url, category FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY requested_url DESC NULLS LAST, category DESC NULLS LAST) AS r FROM rag_documents WHERE status = 'ok') WHERE r = 1)
    SELECT coalesce(f.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN f.url ELSE c.url END AS url, CASE WHEN c.doc_id IS NULL THEN f.category ELSE c.category END AS category,
           CASE WHEN c.doc_id IS NULL THEN f.scope WHEN f.doc_id IS NULL THEN 'curated' ELSE 'curated|' || f.scope END AS scope FROM f FULL JOIN c ON f.doc_id = c.doc_id""",
    "src_curated": _URLS
    + """, entries AS (SELECT DISTINCT requested_url, category, error_message AS reason FROM rag_documents),
    named AS (SELECT e.requested_url, e.category, e.reason, u.url FROM entries e LEFT JOIN (SELECT DISTINCT requested_url, url FROM urls) u ON e.requested_url IS NOT DISTINCT FROM u.requested_url)
    SELECT requested_url AS url, url AS canonical_url, category, reason,
           CASE WHEN coalesce(lower(regexp_extract(requested_url, '^([^:/?#]+):', 1)), '') NOT IN ('http', 'https') THEN 'url' WHEN coalesce(category, '') NOT IN ('compute', 'glossary', 'sql') THEN 'category'
                WHEN coalesce(reason, '') = '' THEN 'reason' WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'duplicate' END AS problem FROM named""",
    "ext_shells": _URLS.replace("rag_documents", "fetch_results")
    + """SELECT DISTINCT f.doc_id, f.requested_url, u.url AS canonical_url, CASE WHEN outcome = 'not_found' THEN 'removed' ELSE 'fetch_failed' END AS status, http_status, error_message
    FROM fetch_results f LEFT JOIN (SELECT DISTINCT requested_url, url FROM urls) u ON f.requested_url = u.requested_url
    WHERE NOT coalesce(outcome = 'ok' AND length(html) > 0 AND length(resolved_url) > 0, FALSE)""",
    "join_owned_turns": """
    WITH c AS (SELECT c_nationkey AS owner_user_id, c_custkey AS conversation_id, c_acctbal >= 0 AS active FROM customer),
    q AS (SELECT owner_user_id, conversation_id FROM c UNION SELECT s_nationkey, s_suppkey FROM supplier)
    SELECT q.owner_user_id, q.conversation_id, o_orderkey AS turn_id FROM q JOIN c USING (owner_user_id, conversation_id) JOIN orders ON o_custkey = q.conversation_id WHERE active""",
    "top_conversations": """
    WITH o AS (SELECT o_custkey AS conversation_id, max(o_orderdate) AS updated_at FROM orders GROUP BY ALL)
    SELECT c_nationkey AS owner_user_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY updated_at DESC, conversation_id) AS place, conversation_id, strftime(updated_at, '%Y-%m-%d') AS updated
    FROM customer JOIN o ON c_custkey = conversation_id WHERE c_acctbal >= 0""",
    "ret_read": """
    WITH d AS (SELECT DISTINCT doc_id, document_version FROM rag_documents WHERE document_version IS NOT NULL), w AS (SELECT *, unnest([0, 1, 2, 3]) AS ord FROM d),
    a AS (SELECT doc_id || '/' || document_version AS request_id, ord, substr(sha256(doc_id || ':' || document_version || ':' || [1, 0, -1, 1][ord + 1]), 1, 24) AS chunk_id FROM w)
    SELECT request_id, CAST(ord AS BIGINT) AS ord, chunk_id, position FROM a JOIN (SELECT DISTINCT chunk_id, position FROM rag_chunks) USING (chunk_id)""",
    "dml_delete_category": """
    WITH d AS (SELECT DISTINCT doc_id, category FROM rag_documents), c AS (SELECT DISTINCT chunk_id, doc_id FROM rag_chunks),
    n AS (SELECT category, count(*) AS documents FROM d GROUP BY ALL), m AS (SELECT category, count(*) AS chunks FROM c JOIN d USING (doc_id) GROUP BY ALL)
    SELECT n.category, documents, coalesce(chunks, 0) AS chunks, (SELECT count(*) FROM d) - documents AS documents_left, (SELECT count(*) FROM c) - coalesce(chunks, 0) AS chunks_left
    FROM n LEFT JOIN m ON n.category = m.category""",
    "dml_latest_pages": """SELECT doc_id, epoch_us(fetched_at) AS fetched_us, outcome, http_status FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC NULLS LAST, outcome DESC NULLS LAST, http_status DESC NULLS LAST) AS r FROM fetch_results) WHERE r = 1""",
    "dml_turn_numbers": """
    WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
    m AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'purchase'),
    l AS (SELECT user_id, max(n) AS last FROM o GROUP BY ALL)
    SELECT event_id, user_id, CAST(n AS INTEGER) AS turn_number FROM o UNION ALL
    SELECT event_id, m.user_id, CAST(n + coalesce(last, 0) AS INTEGER) FROM m LEFT JOIN l ON m.user_id = l.user_id""",
    "win_last_turns": """SELECT user_id, string_agg(substr(event_type, 1, 900) || ': ' || substr(props, 1, 1200), chr(10) ORDER BY r DESC) AS turns FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3 GROUP BY user_id""",
    "agg_categories": """SELECT category, count(*) AS documents, count(indexed_content_hash) AS indexed, count(*) FILTER (last_run_action = 'changed') AS changed,
      count(*) FILTER (http_status <> 200) AS not_ok, max(consecutive_404_count) AS most_404 FROM (SELECT DISTINCT * FROM rag_documents) GROUP BY category""",
    "agg_errors": "SELECT outcome, error_message, count(*) AS pages FROM (SELECT DISTINCT doc_id, outcome, error_message FROM fetch_results) GROUP BY ALL",
    "agg_run": """SELECT count(*) AS pages, count(*) FILTER (coalesce(outcome <> 'ok', TRUE)) AS failed, round((max(epoch_us(fetched_at)) - min(epoch_us(fetched_at))) / 1e6, 3) AS seconds
      FROM (SELECT DISTINCT doc_id, outcome, fetched_at FROM fetch_results)""",
    "agg_vector_spaces": """SELECT embedding_model, embedding_revision, count(*) AS rows, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (len(vector) <> embedding_dimension) AS wrong_dimension,
      count(*) = count(DISTINCT chunk_id) AND count(*) FILTER (len(vector) <> embedding_dimension) = 0 AS valid FROM rag_chunk_embeddings GROUP BY ALL""",
    "snp_normalise": """
    WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings),
    u AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN l = 0 THEN 0.0 ELSE x::DOUBLE / l END) AS v FROM n)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length, round(v[1], 6) AS first FROM u""",
    "ret_semantic": """
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings, q WHERE vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "ret_hybrid": _SEARCH + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM best",
    "evl_metrics": _SEARCH
    + """, hits AS (SELECT q.query_id, min(rank) FILTER (c.source_url = q.expected_source_url) AS hit FROM q LEFT JOIN best b ON q.query_id = b.query_id LEFT JOIN c ON b.chunk_id = c.chunk_id GROUP BY ALL)
    SELECT count(*) AS cases, count(hit) AS hits, count(hit) / count(*) AS recall, avg(coalesce(1 / hit, 0)) AS mean_reciprocal_rank FROM hits""",
    "prj_cards": _SEARCH
    + """, shown AS (SELECT DISTINCT chunk_id, source_title AS title, source_url AS url, coalesce(array_to_string(heading_path, ' > '), '') AS heading, substr(chunk_text, 1, 520) AS text FROM rag_chunks)
    SELECT query_id, 'S' || rank AS label, rank, chunk_id, round(score, 4) AS score, title, url, heading, text FROM best JOIN shown USING (chunk_id)""",
    "win_labels": _SEARCH
    + """, f AS (SELECT expected_source_url AS session_id, chunk_id, min(query_id * 100 + rank) AS place, round(arg_max(score, query_id), 6) AS score FROM best JOIN q USING (query_id) GROUP BY ALL)
    SELECT session_id, chunk_id, 'S' || row_number() OVER (PARTITION BY session_id ORDER BY place) AS label, score FROM f""",
    "set_novelty": _SEARCH
    + """, s AS (SELECT expected_source_url AS session_id, query_id AS search_no, chunk_id FROM best JOIN q USING (query_id)),
    n AS (SELECT *, search_no = min(search_no) OVER (PARTITION BY session_id, chunk_id) AS fresh, min(search_no) OVER (PARTITION BY session_id) AS begun FROM s),
    g AS (SELECT session_id, search_no, begun, count(*) AS found, count(*) FILTER (fresh) AS new FROM n GROUP BY ALL)
    SELECT session_id, search_no, found, new, CASE WHEN new = 0 THEN 'none' WHEN search_no > begun AND new < 2 THEN 'low' ELSE 'ok' END AS novelty FROM g""",
    "ret_within": f"""
    WITH c AS (SELECT DISTINCT chunk_id, source_title, source_url, chunk_text FROM rag_chunks k JOIN rag_documents d ON k.doc_id = d.doc_id AND k.document_version = d.document_version
           WHERE d.status IN ('ok', 'pending_snapshot')),
    corpus AS (SELECT chunk_id, source_url, lower(coalesce(source_title, '') || ' ' || coalesce(chunk_text, '')) AS t, {_bytes("chunk_text")} AS v FROM c),
    p AS (SELECT source_url, coalesce(max(source_title), '') AS question FROM c WHERE source_url IS NOT NULL GROUP BY ALL),
    q AS (SELECT source_url, {_bytes("question")} AS e, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM p),
    asked AS (SELECT *, list_distinct(list_filter(w, lambda x: length(x) > 2 AND x NOT IN {_STOPS})) AS terms, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM q),
    met AS (SELECT source_url AS query_id, chunk_id, list_sum(list_transform(list_zip(v, e), lambda p: p[1] * p[2])) AS sem,
                   CASE WHEN len(terms) = 0 THEN 0.0 ELSE least(1.0, round(0.75 * len(list_filter(terms, lambda x: contains(t, x))) / len(terms)
                     + 0.25 * len(list_filter(pairs, lambda x: contains(t, x))) / greatest(len(pairs), 1), 12)) END AS lex FROM corpus JOIN asked USING (source_url)),
    placed AS (SELECT query_id, chunk_id, 0.65 * round(sem, 12) + 0.35 * lex AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.65 * round(sem, 12) + 0.35 * lex DESC, chunk_id) AS rank FROM met)
    SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM placed WHERE rank <= 10""",
    "prj_opened": _SEARCH
    + """, shown AS (SELECT DISTINCT chunk_id, source_title AS title, source_url AS url, coalesce(array_to_string(heading_path, ' > '), '') AS heading, chunk_text AS text FROM rag_chunks)
    SELECT query_id, 'S' || rank AS label, chunk_id, title, url, heading, text FROM best JOIN shown USING (chunk_id)""",
    "grd_prompts": _SEARCH
    + """, cards AS (SELECT b.query_id, rank, '[S' || rank || '] ' AS s, coalesce(source_title, '') AS title, coalesce(source_url, '') AS url, coalesce(chunk_text, '') AS text,
                       list_sort(list_filter(terms, lambda x: contains(lower(chunk_text), x))) AS held
                     FROM best b JOIN c USING (chunk_id) JOIN asked a ON a.query_id = b.query_id),
    shown AS (SELECT query_id, string_agg(s || title || chr(10) || 'URL: ' || url || chr(10) || 'Excerpt: ' || text, chr(10) || chr(10) ORDER BY rank) AS excerpts,
                     string_agg(s || 'may be used only for: ' || array_to_string(held, '; '), chr(10) ORDER BY rank) FILTER (len(held) > 0) AS scopes FROM cards GROUP BY ALL)
    SELECT item_id AS query_id, 'Answer from the excerpts alone and cite them.' || coalesce(chr(10) || chr(10) || 'Scope of the sources:' || chr(10) || scopes, '')
           || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Excerpts:' || chr(10) || coalesce(excerpts, '') AS prompt
    FROM eval_items LEFT JOIN shown ON query_id = item_id""",
    "grd_checks": _SEARCH
    + """, told AS (SELECT query_id, string_agg(source_title || ' [S' || rank || ', S1]', '. ' ORDER BY rank DESC) || ' [S99]' AS answer, list_distinct(list_append(list(rank), 1)) AS used,
                      string_agg(source_title, chr(1) ORDER BY rank DESC) AS titles, list('S' || rank ORDER BY rank DESC) AS ls, list(rank ORDER BY rank DESC) AS rs
                    FROM (SELECT DISTINCT b.query_id, b.rank, b.chunk_id, c.source_title FROM best b JOIN c USING (chunk_id)) WHERE length(source_title) > 30 GROUP BY ALL),
    n AS (SELECT query_id, count(*) AS n, round(max(score), 6) AS top FROM best GROUP BY ALL),
    j AS (SELECT item_id AS query_id, coalesce(n, 0) AS n, top, answer, used, titles, ls, rs FROM eval_items LEFT JOIN n ON n.query_id = item_id LEFT JOIN told ON told.query_id = item_id)
    SELECT query_id, CASE WHEN answer IS NULL THEN '' ELSE array_to_string(list_filter([ls[1], 'S1'] || ls[2:], lambda x, i: list_position([ls[1], 'S1'] || ls[2:], x) = i) || ['S99'], ',') END AS labels,
           CASE WHEN n = 0 THEN 'no_results' WHEN top < 0.55 THEN 'below_relevance_threshold' WHEN answer IS NULL THEN 'no_citations_in_model_output' END AS reason,
           CASE WHEN answer IS NULL THEN 'Nothing.' ELSE array_to_string(list_transform(string_split(titles, chr(1)), lambda t, i: t || ' [S' || (1 + len(list_filter(used, lambda u: u < rs[i]))) || ', S1]'), '. ') || ' [S99]' END AS answer
    FROM j""",
    "emb_missing": f"""
    WITH c AS (SELECT DISTINCT chunk_id, chunk_text FROM rag_chunks c JOIN rag_documents d ON c.doc_id = d.doc_id AND c.document_version = d.document_version WHERE d.status IN ('ok', 'pending_snapshot')),
    m AS (SELECT chunk_id, {_bytes("chunk_text")} AS v FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM rag_chunk_embeddings WHERE embedding_model = 'tess-embed-small' AND embedding_revision = 'v1'))
    SELECT chunk_id, CAST(16 AS INTEGER) AS embedding_dimension, round(CAST(CAST(v[1] AS FLOAT) AS DOUBLE), 6) AS first, round(CAST(CAST(v[16] AS FLOAT) AS DOUBLE), 6) AS last FROM m""",
    "src_documents": """SELECT DISTINCT doc_id, requested_url, canonical_url, title, category, source_last_updated, source_content_hash, document_version, status, indexed_content_hash,
      indexed_source_last_updated, chunked_content_hash, chunked_source_last_updated, chunked_document_version, error_message, coalesce(consecutive_404_count, 0) AS consecutive_404_count,
      array_to_string(source_origins, '|') AS origins FROM rag_documents""",
    "dml_clear_checkpoints": "SELECT count(indexed_content_hash) AS cleared FROM (SELECT DISTINCT * FROM rag_documents)",
    "agg_fingerprint": """
    WITH d AS (SELECT DISTINCT doc_id, document_version, source_last_updated FROM rag_documents WHERE status IN ('ok', 'pending_snapshot') AND document_version IS NOT NULL),
    h AS (SELECT sha256(CAST(to_json({'doc_id': doc_id, 'document_version': document_version, 'source_last_updated': source_last_updated}) AS VARCHAR)) AS h FROM d),
    w AS (SELECT count(*) AS documents, sum(CAST(('0x' || substr(h, 1, 8)) AS BIGINT)) AS w0, sum(CAST(('0x' || substr(h, 9, 8)) AS BIGINT)) AS w1, sum(CAST(('0x' || substr(h, 17, 8)) AS BIGINT)) AS w2, sum(CAST(('0x' || substr(h, 25, 8)) AS BIGINT)) AS w3, sum(CAST(('0x' || substr(h, 33, 8)) AS BIGINT)) AS w4, sum(CAST(('0x' || substr(h, 41, 8)) AS BIGINT)) AS w5, sum(CAST(('0x' || substr(h, 49, 8)) AS BIGINT)) AS w6, sum(CAST(('0x' || substr(h, 57, 8)) AS BIGINT)) AS w7 FROM h)
    SELECT documents, format('{:08x}', CAST(coalesce(w0, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w1, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w2, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w3, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w4, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w5, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w6, 0) % 4294967296 AS BIGINT)) || format('{:08x}', CAST(coalesce(w7, 0) % 4294967296 AS BIGINT)) AS fingerprint FROM w""",
    "ref_plan": _REFRESH + "SELECT doc_id, change, " + _CHUNKS + " AS needs_chunks, change IN ('added', 'changed', 'dated') AS needs_snapshot, CASE WHEN change IN ('missing', 'failed') THEN v ELSE nv END AS document_version FROM plan",
    "ref_counts": _REFRESH
    + """SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'dated') AS dated,
      count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'failed') AS failed, count(*) FILTER (change = 'missing') AS missing,
      count(*) FILTER (change IN ('added', 'changed', 'dated')) AS pending, """
    + f"count(*) FILTER ({_CHUNKS}) AS to_chunk FROM plan",
}
