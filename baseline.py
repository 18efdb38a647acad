
import sys
import tempfile
import time

from pyspark.sql import functions as F

from siltstone.functions.identity import hash_embedding
from siltstone.operators import chunking, extract, search
from siltstone.plans.refresh import plan_refresh
from siltstone.plans.tables import publish_snapshot
from siltstone.runtime import release, session, table

AT = "/root/testdata/sf0.1"


def timed(run, times: int = 2) -> list[float]:
    out = []
    for _ in range(times):
        began = time.time()
        run()
        out.append(time.time() - began)
    return out


def main() -> None:
    spark = session(sys.argv[1] if len(sys.argv) > 1 else "8", "baseline")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    pages = table(spark, AT, "fetch_results").where(F.col("html").isNotNull()).select("doc_id", "html").distinct()
    n = pages.count()
    show = lambda name, seconds, per=None: print(f"{name} | cold {seconds[0]:.2f} s, warm {seconds[1]:.2f} s" + (f" ({per / seconds[1]:.0f}/s)" if per else ""), flush=True)
    show(f"HTML extraction, {n} pages", timed(lambda: noop(extract.extract_pages(pages.repartition(8)))), n)
    html = [r["html"] for r in pages.collect()]
    show("the same in a single-threaded Python loop", timed(lambda: [extract._extracted(h) for h in html]), n)
    documents = table(spark, AT, "extracted_docs").select("doc_id", F.lit("v1").alias("document_version"), "nodes").distinct()
    m = documents.count()
    show(f"Chunking, {m} documents", timed(lambda: noop(chunking.chunk_documents(documents.repartition(8)))), m)
    corpus = table(spark, AT, "rag_chunks").select("chunk_id", "source_title", "source_url", "chunk_text").distinct().withColumn("vector", hash_embedding(F.col("chunk_text")))
    asked = table(spark, AT, "eval_items").select(F.col("item_id").alias("query_id"), "question").withColumn("vector", hash_embedding(F.col("question"))).orderBy("query_id")
    for k in (1, 64):
        show(f"Hybrid search, {k} queries, k = 10", timed(lambda k=k: noop(search.hybrid_search(corpus, asked.limit(k), k=10))))
    fetched = table(spark, AT, "extracted_docs").groupBy("doc_id").agg(F.max("source_content_hash").alias("source_content_hash"), F.max("source_last_updated").alias("source_last_updated"))
    version = F.concat_ws(":", "source_content_hash", F.lit("v1"))
    same = fetched.select("doc_id", version.alias("document_version"), F.col("source_content_hash").alias("indexed_content_hash"), F.col("source_last_updated").alias("indexed_source_last_updated"), *[F.lit(None).cast("string").alias(c) for c in ("chunked_content_hash", "chunked_source_last_updated", "chunked_document_version")])
    show("Refresh, everything unchanged", timed(lambda: noop(plan_refresh(same, fetched, "v1"))))
    vectors = table(spark, AT, "embeddings").limit(2000).select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("m").alias("embedding_model"), F.lit("r").alias("embedding_revision"), F.col("embedding").alias("vector"), F.current_timestamp().alias("created_at"))
    width = len(vectors.first()["vector"])
    chunks = vectors.select("chunk_id", F.lit("text").alias("chunk_text"))
    show("Snapshot build and activate, 2,000 vectors", timed(lambda: publish_snapshot(tempfile.mkdtemp(prefix="spark-"), chunks, vectors, model="m", revision="r", dimension=width)))
    release(spark)


if __name__ == "__main__":
    main()
