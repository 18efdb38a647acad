"""What a new fetch of all pages changes in the corpus, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


CHUNKED = ("chunked_content_hash", "chunked_source_last_updated", "chunked_document_version")


def plan_refresh(previous: DataFrame, fetched: DataFrame, revision: str) -> DataFrame:
    """(doc_id, change, needs_chunks, needs_snapshot, document_version): each page of either side, once.

    ``previous``: doc_id, document_version, indexed_content_hash, indexed_source_last_updated
    and the checkpoints of the last chunking (chunked_content_hash, chunked_source_last_updated,
    chunked_document_version). ``fetched``: doc_id, source_content_hash, source_last_updated
    (null hash: no content came). A version is the content hash and the chunking revision.
    ``added``; ``changed`` if hash or revision differ; ``dated`` if only the date is new;
    ``unchanged``; ``failed`` without content; ``missing`` if the page was not among the
    fetched. Null equals null. Added, changed and dated pages wait for the next snapshot;
    added and changed ones are chunked, unless a run that did not finish has done just that.
    """
    named = {"document_version": "_v", "indexed_content_hash": "_h", "indexed_source_last_updated": "_d", **dict(zip(CHUNKED, ("_ch", "_cd", "_cv")))}
    p = previous.select("doc_id", *[F.col(c).alias(n) for c, n in named.items()], F.lit(True).alias("_p")).distinct()
    f = fetched.select("doc_id", "source_content_hash", "source_last_updated", F.lit(True).alias("_f")).distinct()
    version = F.concat_ws(":", "source_content_hash", F.lit(revision))
    content = F.col("_p").isNull() | ~F.col("source_content_hash").eqNullSafe(F.col("_h"))
    cut = F.col("_p").isNotNull() & ~version.eqNullSafe(F.col("_v"))
    dated = F.col("_p").isNotNull() & F.col("source_last_updated").isNotNull() & ~F.col("source_last_updated").eqNullSafe(F.col("_d"))
    change = (
        F.when(F.col("_f").isNull(), "missing").when(F.col("source_content_hash").isNull(), "failed").when(F.col("_p").isNull(), "added")
        .when(content | cut, "changed").when(dated, "dated").otherwise("unchanged")
    )
    joined = p.join(f, "doc_id", "full_outer").withColumn("change", change)
    fresh = F.col("change").isin("added", "changed")
    done = F.col("_ch").eqNullSafe(F.col("source_content_hash")) & F.col("_cd").eqNullSafe(F.col("source_last_updated")) & F.col("_cv").eqNullSafe(version)
    return joined.select(
        "doc_id", "change", (fresh & ~done).alias("needs_chunks"), (fresh | (F.col("change") == "dated")).alias("needs_snapshot"),
        F.when(F.col("change").isin("missing", "failed"), F.col("_v")).otherwise(version).alias("document_version"),
    )


def change_counts(plan: DataFrame) -> DataFrame:
    kinds = ("added", "changed", "dated", "unchanged", "failed", "missing")
    return plan.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds], F.count_if("needs_snapshot").alias("pending"), F.count_if("needs_chunks").alias("to_chunk"))
