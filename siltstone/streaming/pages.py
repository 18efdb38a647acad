"""Pages that arrive as files, merged into the current state batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.plans.tables import Buckets


def latest_pages(pages: DataFrame) -> DataFrame:
    """The latest fetch of each doc_id: late and repeated fetches give way."""
    columns = [c for c in pages.columns if c != "doc_id"]
    return pages.groupBy("doc_id").agg(F.max(F.struct("fetched_at", *[c for c in columns if c != "fetched_at"])).alias("_m")).select("doc_id", *[F.col(f"_m.{c}").alias(c) for c in columns])


def keep_current(spark: SparkSession, source: str, schema, table: Buckets, checkpoint: str) -> StreamingQuery:
    """Stream Parquet drops of fetched pages into a table bucketed by doc_id, from which ``current_pages`` reads.

    A batch only appends the latest page of each of its documents, so its cost is that of its
    own rows. A batch that is run again appends the same rows again, which changes nothing for
    readers; ``table.compact(spark, ["fetched_at"])`` drops what is superseded, when it suits.
    """

    def merge(batch: DataFrame, _: int) -> None:
        table.append(latest_pages(batch))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pages(spark: SparkSession, table: Buckets) -> DataFrame:
    """The latest page of each document; late and repeated ones never replace a newer one."""
    return latest_pages(table.read(spark))
