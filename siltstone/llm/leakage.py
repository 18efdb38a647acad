"""Evaluation passages inside training text, by prefix-filtered set join (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltstone.functions.text import words
from siltstone.llm.near_duplicates import _lists, _shingles
from siltstone.runtime import settle

#: Characters that are invisible in a text and are dropped before comparing.
INVISIBLE = "​­"


def _located(width: int, keys: int, wanted=None):
    """Arrow batches (``keys`` leading columns, ``_words``) to one row a shingle: the keys,
    ``_at`` (its first word's index), ``_shingle``; with ``wanted`` only shingles of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed, bounds = _shingles(*_lists(batch.column("_words")), width)
            if wanted is None:
                at = np.arange(len(mixed))
            else:
                known = wanted.value
                slot = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
                at = np.flatnonzero(known[slot] == mixed)
            row = np.searchsorted(bounds, at, side="right") - 1
            kept = batch.select(batch.schema.names[:keys]).take(pa.array(row))
            place = pa.array((at - bounds[row]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*kept.columns, place, pa.array(mixed[at].view(np.int64))], names=[*kept.schema.names, "_at", "_shingle"])

    return run


def _hashed(text: Column) -> Column:
    return F.transform(words(F.translate(text, INVISIBLE, "")), lambda w: F.xxhash64(w))


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    run_words: int = 13,
    width: int = 5,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """(doc, item, shared_words, item_share): documents sharing ``run_words`` consecutive words with a passage.

    Of a passage with fewer words (but at least ``width``) all must be shared in a row.
    ``shared_words`` is the longest shared run and ``item_share`` that run over the passage's
    words. An item is the set of its windows of ``run_words`` words, and a window the set of
    its ``run_words - width + 1`` shingles of ``width`` words, all of which a document with
    that window holds. So one of them suffices as prefix: the rarest by the number of
    documents in the whole corpus. Documents and prefixes are joined on it, the position in
    the document must leave room for the window (positional and length bounds), and each
    candidate alignment is verified by counting consecutive equal shingles on it.

    The text is read once, and only shingles of the items are kept. Up to ``most_broadcast``
    of them (8 bytes each) are looked up in the scan; more are met by one shuffled semi join.

    Null or blank texts and passages, and passages of fewer than ``width`` words, match
    nothing. Repeated rows count once. Empty tables give no rows. Texts of any length are read
    whole. Further columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    if not 0 < width <= run_words:
        raise ValueError("width must be within run_words")
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), _hashed(F.col(passage_col)).alias("_words")).distinct()
    asked = asked.where(F.size("_words") >= width).withColumn("_passage", F.xxhash64("_words")).withColumn("_n", F.size("_words")).select("_item", "_passage", "_n", "_words")
    kind = items.schema[item_col].dataType.simpleString()
    own = settle(asked.mapInArrow(_located(width, 3), f"_item {kind}, _passage long, _n int, _at int, _shingle long"), "items")
    need = F.least(F.col("_n"), F.lit(run_words)) - (width - 1)
    own = own.withColumn("_need", need)
    shingles = own.select("_shingle").distinct()
    texts = documents.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("_doc"), _hashed(F.col(text_col)).alias("_words"))
    texts = texts.where(F.size("_words") >= width).withColumn("_text", F.xxhash64("_words")).select("_doc", "_text", "_words")
    doc_kind = documents.schema[doc_col].dataType.simpleString()
    schema = f"_doc {doc_kind}, _text long, _at int, _shingle long"
    count = shingles.count()
    if not count:
        return spark.createDataFrame([], f"{doc_col} {doc_kind}, {item_col} {kind}, shared_words int, item_share double")
    if count <= most_broadcast:
        known = shingles.toPandas()["_shingle"].to_numpy(np.int64).view(np.uint64)
        found = texts.mapInArrow(_located(width, 2, spark.sparkContext.broadcast(np.sort(known))), schema)
    else:
        found = texts.mapInArrow(_located(width, 2), schema).join(shingles, "_shingle", "left_semi").select("_doc", "_text", "_at", "_shingle")
    found = settle(found.distinct(), "shingles")

    rarity = found.groupBy("_shingle").agg(F.count_distinct("_doc").alias("_docs"))
    ranked = own.join(rarity, "_shingle")  # a shingle in no document ends a window
    # a short passage has one window, which begins with it and is cut by its end
    ahead = W.partitionBy("_item", "_passage").orderBy("_at").rangeBetween(0, run_words - width)
    windows = ranked.select("*", F.min(F.struct("_docs", "_shingle", "_at")).over(ahead).alias("_rarest"), F.count("*").over(ahead).alias("_all")).where(F.col("_all") == F.col("_need"))
    prefix = windows.select("_item", "_passage", "_n", F.col("_rarest._shingle").alias("_shingle"), F.col("_rarest._at").alias("_i"), F.col("_at").alias("_start")).distinct()
    met = (
        found.join(prefix, "_shingle")
        .where(F.col("_at") >= F.col("_i") - F.col("_start"))
        .select("_doc", "_text", "_item", "_passage", "_n", (F.col("_at") - F.col("_i")).alias("_shift"))
        .distinct()
    )
    aligned = met.join(found, ["_doc", "_text"]).withColumn("_i", F.col("_at") - F.col("_shift"))
    equal = aligned.join(own.select("_item", "_passage", F.col("_at").alias("_i"), "_shingle"), ["_item", "_passage", "_i", "_shingle"], "left_semi")
    line = W.partitionBy("_doc", "_text", "_item", "_passage", "_shift").orderBy("_i")
    runs = equal.withColumn("_run", F.col("_i") - F.row_number().over(line)).groupBy("_doc", "_text", "_item", "_passage", "_n", "_shift", "_run").agg(F.count("*").alias("_len"))
    longest = runs.where(F.col("_len") >= need).groupBy("_doc", "_item").agg(F.max(F.struct("_len", "_n")).alias("_m"))
    shared = (F.col("_m._len") + width - 1).cast("int")
    return longest.select(F.col("_doc").alias(doc_col), F.col("_item").alias(item_col), shared.alias("shared_words"), (shared / F.col("_m._n")).alias("item_share"))
