"""Vectors of texts from a given provider, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.operators.corpus import missing_embeddings
from siltstone.runtime import settle

Provider = Callable[[list[str]], "list[list[float]] | np.ndarray"]
COLUMNS = "chunk_id string, embedding_model string, embedding_revision string, embedding_dimension int, vector array<float>"


class Busy(Exception):
    """Raised by a provider that asks to be called again later."""


def digest_vectors(texts: list[str]) -> np.ndarray:
    """A provider for tests and dry runs: sixteen numbers of each text's digest."""
    found = np.array([list(hashlib.sha256(t.encode()).digest()[:16]) for t in texts], float).reshape(len(texts), 16)
    return (found - 127.5) / 127.5


def _asked(provider: Provider, texts: list[str], attempts: int, wait: float) -> list[list[float]]:
    for n in range(attempts):
        try:
            vectors = [list(map(float, v)) for v in provider(texts)]
        except Busy:
            if n + 1 == attempts:
                raise
            time.sleep(min(60.0, wait * 2**n))
            continue
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
    raise ValueError("attempts must be at least 1")


def embedded(chunks: DataFrame, provider: Provider, *, model: str, revision: str, batch: int = 32, attempts: int = 8, wait: float = 5.0) -> DataFrame:
    """(chunk_id, embedding_model, embedding_revision, embedding_dimension, vector) of each chunk.

    ``provider`` gets at most ``batch`` texts at a time and gives as many vectors (else an
    error); while it is ``Busy`` it is asked again, ``attempts`` times in all, after waits that
    double. It is sent to the tasks, which hold one batch each. Null ids take no part, a null
    text is embedded as an empty one, repeated rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = _asked(provider, part.column("_text").to_pylist(), attempts, wait)
                n = len(vectors)
                columns = [part.column("chunk_id"), pa.array([model] * n), pa.array([revision] * n), pa.array([len(v) for v in vectors], pa.int32()), pa.array(vectors, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "embedding_model", "embedding_revision", "embedding_dimension", "vector"])

    rows = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", F.coalesce("chunk_text", F.lit("")).alias("_text")).dropDuplicates(["chunk_id"])
    return rows.mapInArrow(run, COLUMNS)


def embed_missing(cache, chunks: DataFrame, provider: Provider, *, model: str, revision: str, slices: int = 16, **options) -> int:
    """Embed the chunks that a ``Buckets`` table of vectors lacks; returns how many there were.

    What is lacking is found once and written down in ``slices`` of the ids' hashes; each is
    appended when it is finished, so that a run that was stopped goes on where it was.
    """
    spark = chunks.sparkSession
    have = cache.read(spark) if cache.exists(spark) else spark.createDataFrame([], COLUMNS)
    rows = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"])
    lacking = missing_embeddings(rows, have, model, revision).withColumn("_slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int"))
    lacking, done = settle(lacking, "lacking", ["_slice"]), 0
    for i, n in sorted((r["_slice"], r["count"]) for r in lacking.groupBy("_slice").count().collect()):
        some = lacking.where(F.col("_slice") == i).drop("_slice")
        cache.append(embedded(some, provider, model=model, revision=revision, **options).withColumn("created_at", F.current_timestamp()))
        done += n
    return done
