"""Hybrid search of many questions over a corpus in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.identity import phrases, terms
from siltstone.functions.vectors import dot

SEMANTIC, LEXICAL = 0.65, 0.35
DECIMALS = 12


def pool_size(k: int) -> int:
    return max(6 * k, 60)


class _Questions:
    """The stated questions as matrices: vectors, and which words and pairs each asks for."""

    def __init__(self, rows):
        self.ids = [r["query_id"] for r in rows]
        self.vectors = np.array([r["vector"] for r in rows], float)
        self.patterns = sorted({p for r in rows for p in [*r["_terms"], *r["_pairs"]]})
        at = {p: i for i, p in enumerate(self.patterns)}
        self.weights = np.zeros((len(self.patterns), len(rows)))
        for j, r in enumerate(rows):
            for word in r["_terms"]:
                self.weights[at[word], j] += 0.75 / len(r["_terms"])
            for pair in r["_pairs"] if r["_terms"] else ():
                self.weights[at[pair], j] += 0.25 / len(r["_pairs"])

    def lexical(self, texts: list[str], matcher) -> np.ndarray:
        """Scores by text and question; only the patterns that a text holds are added up."""
        out = np.zeros((len(texts), len(self.ids)))
        for i, text in enumerate(texts):
            held = sorted({p for _, p in matcher.iter(text)})
            if held:
                out[i] = self.weights[held].sum(0)
        return np.minimum(out, 1.0).round(DECIMALS)


class _Top:
    """The best ``most`` rows of each question by one score, of all rows seen so far."""

    def __init__(self, questions: int, most: int):
        self.most, self.floor = most, np.full(questions, -np.inf)  # what a row must reach
        self.query, self.ids, self.scores = np.empty(0, int), np.empty(0, object), np.empty((0, 3))

    def add(self, names: np.ndarray, score: np.ndarray, semantic: np.ndarray, lexical: np.ndarray, use: np.ndarray) -> None:
        row, q = np.nonzero(use & (score >= self.floor))
        if not len(row):
            return
        query, ids = np.concatenate([self.query, q]), np.concatenate([self.ids, names[row]])
        scores = np.concatenate([self.scores, np.stack([score[row, q], semantic[row, q], lexical[row, q]], 1)])
        order = np.lexsort((ids, -scores[:, 0], query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.floor[query[place == self.most - 1]] = scores[place == self.most - 1, 0]
        kept = place < self.most
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]


def _best(shared, most: int, id_type: pa.DataType):
    """Of each partition and question, the ``most`` rows by semantic and by lexical score: a partial top k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = shared.value
        matcher = ahocorasick.Automaton()
        for i, p in enumerate(asked.patterns):
            matcher.add_word(p, i)
        matcher.make_automaton()
        tops = [_Top(len(asked.ids), most) for _ in range(2)]
        step = max(16, 250_000 // len(asked.ids))
        for batch in batches:
            names = np.array(batch.column("chunk_id").to_pylist(), object)
            vectors = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            texts = batch.column("_text").to_pylist()
            for at in range(0, batch.num_rows, step):
                some = slice(at, at + step)
                semantic = vectors[some] @ asked.vectors.T
                lexical = asked.lexical(texts[some], matcher) if asked.patterns else np.zeros_like(semantic)
                tops[0].add(names[some], semantic, semantic, lexical, np.ones_like(semantic, bool))
                tops[1].add(names[some], lexical, semantic, lexical, lexical > 0)
        for kind, top in enumerate(tops):
            columns = [pa.array([asked.ids[q] for q in top.query], id_type), pa.array(top.ids, pa.string()), pa.array(top.scores[:, 1]), pa.array(top.scores[:, 2])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([kind] * len(top.query), pa.int32())], names=["query_id", "chunk_id", "semantic", "lexical", "_kind"])

    return run


def hybrid_search(corpus: DataFrame, questions: DataFrame, *, k: int = 10, most_questions: int = 2000) -> DataFrame:
    """(query_id, rank, chunk_id, score, semantic, lexical): the ``k`` best chunks of each question.

    ``corpus``: chunk_id, source_title, chunk_text, vector; ``questions``: query_id, question,
    vector. The score is 0.65 times the inner product, which counts only within the question's
    best ``max(6 k, 60)`` by it, plus 0.35 times the lexical score; chunks outside that pool
    are candidates if their lexical score is not 0. The lexical score is three quarters the
    share of the question's terms and one quarter the share of its adjacent word pairs that
    occur in title and text; 0 without terms. Ties go to the smaller chunk_id. Chunks without id
    or vector take no part.

    The corpus streams past the questions in blocks of about ``most_questions``, by a hash of
    their id. All words of a block are found in one pass over a text. Each partition keeps its
    best rows for each question, and only these ids and scores are shuffled, never texts.
    """
    spark = questions.sparkSession
    asked = questions.select("query_id", terms("question").alias("_terms"), phrases("question").alias("_pairs"), "vector")
    kind = questions.schema["query_id"].dataType.simpleString()
    first = asked.limit(most_questions + 1).collect()
    blocks = 1 if len(first) <= most_questions else -(-asked.count() // most_questions)
    pool, most = pool_size(k), pool_size(k) + k
    text = F.lower(F.concat_ws(" ", F.coalesce("source_title", F.lit("")), F.coalesce("chunk_text", F.lit(""))))
    texts = corpus.where(F.col("chunk_id").isNotNull() & F.col("vector").isNotNull()).select("chunk_id", text.alias("_text"), "vector")
    best = None
    for b in range(blocks):
        rows = first if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if rows:
            run = _best(spark.sparkContext.broadcast(_Questions(rows)), most, to_arrow_type(questions.schema["query_id"].dataType))
            some = texts.mapInArrow(run, f"query_id {kind}, chunk_id string, semantic double, lexical double, _kind int")
            best = some if best is None else best.unionByName(some)
    if best is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, chunk_id string, score double, semantic double, lexical double")
    by_meaning = W.partitionBy("query_id", "_kind").orderBy(F.when(F.col("_kind") == 0, -F.col("semantic")).otherwise(-F.col("lexical")), "chunk_id")
    ranked = best.withColumn("_r", F.row_number().over(by_meaning)).where(F.col("_r") <= F.when(F.col("_kind") == 0, pool).otherwise(most))
    # a chunk that is in both lists is in the pool
    one = ranked.groupBy("query_id", "chunk_id").agg(F.min("_kind").alias("_kind"), F.first("semantic").alias("semantic"), F.first("lexical").alias("lexical"))
    score = SEMANTIC * F.when(F.col("_kind") == 0, F.col("semantic")).otherwise(0.0) + LEXICAL * F.col("lexical")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = one.withColumn("score", score).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return scored.select("query_id", "rank", "chunk_id", "score", "semantic", "lexical")


def _nearest(shared, most: int, id_type: pa.DataType, query_type: pa.DataType):
    """Of each partition and query, the ``most`` rows with the largest inner product: a partial top k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        floor = np.full(len(names), -np.inf)  # what a row must reach to be among a query's best so far
        query, ids, score = np.empty(0, int), None, np.empty(0)
        step = max(16, 250_000 // len(names))
        for batch in batches:
            rows = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            own = batch.column("id").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, step):
                met = (rows[at : at + step] @ asked.T).round(DECIMALS)
                row, q = np.nonzero(met >= floor)
                ids = own[at + row] if ids is None else np.concatenate([ids, own[at + row]])
                query, score = np.concatenate([query, q]), np.concatenate([score, met[row, q]])
                order = np.lexsort((ids, -score, query))
                query, ids, score = query[order], ids[order], score[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                floor[query[place == most - 1]] = score[place == most - 1]
                query, ids, score = (x[place < most] for x in (query, ids, score))
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], query_type), pa.array(ids, id_type), pa.array(score)], names=["query_id", "id", "score"])

    return run


def semantic_search(corpus: DataFrame, queries: DataFrame, *, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products of each query, ties to the smaller id.

    ``corpus`` has id, vector and ``queries`` query_id, vector; a row is not its own result.
    Scores are double precision, rounded to 12 decimals. Vectors are compared with those of
    their length; null ids and vectors, and vectors that hold nulls, take no part.

    The queries are taken in blocks of about ``block``, each broadcast (its size is bounded by
    ``block`` vectors) and met by one scan of the corpus. A partition keeps its best ``k`` + 1
    rows for each query, so what is shuffled grows with queries and partitions, not with pairs.
    """
    spark = corpus.sparkSession
    kinds = [queries.schema["query_id"].dataType, corpus.schema["id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"

    def whole(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(name, "vector").where(F.col(name).isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))

    asked, rows = whole(queries, "query_id").distinct(), whole(corpus, "id")
    found = spark.createDataFrame([], schema)
    for width, n in [tuple(r) for r in asked.groupBy(F.size("vector")).count().collect() if r[0] > 0]:
        blocks = -(-n // block)
        for b in range(blocks):
            some = asked.where((F.size("vector") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toPandas()
            if len(some):
                shared = spark.sparkContext.broadcast((some["query_id"].tolist(), np.array(some["vector"].tolist(), float)))
                best = _nearest(shared, k + 1, to_arrow_type(kinds[1]), to_arrow_type(kinds[0]))
                found = found.unionByName(rows.where(F.size("vector") == width).select("id", "vector").mapInArrow(best, schema))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.where(F.col("id") != F.col("query_id")).distinct()
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def lexical_score(text: Column, asked_terms: Column, asked_pairs: Column) -> Column:
    """Three quarters the share of terms, one quarter the share of word pairs found in a lower-case text; 0 without terms."""

    def share(wanted: Column, weight: float) -> Column:
        hits = F.size(F.filter(wanted, lambda x: text.contains(x)))
        return F.coalesce(weight * hits / F.nullif(F.size(wanted), F.lit(0)), F.lit(0.0))

    return F.when(F.size(asked_terms) > 0, F.least(F.lit(1.0), F.round(share(asked_terms, 0.75) + share(asked_pairs, 0.25), DECIMALS))).otherwise(0.0)


def search_within(corpus: DataFrame, questions: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, score): hybrid search of each question (query_id, question, vector,
    source_url) among the chunks of one page.

    The page is filtered first, so every one of its chunks is in the pool: 0.65 times the inner
    product and 0.35 times the lexical score. One equality join on the page; scores are
    expressions, and the rank is a window that Spark limits before it is shuffled.
    """
    asked = questions.select("query_id", "source_url", F.col("vector").alias("_v"), terms("question").alias("_terms"), phrases("question").alias("_pairs"))
    text = F.lower(F.concat_ws(" ", F.coalesce("source_title", F.lit("")), F.coalesce("chunk_text", F.lit(""))))
    met = corpus.select("chunk_id", "source_url", "vector", text.alias("_text")).join(asked, "source_url")
    score = SEMANTIC * F.round(dot(F.col("vector"), F.col("_v")), DECIMALS) + LEXICAL * lexical_score(F.col("_text"), F.col("_terms"), F.col("_pairs"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return met.select("query_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def first_hits(results: DataFrame, expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, hit): rank of the first result from the expected page, null if there is none."""
    pages = chunks.select("chunk_id", "source_url").distinct()
    ranks = results.join(pages, "chunk_id").join(expected, "query_id").where(F.col("source_url") == F.col("expected_source_url")).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return expected.select("query_id").join(ranks, "query_id", "left")


def retrieval_metrics(hits: DataFrame) -> DataFrame:
    """One row: cases, hits, recall, mean_reciprocal_rank; 0 for no cases."""
    mrr = F.coalesce(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), F.lit(0.0))
    return hits.agg(F.count("*").alias("cases"), F.count("hit").alias("hits"), F.coalesce(F.avg(F.col("hit").isNotNull().cast("double")), F.lit(0.0)).alias("recall"), mrr.alias("mean_reciprocal_rank"))
