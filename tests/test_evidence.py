"""Evidence cards, labels and novelty; embedding with a provider."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.identity import hash_embedding
from siltstone.operators import corpus, embedding, evidence
from siltstone.plans.tables import Buckets

FOUND = "session_id string, search_no int, rank int, chunk_id string"


def test_labels_and_novelty(spark):
    rows = [("s", 1, 1, "b"), ("s", 1, 2, "a"), ("s", 2, 1, "a"), ("s", 2, 2, "c"), ("s", 3, 1, "b"), ("s", 4, 1, "d"), ("s", 4, 2, "e"), ("t", 9, 1, "a")]
    df = spark.createDataFrame(rows + rows[:2], FOUND)
    scored = df.withColumn("score", F.col("search_no") / 10.0)  # found again, a chunk keeps its label and takes the new score
    want = {("s", "b", "S1", 0.3), ("s", "a", "S2", 0.2), ("s", "c", "S3", 0.2), ("s", "d", "S4", 0.4), ("s", "e", "S5", 0.4), ("t", "a", "S1", 0.9)}
    assert {tuple(r) for r in evidence.source_labels(scored).collect()} == want
    got = {(r.session_id, r.search_no): (r.found, r.new, r.novelty) for r in evidence.novelty(df).collect()}
    assert got == {("s", 1): (2, 2, "ok"), ("s", 2): (2, 1, "low"), ("s", 3): (1, 0, "none"), ("s", 4): (2, 2, "ok"), ("t", 9): (1, 1, "ok")}
    assert evidence.novelty(df.limit(0)).count() == evidence.source_labels(scored.limit(0)).count() == 0


def test_cards(spark):
    found = spark.createDataFrame([(1, 1, "a", 0.123456), (1, 2, "gone", 0.1)], "query_id int, rank int, chunk_id string, score double")
    chunks = spark.createDataFrame([("a", "T", "u", ["H", "K"], "x" * 600, 1), ("a", "T", "u", ["H", "K"], "x" * 600, 2), ("b", None, None, None, None, 3)], "chunk_id string, source_title string, source_url string, heading_path array<string>, chunk_text string, rank int")
    cards = [r.asDict() for r in evidence.evidence_cards(found, chunks).collect()]
    assert cards == [{"query_id": 1, "label": "S1", "rank": 1, "chunk_id": "a", "score": 0.1235, "title": "T", "url": "u", "heading": "H > K", "text": "x" * 520}]


def test_embedding(spark):
    chunks = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", ""), ("c", None), (None, "y")], "chunk_id string, chunk_text string")
    got = {r.chunk_id: r.vector for r in embedding.embedded(chunks, embedding.digest_vectors, model="m", revision="r", batch=2).collect()}
    want = {r.chunk_id: r.v for r in chunks.where("chunk_id is not null").select("chunk_id", hash_embedding(F.col("chunk_text")).cast("array<float>").alias("v")).collect()}
    assert got == want and set(got) == {"a", "b", "c"}
    assert embedding.embedded(chunks.limit(0), embedding.digest_vectors, model="m", revision="r").count() == 0


def test_provider_answers():
    asked = []

    def busy_twice(texts):
        asked.append(len(texts))
        if len(asked) < 3:
            raise embedding.Busy
        return [[0.5]] * len(texts)

    assert embedding._asked(busy_twice, ["x", "y"], 3, 0) == [[0.5], [0.5]] and asked == [2, 2, 2]
    with pytest.raises(ValueError):
        embedding._asked(lambda texts: [], ["x"], 3, 0)
    asked.clear()
    with pytest.raises(embedding.Busy):
        embedding._asked(busy_twice, ["x"], 2, 0)


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    cache = Buckets(str(tmp_path / "v"), ("chunk_id",), 4)
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(12)], "chunk_id string, chunk_text string")
    run = lambda rows, **more: embedding.embed_missing(cache, rows, embedding.digest_vectors, **({"model": "m", "revision": "r", "slices": 2} | more))
    assert run(chunks.where("chunk_id < 'c5'")) == 7
    first = {str(f) for f in (tmp_path / "v").rglob("*.parquet")}
    assert run(chunks) == 5 and run(chunks) == 0 and run(chunks.limit(1), revision="s") == 1
    assert first < {str(f) for f in (tmp_path / "v").rglob("*.parquet")}  # appends rewrite nothing
    assert cache.read(spark).groupBy("embedding_revision").count().orderBy("embedding_revision").collect() == [("r", 12), ("s", 1)]


def test_opened_cards_and_prompts(spark):
    found = spark.createDataFrame([(1, 2, "a", 0.5), (1, 1, "b", 0.6)], "query_id int, rank int, chunk_id string, score double")
    chunks = spark.createDataFrame([("a", "T", "u", ["H"], "x" * 900), ("b", None, "v", None, "y"), ("b", None, "v", None, "y")], "chunk_id string, source_title string, source_url string, heading_path array<string>, chunk_text string")
    assert {(r.label, r.chunk_id, r.heading, len(r.text)) for r in evidence.opened_cards(found, chunks).collect()} == {("S2", "a", "H", 900), ("S1", "b", "", 1)}
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    supports = spark.createDataFrame([(1, "a", ["p", "q"])], "query_id int, chunk_id string, supports array<string>")
    got = {r.query_id: r.prompt for r in evidence.prompts(asked, found, chunks, supports, instructions="Cite.").collect()}
    assert got[1] == "Cite.\n\nScope of the sources:\n[S2] may be used only for: p; q\n\nQuestion: why?\n\nExcerpts:\n[S1] \nURL: v\nExcerpt: y\n\n[S2] T\nURL: u\nExcerpt: " + "x" * 900
    assert got[2] == "Cite.\n\nQuestion: how?\n\nExcerpts:\n"


def test_scan_and_checkpoints(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/rag_documents.parquet")
    cleared, counted = corpus.clear_checkpoints(rows)
    assert cleared.columns == rows.columns and cleared.where("indexed_content_hash is not null or chunked_content_hash is not null").count() == 0
    assert counted.first()[0] == rows.where("indexed_content_hash is not null").count() and corpus.clear_checkpoints(rows.limit(0))[1].first()[0] == 0
    assert corpus.documents_scan(rows).where("consecutive_404_count is null").count() == 0
