from datetime import datetime

import numpy as np
import pytest

from siltstone.llm import neighbours
from siltstone.llm.neighbours import latest_vectors, nearest_neighbours, neighbour_pairs

SCHEMA = "embedding_model string, embedding_revision string, chunk_id string, embedding_dimension int, vector array<float>, created_at timestamp, _list string, _role string"
T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def exact(ids, x, k):
    x = x.astype(np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i, row in enumerate(np.lexsort((np.broadcast_to(np.arange(len(ids)), s.shape), -s), axis=1)[:, :k]) for j in row}


def vectors(n=3000, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, d))
    return [f"v{i:05}" for i in range(n)], centres[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, d))


def test_recall(spark):
    ids, x = vectors()
    df = frame(spark, [("m", "r", i, 24, v.tolist(), T1) for i, v in zip(ids, x)])
    want = exact(ids, x, 5)
    got = [(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5).collect()]
    assert len(got) == len(set(got)) == 15000 and len(set(got) & want) >= 0.98 * len(want)


@pytest.mark.parametrize("more", [{"most_lists": 8}, {"list_rows": 128, "sample_rows": 512}])
def test_lists_as_on_tables_of_another_size(spark, more):
    """Lists that had to grow, as beyond most_lists x list_rows vectors, and many more lists than the bounded sample could fit."""
    ids, x = vectors(9000)
    df = frame(spark, [("m", "r", i, 24, v.tolist(), T1) for i, v in zip(ids, x)])
    got = {(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5, **more).collect()}
    want = exact(ids, x, 5)
    assert len(got & want) >= 0.97 * len(want)
    sizes = neighbours.space_sizes(df)
    books = neighbours.fit_codebooks(df, sizes, {k: n for k, (n, _) in sizes.items()}, most_copies=9, kept_copies=6, parts=8, seed=11, **{"list_rows": 256, "most_lists": 262144, "sample_rows": 65536} | more)
    (book,) = books.values()
    assert len(book.lists) == book.first[-1] and (len(book.lists) <= 10 if "most_lists" in more else 50 < len(book.lists) < 90)
    filed = df.select("embedding_model", "embedding_revision", "chunk_id", "vector").mapInArrow(
        neighbours._file(spark.sparkContext.broadcast(books), 4, 0.3), "embedding_model string, embedding_revision string, chunk_id string, vector array<float>, _list int, _role int"
    )
    counts = filed.groupBy("_list").count().collect()
    assert sum(r["count"] for r in counts) <= 4 * 9000 and max(r["count"] for r in counts) < 20 * np.median([r["count"] for r in counts])


def test_small_groups_among_many_lists(spark):
    """As on large tables: many small groups far from each other, most of them without a centroid of their own."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1500, 64))
    x = np.repeat(centres, 12, axis=0) + 0.35 * rng.normal(size=(18000, 64))
    ids = [f"v{i:05}" for i in range(18000)]
    df = frame(spark, [("m", "r", i, 64, v.tolist(), T1) for i, v in zip(ids, x)])
    got = [(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5, least=0.8).collect()]
    inside = np.array([exact(ids[i : i + 12], x[i : i + 12], 5) for i in range(0, 18000, 12)], object)  # groups do not mix at this distance
    want = set().union(*inside)
    assert len(got) == len(set(got)) and max(np.unique([a for a, _ in got], return_counts=True)[1]) <= 5
    assert len(set(got) & want) >= 0.98 * len(want)


def test_nearest_lists_against_all():
    ids, x = vectors(500)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    book = neighbours.Codebook(unit[:4], [unit[4:9], unit[9:10], unit[10:30], unit[30:33]])
    near, value = book.nearest(unit, 6)
    score = unit @ book.lists.T
    assert np.allclose(value, np.take_along_axis(score, near, 1), atol=1e-6)
    assert (near == np.argsort(-score, axis=1, kind="stable")[:, :6]).mean() > 0.99


def test_hot_copies_and_ties(spark):
    ids, x = vectors(600)
    x[:300] = x[0]
    x[300:303] = 2 * x[0]
    df = frame(spark, [("m", "r", i, 24, v.tolist(), T1) for i, v in zip(ids, x)])
    got = {(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5).collect()}
    want = exact(ids, x, 5)
    hot = set(ids[:303])
    assert {p for p in got if p[0] in hot} == {p for p in want if p[0] in hot}
    assert len(got & want) >= 0.95 * len(want)


def test_sample_of_a_hot_vector(spark):
    """A third of all rows equal and inside the sample: it holds the vector once, and stays within its limit."""
    ids, x = vectors(6000)
    x[:2000] = x[0]
    rows = [("m", "r", i, 24, v.tolist(), T1) for i, v in zip(ids, x)]
    df = frame(spark, rows + [(f"n{j}", "r", i, 24, v.tolist(), T1) for j in range(3) for i, v in zip(ids[:400], vectors(400, seed=j + 2)[1])])
    got = {(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5, sample_rows=2048).where("embedding_model = 'm'").collect()}
    want = exact(ids, x, 5)
    assert len(got & want) >= 0.95 * len(want)
    sizes = neighbours.space_sizes(df)
    sample = neighbours.sample_vectors(df, sizes, {key: 500 for key in sizes}, 11, 100, 6).collect()
    by_space = {key[0]: [r for r in sample if r["_space"] == key[0]] for key in sizes}
    assert all(len({tuple(r.vector) for r in some}) == len(some) < 650 for some in by_space.values()) and len(sample) > 1200
    assert max(r["_n"] for r in sample) <= 6


def test_more_copies_than_candidates(spark):
    """Groups of copies too small to count as hot, but larger than the candidates that are reranked."""
    ids, x = vectors(400)
    for i in range(0, 400, 20):
        x[i : i + 20] = x[i]
    df = frame(spark, [("m", "r", i, 24, v.tolist(), T1) for i, v in zip(ids, x)])
    df = df.unionByName(frame(spark, [("n", "r", f"w{i}", 24, np.random.default_rng(i).normal(size=24).tolist(), T1) for i in range(8)]))
    got = {(r.chunk_id, r.neighbour_id) for r in nearest_neighbours(df, k=5, depth=8).collect() if r.chunk_id[0] == "v"}
    assert got == exact(ids, x, 5)


def test_unusable_and_old_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("m", "r", "a", 2, [1.0, 0.0], T1), ("m", "r", "a", 2, [0.0, 1.0], T2), ("m", "r", "b", 2, [0.0, 1.0], T1), ("m", "r", "b", 2, [0.0, 1.0], T1), ("m", "r", "c", 2, [nan, 1.0], T1),
        ("m", "r", "d", 2, [0.0, 0.0], T1), ("m", "r", "e", 2, [1.0], T1), ("m", "r", "f", 2, None, T1), ("m", "r", "g", 2, [inf, 1.0], T1), ("m", "r", "h", None, [1.0, 1.0], T1),
        ("m", "r", None, 2, [1.0, 1.0], T1), ("m", "r", "i", 2, [1.0, None], T1), ("m", "r", "j", 2, [1.0, 1.0], T1), ("m", "r", "j", 2, [nan, 1.0], T2), (None, "r", "a", 2, [1.0, 1.0], None), ("n", "r", "z", 3, [1.0, 1.0, 1.0], T1),
    ]
    df = frame(spark, rows)
    assert {(r.embedding_model, r.chunk_id): r.vector for r in latest_vectors(df).collect()} == {("m", "a"): [0.0, 1.0], ("m", "b"): [0.0, 1.0], (None, "a"): [1.0, 1.0], ("n", "z"): [1.0, 1.0, 1.0]}
    got = nearest_neighbours(df, k=5, least=0.8)
    assert [tuple(r) for r in neighbour_pairs(got).collect()] == [("m", "r", "a", "b")]
    assert nearest_neighbours(df.limit(0)).count() == 0
