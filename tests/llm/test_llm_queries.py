"""Queries with SQL against it; the others against brute force on the smaller tables."""

import re
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm.queries import ORACLES, QUERIES
from siltstone.runtime import table
from tests.compare import compare

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.endswith("_found") or n in ORACLES])
def test_query(spark, name):
    rows, wanted, equal = compare(spark, SMALL, name)
    assert rows > 0
    assert equal or name not in ORACLES, (rows, wanted)


COLUMNS = {
    "p1_found": {"chunk_id": "string", "line_no": "int"}, "p3_found": {"doc_id": "string", "line_no": "int"},
    "p4_found": {"embedding_model": "string", "embedding_revision": "string", "chunk_id_a": "string", "chunk_id_b": "string"},
    "p5_found": {"item_kind": "string", "item_id": "string", "item_no": "int"}, "p6_found": {"chunk_id_a": "string", "chunk_id_b": "string"},
    "p7_found": {"item_id": "bigint", "doc_id": "bigint"}, "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_result_columns_and_distinct_rows(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert dict(found.dtypes) == COLUMNS[name]
    rows = found.collect()
    assert len(rows) == len(set(rows))


def test_similar_chunks_against_all_pairs(spark):
    chunks, documents = table(spark, NEXT, "rag_chunks"), table(spark, NEXT, "rag_documents")
    rows = chunks.join(documents.select("doc_id", "document_version").distinct(), ["doc_id", "document_version"]).select("chunk_id", "doc_id", "chunk_text").distinct().collect()
    sets, holders = [], defaultdict(list)
    for i, r in enumerate(rows):
        w = WORD.findall(r.chunk_text.lower())
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)})
        for s in sets[-1]:
            holders[s].append(i)
    want = set()
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += j > i
        for j, n in common.items():
            if n and rows[i].doc_id != rows[j].doc_id and n >= 0.6 * (len(s) + len(sets[j]) - n):
                want.add(tuple(sorted((rows[i].chunk_id, rows[j].chunk_id))))
    got = {tuple(r) for r in QUERIES["p6_found"](spark, NEXT).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_neighbours_against_all_pairs(spark):
    from siltstone.llm.neighbours import latest_vectors

    found = QUERIES["p4_found"](spark, NEXT).collect()
    got = {tuple(r) for r in found}
    want = set()
    rows = latest_vectors(table(spark, NEXT, "rag_chunk_embeddings")).toPandas()
    for (model, revision), g in rows.groupby(["embedding_model", "embedding_revision"]):
        g = g.sort_values("chunk_id")
        ids, x = g.chunk_id.to_numpy(), np.array(g.vector.tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sims = np.round(x @ x.T, 12)
        np.fill_diagonal(sims, -1)
        for i, near in enumerate(np.argsort(-sims, axis=1, kind="stable")[:, :5]):
            want |= {(model, revision, *sorted((ids[i], ids[j]))) for j in near if sims[i, j] >= 0.8}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_reading_levels_on_held_out_labels(spark):
    from siltstone.llm.reading import reading_levels

    labels = table(spark, "/root/testdata/sf0.1", "reading_labels")
    rated = {r.doc_id: r.m for r in labels.where("reading_level is not null").groupBy("doc_id").agg({"reading_level": "avg"}).toDF("doc_id", "m").collect()}
    documents = table(spark, "/root/testdata/sf0.1", "documents")
    fitted_on = labels.where("doc_id % 2 = 0")  # the others are held out
    held = {r.doc_id: r for r in reading_levels(documents, fitted_on).collect() if r.doc_id in rated and r.doc_id % 2}
    judged = [(r.estimate, rated[d]) for d, r in held.items() if r.estimate is not None]
    assert len(judged) > 200
    assert np.sqrt(np.mean([(a - b) ** 2 for a, b in judged])) < 0.4
    assert np.mean([(a >= 3.5) == (b >= 3.5) for a, b in judged]) > 0.95
