from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from siltstone.functions.nodes import NODES
from siltstone.llm.splitting import oversized_pieces, split_pieces


def pieces(spark, texts, limit=40, overlap=10):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.p for r in rows.select("i", split_pieces(F.col("t"), limit, overlap).alias("p")).orderBy("i").collect()]


def check(text, got, limit, overlap):
    assert "".join(p.piece[p.overlap :] for p in got) == text
    for p in got:
        assert 0 < len(p.piece) <= limit and p.overlap <= overlap
        assert text[p.start : p.start + len(p.piece)] == p.piece


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c.,\n\té😀 。", max_size=200), min_size=1, max_size=30))
def test_pieces_are_the_text(spark, texts):
    for text, got in zip(texts, pieces(spark, texts)):
        check(text, got, 40, 10)


def test_strongest_boundary_first(spark):
    first = [p[0].piece for p in pieces(spark, ["aaaa bbbb cccc dd.\n\neeee ffff. gggg hhhh iiii jjjj kkkk", "aaaa bbbb cccc ddd. eee ffff gggg hhhh iiii jjjj kkkk", "aaaa bbbb cccc, dddd eee ffff gggg hhhh iiii jjjj"])]
    assert first == ["aaaa bbbb cccc dd.\n\n", "aaaa bbbb cccc ddd. ", "aaaa bbbb cccc, "]


def test_no_boundary_and_limits(spark):
    got = pieces(spark, ["x" * 100, "y" * 40, "y" * 41, "", None, "😀" * 90])
    for text, p in zip(["x" * 100, "y" * 40, "y" * 41, ""], got):
        check(text, p, 40, 10)
    assert len(got[1]) == 1 and got[4] is None and all(len(p.piece) <= 40 for p in got[5])


def test_very_long_text(spark):
    text = "A sentence of words. " * 40000
    check(text, pieces(spark, [text], 1600, 240)[0], 1600, 240)


def node(kind, text=None, level=None, items=None, rows=None):
    return (kind, level, text, None, None, False, items, rows)


def test_units_and_heading_paths(spark):
    long = "w " * 900
    nodes = [node("heading", "A", 1), node("heading", "B", 2), node("paragraph", long), node("heading", "C", 2), node("list", items=["short", long, None]), node("heading", long, 3), node("table", rows=[["c" * 900, None], ["d" * 900]]), node("code", None), node("paragraph", "short")]
    chunks = spark.createDataFrame([("c1", long, ["H"], 1), ("c1", long, ["H"], 1), ("c2", "x" * 1600, None, 1), ("c3", None, None, 1), (None, long, None, 1)], "chunk_id string, chunk_text string, heading_path array<string>, piece int")
    docs = spark.createDataFrame([("d", nodes, "x"), ("d", nodes, "x"), ("e", None, "x"), ("f", [], "x")], f"doc_id string, nodes {NODES}, item_id string")
    got = oversized_pieces(chunks, docs).collect()
    paths = {(r.item_kind, r.item_id, r.item_no, r.unit_no): r.heading_path for r in got}
    assert set(paths) == {("chunk", "c1", 0, 0), ("chunk", None, 0, 0), ("node", "d", 2, 0), ("node", "d", 4, 1), ("node", "d", 6, 0)}
    assert paths["node", "d", 2, 0] == ["A", "B"] and paths["node", "d", 4, 1] == ["A", "C"] and paths["node", "d", 6, 0] == ["A", "C", long]
    assert len(got) == len({(r.item_kind, r.item_id, r.item_no, r.unit_no, r.piece_no) for r in got})
    assert oversized_pieces(chunks.limit(0), docs.limit(0)).count() == 0
