from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import identity as ids
from siltstone.functions.citations import cited_labels, grounding, renumbered
from siltstone.operators import chunking, corpus, extract, history, search
from siltstone.plans.refresh import change_counts, plan_refresh
from siltstone.plans.tables import Buckets, active_snapshot, publish_snapshot
from siltstone.sources import pages as sources
from siltstone.streaming.pages import current_pages, keep_current

PAGE = """<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article><div class="theme-doc-markdown">
<h1>The​ title</h1><p>One <b>two</b> , three.<p>Next&nbsp;one<p></p>loose<img src=x>
<h2>Part</h2><ul><li>first<li>second <i>item</i></ul><ol><li>one</li></ol>
<table><tr><th>A<th>B</tr><tr><td>1<td>2</tr><tr></tr></table>
<div class="codeBlockContainer_x language-sql"><pre><code>select 1<br>from t
</code></pre></div>
<div class="tabs-container"><ul><li role="tab">CLI</li></ul><div role="tabpanel"><div class="codeBlockContainer"><code>run</code></div></div></div>
</div></article><span class="theme-last-updated"><time datetime="2024-01-02"></time></span></body></html>"""


def column(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_urls(spark):
    got = column(spark, ids.canonical_url, " HTTPS://Ex.com/A/b//?utm_source=x&b=2&a=1&ref=n&c#f ", "https://ex.com/", "https://ex.com/a b?x", None, "")
    assert got == ["https://ex.com/A/b?a=1&b=2&c=", "https://ex.com/", "https://ex.com/a b?x=", None, ""]
    assert column(spark, ids.slug, "https://h/aws/en/Some_Page/", "https://h/", "https://h/gcp/en/") == ["some-page", "index", "gcp-en"]


def test_titles_keys_terms(spark):
    long = "word " * 30
    assert column(spark, ids.history_title, " a \n b ", "", long, "x" * 100, None) == ["a b", "New conversation", ("word " * 17).strip()[:84] + "…", "x" * 85 + "…", None]
    assert column(spark, ids.query_key, "Beta alpha, beta!", "???") == ["alpha beta beta", ""]
    assert column(spark, ids.terms, "What is the Delta table, delta of it?") == [["delta", "table"]]
    assert column(spark, ids.phrases, "a b c", "one", "") == [["a b", "b c"], [], []]
    assert column(spark, ids.clean_text, "a  b​ , c ; d") == ["a b, c; d"]


def test_citations(spark):
    rows = spark.createDataFrame([("x [S2, S9] y [S1,S2]", 0.9, 3), ("none", 0.9, 3), ("[S7]", 0.9, 3), ("[S1]", 0.4, 3), ("[S1]", 0.9, 0), (None, 0.9, 1), ("a [S3]", 0.9, 3)], "t string, s double, n int")
    got = rows.select(cited_labels(F.col("t")).alias("l"), grounding(F.col("t"), F.col("s"), F.col("n")).alias("g"), renumbered(F.col("t"), F.col("n")).alias("r")).collect()
    assert got[0].l == ["S2", "S9", "S1"] and got[0].g is None and got[0].r == "x [S2, S9] y [S1, S2]"
    assert [r.g for r in got[1:6]] == ["no_citations_in_model_output", "invalid_citation_labels", "below_relevance_threshold", "no_results", "no_citations_in_model_output"]
    assert got[6].r == "a [S1]"


def test_extraction(spark):
    rows = spark.createDataFrame([("a", PAGE), ("b", "<article><p>no title</article>"), ("c", None), ("d", "")], "doc_id string, html string")
    got = {r.doc_id: r for r in extract.extract_pages(rows).collect()}
    assert set(got) == {"a", "b", "d"} and got["b"].error and got["d"].nodes is None
    a = got["a"]
    assert (a.title, a.source_last_updated) == ("The title", "2024-01-02")
    assert [n.type for n in a.nodes] == ["heading", "paragraph", "paragraph", "heading", "list", "list", "table", "code", "code"]
    assert a.nodes[1].text == "One two, three." and a.nodes[2].text == "Next one"
    assert a.nodes[4]["items"] == ["first", "second item"] and a.nodes[6].rows == [["A", "B"], ["1", "2"]]
    assert a.nodes[7].language == "sql" and a.nodes[7].text == "select 1\nfrom t" and a.nodes[8].tab_label == "CLI"
    assert a.markdown_body.startswith("# The title\n\nOne two, three.\n\nNext one\n\n## Part\n\n• first\n• second item\n\n1. one\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n```sql\n")
    assert a.markdown_body.endswith("**CLI**\n\n```\nrun\n```\n")


def test_split_text(spark):
    rows = spark.createDataFrame([("",), (None,), ("a" * 50,), ("one two three four five six",)], "t string")
    assert [r.p for r in rows.select(chunking.split_text(F.col("t"), 20, 5).alias("p")).collect()] == [[], None, ["a" * 20, "a" * 20, "a" * 20], ["one two three four", "four five six"]]


def test_chunking(spark):
    from siltstone.functions.nodes import NODES

    def node(kind, text=None, level=None, items=None, ordered=None, rows=None):
        return (kind, level, text, None, None, ordered, items, rows)

    nodes = [node("paragraph", "before"), node("heading", "H1", 1), node("heading", "H2", 2), node("paragraph", "p" * 30), node("list", items=["x", "y"], ordered=True), node("heading", "empty", 3), node("heading", "H1b", 1), node("table", rows=[["a", None], ["c"]])]
    rows = spark.createDataFrame([("d", "v", nodes), ("e", "v", []), ("f", "v", None)], f"doc_id string, document_version string, nodes {NODES}")
    got = sorted(chunking.chunk_documents(rows, most=40, overlap=10).collect(), key=lambda r: r.position)
    assert [r.chunk_text for r in got] == ["before", "H1\nH2\n" + "p" * 30, "H1\nH2\n" + "p" * 10 + "\n1. x\n2. y", "H1b\na | \nc"]
    assert [r.heading_path for r in got] == [[], ["H1", "H2"], ["H1", "H2"], ["H1b"]] and len({r.chunk_id for r in got}) == 4


def test_neighbours_and_reading_order(spark):
    c = spark.createDataFrame([(f"c{i}", "d", "v", i) for i in range(7)] + [("o", "e", "v", 1)], "chunk_id string, doc_id string, document_version string, position int")
    near = {(r.anchor_id, r.chunk_id) for r in corpus.neighbours(c, c, 2).collect()}
    assert near == {(f"c{i}", f"c{j}") for i in range(7) for j in range(7) if abs(i - j) <= 2} | {("o", "o")}
    asked = spark.createDataFrame([(1, ["c2", "nope", "c0", "c2"])], "request_id int, ids array<string>")
    assert [r.chunk_id for r in corpus.read_in_order(asked, c).orderBy("ord").collect()] == ["c2", "c0", "c2"]


def test_chunks_in_order(spark):
    chunks = spark.createDataFrame([("b", "d", "v", 1), ("a", "d", "v", 0), ("a", "d", "v", 0), ("x", "d", "old", 0), ("c", "a", "v", 5)], "chunk_id string, doc_id string, document_version string, position int")
    documents = spark.createDataFrame([("d", "v", "ok"), ("a", "v", "pending_snapshot"), ("e", "v", "removed")], "doc_id string, document_version string, status string")
    assert [r.chunk_id for r in corpus.ordered_chunks(chunks, documents).collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        corpus.ordered_chunks(chunks, documents.where("status = 'removed'"))


def test_sources_merge_and_path_families(spark):
    found = spark.createDataFrame([("1", "u1", "a", "r1", 0), ("1", "u1", "b", "r2", 1), ("2", "u2", "a", "r1", 0)], "doc_id string, url string, category string, scope string, root_order int")
    curated = spark.createDataFrame([("1", "u1c", "c", "supplemental"), ("3", "u3", "c", "supplemental")], "doc_id string, url string, category string, scope string")
    got = {r.doc_id: tuple(r)[1:] for r in corpus.merge_sources(found, curated).collect()}
    assert got == {"1": ("u1c", "c", "r2|supplemental"), "2": ("u2", "a", "r1"), "3": ("u3", "c", "supplemental")}
    pages = spark.createDataFrame([("h", p) for p in ("/a/x", "/a", "/ab", "/b-more/x", "/c")] + [("other", "/a/x")], "host string, path string")
    roots = spark.createDataFrame([("h", "/a/", "r"), ("h", "/b", "s")], "host string, prefix string, root_id string")
    assert {(r.host, r.path, r.root_id) for r in corpus.in_path_family(pages, roots, F.col("path"), F.col("host")).collect()} == {("h", "/a/x", "r"), ("h", "/a", "r"), ("h", "/b-more/x", "s")}
    assert corpus.in_path_family(pages, roots.limit(0), F.col("path"), F.col("host")).count() == 0


def test_refresh_plan(spark):
    kinds = "doc_id string, document_version string, indexed_content_hash string, indexed_source_last_updated string, chunked_content_hash string, chunked_source_last_updated string, chunked_document_version string"
    no = (None, None, None)
    rows = [("same", "h:v1", "h", "d", *no), ("hash", "h:v1", "h", "d", *no), ("cut", "h:v0", "h", "d", *no), ("date", "h:v1", "h", "d", *no), ("gone", "h:v1", "h", None, *no), ("bad", "h:v1", "h", None, *no), ("done", "h:v1", "h", "d", "h2", "d", "h2:v1")]
    old = spark.createDataFrame(rows, kinds)
    new = spark.createDataFrame([("same", "h", "d"), ("hash", "h2", "d"), ("cut", "h", None), ("date", "h", "d2"), ("bad", None, None), ("new", "n", None), ("done", "h2", "d")], "doc_id string, source_content_hash string, source_last_updated string")
    got = {r.doc_id: r for r in plan_refresh(old, new, "v1").collect()}
    assert {k: r.change for k, r in got.items()} == {"same": "unchanged", "hash": "changed", "cut": "changed", "date": "dated", "gone": "missing", "bad": "failed", "new": "added", "done": "changed"}
    assert {k for k, r in got.items() if r.needs_chunks} == {"hash", "cut", "new"} and {k for k, r in got.items() if r.needs_snapshot} == {"hash", "cut", "new", "date", "done"}
    assert change_counts(plan_refresh(old, new, "v1")).first().asDict() == {"added": 1, "changed": 3, "dated": 1, "unchanged": 1, "failed": 1, "missing": 1, "pending": 5, "to_chunk": 3}


def test_marking_and_deleting(spark):
    documents = spark.createDataFrame([("a", "pending_snapshot", "h", "t", None, None, "new"), ("b", "removed", "h", "t", "g", None, "x"), ("c", None, "h", "t", None, None, None)], "doc_id string, status string, source_content_hash string, source_last_updated string, indexed_content_hash string, indexed_source_last_updated string, last_run_action string")
    got = {r.doc_id: tuple(r)[1:] for r in corpus.materialised(documents).collect()}
    assert got == {"a": ("ok", "h", "t", "h", "t", "published"), "b": ("removed", "h", "t", "g", None, "x"), "c": (None, "h", "t", None, None, None)}
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "gone"), ("4", None)], "chunk_id string, doc_id string")
    assert {r.chunk_id for r in corpus.without_removed(chunks, documents).collect()} == {"1", "3", "4"}
    vectors = spark.createDataFrame([("1", "m", "r", None, 1, [1.0]), ("2", "m", "r", None, 1, [2.0])], "chunk_id string, embedding_model string, embedding_revision string, created_at timestamp, embedding_dimension int, vector array<float>")
    left = corpus.delete_documents(documents.where("doc_id = 'b'"), documents, chunks, vectors)
    assert [d.count() for d in left] == [2, 3, 1]
    day = [datetime(2025, 1, d) for d in (1, 2)]
    more = spark.createDataFrame([("2", "m", "r", day[0], 1, [7.0]), ("2", "m", "r", day[1], 1, [8.0]), ("5", "m", "r", None, 1, [9.0])], vectors.schema)
    saved = corpus.save_vectors(vectors, more)
    assert {r.chunk_id: r.vector for r in saved.collect()} == {"1": [1.0], "2": [8.0], "5": [9.0]} and {tuple(r) for r in corpus.save_vectors(saved, more).select("chunk_id", "created_at").collect()} == {tuple(r) for r in saved.select("chunk_id", "created_at").collect()}


def test_owners_and_lists(spark):
    conversations = spark.createDataFrame([("o", "c1", "active", 1), ("o", "c2", "active", 2), ("o", "c3", "closed", 3), ("p", "c4", "active", 1)], "owner_user_id string, conversation_id string, status string, updated_at int")
    turns = spark.createDataFrame([(c, i) for c in ("c1", "c3", "c4") for i in (1, 2)], "conversation_id string, turn_number int")
    asked = spark.createDataFrame([("o", "c1"), ("o", "c1"), ("o", "c3"), ("o", "c4"), ("p", "c4")], "owner_user_id string, conversation_id string")
    assert {(r.owner_user_id, r.conversation_id, r.turn_number) for r in history.owned_turns(asked, turns, conversations).collect()} == {("o", "c1", 1), ("o", "c1", 2), ("p", "c4", 1), ("p", "c4", 2)}
    assert [(r.owner_user_id, r.place, r.conversation_id) for r in history.newest_conversations(conversations).orderBy("owner_user_id", "place").collect()] == [("o", 1, "c2"), ("o", 2, "c1"), ("p", 1, "c4")]
    entries = spark.createDataFrame([("https://h/a", "c", "r"), ("https://h/a/?ref=x", "c", "r"), ("ftp://h/b", "c", "r"), (None, "c", "r"), ("https://h/c", "z", "r"), ("https://h/d", "c", ""), ("https://h/e", "c", "r")], "url string, category string, reason string")
    assert {r.url: r.problem for r in sources.checked_list(entries, {"c"}).collect()} == {"https://h/a": "duplicate", "https://h/a/?ref=x": "duplicate", "ftp://h/b": "url", None: "url", "https://h/c": "category", "https://h/d": "reason", "https://h/e": None}
    with pytest.raises(ValueError, match="duplicate|url"):
        sources.curated_list(entries, {"c"})
    assert sources.curated_list(entries.where("url = 'https://h/e'"), {"c"}).count() == 1
    rules = [("at", "/x/y", "one"), ("under", "/x", "family")]
    assert column(spark, lambda v: ids.path_category(v, rules, "rest"), "https://h/x/y", "https://h/x/y/z", "https://h/q", None) == ["one", "family", "rest", "rest"]


def test_deep_and_broken_pages(spark):
    deep = "<article><h1>T</h1>" + "<div>" * 5000 + "<p>in it</p>" + "</div>" * 5000 + "</article>"
    wide = "<article><h1>T</h1>" + "<p>one" * 20000 + "</article>"
    pages = [("deep", deep), ("wide", wide), ("cut", "<article><h1>T</h1><ul><li>a<li>b <b>c</ul>x<table><tr><td>1<table><tr><td>2</table></table>"), ("odd", "<article><h1>T</h1></p></ul><![x[<p &#xFFFFFFFF; <" + "<b" * 1000)]
    got = {r.doc_id: r for r in extract.extract_pages(spark.createDataFrame(pages, "doc_id string, html string")).collect()}
    assert set(got) == {"deep", "wide", "cut", "odd"} and [n.text for n in got["deep"].nodes] == ["T", "in it"] and len(got["wide"].nodes) == 20001
    assert got["cut"].nodes[1]["items"] == ["a", "b c"] and got["cut"].nodes[2].rows == [["1 2", "2"], ["2"]]
    fetched = spark.createDataFrame([("a", "https://h/a/", "https://h/a", 200, "<p>", None, "ok"), ("b", "https://h/b/", None, 404, None, None, "not_found"), ("c", "https://h/c", "https://h/c", 200, "", None, "ok"), ("d", None, None, None, None, "down", None)], "doc_id string, requested_url string, resolved_url string, http_status int, html string, error_message string, outcome string")
    assert {r.doc_id: (r.canonical_url, r.status) for r in extract.document_shells(fetched).collect()} == {"b": ("https://h/b", "removed"), "c": ("https://h/c", "fetch_failed"), "d": (None, "fetch_failed")}


def test_search_within_pages(spark):
    corpus_rows = spark.createDataFrame([("a", "u", "t", "apple pie", [1.0, 0.0]), ("b", "u", "t", "pie of apple", [0.0, 1.0]), ("c", "w", "t", "apple pie", [5.0, 5.0]), ("d", None, "t", "apple", [1.0, 1.0])], "chunk_id string, source_url string, source_title string, chunk_text string, vector array<double>")
    asked = spark.createDataFrame([(1, "apple pie", [1.0, 0.5], "u"), (2, "of the", [0.0, 1.0], "w"), (3, "x", [1.0, 1.0], "nowhere")], "query_id int, question string, vector array<double>, source_url string")
    got = [(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in search.search_within(corpus_rows, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", round(0.65 * 0.5 + 0.35 * 0.75, 9)), (2, 1, "c", 3.25)]


def test_fingerprint_follows_content_not_order(spark):
    rows = [(f"d{i}", "v", None, "ok") for i in range(20)]
    make = lambda r: corpus.corpus_fingerprint(spark.createDataFrame(r, "doc_id string, document_version string, source_last_updated string, status string")).first()
    one = make(rows)
    assert one == make(rows[::-1]) and one.documents == 20 and one.fingerprint != make([*rows[:-1], ("d19", "w", None, "ok")]).fingerprint
    assert make([("x", "v", None, "removed")]).documents == 0


def test_bucketed_table(spark, tmp_path):
    t = Buckets(str(tmp_path / "t"), ("k",), 3)
    assert not t.exists(spark)
    t.upsert(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    t.upsert(spark.createDataFrame([(2, "B"), (30, "c")], "k int, v string"))
    kept = [f for f in files if f.exists()]
    assert {(r.k, r.v) for r in t.read(spark).collect()} == {(i, "a") for i in range(20) if i != 2} | {(2, "B"), (30, "c")}
    assert 0 < len(kept) < len(files)  # a bucket that is not touched keeps its file
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"))
    t.delete_where_in(spark.createDataFrame([(i, 0) for i in range(25)], "k int, other int"))
    assert [(r.k, r.v) for r in t.read(spark).collect()] == [(30, "c")]
    t.append(spark.createDataFrame([(9, "z", 5)], "k int, v string, n long"))
    t.append(spark.createDataFrame([(9, "z", 6)], "k int, v string, n long"))
    assert sorted((r.k, r.n) for r in t.read(spark).collect()) == [(9, 5), (9, 6), (30, None)]
    t.compact(spark, ["n"])
    assert sorted((r.k, r.v, r.n) for r in t.read(spark).collect()) == [(9, "z", 6), (30, "c", None)]


def test_snapshot_publication(spark, tmp_path):
    root = str(tmp_path / "s")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, chunk_text string")
    at = datetime(2025, 1, 1)
    vectors = spark.createDataFrame([("a", "m", "r", [3.0, 4.0], at), ("b", "m", "r", [0.0, 0.0], at)], "chunk_id string, embedding_model string, embedding_revision string, vector array<float>, created_at timestamp")
    assert active_snapshot(spark, root) is None
    first = publish_snapshot(root, chunks, vectors, model="m", revision="r", dimension=2)
    assert publish_snapshot(root, chunks, vectors, model="m", revision="r", dimension=2) == first
    assert {r.chunk_id: r.vector for r in spark.read.parquet(first.snapshot).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    with pytest.raises(ValueError):
        publish_snapshot(root, chunks.union(spark.createDataFrame([("c", "z")], chunks.schema)), vectors, model="m", revision="r", dimension=2)
    assert active_snapshot(spark, root) == first
    second = publish_snapshot(root, chunks.where("chunk_id = 'a'"), vectors, model="m", revision="r", dimension=2)
    assert second.snapshot != first.snapshot and active_snapshot(spark, root) == second and spark.read.parquet(first.snapshot).count() == 2


def test_turns(spark):
    old = spark.createDataFrame([("u", 4)], "key string, turn_number int")
    new = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("w", 1, "c" * 2000)], "key string, at int, text string")
    numbered = history.numbered_turns(new, old, key="key", order=["at"])
    assert {(r.key, r.at): r.turn_number for r in numbered.collect()} == {("u", 1): 5, ("u", 2): 6, ("w", 1): 1}
    last = {r.key: r.turns for r in history.last_turns(new, key="key", order=["at"], texts={"key": 9, "text": 900}, limit=1).collect()}
    assert [(x.key, x.text) for x in last["u"]] == [("u", "b")] and len(last["w"][0].text) == 900


def test_numbering_of_a_hot_key(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 37) % 500, i) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.i: r._n for r in history.numbered(spark.createDataFrame(rows, "key string, at int, i int").repartition(5), key="key", order=["at"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    assert history.numbered(spark.createDataFrame([], "key string, at int"), key="key", order=["at"]).count() == 0


def test_semantic_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]  # many ties
    odd = [("short", [1.0]), ("null", None), ("part", [1.0, None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), rows[0]]
    corpus_rows = spark.createDataFrame(rows + odd, "id string, vector array<double>").repartition(5)
    asked = [r for r in rows if r[0].endswith("0")]
    queries = spark.createDataFrame([*asked, ("short", [2.0]), ("none", None), asked[0]], "query_id string, vector array<double>")
    got = [tuple(r) for r in search.semantic_search(corpus_rows, queries, k=7, block=9).collect()]
    want = []
    for q, v in asked:
        best = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    empty = queries.limit(0)
    assert search.semantic_search(corpus_rows, empty).count() == 0 and search.semantic_search(corpus_rows.limit(0), queries).count() == 0


def test_hybrid_search_in_blocks(spark):
    corpus = spark.createDataFrame([(f"c{i}", "t", f"apple pie {i}", [float(i % 5), 1.0]) for i in range(30)], "chunk_id string, source_title string, chunk_text string, vector array<double>")
    asked = spark.createDataFrame([(i, f"apple pie {i}", [1.0, float(i)]) for i in range(7)], "query_id int, question string, vector array<double>")
    whole, blocks = (sorted(tuple(r) for r in search.hybrid_search(corpus, asked, k=3, most_questions=n).collect()) for n in (2000, 2))
    assert blocks == whole and len(whole) == 21


def test_hybrid_search_pool_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i:03}", "T", "apple pie" if i == 150 else "filler", rng.normal(size=4).tolist()) for i in range(200)]
    q = [0.1, -0.2, 0.3, 0.4]
    found = search.hybrid_search(spark.createDataFrame(rows, "chunk_id string, source_title string, chunk_text string, vector array<double>").repartition(3), spark.createDataFrame([(1, "apple pie", q), (2, "the of", q)], "query_id int, question string, vector array<double>"), k=5).collect()
    sem = {r[0]: float(np.dot(r[3], q)) for r in rows}
    pool = sorted(sem, key=lambda i: (-sem[i], i))[:60]
    for query, words in ((1, {"c150"}), (2, set())):
        score = {i: 0.65 * (sem[i] if i in pool else 0) + 0.35 * (i in words) for i in set(pool) | words}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query] == want
    none = spark.createDataFrame([], "query_id int, question string, vector array<double>")
    assert search.hybrid_search(spark.createDataFrame(rows[:1], "chunk_id string, source_title string, chunk_text string, vector array<double>"), none).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "query_id int, hit int")
    m = search.retrieval_metrics(hits).first()
    assert (m.cases, m.hits) == (3, 2) and abs(m.mean_reciprocal_rank - 1.25 / 3) < 1e-12
    assert search.retrieval_metrics(hits.limit(0)).first().recall == 0


def test_fetch_outcomes(spark):
    def fetch(url):
        if url == "down":
            raise OSError("no route")
        return {"ok": (200, "<p>"), "gone": (404, ""), "busy": (503, ""), "odd": (418, "")}[url]

    rows = spark.createDataFrame([(u, u) for u in ("ok", "gone", "busy", "odd", "down")], "doc_id string, requested_url string")
    got = {r.doc_id: (r.outcome, r.http_status) for r in sources.fetch_pages(rows, fetch, attempts=2, backoff=0).collect()}
    assert got == {"ok": ("ok", 200), "gone": ("not_found", 404), "busy": ("http_error", 503), "odd": ("http_error", 418), "down": ("network_error", None)}


def test_sitemap_and_roots(spark, tmp_path):
    f = tmp_path / "s.xml"
    f.write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h.example/a/</loc></url><url><loc>https://h.example/a?utm_source=x</loc></url><url><loc>https://other.example/b</loc></url><url><loc></loc></url></urlset>')
    assert [r.url for r in sources.sitemap(spark, str(f), "h.example").collect()] == ["https://h.example/a"]
    with pytest.raises(ValueError):
        sources.sitemap(spark, str(f), "absent.example").count()
    good = {"id": "r", "landing_url": "https://h/", "allowed_path_prefixes": ["/a/"], "category": "c", "max_pages": 1}
    roots = sources.discovery_roots(spark, [good], {"c"})
    for bad in ({**good, "category": "z"}, {**good, "max_pages": 0}, {**good, "allowed_path_prefixes": ["a"]}, {**good, "landing_url": "x"}):
        with pytest.raises(ValueError):
            sources.discovery_roots(spark, [bad], {"c"})
    with pytest.raises(ValueError):
        sources.discovery_roots(spark, [good, good], {"c"})
    one = spark.createDataFrame([("r",)], "root_id string")
    assert sources.checked_roots(one, roots).first().pages == 1
    for wrong in (one.limit(0), one.union(one)):
        with pytest.raises(ValueError):
            sources.checked_roots(wrong, roots)


def test_linked_pages(spark):
    html = """<a href="/aws/en/x/?utm_source=n">x</a><A class=k HREF='https://Other.example/y#part'>y</a><a href="z.html">z</a><a href="#top">t</a><a href="mailto:a@b">m</a><a href="//h.example/w"></a><a href="/aws/en/x">again</a><a name=q>"""
    pages = spark.createDataFrame([("p", "https://h.example/aws/en/index?q=1", html), ("n", "https://h.example/", None)], "doc_id string, url string, html string")
    assert {r.url for r in sources.linked_pages(pages).collect()} == {"https://h.example/aws/en/x", "https://other.example/y", "https://h.example/aws/en/z.html", "https://h.example/w"}


def test_streamed_pages_keep_the_latest(spark, tmp_path):
    schema = "doc_id string, fetched_at timestamp, html string"
    day = [datetime(2025, 1, d) for d in (1, 2, 3)]
    t = Buckets(str(tmp_path / "pages"), ("doc_id",), 2)
    drop = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: keep_current(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, t, str(tmp_path / "cp")).awaitTermination()
    drop([("a", day[1], "new"), ("b", day[0], "b")])
    run()
    files = set((tmp_path / "pages").rglob("*.parquet"))
    drop([("a", day[0], "late"), ("b", day[2], "newer"), ("b", day[2], "newer")])
    run()
    assert files < set((tmp_path / "pages").rglob("*.parquet"))  # a batch rewrites nothing
    want = {"a": "new", "b": "newer"}
    assert {r.doc_id: r.html for r in current_pages(spark, t).collect()} == want and t.read(spark).count() == 4
    t.compact(spark, ["fetched_at"])
    assert {r.doc_id: r.html for r in t.read(spark).collect()} == want and t.read(spark).count() == 2
