from siltstone.llm.repeated_lines import line_templates, repeated_lines, without_lines

CHUNKS, DOCS = "chunk_id string, doc_id string, document_version string, chunk_text string, leaf string, line string", "doc_id string, document_version string, category string, _source string"


def tables(spark, chunks, docs):
    return spark.createDataFrame([(*c, "x", "y") for c in chunks], CHUNKS), spark.createDataFrame([(*d, "z") for d in docs], DOCS)


def found(spark, chunks, docs, wildcards=False, **kw):
    return {tuple(r) for r in repeated_lines(*tables(spark, chunks, docs), wildcards=wildcards, **kw).collect()}


def sample(n=5, text="Body of doc {i} here\nFiled  Under NOTICE {i}\nx 1"):
    return [(f"c{i}", f"d{i}", "v", text.format(i="abcdefgh"[i % 8] * (i + 1) if "{i}" not in text else i)) for i in range(n)], [(f"d{i}", "v", "cat") for i in range(n)]


def test_lines_equal_but_for_case_space_and_digits(spark):
    chunks = [(f"c{i}", f"d{i}", "v", f"{'uvwxyz'[i]} own words {'uvwxyz'[i]}\n  Filed{' ' * (i + 1)}UNDER notice {10**i}\nab 12") for i in range(5)]
    docs = [(f"d{i}", "v", "cat") for i in range(5)]
    assert found(spark, chunks, docs) == {(f"c{i}", 1) for i in range(5)}
    assert found(spark, chunks, docs, least_docs=6) == set()
    assert found(spark, [*chunks, *chunks], [*docs, *docs]) == {(f"c{i}", 1) for i in range(5)}


def test_share_counts_documents_with_current_chunks(spark):
    chunks = [(f"c{i}", f"d{i}", "v", "same old site line" if i < 4 else f"own text {'abcdefghij'[i % 10] * (i // 10 + 1)} number") for i in range(51)]
    docs = [(f"d{i}", "v", "cat") for i in range(51)]
    assert found(spark, chunks, docs) == set()  # 4 of 51 are under 8 %
    assert len(found(spark, chunks[:50], docs)) == 4  # documents without current chunks do not count
    assert len(found(spark, chunks, [(d, "other" if d == "d50" else v, c) for d, v, c in docs])) == 4


def test_other_versions_sources_and_few_words(spark):
    chunks = [(f"c{i}", f"d{i}", "v" if i else "old", "site line of all") for i in range(4)] + [(f"e{i}", f"f{i}", "v", "two words") for i in range(5)]
    docs = [(f"d{i}", "v", "cat") for i in range(4)] + [(f"f{i}", "v", "other") for i in range(5)]
    assert found(spark, chunks, docs) == set()


def test_repeats_within_a_document_count_once(spark):
    assert found(spark, [("c", "d", "v", "\n".join(["again and again"] * 50))], [("d", "v", "cat")]) == set()


def test_nulls_empty_long(spark):
    line = "a very " + "long " * 20000 + "line"
    chunks = [(f"c{i}", f"d{i}", "v", line) for i in range(4)] + [("n", "d0", "v", None), ("m", None, "v", line), ("o", "d0", None, line), ("e", "d1", "v", ""), (None, "d3", "v", line)]
    docs = [(f"d{i}", "v", None) for i in range(4)] + [(None, "v", None)]
    assert found(spark, chunks, docs) == {(f"c{i}", 0) for i in range(4)} | {(None, 0)}
    assert found(spark, [], []) == set()


def test_removal_keeps_all_rows(spark):
    chunks, docs = tables(spark, [(f"c{i}", f"d{i}", "v", f"own {i}\nthe site line here\n\nend") for i in range(4)] + [("x", "dx", "v", None), ("y", "d0", "v", "the site line here")], [(f"d{i}", "v", "c") for i in range(4)])
    got = {r.chunk_id: (r.clean_text, r.removed_lines) for r in without_lines(chunks, repeated_lines(chunks, docs)).collect()}
    assert got == {f"c{i}": (f"own {i}\n\nend", 1) for i in range(4)} | {"x": (None, 0), "y": ("", 1)}


NAMES = ("Jane Doe", "John Roe", "Ada Poe", "Max Low", "Una Fay", "Ian May", "Eve Ray", "Leo Kay")


def test_lines_that_differ_in_a_name_share_a_template(spark):
    chunks = [(f"c{i}", f"d{i}", "v", f"{w} alone says {w}\nWritten by {w}\n{w} has {'abcdefgh'[i]} {w} own") for i, w in enumerate(NAMES)]
    docs = [(f"d{i}", "v", "c") for i in range(8)]
    assert found(spark, chunks, docs, wildcards=True, depth=2) == {(f"c{i}", 1) for i in range(8)}
    assert found(spark, chunks, docs, wildcards=True) == {(f"c{i}", 1) for i in range(8)}
    assert found(spark, chunks, docs) == set()
    assert found(spark, chunks, docs, wildcards=True, least_constant=1.0) == set()  # a tree without slots finds none of them
    (t,) = line_templates(*tables(spark, chunks, docs)).collect()
    assert (t.source, t.template, t.slots, t.lines, t.docs) == ("c", "written by <*> <*>", 2, 8, 8)


def test_templates_do_not_depend_on_order_or_partitions(spark):
    chunks = [(f"c{i}", f"d{i}", "v", f"Page {i} of the {w} guide\nwritten by {w}\nno two lines {w * (i + 1)}") for i, w in enumerate(NAMES)]
    docs = [(f"d{i}", "v", "c") for i in range(8)]
    want = {tuple(r) for r in line_templates(*tables(spark, chunks, docs)).collect()}
    got = {tuple(r) for r in line_templates(*(t.repartition(5) for t in tables(spark, chunks[::-1], docs))).collect()}
    assert got == want == {("c", "page # of the <*> <*> guide", 2, 8, 8), ("c", "written by <*> <*>", 2, 8, 8)}


def test_a_token_of_enough_documents_is_no_slot(spark):
    chunks, docs = [(f"c{i}", f"d{i}", "v", f"page {i} by the {'red' if i < 4 else 'abcdefgh'[i]} team") for i in range(8)], [(f"d{i}", "v", "c") for i in range(8)]
    r = line_templates(*tables(spark, chunks, docs)).collect()
    assert {(x.template, x.docs) for x in r} == {("page # by the red team", 4), ("page # by the <*> team", 4)}


def test_enough_documents_whatever_the_share(spark):
    chunks = [(f"c{i}", f"d{i}", "v", "same old site line" if i < 4 else f"own text {'abcdefghij'[i % 10] * (i // 10 + 1)} number") for i in range(51)]
    docs = [(f"d{i}", "v", "cat") for i in range(51)]
    assert found(spark, chunks, docs) == set()
    assert len(found(spark, chunks, docs, enough_docs=4)) == 4


def test_hot_source_and_line(spark):
    chunks = spark.range(6000).selectExpr("concat('c', id) chunk_id", "if(id % 3 = 0, 'hot', concat('d', id)) doc_id", "'v' document_version", "'one line for everyone' chunk_text")
    docs = chunks.selectExpr("doc_id", "document_version", "'c' category").distinct()
    assert repeated_lines(chunks, docs).count() == 6000
