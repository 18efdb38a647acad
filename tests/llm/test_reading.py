from siltstone.llm.reading import fit_levels, prose_sentences, readability, reading_levels

DOCS, LABELS = "doc_id long, text string, words string, estimate string", "doc_id long, rater_id int, reading_level int"


def test_prose_only(spark):
    text = "# The heading of it.\n```\nthe code is here.\n```\n| the | cell |\n- the item is here.\nTitle without end\nThe cat is on the mat. Is it at home?\nLe chat est dans la maison avec nous.\nThe view cat_view_12 is in a/b now."
    got = prose_sentences(text)
    assert [n for n, _ in got] == [6, 4, 7] and "cat_view_12" not in got[2][1]
    assert prose_sentences("") == [] and prose_sentences("```\nnever closed, it is code.") == []


def test_finished_sentences_of_a_cut_paragraph():
    got = prose_sentences("The cat is on the mat. It is at home (as the dog was.) And then it went to the")
    assert [n for n, _ in got] == [6, 8]
    assert prose_sentences("This is the title of a page") == [] and len(prose_sentences("The cat is here! " * 40 + "Read more about the cat")) == 40


def test_features_and_familiar_words(spark):
    docs = [(i, "The cat is on the mat. It is the cat.") for i in range(20)] + [(99, "The ontological mat is in the epistemological cat."), (100, None), (101, ""), (102, "```x```"), (103, "Das ist ein Satz von mir."), (99, "The ontological mat is in the epistemological cat.")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    got = {r.doc_id: r for r in readability(df, familiar_share=0.2).collect()}
    assert got[0].unfamiliar_share == 0 and got[0].sentence_tokens == 5 and got[0].sentences == 2
    assert abs(got[99].unfamiliar_share - 3 / 8) < 1e-9  # "in" is used by two documents alone
    assert all(got[i].unfamiliar_share is None and got[i].sentences == 0 for i in (100, 101, 102, 103))
    assert readability(df.limit(0)).count() == 0


def test_one_formula_for_any_number_of_labels(spark):
    easy, hard = "The cat is here. It is a cat. ", "The {} of the {} is in the {} for which it has been {} as such by all of the other {} that we have had. "
    docs = [(i, easy * 5) for i in range(40)] + [(100 + i, hard.format(*[f"{'qwertzuiop'[i % 10]}{'asdfghjk'[j]}word{'yxcvb'[i % 5]}" for j in range(5)]) * 3) for i in range(40)] + [(500, "x" * 100000), (501, (easy * 20000))]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    labels = [(i, r, 1) for i in range(30) for r in (1, 2)] + [(100 + i, 1, 5) for i in range(30)] + [(100, 2, None), (None, 1, 3), (777, 1, 2)]
    got = {r.doc_id: r.reading_level for r in reading_levels(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert {got[i] for i in range(30, 40)} == {1} and {got[i] for i in range(130, 140)} == {5} and got[500] is None and got[501] == 1
    few = {r.doc_id: r.reading_level for r in reading_levels(df, spark.createDataFrame([], LABELS)).collect()}
    assert few[0] < few[100]
    features = spark.createDataFrame([(i, i / 100, 8.0 + i / 4) for i in range(100)], "doc_id int, unfamiliar_share double, sentence_tokens double")
    near = [fit_levels(features, spark.createDataFrame([(i, 1, 3) for i in range(0, 100, 100 // n)], LABELS)) for n in (1, 29, 30)]
    at = [w[0] + w[1] * 0.5 + w[2] * 20 + w[3] * 0.25 + w[4] * 400 + w[5] * 10 for w in near]
    assert abs(at[1] - at[2]) < 0.05 < abs(at[0] - at[1])  # no jump where a document more is labelled


def test_every_document_has_a_row(spark):
    rows = [(1, "The cat is on the mat. It is the cat.", None), (2, "Das ist ein Satz von mir.", "de"), (3, None, "en"), (1, "The cat is on the mat. It is the cat.", None)]
    got = reading_levels(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS), keep=["lang"]).collect()
    assert sorted((r.doc_id, r.lang or "", r.reading_level is None) for r in got) == [(1, "", False), (1, "", False), (2, "de", True), (3, "en", True)]
