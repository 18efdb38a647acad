import random

from siltstone.llm.leakage import leaked_items

DOCS, ITEMS = "doc_id long, text string, _item string", "item_id long, passage string, _at string"
WORDS = [f"w{i}" for i in range(400)]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "x") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "x") for x in items], ITEMS)
    return {(r.doc_id, r.item_id): (r.shared_words, r.item_share) for r in leaked_items(d, i, **kw).collect()}


def test_runs_of_exactly_thirteen_words(spark):
    rng = random.Random(5)
    passage = [rng.choice(WORDS) for _ in range(40)]
    filler = lambda n: [rng.choice(WORDS) for _ in range(n)]
    docs = [
        (1, " ".join([*filler(50), "stop1", *passage[5:18], "stop2", *filler(30)])),
        (2, " ".join([*filler(50), "stop1", *passage[5:17], "stop2", *filler(30)])),
        (3, ", ".join(passage).upper().replace("W1", "​W­1")),
        (4, " ".join([*passage[:12], "x", *passage[12:24], "y", *passage[24:36]])),
        (5, " ".join(["a", *passage[:13], "b", *passage[20:35]])),
    ]
    got = run(spark, docs, [(9, " ".join(passage)), (8, " ".join(passage[:4])), (7, None), (6, "")])
    assert {k: v[0] for k, v in got.items()} == {(1, 9): 13, (3, 9): 40, (5, 9): 15} and got[3, 9][1] == 1.0


def test_shared_shingles_out_of_order_are_no_run(spark):
    rng = random.Random(6)
    p = [rng.choice(WORDS) for _ in range(30)]
    got = run(spark, [(1, " ".join(p[10:20] + ["x"] + p[0:10] + ["y"] + p[18:30]))], [(1, " ".join(p))])
    assert got == {}


def test_repeats_within_texts_blocks_and_hot_copies(spark):
    p = " ".join(["again and again"] * 10)
    docs = [(i, "so " + p + " it goes") for i in range(300)] + [(i, "so " + p + " it goes") for i in range(100)]
    items = [(1, p), (1, p), (2, p + " and more"), (3, " ".join(WORDS[:20]))]
    got = run(spark, docs, items)
    assert got == run(spark, docs, items, most_broadcast=0) and set(got) == {(d, i) for d in range(300) for i in (1, 2)} and got[0, 1][0] == 30


def test_nulls_empty_and_long(spark):
    long = " ".join(WORDS * 300)
    assert set(run(spark, [(1, None), (2, ""), (3, long), (None, long)], [(1, " ".join(WORDS[380:] + WORDS[:5])), (None, long)])) == {(3, 1)}
    assert run(spark, [], [(1, long)]) == {} and run(spark, [(1, long)], []) == {}


def test_short_passages_must_be_whole(spark):
    docs = [(1, "x a b c d e f y"), (2, "x a b c d e z f"), (3, "q r s t u a b c d e f g h i j k l m n")]
    items = [(1, "a b c d e f"), (2, "a b c d"), (3, "b c d e f"), (4, "a b c d e f g h i j k l zz")]
    want = {(1, 1): 6, (1, 3): 5, (3, 1): 6, (3, 3): 5}
    assert {k: v[0] for k, v in run(spark, docs, items).items()} == want
    assert {k: v[0] for k, v in run(spark, docs, items, most_broadcast=0).items()} == want  # by a shuffled join
