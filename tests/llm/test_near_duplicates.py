import random

from pyspark.sql import functions as F

from siltstone.llm.groups import connected
from siltstone.llm.near_duplicates import _anchors, _meeting, duplicate_pairs, near_duplicates

SCHEMA = "id string, doc string, text string, class_id string, _sketch string"


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    members, links = near_duplicates(frame, id_col="id", text_col="text", keep=["doc"], **kw)
    return members, links, {tuple(r) for r in duplicate_pairs(members, links, id_col="id", apart="doc").collect()}


def jaccard(a, b, width):
    s = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(80)]
        rows.append((f"a{i:02}", f"d{i}", " ".join(words)))
        edited = list(words)
        for _ in range(i % 6):
            edited[rng.randrange(80)] = rng.choice(vocabulary)
        if i % 5 == 0:
            edited = edited[40:] + edited[:40]
        rows.append((f"b{i:02}", f"e{i}", " ".join(edited)))
    got = run(spark, rows, width=3, threshold=0.6)[2]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[2], b[2], 3) >= 0.6}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20


def test_copies_are_one_class_and_not_compared(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(f"r{i:04}", "hot" if i < 1990 else f"d{i}", text if i % 2 else text.upper()) for i in range(2000)]
    members, links, pairs = run(spark, rows)
    assert members.select("class_id").distinct().count() == 1 and links.count() == 0
    assert len(pairs) == 1990 * 10 + 45


def test_nulls_short_empty_repeated(spark):
    text = " ".join(f"t{i}" for i in range(3000))
    members, links, pairs = run(spark, [("a", "d", None), ("b", "e", ""), ("c", "f", "too short"), ("d", "g", text), ("d", "g", text), ("e", None, text), (None, "h", text), ("f", "i", text + " more")])
    assert {r.id for r in members.collect()} == {"d", "e", "f", None}
    assert ("d", "f") in pairs and all(a is not None and a < b for a, b in pairs)
    assert run(spark, [])[2] == set()


def test_groups(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(100, 200), (200, 300), (7, 7), (None, 5)], "a int, b int")
    got = {r.node: r.group_id for r in connected(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(13)} | {100: 100, 200: 100, 300: 100}
    assert connected(links.where(F.lit(False)), "a", "b").count() == 0


def test_anchors_cover_within_radius_and_threshold():
    """For all words of four symbols modulo 3: each lies within radius 1 of four anchors, and any
    two that differ in at most one symbol, which is the threshold, have an anchor in common."""
    from itertools import product

    words = list(product(range(3), repeat=4))
    code = {w for w in words if sum(w) % 3 == 0}
    near = {w: {c for c in code if sum(x != y for x, y in zip(w, c)) <= 1} for w in words}
    assert all(near[w] for w in words)  # covering radius 1
    for w in words:
        made = {w[:i] + ((w[i] - sum(w)) % 3,) + w[i + 1 :] for i in range(4)}
        assert made == near[w]  # the anchors that are made are those within the radius
    assert all(near[v] & near[w] for v in words for w in words if sum(x != y for x, y in zip(v, w)) <= 1)


def test_made_anchors_are_code_words(spark):
    rows = spark.createDataFrame([([5, -7, 2147483647, 3],), ([5, 99, 2147483647, 3],), ([6, 98, 2147483647, 3],)], "s array<int>").select(_anchors(F.col("s"), 1, 4).alias("a")).collect()
    a, b, c = (set(r.a) for r in rows)
    assert len(a) == 4 and len(a & b) == 1 and not a & c and len(b & c) == 0


def test_many_variants_of_one_text(spark):
    """All share their anchors: the hot keys are split into cells, and no link is lost."""
    rows = [(f"r{i:05}", f"d{i}", " ".join([f"t{j}" for j in range(60)] + [f"x{i}"] + [f"u{j}" for j in range(5)])) for i in range(300)]
    whole = run(spark, rows, width=3, threshold=0.6)[2]
    split = run(spark, rows, width=3, threshold=0.6, cell_rows=64)[2]
    assert whole == split and len(split) == 300 * 299 // 2


def test_cells_meet_every_pair_once(spark):
    rows = spark.range(700).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    for cell_rows in (10**6, 50):
        met = _meeting(rows, "k", "x", F.lit(True), cell_rows).select(F.least("a.x", "b.x"), F.greatest("a.x", "b.x")).collect()
        keys = {r.x: r.k for r in rows.collect()}
        assert len(met) == len({tuple(r) for r in met}) == sum(keys[i] == keys[j] for i in range(700) for j in range(i))
