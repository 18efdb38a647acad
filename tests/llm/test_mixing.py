from siltstone.llm.mixing import counted_documents, mix_sources

DOCS, TARGETS = "doc_id long, source string, text string, rate int", "mix_name string, source string, target_weight double, max_repeats int, budget_ratio double, tokens int"


def run(spark, docs, targets):
    d = spark.createDataFrame([(*x, 1) for x in docs], DOCS)
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGETS)
    chosen, shares = mix_sources(counted_documents(d), t)
    return [r.asDict() for r in chosen.collect()], {(r.mix_name, r.source): r for r in shares.collect()}


def test_rates_caps_and_repeats(spark):
    docs = [(i, ("Big " if i % 2 else "big"), "one two three four five") for i in range(400)] + [(1000 + i, "small", "one two three four five") for i in range(10)]
    chosen, shares = run(spark, docs, [("m", "big", 50.0, 4, 0.5), ("m", " SMALL", 50.0, 3, 0.5), ("m", "none", 100.0, 3, 0.5), ("empty", "none", 1.0, 2, 0.5)])
    big, small = shares["m", "big"], shares["m", "small"]
    assert abs(big.target_share - 0.25) < 1e-9 and abs(big.rate - 0.25 * 0.5 * 410 / 400) < 1e-9 and small.rate == 3.0
    assert small.used_tokens == 3 * small.source_tokens and shares["m", "none"].rate == 0 and shares["empty", "none"].actual_share is None
    assert abs(big.used_docs - 400 * big.rate) < 30 and abs(big.actual_share + small.actual_share - 1) < 1e-9
    assert {c["repeats"] for c in chosen if c["source"] == "small"} == {3} and sum(c["tokens"] * c["repeats"] for c in chosen) == big.mix_tokens
    again, _ = run(spark, docs[::-1], [("m", "big", 50.0, 4, 0.5), ("m", "small", 50.0, 3, 0.5), ("m", "none", 100.0, 3, 0.5)])
    key = lambda c: (c["doc_id"], c["repeats"])
    assert sorted(map(key, again)) == sorted(map(key, chosen))


def test_fraction_is_drawn(spark):
    docs = [(i, "s", "alpha beta") for i in range(2000)]
    chosen, shares = run(spark, docs, [("m", "s", 1.0, 9, 1.3)])
    assert {c["repeats"] for c in chosen} == {1, 2} and abs(shares["m", "s"].used_tokens / shares["m", "s"].budget_tokens - 1) < 0.03


def test_nulls_and_empty(spark):
    docs = [(1, None, "text here"), (2, "s", None), (3, "s", ""), (4, "s", "x " * 50000), (None, "s", "word")]
    chosen, shares = run(spark, docs, [("m", "s", None, 2, 0.5), (None, "s", 1.0, 1, 0.5), ("n", None, 1.0, 1, 0.5), ("o", "s", 1.0, None, 0.5), ("p", "s", 1.0, 5, None), ("q", "s", 1.0, 5, 10.0)])
    assert {k: v.rate for k, v in shares.items()} == {("m", "s"): 0.0, ("o", "s"): 0.0, ("p", "s"): 0.0, ("q", "s"): 5.0}
    assert {(c["doc_id"], c["repeats"]) for c in chosen} == {(2, 5), (3, 5), (4, 5), (None, 5)}
    assert run(spark, [], [("m", "s", 1.0, 2, 0.5)])[0] == [] and run(spark, docs, []) == ([], {})


def test_tokens_are_the_tokenizers(spark):
    import base64

    import tiktoken

    from siltstone.llm.mixing import PATTERN, VOCABULARY

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world's  end\n\n", "ünïcode 漢字 😀", "<|endoftext|>", ""]
    d = spark.createDataFrame([(i, "s", t, 1) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.tokens for r in counted_documents(d).collect()} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}
