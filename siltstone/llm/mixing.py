"""Combining sources so that each holds a target share of a mix's tokens (problem 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltstone.functions.text import strip
from siltstone.runtime import settle

#: Where the vocabulary file is, on every machine, unless the session's setting of this name tells otherwise.
SETTING, VOCABULARY = "spark.siltstone.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of the whole text under a public byte-pair vocabulary; null for null."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: None if t is None else len(encode(t)), na_action="ignore").astype("Int64")

    return count(text)


def source_name(source: Column) -> Column:
    """Sources are written unevenly: letter case and surrounding white space do not count."""
    return F.lower(strip(source))


def mix_rates(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """How often each source of each mix is used: (mix_name, source, share, docs, tokens, max_repeats, budget, rate).

    ``sizes`` has source, docs, tokens for all sources. Repeated rows of ``targets`` count once;
    the weights of different rows of a source are added up. A mix's budget is its budget_ratio of
    all tokens, and a source's share of it over the source's tokens is its rate, at most
    ``max_repeats``. What an exhausted source lacks is not given to others, which would put
    them above their targets; the mix is then smaller than its budget.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    t = targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull()).select("mix_name", "source", "target_weight", "max_repeats", "budget_ratio").distinct()
    t = t.groupBy("mix_name", source_name(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
        F.max(F.coalesce("budget_ratio", F.lit(0.0))).alias("budget_ratio"),
    )
    mix = W.partitionBy("mix_name")
    t = t.withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0)))
    t = t.withColumn("budget_ratio", F.max("budget_ratio").over(mix))
    t = t.join(sizes, "source", "left").fillna(0, ["docs", "tokens"]).crossJoin(total)  # total is one row
    t = t.withColumn("budget", F.col("budget_ratio") * F.col("_all"))
    rate = F.least(F.coalesce(F.try_divide(F.col("share") * F.col("budget"), F.col("tokens").cast("double")), F.lit(0.0)), F.col("max_repeats").cast("double"))
    t = t.withColumn("rate", rate)
    return t.select("mix_name", "source", "share", "docs", "tokens", "max_repeats", "budget", "rate")


def counted_documents(documents: DataFrame, *, vocabulary: str | None = None, pattern: str = PATTERN, name: str = "tokens") -> DataFrame:
    """(doc_id, source, tokens) of every document, counted once and written down. The vocabulary
    is the given file, or the one that the session's ``spark.siltstone.vocabulary`` names."""
    vocabulary = vocabulary or documents.sparkSession.conf.get(SETTING, VOCABULARY)
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce(token_count(F.col("text"), vocabulary, pattern), F.lit(0)).alias("tokens"))
    return settle(rows, name)


def mix_sources(counted: DataFrame, targets: DataFrame, *, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for every mix.

    ``chosen``: mix_name, source, doc_id, tokens, repeats >= 1: a document is used floor(rate)
    times, and once more with probability rate - floor(rate), drawn from a hash of seed, mix
    and doc_id, so that a rerun or a lost executor gives the same documents. ``shares``, one
    row a mix and source: mix_name, source, target_share, max_repeats, docs, source_tokens,
    rate, used_docs, used_tokens, actual_share (of the mix's tokens; null for an empty mix),
    mix_tokens, budget_tokens.

    Tokens are summed per source with partial sums in the scan, so a source with a third of
    all rows is no hot key; rates are one row a target, and Spark broadcasts them where they
    are small. A target without documents, a zero or null weight, repeats or budget gives
    rate 0 and a row in ``shares``. Documents of null source are in no mix, but count for
    the budget, as do documents of sources in no mix. Null and empty texts have 0 tokens.
    Repeated rows of a document are repeated in ``chosen``. Empty tables give empty results.
    """
    sizes = counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    rates = mix_rates(targets, sizes)
    used = counted.join(rates.select("mix_name", "source", "rate").where(F.col("rate") > 0), "source")
    draw = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    repeats = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    chosen = used.select("mix_name", "source", "doc_id", "tokens", repeats.alias("repeats")).where(F.col("repeats") > 0)
    sums = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("used_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    mix = W.partitionBy("mix_name")
    shares = (
        rates.join(sums, ["mix_name", "source"], "left")
        .fillna(0, ["used_docs", "used_tokens"])
        .withColumn("mix_tokens", F.sum("used_tokens").over(mix))
        .select(
            "mix_name", "source", F.col("share").alias("target_share"), "max_repeats", "docs", F.col("tokens").alias("source_tokens"), "rate",
            "used_docs", "used_tokens", F.try_divide("used_tokens", "mix_tokens").alias("actual_share"), "mix_tokens", F.col("budget").alias("budget_tokens"),
        )
    )
    return chosen, shares
