"""Reading level of each document by a familiar-word formula (problem 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.runtime import settle

#: Fixed value: common English function words, by which a sentence is taken for English.
FUNCTION_WORDS = frozenset(
    "the a an of to in and is are was were be been by for with on at as that this these those it its from or not but which when "
    "if they you we can will has have had do does than so such no".split()
)
_FENCE = re.compile(r"^(?:```|~~~).*?(?:^(?:```|~~~)|\Z)", re.S | re.M)
_MARKED = re.compile(r"^(?:#|\||>|[-*•+]\s|\d+[.)]\s)")
_ENDED = re.compile(r"[.!?…][\"”’')\]]*\s*$")
_BOUNDARY = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+")
#: A token that is a plain word but for punctuation at its ends.
_PLAIN = re.compile(r"""(?<!\S)[.,;:!?…()\[\]"“”‘’']*([^\W\d_]+(?:['’-][^\W\d_]+)*)[.,;:!?…()\[\]"“”‘’']*(?!\S)""")


def prose_sentences(text: str, english: float = 0.1) -> list[tuple[int, list[str]]]:
    """(tokens, plain words) of each English sentence of running text.

    Fenced code, table rows, headings, list items and quotes are no prose, nor is what follows
    the last sentence end of a line: a title, a cut sentence. The finished sentences before it
    count. A sentence whose share of English function words is under ``english`` is a foreign
    passage. Names with digits or joining signs are tokens of the sentence, but no words of it.
    """
    out = []
    for line in _FENCE.sub("\n", text).split("\n"):
        line = line.strip()
        if not line or _MARKED.match(line) or line.count("|") > 1:
            continue
        sentences = _BOUNDARY.split(line)
        if not _ENDED.search(line):
            sentences.pop()
        for sentence in sentences:
            plain = _PLAIN.findall(sentence.lower())
            if len(plain) > 2 and sum(map(FUNCTION_WORDS.__contains__, plain)) >= english * len(plain):
                out.append((len(sentence.split()), plain))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sentences, tokens, words, counts, offsets = [], [], [], [], [0]
        for text in batch.column("_text").to_pylist():
            found = prose_sentences(text or "")
            seen = Counter(w for _, plain in found for w in plain)
            sentences.append(len(found))
            tokens.append(sum(n for n, _ in found))
            words += seen.keys()
            counts += seen.values()
            offsets.append(len(words))
        each = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int32())], ["w", "n"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
        kept = batch.drop_columns(["_text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sentences, pa.int32()), pa.array(tokens, pa.int32()), lists], names=[*kept.schema.names, "sentences", "tokens", "_words"])


def readability(documents: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, familiar_share: float = 0.1) -> DataFrame:
    """(doc, the ``keep`` columns, sentences, words, unfamiliar_share, sentence_tokens) of every document, written down.

    A word is familiar if at least ``familiar_share`` of the documents with prose use it in
    their prose. Document frequencies are counted over all given documents. The list cannot
    exceed the mean number of distinct words a document / familiar_share, so it is small
    whatever the corpus, and becomes a set within the plan; shares are null for a document
    without prose (null, empty, only code, only foreign). Repeated rows give repeated rows.
    """
    rows = documents.select(F.col(doc_col).alias("_doc"), *[F.col(c).alias(f"_kept_{c}") for c in keep or []], F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    counted = settle(rows.mapInArrow(_counted, f"{kinds}, sentences int, tokens int, _words array<struct<w:string,n:int>>"), "prose")
    least = counted.where(F.col("sentences") > 0).count() * familiar_share
    frequency = counted.select(F.explode("_words.w").alias("_word")).groupBy("_word").agg(F.count("*").alias("_docs"))
    familiar = [r["_word"] for r in frequency.where(F.col("_docs") >= least).select("_word").collect()]

    def total(entries: Column) -> Column:
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

    unfamiliar = total(F.filter("_words", lambda x: ~x["w"].isin(familiar)))
    sums = counted.select("*", total(F.col("_words")).alias("words"), unfamiliar.alias("_unfamiliar"))
    return settle(
        sums.select(
            F.col("_doc").alias(doc_col),
            *[F.col(f"_kept_{c}").alias(c) for c in keep or []],
            "sentences",
            "words",
            F.try_divide("_unfamiliar", "words").alias("unfamiliar_share"),
            F.try_divide("tokens", "sentences").alias("sentence_tokens"),
        ),
        "features",
    )


def _terms(unfamiliar, length) -> list:
    return [unfamiliar, length, unfamiliar * unfamiliar, length * length, unfamiliar * length]


#: Documented prior of the weights (one, then ``_terms``): a share of unfamiliar words of 0 to
#: 0.5 and sentences of 8 to 32 tokens span about levels 1 to 5. And the usual size of each term.
PRIOR, SCALES = (0.0, 4.0, 1 / 12, 0.0, 0.0, 0.0), (1.0, 0.5, 20.0, 0.25, 400.0, 10.0)


def fit_levels(features: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", most_labels: int = 20000, prior_strength: float = 1.0) -> list[float]:
    """Weights of the formula, by ridge regression on the raters' mean level of at most
    ``most_labels`` labelled documents (the smallest by hash). Null levels do not count.

    The weights are drawn towards ``PRIOR`` as strongly as by ``prior_strength`` documents for
    each term, so the same formula holds for any number of labels: with none it is the prior,
    with hundreds the prior no longer matters.
    """
    means = labels.where(F.col("reading_level").isNotNull()).groupBy(doc_col).agg(F.avg("reading_level").alias("_level"))
    both = features.where(F.col("unfamiliar_share").isNotNull()).join(means, doc_col)
    rows = both.select("unfamiliar_share", "sentence_tokens", "_level", F.xxhash64(doc_col).alias("_h")).orderBy("_h", "_level", "unfamiliar_share").limit(most_labels).collect()
    prior, scales = np.array(PRIOR), np.array(SCALES)
    x = np.array([[1.0, *_terms(r[0], r[1])] for r in rows], float).reshape(-1, len(prior)) / scales
    y = np.array([r[2] for r in rows], float)
    start = prior * scales
    step = np.linalg.solve(x.T @ x + prior_strength * np.eye(len(prior)), x.T @ (y - x @ start))
    return ((start + step) / scales).tolist()


def estimated_level(weights: list[float], unfamiliar: Column, length: Column) -> Column:
    terms = [F.lit(float(w)) * t for w, t in zip(weights[1:], _terms(unfamiliar, length))]
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), sum(terms, F.lit(float(weights[0])))))


def reading_levels(
    documents: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, familiar_share: float = 0.1, most_labels: int = 20000
) -> DataFrame:
    """(doc, the ``keep`` columns, estimate, reading_level, unfamiliar_share, sentence_tokens, sentences) of every document.

    ``estimate`` is on the raters' scale of 1 to 5, ``reading_level`` the nearest whole level
    (a half goes up); both are null for a document without English prose. No document is left
    out, whatever language it is said to be in: sentences tell that themselves.
    """
    features = readability(documents, doc_col=doc_col, text_col=text_col, keep=keep, familiar_share=familiar_share)
    weights = fit_levels(features, labels, doc_col=doc_col, most_labels=most_labels)
    estimate = F.when(F.col("unfamiliar_share").isNotNull(), estimated_level(weights, F.col("unfamiliar_share"), F.col("sentence_tokens")))
    level = F.floor(F.col("estimate") + 0.5).cast("int").alias("reading_level")
    return features.withColumn("estimate", estimate).select(doc_col, *(keep or []), "estimate", level, "unfamiliar_share", "sentence_tokens", "sentences")
