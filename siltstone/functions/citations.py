"""Source labels such as [S1, S2] in answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: a bracket of labels.
CITATION = r"\[((?:S\d+)(?:\s*,\s*S\d+)*)\]"


def cited_labels(answer: Column) -> Column:
    """Labels in citation brackets, in order, each once."""
    brackets = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.regexp_extract_all(F.array_join(brackets, ","), F.lit(r"S\d+"), F.lit(0)))


def grounding(answer: Column, best_score: Column, results: Column, threshold: float = 0.5) -> Column:
    """Why an answer is not supported by its results, null if it is. ``results`` is the number of them."""
    labels = cited_labels(answer)
    known = F.transform(F.sequence(F.lit(1), F.greatest(results, F.lit(1))), lambda i: F.concat(F.lit("S"), i.cast("string")))
    return (
        F.when(results == 0, F.lit("no_results"))
        .when(best_score < threshold, F.lit("below_relevance_threshold"))
        .when(F.coalesce(F.size(labels), F.lit(0)) == 0, F.lit("no_citations_in_model_output"))
        .when(~F.arrays_overlap(labels, known), F.lit("invalid_citation_labels"))
    )


def renumbered(answer: Column, results: Column) -> Column:
    """The answer with its valid labels numbered without gaps, in the results' order; unknown ones stay."""
    cited = cited_labels(answer)
    known = F.transform(F.sequence(F.lit(1), F.greatest(results, F.lit(1))), lambda i: F.concat(F.lit("S"), i.cast("string")))
    kept = F.when(results > 0, F.array_intersect(known, cited)).otherwise(F.array().cast("array<string>"))

    def new(label: Column, used: Column) -> Column:
        at = F.array_position(used, label)
        return F.when(at > 0, F.concat(F.lit("S"), at.cast("string"))).otherwise(label)

    def piece(text: Column, used: Column) -> Column:
        labels = F.regexp_extract_all(text, F.lit(r"S\d+"), F.lit(0))
        return F.when(text.rlike(f"^{CITATION}$"), F.concat(F.lit("["), F.array_join(F.transform(labels, lambda x: new(x, used)), ", "), F.lit("]"))).otherwise(text)

    # brackets of labels, and everything between them
    pieces = F.regexp_extract_all(answer, F.lit(rf"(?s){CITATION}|[^\[]+|\["), F.lit(0))
    bound = F.transform(F.array(kept), lambda used: F.array_join(F.transform(pieces, lambda t: piece(t, used)), ""))
    return F.get(bound, F.lit(0))
