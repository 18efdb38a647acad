"""Search results as evidence: cards, labels that last over several searches, what a search adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def evidence_cards(results: DataFrame, chunks: DataFrame, *, most: int = 520) -> DataFrame:
    """(query_id, label, rank, chunk_id, score, title, url, heading, text): a card a result.

    ``results``: query_id, rank, chunk_id, score; ``chunks``: chunk_id, source_title,
    source_url, heading_path, chunk_text. Labels are S1, S2 and so on by rank, the text is cut
    at ``most`` characters and the score rounded to four decimals. Results of unknown chunks
    have no card. Texts are cut before the join, so whole ones are not shuffled.
    """
    shown = chunks.select(
        "chunk_id", F.col("source_title").alias("title"), F.col("source_url").alias("url"), F.concat_ws(" > ", "heading_path").alias("heading"), F.substring("chunk_text", 1, most).alias("text")
    ).distinct()
    label = F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label")
    return results.select("query_id", label, "rank", "chunk_id", F.round("score", 4).alias("score")).join(shown, "chunk_id")


def opened_cards(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, label, chunk_id, title, url, heading, text): the results opened, with their whole text."""
    shown = chunks.select(
        "chunk_id", F.col("source_title").alias("title"), F.col("source_url").alias("url"), F.concat_ws(" > ", "heading_path").alias("heading"), F.col("chunk_text").alias("text")
    ).distinct()
    found = results.select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), "chunk_id")
    return shown.join(found, "chunk_id").select("query_id", "label", "chunk_id", "title", "url", "heading", "text")


def prompts(questions: DataFrame, results: DataFrame, chunks: DataFrame, supports: DataFrame, *, instructions: str) -> DataFrame:
    """(query_id, prompt): the instructions, what each source may be used for, the question, and the excerpts by rank.

    ``questions``: query_id, question; ``supports``: query_id, chunk_id, supports (array of
    points), for some of the results. A question without results has no excerpts.
    """
    cards = opened_cards(results, chunks).join(results.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"]).join(supports, ["query_id", "chunk_id"], "left")
    source = F.concat(F.lit("["), F.col("label"), F.lit("] "))
    excerpt = F.concat(source, F.coalesce("title", F.lit("")), F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\nExcerpt: "), F.coalesce("text", F.lit("")))
    scope = F.when(F.size("supports") >= 0, F.concat(source, F.lit("may be used only for: "), F.array_join("supports", "; ")))
    each = F.array_sort(F.collect_list(F.struct("rank", scope.alias("scope"), excerpt.alias("excerpt"))))  # the few results of a question
    shown = cards.groupBy("query_id").agg(each.alias("_e"))
    scopes = F.filter(F.col("_e.scope"), lambda x: x.isNotNull())
    rules = F.when(F.size(scopes) > 0, F.concat(F.lit("\n\nScope of the sources:\n"), F.array_join(scopes, "\n"))).otherwise("")
    excerpts = F.coalesce(F.array_join(F.col("_e.excerpt"), "\n\n"), F.lit(""))
    joined = questions.select("query_id", "question").join(shown, "query_id", "left")
    return joined.select("query_id", F.concat(F.lit(instructions), rules, F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\n\nExcerpts:\n"), excerpts).alias("prompt"))


def first_found(results: DataFrame) -> DataFrame:
    """(session_id, chunk_id, search_no, rank): where a session's searches first brought up each chunk."""
    first = F.min(F.struct("search_no", "rank")).alias("_f")
    return results.groupBy("session_id", "chunk_id").agg(first).select("session_id", "chunk_id", "_f.search_no", "_f.rank")


def source_labels(results: DataFrame) -> DataFrame:
    """(session_id, chunk_id, label, score): chunks numbered S1, S2 and so on in the order a session first found them.

    ``results``: session_id, search_no, rank, chunk_id, score. A chunk found again keeps its
    label and takes the score of the last search that found it.
    """
    first, last = F.min(F.struct("search_no", "rank")).alias("_f"), F.max(F.struct("search_no", "score")).alias("_l")
    w = W.partitionBy("session_id").orderBy("_f.search_no", "_f.rank", "chunk_id")
    found = results.groupBy("session_id", "chunk_id").agg(first, last)
    return found.select("session_id", "chunk_id", F.concat(F.lit("S"), F.row_number().over(w).cast("string")).alias("label"), F.col("_l.score").alias("score"))


def novelty(results: DataFrame, *, least: int = 2) -> DataFrame:
    """(session_id, search_no, found, new, novelty) of each search.

    ``new`` chunks are those no earlier search of the session found. ``none`` without any,
    ``low`` with fewer than ``least`` in a search that is not the session's first, else ``ok``.
    """
    found = results.select("session_id", "search_no", "chunk_id").distinct().groupBy("session_id", "search_no").agg(F.count("*").alias("found"))
    new = first_found(results).groupBy("session_id", "search_no").agg(F.count("*").alias("new"))
    begun = F.min("search_no").over(W.partitionBy("session_id"))
    both = found.join(new, ["session_id", "search_no"], "left").fillna(0, ["new"]).withColumn("_begun", begun)
    kind = F.when(F.col("new") == 0, "none").when((F.col("search_no") > F.col("_begun")) & (F.col("new") < least), "low").otherwise("ok")
    return both.select("session_id", "search_no", "found", "new", kind.alias("novelty"))
