"""Identities and keys of pages, chunks and questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siltstone.functions.text import squeeze

#: Query parameters that do not identify a page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source"]
#: Leading parts that a slug leaves out, tried in this order.
SLUG_PREFIXES = ["aws-en-", "gcp-en-", "api-workspace-"]
#: Words that are no search terms.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "difference", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "with"]
TITLE_LIMIT, TITLE_CUT = 88, 85

_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def path_category(url: Column, rules: list[tuple[str, str, str]], otherwise: str | Column) -> Column:
    """The category of a page by its path: the first of ``rules`` (``under`` or ``at``, path,
    category) that fits, where ``under`` is a prefix and ``at`` the whole path."""
    path, other = url_path(canonical_url(url)), otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(*[F.when(path.startswith(p) if kind == "under" else path == p, F.lit(category)) for kind, p, category in rules], other)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no slashes at the path's end, no tracking parameters, the
    others sorted by name and value, no fragment. Parameters keep the encoding they came in."""
    text = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(text, _URL, 1)), F.lower(F.regexp_extract(text, _URL, 2))
    path = url_path(text)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(text, _URL, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def doc_id(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 16)


def chunk_id(document: Column, version: Column, position: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", document, version, position.cast("string")), 256), 1, 24)


def slug(canonical: Column) -> Column:
    """The path in lower case, other characters as single hyphens, without a known prefix; else ``index``."""
    text = F.regexp_replace(F.regexp_replace(F.lower(url_path(canonical)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.coalesce(*[F.when(text.startswith(p), F.substring(text, len(p) + 1, 1 << 30)) for p in SLUG_PREFIXES], text)
    return F.when(cut == "", F.lit("index")).otherwise(cut)


def history_title(question: Column) -> Column:
    """A question as a label of at most 88 characters, cut at a blank within the first 85."""
    text = squeeze(question)
    head = F.substring(text, 1, TITLE_CUT)
    at_blank = F.regexp_extract(head, "^(.*) ", 1)
    short = F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("…"))
    return F.when(text == "", F.lit("New conversation")).when(F.length(text) <= TITLE_LIMIT, text).otherwise(short)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_key(question: Column) -> Column:
    """Equal for questions of the same words in any order; repeats count."""
    return F.array_join(F.array_sort(ascii_words(question)), " ")


def terms(text: Column) -> Column:
    """Distinct search terms: words of over two characters that are no stop words."""
    return F.array_distinct(F.filter(ascii_words(text), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def phrases(text: Column) -> Column:
    """Pairs of adjacent words, stop words included."""
    w = ascii_words(text)
    n = F.size(w)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def clean_text(text: Column) -> Column:
    """White space squeezed, zero-width spaces dropped, none before punctuation."""
    return F.regexp_replace(F.regexp_replace(squeeze(text), "​", ""), r"(?U)\s+([:,.;!?])", "$1")


def hash_embedding(text: Column) -> Column:
    """Sixteen numbers in -1 to 1 from the first bytes of the text's digest; for tests and dry runs."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    # bound in an array of one, so that it is worked out once a text
    numbers = F.transform(F.array(digest), lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5))
    return F.get(numbers, F.lit(0))
