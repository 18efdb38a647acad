"""Page, sitemap and configuration sources."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions.identity import canonical_url, doc_id, slug

#: Answers after which a fetch is tried again.
RETRIED = frozenset({429, 500, 502, 503, 504})


def fetch_pages(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], *, attempts: int = 4, backoff: float = 1.0) -> DataFrame:
    """(doc_id, requested_url, http_status, html, error_message, outcome) of each row (doc_id, requested_url).

    ``fetch`` gives status and text, and runs in the tasks. Outcomes: ok (2xx), not_found (404,
    at once), http_error, network_error; other errors are tried again after 1, 2, 4 ... times
    ``backoff`` seconds.
    """

    def one(url: str) -> tuple:
        for turn in range(attempts):
            last = turn == attempts - 1
            try:
                status, text = fetch(url)
            except OSError as e:
                if last:
                    return None, None, str(e), "network_error"
            else:
                if 200 <= status < 300:
                    return status, text, None, "ok"
                if status not in RETRIED or last:
                    return status, None, f"HTTP {status}", "not_found" if status == 404 else "http_error"
            time.sleep(backoff * 2**turn)
        return None, None, "no attempt", "network_error"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, u, *one(u)) for d, u in zip(f["doc_id"], f["requested_url"])]
            out = pd.DataFrame(rows, columns=["doc_id", "requested_url", "http_status", "html", "error_message", "outcome"])
            yield out.astype({"http_status": "Int64"})

    return urls.select("doc_id", "requested_url").mapInPandas(run, "doc_id string, requested_url string, http_status int, html string, error_message string, outcome string")


def sitemap(spark: SparkSession, path: str, host: str) -> DataFrame:
    """(url, doc_id, slug) of the https pages of one host in a sitemap file, each once.

    A sitemap that cannot be read, or has no such page, is an error: it must not look as if
    all pages were gone.
    """
    rows = spark.read.format("xml").option("rowTag", "url").option("mode", "FAILFAST").schema("loc string").load(path)
    url = canonical_url(F.col("loc"))
    pages = rows.where(F.col("loc").isNotNull()).select(url.alias("url")).where(F.col("url").startswith(f"https://{host}/") | (F.col("url") == f"https://{host}")).distinct()
    if not pages.limit(1).count():
        raise ValueError(f"no page of {host} in the sitemap {path}")
    return pages.select("url", doc_id(F.col("url")).alias("doc_id"), slug(F.col("url")).alias("slug"))


def discovery_roots(spark: SparkSession, roots: list[dict], categories: set[str]) -> DataFrame:
    """(root_order, root_id, prefix, category, max_pages) of a checked list of roots, one row a prefix."""
    seen, rows = set(), []
    for order, r in enumerate(roots):
        name, prefixes, most = r.get("id"), r.get("allowed_path_prefixes") or [], r.get("max_pages", 250)
        wrong = (
            not name or name in seen or not str(r.get("landing_url", "")).startswith(("http://", "https://"))
            or not prefixes or not all(isinstance(p, str) and p.startswith("/") for p in prefixes)
            or r.get("category") not in categories or isinstance(most, bool) or not isinstance(most, int) or not 1 <= most <= 250
        )
        if wrong:
            raise ValueError(f"root {order} is not valid: {r}")
        seen.add(name)
        rows += [(order, name, p, r["category"], most) for p in prefixes]
    return spark.createDataFrame(rows, "root_order int, root_id string, prefix string, category string, max_pages int")


def checked_roots(selected: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, pages) of selected pages; a root with none, or over its ``max_pages``, is an error."""
    limits = roots.groupBy("root_id").agg(F.max("max_pages").alias("_most"))
    counts = limits.join(selected.groupBy("root_id").agg(F.count("*").alias("pages")), "root_id", "left").fillna(0, ["pages"])
    wrong = counts.where((F.col("pages") == 0) | (F.col("pages") > F.col("_most"))).collect()  # a row a root
    if wrong:
        raise ValueError("roots out of bounds: " + ", ".join(f"{r['root_id']} has {r['pages']} pages" for r in wrong))
    return counts.drop("_most")


def linked_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, url): the pages that the anchors of pages (doc_id, url, html) lead to, each once, in canonical form.

    Addresses are resolved against the page's own; fragments, mail addresses, scripts and the
    like lead nowhere. ``corpus.in_path_family`` keeps those that belong to a root.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'<>]*)["']"""), F.lit(1))
    each = pages.select("doc_id", F.col("url").alias("_base"), F.explode(anchors).alias("_href")).withColumn("_href", F.trim(F.regexp_replace("_href", "&amp;", "&")))
    scheme, origin = F.regexp_extract("_base", "^([^:/?#]+:)", 1), F.regexp_extract("_base", "^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("_base", "[?#].*$", ""), "(?<![:/])/[^/]*$", "/")
    href = F.col("_href")
    url = (
        F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
        .when(~href.rlike("^(?:#|$|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", "")))
    )
    return each.select("doc_id", canonical_url(url).alias("url")).where(F.col("url").isNotNull()).distinct()


def checked_list(entries: DataFrame, categories: set[str]) -> DataFrame:
    """(doc_id, slug, url, canonical_url, category, reason, problem) of a curated list (url, category, reason).

    ``problem`` is the first of: url (not http or https), category (unknown), reason (none),
    duplicate (another entry has the same canonical page); null for a good entry.
    """
    from pyspark.sql import Window as W

    canonical = canonical_url(F.col("url"))
    named = entries.select("url", canonical.alias("canonical_url"), "category", "reason").withColumn("doc_id", doc_id(F.col("canonical_url")))
    fits = F.lower(F.regexp_extract("url", "^([^:/?#]+):", 1)).isin("http", "https")
    problem = (
        F.when(~F.coalesce(fits, F.lit(False)), "url")
        .when(~F.coalesce(F.col("category").isin(*sorted(categories)), F.lit(False)), "category")
        .when(F.coalesce(F.length("reason"), F.lit(0)) == 0, "reason")
        .when(F.count("*").over(W.partitionBy("doc_id")) > 1, "duplicate")
    )
    return named.select("doc_id", slug(F.col("canonical_url")).alias("slug"), "url", "canonical_url", "category", "reason", problem.alias("problem"))


def curated_list(entries: DataFrame, categories: set[str]) -> DataFrame:
    """The pages of a curated list without ``problem``; a list with one is an error that names a few."""
    checked = checked_list(entries, categories)
    wrong = checked.where(F.col("problem").isNotNull()).select("url", "problem").orderBy("url").limit(5).collect()
    if wrong:
        raise ValueError("the list is not valid: " + ", ".join(f"{r['url']!r}: {r['problem']}" for r in wrong))
    return checked.drop("problem")
