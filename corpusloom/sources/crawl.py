"""Pages as a source: fetching with robots rules, and a breadth-first crawl of one site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import parsed_pages
from ..functions.text import rejoined_sentences, word_count
from ..operators.documents import skipped_url
from ..operators.ranking import top_k
from .discovery import host, internal_links, page_links
from .shared import shared_table
from .web import Fetcher, allowed, fetched

MIN_WORDS = 30


def fetched_pages(urls: DataFrame, fetch: Fetcher, robots: DataFrame | None = None) -> DataFrame:
    """(url, html, title, text, outcome) of addresses: robots (host, robots) are asked first; what isn't
    HTML has no text; a failure is a row. Every address is fetched once and kept as a table."""
    rows = urls.select("url").distinct()
    if robots is not None:
        known = robots.select(F.col("host").alias("_host"), "robots")
        rows = rows.withColumn("_host", host(F.col("url"))).join(known, "_host", "left").withColumn("ok", allowed(F.col("url"), F.col("robots")))
        rows = rows.select("url", F.coalesce("ok", F.lit(True)).alias("ok"))
    else:
        rows = rows.withColumn("ok", F.lit(True))
    rows = shared_table(rows, "asked")
    got = shared_table(fetched(rows.where("ok"), fetch), "fetched")
    pages = parsed_pages(got.where("body is not null and error is null").select("url", F.col("body").alias("html"))).select("url", "title", "text")
    text = rejoined_sentences(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    outcome = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("title").isNull(), "not html").otherwise("ok")
    read = got.join(pages, "url", "left").select("url", F.when(F.col("title").isNotNull(), F.col("body")).alias("html"), "title", text.alias("text"), outcome.alias("outcome"))
    none = F.lit(None).cast("string")
    return read.unionByName(rows.where("not ok").select("url", none.alias("html"), none.alias("title"), none.alias("text"), F.lit("robots").alias("outcome")))


def crawl(seeds: DataFrame, fetch: Fetcher, netloc: str, patterns: tuple[str, ...] = (), robots: DataFrame | None = None, visited: DataFrame | None = None, max_pages: int = 60, max_depth: int = 3) -> DataFrame:
    """(url, depth, outcome, title, text) of the pages a crawl visits, level by level. Addresses lose their
    closing slash; those seen, or skipped by a pattern, aren't visited. Pages of fewer than MIN_WORDS
    words are ``short``: not saved, but their links are followed. The crawl ends when max_pages are saved
    (a stated limit; pages of a level count in the order of their addresses) or no address is left."""
    clean = lambda c: F.regexp_replace(c, "/+$", "")
    frontier = seeds.select(clean("url").alias("url")).distinct()
    seen = frontier.where("false") if visited is None else visited.select(clean("url").alias("url")).distinct()
    saved, log = 0, None
    for depth in range(max_depth + 1):
        level = shared_table(frontier.join(seen, "url", "left_anti"), "frontier")
        if level.isEmpty():
            break
        blocked = skipped_url(F.col("url"), patterns)
        pages = shared_table(fetched_pages(level.where(~blocked), fetch, robots), "pages")
        good = pages.where((F.col("outcome") == "ok") & (word_count(F.col("text")) >= MIN_WORDS))
        kept = top_k(good.select("url", F.lit(1).alias("_all")), ["_all"], [F.col("url").asc()], max_pages - saved).select("url", F.lit(True).alias("_kept"))
        told = pages.join(kept, "url", "left")
        outcome = F.when(F.col("_kept"), "saved").when(F.col("outcome") != "ok", F.col("outcome")).when(word_count(F.col("text")) < MIN_WORDS, "short").otherwise("beyond the limit")
        rows = told.select("url", F.lit(depth).alias("depth"), outcome.alias("outcome"), "title", "text")
        none = F.lit(None).cast("string")
        rows = rows.unionByName(level.where(blocked).select("url", F.lit(depth).alias("depth"), F.lit("pattern").alias("outcome"), none.alias("title"), none.alias("text")))
        rows = shared_table(rows, "visited")
        log = rows if log is None else log.unionByName(rows)
        saved += rows.where("outcome = 'saved'").count()
        if saved >= max_pages:
            break
        seen = shared_table(seen.unionByName(level), "seen")
        links = internal_links(page_links(pages.where("outcome = 'ok'").select("url", "html")), netloc)
        frontier = links.select(clean("url").alias("url")).distinct()
    if log is None:
        return seeds.sparkSession.createDataFrame([], "url string, depth int, outcome string, title string, text string")
    return log
