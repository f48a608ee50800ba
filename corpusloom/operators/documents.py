"""Documents: selection, disposition, discovery, snapshots and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_title, script_share, strip, word_count
from ..sources.shared import shared_table
from .ranking import first_seen, top_k

MAX_BYTES, MIN_WORDS = 25 * 1024 * 1024, 30


def skipped_url(url: Column, patterns: tuple[str, ...]) -> Column:
    return url.rlike("(?i)" + "|".join(patterns)) if patterns else F.lit(False)


# Paths that hold no content of their own.
SKIP_PATHS = (r"/wp-admin", r"/wp-login", r"/feed/?$", r"/tag/", r"/page/\d+", r"e-samarth", r"eoffice", r"webmail", r"/index\.php/", r"/category/")
STATIC_FILES = r"(?i)\.(jpg|jpeg|png|gif|svg|zip|docx?|xlsx?|pptx?|pdf)$"


def convertible(inventory: DataFrame, excluded: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Inventory entries worth converting: a PDF without error, of an acceptable (or unknown) size,
    whose title and name match none of the excluded patterns, with a title in Latin script."""
    title = document_title(F.col("link_text"), F.col("doc_name"), F.col("url"))
    rows = inventory.withColumn("doc_title", title).withColumn("bytes", F.coalesce(F.expr("try_cast(size_bytes as bigint)"), F.lit(0)))
    rows = rows.where((F.coalesce("error_text", F.lit("")) == "") & (F.col("mime_type") == "application/pdf") & (F.col("bytes") <= max_bytes))
    if excluded:
        rows = rows.where(~F.concat_ws(" ", "doc_title", F.coalesce("doc_name", F.lit(""))).rlike("(?i)" + "|".join(excluded)))
    return rows.where(~F.col("doc_title").rlike("[ऀ-ॿ]"))


def by_priority(rows: DataFrame) -> DataFrame:
    """Adds ``newest``: the digits of the modification date as a number, for newest-first order."""
    return rows.withColumn("newest", F.coalesce(F.expr(r"try_cast(regexp_replace(left(coalesce(modified_time, '0'), 10), '\\D', '') as bigint)"), F.lit(0)))


def identifier_density(text: Column, roll: str, mail: str, long_id: str = r"\b\d{10,15}\b") -> Column:
    """Whether a text is a list of persons: identifiers at a density no rule book reaches."""
    n = F.greatest(F.lit(1), word_count(text))

    def dense(p: str) -> Column:
        k = F.regexp_count(text, F.lit(p))
        return (k >= 2) & (k * 100 / n >= 0.5)

    return dense(roll) | dense(mail) | (F.regexp_count(text, F.lit(long_id)) >= 25)


def disposition(text: Column, error: Column, roll: str, mail: str) -> Column:
    """What becomes of a converted text: error, empty, hindi, personal_data or ok, in this order."""
    t = F.coalesce(text, F.lit(""))
    return F.when(error.isNotNull(), "error").when(word_count(t) < MIN_WORDS, "empty").when(script_share(t) > 0.3, "hindi").when(identifier_density(t, roll, mail), "personal_data").otherwise("ok")


def first_links(inventory: DataFrame) -> DataFrame:
    """The first entry of every document key, by page and link."""
    return first_seen(inventory.where("doc_key is not null"), ["doc_key"], [F.col("found_on").asc_nulls_last(), F.col("link_text").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("modified_time").asc_nulls_last()])


def latest_status(status: DataFrame) -> DataFrame:
    """The last run of every key; ties by outcome."""
    return first_seen(status.where("doc_key is not null"), ["doc_key"], [F.col("run_at").desc_nulls_last(), F.col("outcome").asc_nulls_last(), F.col("seconds").asc_nulls_last()])


def to_do(inventory: DataFrame, status: DataFrame) -> DataFrame:
    """Entries without any status yet: a resumed run starts here."""
    return inventory.join(status.select("doc_key"), "doc_key", "left_anti")


def snapshot_diff(stored: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of stored pages against a re-fetch (key, body, html, reachable): stale, skipped
    (not HTML), unchanged or changed; bodies compare without outer white space."""
    f = fetched.select(key, F.col("body").alias("new_body"), "html", "reachable")
    j = stored.select(key, "body").join(f, key, "left")
    same = strip(F.coalesce("body", F.lit(""))).eqNullSafe(strip(F.coalesce("new_body", F.lit(""))))
    outcome = F.when(~F.coalesce("reachable", F.lit(False)), "stale").when(~F.col("html"), "skipped").when(same, "unchanged").otherwise("changed")
    return j.select(key, outcome.alias("outcome"))


def mark_stale(pages: DataFrame, diff: DataFrame, key: str, day: Column) -> DataFrame:
    """Sets ``stale`` once: a page that is marked already keeps its first mark."""
    j = pages.join(diff.where("outcome = 'stale'").select(key, F.lit(True).alias("_gone")), key, "left")
    return j.withColumn("stale", F.coalesce("stale", F.when(F.col("_gone"), day.cast("string")))).drop("_gone")


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int, blocked: Column | None = None) -> DataFrame:
    """(url, depth) reachable from the seeds over (src, dst), level by level: a frontier is a table,
    visited pages are an anti-join, and each level is written so that lineage stays short."""
    level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    if blocked is not None:
        level = level.where(~blocked)
    seen = shared_table(level, "bfs")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        if blocked is not None:
            step = step.where(~blocked)
        frontier = shared_table(step, "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def refreshed(stored: DataFrame, diff: DataFrame, fetched: DataFrame, key: str, day: Column) -> DataFrame:
    """stored pages after a re-fetch: changed ones with the new body and title, fetched on ``day`` and
    without marks; unreachable ones marked stale once; all others as they are."""
    new = diff.where("outcome = 'changed'").select(key).join(fetched.select(key, F.col("body").alias("_body"), F.col("title").alias("_title")), key)
    j = mark_stale(stored, diff, key, day).join(new, key, "left")
    changed = F.col("_body").isNotNull()
    out = {"body": F.when(changed, F.col("_body")).otherwise(F.col("body")), "title": F.when(changed, F.coalesce("_title", "title")).otherwise(F.col("title"))}
    out["fetched"] = F.when(changed, day.cast("string")).otherwise(F.col("fetched"))
    out["stale"] = F.when(~changed, F.col("stale"))
    if "found_on" in stored.columns:
        out["found_on"] = F.when(~changed, F.col("found_on"))
    return j.select(*(out[c].alias(c) if c in out else c for c in stored.columns))


def plan_listing(rows: DataFrame, group: str, order: list[Column], n: int = 25) -> DataFrame:
    """The first n rows of every group with the group's size: what a run would take on first."""
    size = rows.groupBy(group).agg(F.count("*").alias("in_group"))
    return top_k(rows, [group], order, n, "place").join(size, group)


def progress(inventory: DataFrame, status: DataFrame) -> DataFrame:
    """One row: documents, how many have been processed and how many are left."""
    keys = inventory.where("doc_key is not null").select("doc_key").distinct()
    done = status.where("doc_key is not null").select("doc_key").distinct().withColumn("_done", F.lit(1))
    return keys.join(done, "doc_key", "left").agg(F.count("*").alias("documents"), F.count("_done").alias("processed"), (F.count("*") - F.count("_done")).alias("left_over"))
