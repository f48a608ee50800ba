"""Documents and pages found through links, their metadata, and addresses known already."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import parsed_pages
from ..functions.text import drive_id, upload_month
from ..operators.documents import STATIC_FILES, skipped_url
from .raw_files import source_urls

Metadata = Callable[[str], dict]  # identifier -> name, mimeType, size, modifiedTime; may raise


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def page_links(pages: DataFrame) -> DataFrame:
    """(page, anchor_no, url, link_text) of all anchors of pages (url, html), addresses absolute and
    without fragment, in document order."""
    links = parsed_pages(pages).select(F.col("url").alias("page"), F.posexplode("links").alias("anchor_no", "l"))
    return links.select("page", "anchor_no", F.col("l.url").alias("url"), F.col("l.text").alias("link_text"))


def internal_links(links: DataFrame, netloc: str | Column) -> DataFrame:
    """(page, url): the distinct addresses of one site that a crawl goes on with: http(s), no static
    files, no query."""
    site = F.lit(netloc) if isinstance(netloc, str) else netloc
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return links.where((host(F.col("url")) == site) & ~bare.rlike(STATIC_FILES)).select("page", bare.alias("url")).distinct()


def pdf_links(links: DataFrame, netloc: str | Column) -> DataFrame:
    """(page, url): the PDFs of one site, without query."""
    site = F.lit(netloc) if isinstance(netloc, str) else netloc
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return links.where((host(F.col("url")) == site) & F.lower(bare).endswith(".pdf")).select("page", bare.alias("url")).distinct()


def discovered(links: DataFrame, netloc: str | Column, drive: str = r"drive\.google\.com") -> DataFrame:
    """(doc_key, kind, drive_id, url, link_text, found_on): the first link to every document, in the
    order of page and anchor. A document is a shared-drive file, or a PDF of the site."""
    site = F.lit(netloc) if isinstance(netloc, str) else netloc
    rows = links.withColumn("drive_id", drive_id(F.col("url"), drive))
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    web = (host(F.col("url")) == site) & F.lower(path).endswith(".pdf")
    rows = rows.withColumn("kind", F.when(F.col("drive_id").isNotNull(), "drive").when(web, "web")).where("kind is not null")
    rows = rows.withColumn("doc_key", F.concat("kind", F.lit(":"), F.coalesce("drive_id", "url")))
    w = Window.partitionBy("doc_key").orderBy("page", "anchor_no")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select("doc_key", "kind", "drive_id", "url", F.substring("link_text", 1, 200).alias("link_text"), F.col("page").alias("found_on"))


def enriched(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """documents with name, MIME type, size, date and error: of shared files from their metadata (an
    error row, or none, is an error), of PDFs of the site from the address itself."""
    m = metadata.select("drive_id", *(F.col(c).alias(f"_{c}") for c in ("doc_name", "mime_type", "size_bytes", "modified_time", "error_text")))
    j = documents.join(m, "drive_id", "left")
    web = F.col("kind") == "web"
    name = F.element_at(F.split(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), "/"), -1)
    return j.select(
        *documents.columns, F.when(web, name).otherwise(F.col("_doc_name")).alias("doc_name"), F.when(web, "application/pdf").otherwise(F.col("_mime_type")).alias("mime_type"),
        F.when(~web, F.col("_size_bytes")).alias("size_bytes"), F.when(web, upload_month(F.col("url"))).otherwise(F.col("_modified_time")).alias("modified_time"),
        F.when(~web, F.coalesce("_error_text", F.when(F.col("_mime_type").isNull(), "no metadata"))).alias("error_text"),
    )


def fetched_metadata(documents: DataFrame, client: Metadata, secret: str = "") -> DataFrame:
    """(drive_id, doc_name, mime_type, size_bytes, modified_time, error_text) of shared files through a
    given client; a failure is a row whose message doesn't show the secret."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["drive_id", "doc_name", "mime_type", "size_bytes", "modified_time", "error_text"]
        for b in batches:
            rows = []
            for i in b["drive_id"]:
                try:
                    v = client(i)
                    rows.append((i, v.get("name"), v.get("mimeType"), v.get("size"), v.get("modifiedTime"), None))
                except Exception as e:  # noqa: BLE001
                    said = f"{type(e).__name__}: {e}"
                    rows.append((i, None, None, None, None, (said.replace(secret, "<KEY>") if secret else said)[:300]))
            yield pd.DataFrame(rows, columns=cols)

    ids = documents.where("kind = 'drive'").select("drive_id").distinct()
    return ids.mapInPandas(run, "drive_id string, doc_name string, mime_type string, size_bytes string, modified_time string, error_text string")


def known_urls(files: DataFrame, extra: DataFrame, text: str = "value") -> DataFrame:
    """(url): addresses of saved pages (not of converted documents), then those of ``extra`` that aren't
    among them. files: (file, value)."""
    saved = source_urls(files.where(~F.col("file").startswith("doc_")), text)
    return saved.unionByName(extra.select("url").distinct().join(saved, "url", "left_anti"))


def crawl_step(links: DataFrame, visited: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(url): what a crawl visits next: internal addresses that no pattern skips and that weren't seen."""
    fresh = links.select(F.regexp_replace("url", "/+$", "").alias("url")).distinct()
    return fresh.where(~skipped_url(F.col("url"), patterns)).join(visited.select("url"), "url", "left_anti")
