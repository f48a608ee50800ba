"""Raw page files and JSON lines: readers with fixed schemas, header parsing, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ranking import first_seen

CHUNK_SCHEMA = "id string, text string, source_url string, title string, fetched string, file string"
FEEDBACK_SCHEMA = "at string, rating string, question string, answer string, mode string, comment string"


def header_and_body(c: Column) -> tuple[Column, Column]:
    """(header map, body): the text before and after the first '---' line. Keys are lower-cased, a
    line splits at its first colon, the last of equal keys wins; without the line all is header."""
    parts = F.split(c, "---\n", 2)
    lines = F.filter(F.split(parts[0], "\r\n|\n|\r"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("key"), strip(F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x))).alias("value")))
    # keep the last pair of a key, whatever the session's map policy is
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(1))), lambda q: q["key"] == p["key"])) == 0)
    return F.map_from_entries(last), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit(""))


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_url, title, fetched, found_on, stale, body) of whole text files, by file name."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    head, body = header_and_body(F.col("value"))
    rows = raw.select("file", head.alias("head"), body.alias("body"))
    rows = rows.select("file", *(F.try_element_at("head", F.lit(k)).alias(k) for k in ("source_url", "title", "fetched", "found_on", "stale")), "body")
    return rows.orderBy("file")


def write_raw_files(pages: DataFrame, path: str) -> None:
    """Header and body of each page as a row of a text table, one file name a row (by url hash)."""
    name = F.concat(F.regexp_replace(F.col("slug"), r"\W+", "_"), F.lit("_"), F.hex(F.xxhash64("source_url")))
    head = F.concat(F.lit("SOURCE_URL: "), "source_url", F.lit("\nTITLE: "), "title", F.lit("\nFETCHED: "), "fetched", F.lit("\n---\n"))
    pages.select(name.alias("file"), F.concat(head, strip(F.col("body")), F.lit("\n")).alias("value")).write.mode("append").parquet(path)


def source_urls(files: DataFrame, text: str = "value") -> DataFrame:
    """Addresses in the headers of raw texts, without a trailing slash."""
    u = F.regexp_extract(text, r"(?m)^SOURCE_URL:[ \t]*(\S+)", 1)
    return files.select(F.regexp_replace(u, "/+$", "").alias("url")).where("url <> ''").distinct()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("id", "text", "source_url", "title", "fetched", "file").write.mode("overwrite").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Ratings from JSON lines; lines that don't parse are dropped, blank ones too; none without a file."""
    return read_or_empty(spark, path, FEEDBACK_SCHEMA)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that begin like a PDF."""
    return spark.read.format("binaryFile").load(path).where(F.expr("startswith(content, X'25504446')")).select("path", "content")


def write_latest(rows: DataFrame, path: str) -> None:
    """A run's rows added to a JSON-lines table (inventory, status, check results); readers take the last
    row of a key, so a run that is broken off loses nothing that was written."""
    rows.write.mode("append").json(path)


def read_latest(spark: SparkSession, path: str, schema: str, key: str, at: str) -> DataFrame:
    """The last row of every key of a table that runs were added to; no rows where there is none yet."""
    rows = read_or_empty(spark, path, schema).where(F.col(key).isNotNull())
    return first_seen(rows, [key], [F.col(at).desc_nulls_last()])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows where nothing has been written; lines that don't parse are dropped."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_converted(files: DataFrame, path: str) -> None:
    """Converted documents (file, value) as a table, by file name."""
    files.select("file", "value").write.mode("append").parquet(path)


def fetched_pdfs(urls: DataFrame, fetch: Callable[[str], bytes], cached: DataFrame, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(url, content, error) of PDFs: cached content (url, content) wins; what is fetched must begin like
    a PDF and not exceed the size; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    body = fetch(u)
                    error = "too large" if len(body) > max_bytes else None if body[:4] == b"%PDF" else "not a PDF"
                    rows.append((u, None if error else body, error))
                except Exception as e:  # noqa: BLE001
                    rows.append((u, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    have = cached.select("url", "content", F.lit(None).cast("string").alias("error"))
    new = urls.select("url").distinct().join(cached.select("url"), "url", "left_anti").mapInPandas(run, "url string, content binary, error string")
    return urls.select("url").distinct().join(have, "url").unionByName(new)
