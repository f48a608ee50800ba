"""Converted documents: items in reading order to lines of text, tables with the context before them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import clean_context, is_day_grid, row_lines
from ..functions.text import clean, lead_sentence, word_count

ITEMS = "doc string, item_no int, kind string, text string, headers array<string>, cells array<array<string>>, error string"
Converter = Callable[[bytes], list[tuple[str, str, list, list]]]  # content -> (kind, text, headers, rows)


def converted(files: DataFrame, key: str, content: str, converter: Converter) -> DataFrame:
    """Items (section, text, table) of every document, by a given converter; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body in zip(b[key], b[content]):
                try:
                    rows += [(doc, n, kind, text, head, cells, None) for n, (kind, text, head, cells) in enumerate(converter(bytes(body)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((doc, 0, "error", None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["doc", "item_no", "kind", "text", "headers", "cells", "error"])

    return files.select(key, content).mapInPandas(run, ITEMS)


def carried_context(items: DataFrame) -> DataFrame:
    """items with ``section`` and ``lead``: the last heading (80 characters) and the first sentence of the
    last text of eight words or more before each item. A document's items are one window each."""
    said = clean(F.col("text"))
    w = Window.partitionBy("doc").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    section = F.when((F.col("kind") == "section") & (said != ""), F.rtrim(F.substring(said, 1, 80), F.lit(": ")))
    lead = F.when((F.col("kind") == "text") & (word_count(said) >= 8), lead_sentence(said))
    rows = items.withColumn("_s", section).withColumn("_l", lead)
    rows = rows.withColumn("section", F.last("_s", ignorenulls=True).over(w)).withColumn("lead", F.last("_l", ignorenulls=True).over(w))
    return rows.drop("_s", "_l")


def table_context(lead: Column, section: Column, letterhead: str) -> Column:
    """The lead sentence and the heading, cleaned, as the prefix of a table's lines."""
    parts = F.array(*(clean_context(F.coalesce(c, F.lit("")), letterhead) for c in (lead, section)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def document_lines(items: DataFrame, letterhead: str) -> DataFrame:
    """(doc, item_no, line_no, line): texts and headings as lines, tables as one line a row; calendar
    grids and empty texts give none."""
    rows = carried_context(items)
    head, cells = F.coalesce("headers", F.array().cast("array<string>")), F.coalesce("cells", F.array().cast("array<array<string>>"))
    table = F.when(is_day_grid(head, cells), F.array().cast("array<string>")).otherwise(row_lines(head, cells, table_context(F.col("lead"), F.col("section"), letterhead)))
    said = clean(F.col("text"))
    text = F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>"))
    lines = F.when(F.col("kind") == "table", table).when(F.col("kind").isin("section", "text"), text).otherwise(F.array().cast("array<string>"))
    return rows.select("doc", "item_no", F.posexplode(lines).alias("line_no", "line"))


def document_texts(items: DataFrame, letterhead: str) -> DataFrame:
    """(doc, title, body): the lines of every document in order, and its first heading of three words or
    more (120 characters), empty where there is none."""
    line = F.struct("item_no", "line_no", "line")
    body = document_lines(items, letterhead).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))
    heads = items.where((F.col("kind") == "section") & (word_count(clean(F.col("text"))) >= 3))
    title = heads.groupBy("doc").agg(F.substring(F.min_by(clean(F.col("text")), "item_no"), 1, 120).alias("title"))
    docs = items.select("doc").distinct()
    return docs.join(title, "doc", "left").join(body, "doc", "left").select("doc", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))


def converted_files(texts: DataFrame, inventory: DataFrame, today: str) -> DataFrame:
    """(file, value) of converted documents as raw files: header, a line that names document and date,
    text. inventory: (doc, out_file, url, doc_title, modified_time); the date is the day of the last
    change, else today."""
    j = texts.join(inventory, "doc")
    date = F.coalesce(F.nullif(F.substring("modified_time", 1, 10), F.lit("")), F.lit(today))
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_title"))
    head = F.concat(F.lit("SOURCE_URL: "), "url", F.lit("\nTITLE: "), name, F.lit("\nFETCHED: "), date, F.lit("\n---\n"))
    value = F.concat(head, F.lit("Document: "), name, F.lit(" (dated "), date, F.lit(")\n"), "body", F.lit("\n"))
    return j.select(F.col("out_file").alias("file"), value.alias("value"))
