"""Greedy packing of paragraphs into overlapping chunks of a word budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs, staged, words

SIZE, OVERLAP = 150, 30
_SPANS = "array<struct<s:int,e:int>>"


def chunk_spans(lengths: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of a body as word positions [s, e) from the word counts of its paragraphs. Every chunk
    is a contiguous run of the body's words, so the fold carries two numbers and no text: the open
    chunk grows by whole paragraphs; one that would exceed ``size`` is closed and its last
    ``overlap`` words open the next; a paragraph longer than ``size`` closes the open chunk and is
    cut into windows of its own, every size - overlap words."""
    pair = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast(_SPANS).alias("out"))

    def state(s: Column, e: Column, out: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), out.alias("out"))

    def step(st: Column, n: Column) -> Column:
        s, e, out = st["s"], st["e"], st["out"]
        closed = F.when(e > s, F.array_append(out, pair(s, e))).otherwise(out)
        cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(max(size - overlap, 1))), lambda k: pair(e + k, e + F.least(k + size, n)))
        long = state(e + n, e + n, F.concat(closed, cut))
        full = state(F.greatest(s, e - overlap), e + n, closed)
        return F.when(n > size, long).when((e - s + n > size) & (e > s), full).otherwise(state(s, e + n, out))

    return F.aggregate(lengths, start, step, lambda st: F.when(st["e"] > st["s"], F.array_append(st["out"], pair(st["s"], st["e"]))).otherwise(st["out"]))


def with_chunks(df: DataFrame, body: str, out: str = "chunks", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df with its body's chunks as an array; null and blank bodies have none."""
    rows = staged(df, "_words", F.transform(paragraphs(F.coalesce(body, F.lit(""))), words))
    rows = staged(rows, "_cut", F.struct(F.flatten("_words").alias("w"), chunk_spans(F.transform("_words", F.size), size, overlap).alias("spans"))).drop("_words")
    return rows.withColumn(out, F.transform("_cut.spans", lambda x: F.array_join(F.slice("_cut.w", x["s"] + 1, x["e"] - x["s"]), " "))).drop("_cut")


def chunk_table(files: DataFrame) -> DataFrame:
    """Raw files (file, source_url, title, fetched, body) -> chunks with ids ``<stem>::<ordinal>``."""
    rows = with_chunks(files.select("file", "source_url", "title", "fetched", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), "body"), "body")
    rows = rows.select("file", "source_url", "title", "fetched", "stem", F.posexplode("chunks").alias("chunk_no", "text"))
    return rows.select(
        F.concat("stem", F.lit("::"), "chunk_no").alias("id"), "text", F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("title", "stem").alias("title"), F.coalesce("fetched", F.lit("")).alias("fetched"), "file", "chunk_no",
    )
