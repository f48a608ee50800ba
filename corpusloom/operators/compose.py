"""From ranked passages to context and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_sentences, is_document, truncated, vocabulary_overlap

MAX_CHARS, MAX_PASSAGE = 7000, 1000


def conflict_flag(ranked: DataFrame, query_key: str, least: float = 0.15) -> DataFrame:
    """(query_key, conflict, title1, title2): the two best passages come from different sources, share
    little of their words, and the second has a score above ``least``; and what they are titled."""
    pair = ranked.where("rank <= 2").groupBy(query_key).agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("source_url", "text", "score", "title")))
    differ = F.col("source_url1") != F.col("source_url2")
    overlap = vocabulary_overlap(F.col("text1"), F.col("text2"))
    return pair.select(query_key, F.coalesce(differ & (overlap < least) & (F.col("score2") > least), F.lit(False)).alias("conflict"), "title1", "title2")


def block(title: Column, url: Column, fetched: Column, text: Column) -> Column:
    dated = F.when((F.coalesce(fetched, F.lit("")) != "") & is_document(url), F.concat(F.lit(" — dated "), fetched)).otherwise("")
    return F.concat(F.lit("["), title, F.lit(" — "), url, dated, F.lit("]\n"), truncated(text, MAX_PASSAGE))


def context(passages: DataFrame, query_key: str, budget: int = MAX_CHARS) -> DataFrame:
    """(query_key, blocks, chars) from rows (query_key, group_no, rank, title, source_url, fetched,
    text) in the order of group and rank. A passage seen before is passed over; one that doesn't fit
    ends its group, unless nothing was admitted yet. Groups of one question are a handful of rows."""
    row = F.struct(
        F.col("group_no").cast("int").alias("g"), F.col("rank").cast("int").alias("r"),
        F.concat_ws("\u0001", "source_url", F.substring("text", 1, 80)).alias("key"), block(F.col("title"), F.col("source_url"), F.col("fetched"), F.col("text")).alias("block"),
    )
    listed = passages.groupBy(query_key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("chars"), empty.alias("keys"), F.lit(-1).alias("stopped"), empty.alias("blocks"))

    def step(s: Column, x: Column) -> Column:
        seen = F.array_contains(s["keys"], x["key"])
        skip = (s["stopped"] == x["g"]) | seen
        full = (s["chars"] + F.length(x["block"]) > budget) & (F.size(s["blocks"]) > 0)
        return (
            F.when(skip, s)
            .when(full, F.struct(s["chars"].alias("chars"), s["keys"].alias("keys"), x["g"].alias("stopped"), s["blocks"].alias("blocks")))
            .otherwise(F.struct((s["chars"] + F.length(x["block"])).alias("chars"), F.array_append(s["keys"], x["key"]).alias("keys"), s["stopped"].alias("stopped"), F.array_append(s["blocks"], x["block"]).alias("blocks")))
        )

    done = listed.withColumn("s", F.aggregate("rows", start, step))
    return done.select(query_key, F.col("s.blocks").alias("blocks"), F.col("s.chars").alias("chars"))


def extractive_answers(best: DataFrame, query_key: str) -> DataFrame:
    """(query_key, answer) from (query_key, part_no, sub_question, title, text, conflict, title1, title2):
    what the best passage of every part says, or that there is none; parts in order. A conflict names
    the two pages that disagree."""
    # Sentences of an answer without a model.
    said = F.concat(F.lit('On "'), F.col("sub_question"), F.lit('" — '), F.col("title"), F.lit(" says: "), first_sentences(F.col("text")))
    names = F.concat(F.lit(" ("), F.coalesce("title1", F.lit("")), F.lit(" vs "), F.coalesce("title2", F.lit("")), F.lit(")")) if "title1" in best.columns else F.lit("")
    note = F.concat(F.lit("\n\n(Note: Top two matches come from different pages"), names, F.lit(" with little shared content -- verify both before trusting one over the other.)"))
    none = F.concat(F.lit("No good match found for: "), F.col("sub_question"), F.lit("."))
    part = F.when(F.col("text").isNull(), none).when(F.coalesce("conflict", F.lit(False)), F.concat(said, note)).otherwise(said)
    rows = best.select(query_key, F.struct(F.col("part_no"), part.alias("said")).alias("p"))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["said"]), "\n\n").alias("answer"))


def answer_check(answers: DataFrame) -> DataFrame:
    """Adds missing, forbidden and passed to rows with answer, mode, must and must_not (patterns)."""
    hit = lambda p: F.regexp_like(F.col("answer"), F.concat(F.lit("(?i)"), p))
    out = answers.withColumn("missing", F.filter("must", lambda p: ~hit(p))).withColumn("forbidden", F.filter("must_not", hit))
    return out.withColumn("passed", F.coalesce(F.col("mode").startswith("llm"), F.lit(False)) & (F.size("missing") == 0) & (F.size("forbidden") == 0))
