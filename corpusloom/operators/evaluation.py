"""Evaluation: pages and facts found, answers checked, conversations replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import glued, looks_like_followup
from ..functions.text import ordinals_joined
from .ranking import top_k

#: An answerable case doesn't ask for this.
DECLINES = r"(?i)not find|couldn.t find|no information|not available"


def page_hits(found: DataFrame, accepted: DataFrame, case_key: str, k: int = 3) -> DataFrame:
    """(case_key, hit, top_url): whether the address of one of the first k results holds an accepted
    piece. found: (case_key, rank, source_url); accepted: (case_key, accepted array<string>)."""
    best = found.where(F.col("rank") <= k).groupBy(case_key).agg(F.array_sort(F.collect_list(F.struct("rank", "source_url"))).alias("urls"))
    hit = F.exists("accepted", lambda a: F.exists("urls", lambda u: u["source_url"].contains(a)))
    return accepted.join(best, case_key, "left").select(case_key, F.coalesce(hit, F.lit(False)).alias("hit"), F.get("urls", F.lit(0))["source_url"].alias("top_url"))


def fact_ranks(found: DataFrame, facts: DataFrame, case_key: str, k: int = 20) -> DataFrame:
    """(case_key, fact_rank): rank of the first of k passages that matches the fact's pattern (case
    matters, a dot stands for any character); null where none does."""
    hit = F.regexp_like("text", F.concat(F.lit("(?s)"), "pattern"))
    first = found.where(F.col("rank") <= k).join(facts, case_key).where(hit).groupBy(case_key).agg(F.min("rank").alias("fact_rank"))
    return facts.select(case_key).join(first, case_key, "left")


def answerable(cases: DataFrame, case_key: str) -> DataFrame:
    """(case_key, pattern): cases with an answer to be found, and what its passage must match."""
    return cases.where((F.size("must") > 0) & ~F.exists("must", lambda m: m.rlike(DECLINES))).select(case_key, F.col("must")[0].alias("pattern"))


def passage_ranks(found: DataFrame, cases: DataFrame, case_key: str, k: int = 12) -> DataFrame:
    """(case_key, first_rank) over the passages in the order of part and rank, each counted once by its
    address and first 60 characters. found: (case_key, part_no, rank, source_url, text)."""
    seen = found.where(F.col("rank") <= k).withColumn("_key", F.struct("source_url", F.substring("text", 1, 60)))
    once = top_k(seen, [case_key, "_key"], [F.col("part_no").asc(), F.col("rank").asc()], 1, "_n")
    placed = top_k(once, [case_key], [F.col("part_no").asc(), F.col("rank").asc()], 1 << 30, "place")
    hit = F.regexp_like(ordinals_joined(F.col("text")), F.concat(F.lit("(?i)"), "pattern"))
    first = placed.join(cases, case_key).where(hit).groupBy(case_key).agg(F.min("place").alias("first_rank"))
    return cases.select(case_key).join(first, case_key, "left")


def check_summary(results: DataFrame) -> DataFrame:
    """One row: checks, how many passed, those that never reached a model, and their distinct reasons."""
    plain = ~F.coalesce(F.col("mode").startswith("llm"), F.lit(False))
    return results.agg(
        F.count("*").alias("checks"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"), F.coalesce(F.sum(plain.cast("long")), F.lit(0)).alias("without_model"),
        F.array_join(F.array_sort(F.collect_list(F.when(plain, F.col("name")))), ", ").alias("names"), F.array_join(F.array_sort(F.collect_set(F.when(plain, F.substring("mode", 1, 160)))), "; ").alias("reasons"),
    )


def named(cases: DataFrame, name: str, only: str) -> DataFrame:
    """Cases whose name holds a piece; all for an empty one."""
    return cases.where(F.col(name).contains(only)) if only else cases


def replayed(turns: DataFrame, conversation: str, order: list[Column], question: str) -> DataFrame:
    """(conversation, turns, understood_as, combined): every turn is read with the turns before as they
    were understood, in order; the last one is what a check looks at. Conversations are short."""
    listed = turns.groupBy(conversation).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(question).alias("q")))), lambda x: x["q"]).alias("said"))
    start = F.struct(F.lit("").alias("last"), F.lit(False).alias("combined"))

    def step(s: Column, q: Column) -> Column:
        needs = (s["last"] != "") & looks_like_followup(q)
        return F.struct(F.when(needs, glued(q, s["last"])).otherwise(q).alias("last"), needs.alias("combined"))

    done = listed.withColumn("_s", F.aggregate(F.filter("said", lambda q: q.isNotNull()), start, step))
    return done.select(conversation, F.size("said").alias("turns"), F.col("_s.last").alias("understood_as"), F.col("_s.combined").alias("combined"))
