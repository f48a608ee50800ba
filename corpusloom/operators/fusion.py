"""Merging rankings and forming candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import exact_rank, top_k

RANK_OFFSET, KEYWORD_WEIGHT = 30, 0.5
POOL, PER_SOURCE, SCAN = 60, 4, 8


def fuse(dense: DataFrame, keyword: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, rank_dense, rank_keyword, fused): weighted reciprocal ranks. Every item of the
    dense side is ranked on both; without a keyword score it counts with 0."""
    both = dense.select(query_key, key, F.col("score").alias("dense")).join(keyword.select(query_key, key, F.col("score").alias("keyword")), [query_key, key], "left")
    both = both.withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    ranked = exact_rank(both, [query_key], [F.round("dense", 9).desc(), F.col(key).asc()], "rank_dense")
    ranked = exact_rank(ranked, [query_key], [F.round("keyword", 9).desc(), F.col(key).asc()], "rank_keyword")
    score = 1.0 / (RANK_OFFSET + F.col("rank_dense")) + KEYWORD_WEIGHT / (RANK_OFFSET + F.col("rank_keyword"))
    return ranked.select(query_key, key, "rank_dense", "rank_keyword", score.alias("fused"))


def interleave(orders: DataFrame, query_key: str, key: str, depth: int | None = None) -> DataFrame:
    """(query_key, key, rank) from (query_key, key, variant, pos): rankings take turns, first sight
    counts; positions beyond the shortest ranking of a question are left out."""
    shortest = orders.groupBy(query_key, "variant").agg(F.max("pos").alias("m")).groupBy(query_key).agg(F.min("m").alias("m"))
    rows = orders.join(shortest, query_key).where(F.col("pos") <= F.col("m")).drop("m")
    seen = rows.groupBy(query_key, key).agg(F.min(F.struct("pos", "variant")).alias("at"))
    if depth is not None:
        return top_k(seen, [query_key], [F.col("at").asc(), F.col(key).asc()], depth).select(query_key, key, "rank")
    return exact_rank(seen.select(query_key, key, "at.pos", "at.variant"), [query_key], [F.col("pos").asc(), F.col("variant").asc()]).select(query_key, key, "rank")


def capped_pool(ranked: DataFrame, query_key: str, source: str, pool: int = POOL, per_source: int = PER_SOURCE) -> DataFrame:
    """Candidates of each question from rows with ``rank`` and ``contradicts``: the first ``pool`` that
    don't contradict and aren't beyond ``per_source`` of their source; rows passed over come back in
    order while the pool isn't full. Looks at the first pool * SCAN rows, as its definition says."""
    rows = ranked.where(F.col("rank") <= pool * SCAN)
    w = Window.partitionBy(query_key, source, "contradicts").orderBy("rank")
    rows = rows.withColumn("kept", ~F.col("contradicts") & (F.row_number().over(w) <= per_source))
    order = Window.partitionBy(query_key).orderBy(F.col("kept").desc(), F.col("rank").asc())
    return rows.withColumn("pool_pos", F.row_number().over(order)).where(F.col("pool_pos") <= pool)


def rerank(pool: DataFrame, query_key: str, score: str | None, k: int) -> DataFrame:
    """Pool by descending score, ties and a missing scorer keep the pool's order."""
    order = [F.col("pool_pos").asc()] if score is None else [F.col(score).desc(), F.col("pool_pos").asc()]
    return top_k(pool.drop("rank"), [query_key], order, k)
