"""Exact ranks and top-k, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_table


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group. Spark limits each partition to k rows of a group before the
    shuffle (WindowGroupLimit), so a hot group costs k rows a partition."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def exact_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Position of every row in its group. Rows are range-partitioned by group and order, so a group
    larger than a task spreads over several; positions inside a partition get the number of the
    group's rows in the partitions before. Only counts per (partition, group) are aggregated. Range
    partitioning samples its input, so the input is kept as a table first and made once."""
    df = shared_table(df, "unranked")
    sorted_rows = df.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*[F.col(g) for g in group], *order)
    numbered = shared_table(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), "rank")
    counts = numbered.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n"))
    joined = numbered.join(before.select(*group, "_part", "_before", "_first"), [*group, "_part"])
    return joined.withColumn(rank, (F.col("_before") + F.col("_pos") - F.col("_first") + 1).cast("int")).drop("_part", "_pos", "_before", "_first", "_n")


def first_seen(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    return top_k(df, key, order, 1, "_first_seen").drop("_first_seen")


#: Bytes of query vectors that one scan of the items takes along; and queries of one matrix product.
BLOCK_BYTES, PRODUCT = 64 << 20, 1024


def blocks_of(queries: DataFrame, key: str, vector: str, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query vectors in blocks of a fixed number of bytes (or rows), read one after another in the order
    of the key; no more than a block is held."""
    rows = queries.select(key, vector).orderBy(key).toLocalIterator(prefetchPartitions=True)
    ids, vecs = [], []
    for r in rows:
        ids.append(r[0])
        vecs.append(np.asarray(r[1], np.float64))
        if len(ids) == (block or max(1, BLOCK_BYTES // (8 * max(1, len(vecs[0]))))):
            yield np.array(ids), np.stack(vecs)
            ids, vecs = [], []
    if ids:
        yield np.array(ids), np.stack(vecs)


def vector_scores(items: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, k: int | None, block: int | None = None) -> DataFrame:
    """(query_key, key, score): dot products of a stated query set with all rows. Query blocks of a fixed
    size are broadcast one by one (from disk, the driver holds one at a time) and each costs one scan of
    the items; each Arrow batch gives its k best rows a query (all of them for k None) from matrix
    products of at most PRODUCT queries. No join, and nothing but the query block is sent."""
    parts = None
    for ids, q in blocks_of(queries, key, vector, block):
        sent = items.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0).to_numpy()
                m = np.array(b.column(1).to_pylist(), np.float64).T
                for lo in range(0, len(ids), PRODUCT):
                    s = q[lo : lo + PRODUCT] @ m
                    order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1) if k is not None else np.broadcast_to(np.arange(len(keys)), s.shape)
                    best = order[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[lo : lo + PRODUCT], best.shape[1])), pa.array(keys[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], [query_key, key, "score"]
                    )

        one = items.select(key, vector).mapInArrow(run, f"{query_key} bigint, {key} bigint, score double")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return items.sparkSession.createDataFrame([], f"{query_key} bigint, {key} bigint, score double")
    return parts
