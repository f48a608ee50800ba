"""Sliding-window rate limits: a stateful stream, and its batch counterpart for replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY, MINUTE = 86_400_000_000, 60_000_000


def decide(hits: list[int], now: int, per_minute: int, per_day: int) -> tuple[bool, list[int]]:
    """Whether an attempt at ``now`` (microseconds) passes, and the accepted hits to remember. Hits
    older than a day are forgotten; refused attempts aren't recorded."""
    hits = [t for t in hits if now - t <= DAY]
    if len(hits) >= per_day or sum(now - t < MINUTE for t in hits) >= per_minute:
        return False, hits
    return True, [*hits, now]


def limited_stream(attempts: DataFrame, key: str, ts: str, per_minute: int = 10, per_day: int = 150) -> DataFrame:
    """(key, us, accepted) of a stream of attempts; the state of a key is its accepted hits of a day,
    at most per_day numbers."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = []
        for us in sorted(u for b in batches for u in b["us"]):
            ok, hits = decide(hits, int(us), per_minute, per_day)
            rows.append((k[0], int(us), ok))
        state.update((hits,))
        yield pd.DataFrame(rows, columns=["key", "us", "accepted"])

    src = attempts.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return src.groupBy("key").applyInPandasWithState(run, "key string, us bigint, accepted boolean", "hits array<bigint>", "append", "NoTimeout")


def limited_batch(attempts: DataFrame, key: str, ts: str, tie: str, per_minute: int = 10, per_day: int = 150) -> DataFrame:
    """(tie, key, accepted) of a finished log. The fold's state is bounded by per_day; rows of a key
    arrive sorted and are read once, as an Arrow stream over partitions sorted by key and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, []
        for b in batches:
            out = []
            for k, us in zip(b["key"], b["us"]):
                if k != last:
                    last, hits = k, []
                ok, hits = decide(hits, int(us), per_minute, per_day)
                out.append(ok)
            yield pd.DataFrame({tie: b[tie], "key": b["key"], "accepted": out})

    src = attempts.select(tie, F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return src.repartition("key").sortWithinPartitions("key", "us", tie).mapInPandas(run, f"{tie} bigint, key string, accepted boolean")
