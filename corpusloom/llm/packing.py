"""Problem 9: filling fixed-capacity containers.

Sizes are token counts of the limit's tokenizer. The global histogram of sizes has at most
``capacity`` entries a limit, whatever the number of documents, so it may go to the driver. There
(1) dynamic programming chooses the bucket boundaries that minimise padding, the difference
between each item and its bucket's upper bound; (2) token-budget batches form inside each bucket,
from the longest bucket on: items of the bucket first take the room that batches of longer buckets
left (tightest room first, so that few containers are opened), the others are put into new
batches with items of their own bucket only, largest fit first, a batch pattern being applied as
often as the counts allow. Patterns and rooms are counts of sizes and of containers, not lists of
documents. Documents meet their places by rank: the r-th item of a size goes to the r-th place of
that size. Ranks are built from salted groups whose number follows the number of documents, so a
size that a third of all documents share is spread over tasks of about ROWS_PER_SALT rows.

Defined results: a document larger than the capacity is cut into full parts and one rest, nothing
else is cut; documents without tokens (empty or null) have part 0 of 0 tokens in container 0 of
bucket 0; repeated doc_ids are packed once each (their largest size); a limit with a null or
non-positive capacity, or without tokenizer, gives no rows. ``bucket`` is the item's own bucket.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tokenizer import TOKENIZER_DIR, token_counts

BUCKETS = 12
#: Rows of one size that a task ranks, on average; at least SALTS groups.
ROWS_PER_SALT, SALTS = 250_000, 16


def choose_buckets(size: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct sizes with minimal padding.
    Divide and conquer over the last boundary: O(buckets * n log n)."""
    n = len(size)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(count, dtype=np.float64)])
    t = np.concatenate([[0], np.cumsum(count * size, dtype=np.float64)])
    best = size * c[1:] - t[1:]  # one bucket for the first j sizes
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, arg = best.copy(), np.zeros(n, np.int64)
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)  # the last bucket starts at size i
            cost = best[i - 1] + size[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i])
            k = int(np.argmin(cost))
            m = int(i[k])
            if cost[k] < new[j]:
                new[j], arg[j] = cost[k], m
            todo += [(lo, j - 1, a, m), (j + 1, hi, m, b)]
        best = new
        back.append(arg)
    bounds, j = [], n - 1
    for arg in reversed(back):
        bounds.append(int(size[j]))
        if arg[j] == 0:
            break
        j = int(arg[j]) - 1
    return sorted(set(bounds))


def padding(size: np.ndarray, count: np.ndarray, bounds: list[int]) -> int:
    """Tokens of padding if every item is filled up to its bucket's upper bound."""
    top = np.array(bounds, np.int64)[np.searchsorted(bounds, size)]
    return int(((top - size) * count).sum())


def plan_batches(hist: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[list[tuple[int, int, int, int, int, int]], list[int]]:
    """Places (size, first rank, last rank + 1, first container, items of that size a container,
    bucket) and the bucket bounds. Containers of a pattern are numbered one after another."""
    sizes = np.array(sorted(s for s, n in hist.items() if s > 0 and n > 0), np.int64)
    count = np.array([hist[int(s)] for s in sizes], np.int64)
    bounds = choose_buckets(sizes, count, buckets)
    left, used = count.tolist(), [0] * len(sizes)
    size = sizes.tolist()
    places: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []  # (room, first container, containers), sorted
    box = 0
    shortest = size[0] if size else 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room >= shortest:
            insort(rooms, (room, first, n))

    def put(i: int, first: int, n: int, each: int, bucket: int) -> None:
        places.append((size[i], used[i], used[i] + n, first, each, bucket))
        used[i] += n
        left[i] -= n

    lows = [0, *bounds]
    for bucket in range(len(bounds), 0, -1):
        low = int(np.searchsorted(sizes, lows[bucket - 1], "right"))
        high = int(np.searchsorted(sizes, bounds[bucket - 1], "right")) - 1
        for i in range(high, low - 1, -1):  # room that longer buckets left
            while left[i] and (at := bisect_left(rooms, (size[i], -1, -1))) < len(rooms):
                room, first, n = rooms.pop(at)
                each = min(room // size[i], left[i])
                full = min(n, left[i] // each)
                put(i, first, full * each, each, bucket)
                keep(room - each * size[i], first, full)
                if full < n and 0 < left[i] < each:  # one container takes what is left
                    rest = left[i]
                    put(i, first + full, rest, rest, bucket)
                    keep(room - rest * size[i], first + full, 1)
                    full += 1
                keep(room, first + full, n - full)
        top = high
        while top >= low:
            if left[top] == 0:
                top -= 1
                continue
            room, pattern, i = capacity, [], top
            while i >= low and room > 0:
                i = min(i, int(np.searchsorted(sizes, room, "right")) - 1)
                while i >= low and left[i] == 0:
                    i -= 1
                if i < low:
                    break
                k = min(left[i], room // size[i])
                pattern.append((i, k))
                room -= k * size[i]
                i -= 1
            times = min(left[i] // k for i, k in pattern)
            for i, k in pattern:
                put(i, box, times * k, k, bucket)
            keep(room, box, times)
            box += times
    return places, bounds


def _place(plans: dict[int, dict[int, tuple[np.ndarray, ...]]]):
    def run(batches):
        for b in batches:
            limit, size, rank = (b.column(c).to_numpy() for c in ("limit_id", "tokens", "rank"))
            box, bucket = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
            for l in np.unique(limit):
                mine = limit == l
                for s in np.unique(size[mine]):
                    at = np.flatnonzero(mine & (size == s))
                    start, first, each, bk = plans[int(l)][int(s)]
                    i = np.searchsorted(start, rank[at], "right") - 1
                    box[at] = first[i] + (rank[at] - start[i]) // each[i]
                    bucket[at] = bk[i]
            yield pa.RecordBatch.from_arrays(
                [b.column("limit_id"), b.column("doc_id"), b.column("part"), b.column("tokens"), pa.array(bucket), pa.array(box)],
                ["limit_id", "doc_id", "part", "tokens", "bucket", "container_id"],
            )

    return run


_OUT = "limit_id int, doc_id bigint, part int, tokens bigint, bucket int, container_id bigint"


def item_parts(sizes: DataFrame, limit_id: int, capacity: int) -> DataFrame:
    """(limit_id, doc_id, part, tokens): full parts of documents above the capacity, and what is left."""
    cap = F.lit(int(capacity)).cast("long")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / cap)).cast("int")
    part = F.explode(F.sequence(F.lit(0), n - 1)).alias("part")
    cut = sizes.select("doc_id", "tokens", part)
    return cut.select(F.lit(int(limit_id)).cast("int").alias("limit_id"), "doc_id", F.col("part").cast("int"), F.least(cap, F.col("tokens") - F.col("part") * cap).alias("tokens"))


def pack_documents(documents: DataFrame, limits: DataFrame, directory: str | None = None) -> DataFrame:
    """(limit_id, doc_id, part, tokens, bucket, container_id)."""
    spark = documents.sparkSession
    rules = [r for r in limits.select("limit_id", "capacity_tokens", "tokenizer").distinct().collect() if r.limit_id is not None and (r.capacity_tokens or 0) > 0 and r.tokenizer]
    sizes = {}
    for name in sorted({r.tokenizer for r in rules}):
        if not os.path.exists(os.path.join(directory or TOKENIZER_DIR, f"{name}.tiktoken")):
            raise ValueError(f"no rank file for tokenizer {name!r}")
        counted = token_counts(documents.where("doc_id is not null"), name, directory).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
        sizes[name] = materialize(counted, "sizes")
    if not rules:
        return spark.createDataFrame([], _OUT)
    items = None
    for r in rules:
        one = item_parts(sizes[r.tokenizer], r.limit_id, r.capacity_tokens)
        items = one if items is None else items.unionByName(one)
    salts = max(SALTS, -(-documents.count() // ROWS_PER_SALT))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("limit_id", "tokens", "salt").agg(F.count("*").alias("n"))
    grid = counts.select("limit_id", "tokens", "salt", (F.sum("n").over(Window.partitionBy("limit_id", "tokens").orderBy("salt")) - F.col("n")).alias("before"), "n")
    grid = materialize(grid, "ranks")
    hist: dict[int, dict[int, int]] = {}
    for h in grid.groupBy("limit_id", "tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 rows a limit
        hist.setdefault(h.limit_id, {})[h.tokens] = h.n
    plans: dict[int, dict[int, tuple[np.ndarray, ...]]] = {}
    for r in rules:
        places, _ = plan_batches(hist.get(r.limit_id, {}), r.capacity_tokens)
        by: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, 0, 1 << 62, 0)]}  # no tokens, no room needed
        for s, lo, _, box, k, bucket in places:
            by.setdefault(s, []).append((lo, box, k, bucket))
        plans[r.limit_id] = {s: tuple(np.array(c, np.int64) for c in zip(*v)) for s, v in by.items()}
    within = F.row_number().over(Window.partitionBy("limit_id", "tokens", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("within", within).join(grid.select("limit_id", "tokens", "salt", "before"), ["limit_id", "tokens", "salt"])
    ranked = ranked.select("limit_id", "doc_id", "part", "tokens", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(plans), _OUT)
