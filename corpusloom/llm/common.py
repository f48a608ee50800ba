"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_table as materialize  # noqa: F401

#: White space in the sense of the line and shingle definitions: space, tab, CR, LF, no-break space.
NARROW_SPACE = " \t\r\n\u00a0"


#: A table of at most so many rows is broadcast to look things up; a larger one is joined.
LOOKUP_ROWS = 300_000
#: Bits of the filter that spares keys no table holds their shuffle (4 MB).
FILTER_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without a leading ``www.``; null where there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_extract(F.lower(F.trim(url)), r"^((?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*)(?:[/?#:]|$)", 1)
    h = F.when(h == "", bare).otherwise(h)
    h = F.regexp_replace(h, r"^www\.", "")
    return F.when(h == "", None).otherwise(h)


def h64b(b: bytes | str) -> int:
    x = xxhash.xxh3_64_intdigest(b)
    return x - (1 << 64) if x >> 63 else x


def h64(s: str | None) -> int:
    """Signed 64-bit hash of a string, the same in every process."""
    return h64b(s or "")


RUNS = re.compile("[ \t\r\n\u00a0]+")
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85  -     　]")


def narrow_words(s: str) -> list[str]:
    """Words between runs of NARROW_SPACE (other Unicode spaces stay inside words)."""
    if ODD_SPACE.search(s):
        return [w for w in RUNS.split(s) if w]
    return s.split()


def once(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """rows (key, value, ...) with every key once, the smallest value of repeated keys (nulls last);
    null keys count as one.
    Keys that come once, nearly all, stay where they are: only keys and counts are shuffled to find
    the repeated ones, and of rows only those with a repeated key."""
    often = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    few = often.count()
    side = F.broadcast(often) if few <= LOOKUP_ROWS else often
    none = rows.where(F.col(key).isNull())
    again = rows.join(side, key, "left_semi").unionByName(none) if few else none
    single = rows.where(F.col(key).isNotNull())
    single = single.join(side, key, "left_anti") if few else single
    others = [c for c in rows.columns if c not in (key, value)]
    again = again.groupBy(key).agg(F.min(F.struct(F.col(value).isNull().alias("_null"), *(F.col(c) for c in (value, *others)))).alias("_row"))
    return single.unionByName(again.select(key, *(F.col(f"_row.{c}").alias(c) for c in (value, *others))))


def key_filter(table: DataFrame) -> bytes:
    """FILTER_BITS bits; that of a key's hash is set for every key of the table."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = np.array([h64(k) % FILTER_BITS for k in b.column(0).to_pylist()], np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in table.select("key").coalesce(4).mapInArrow(marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
    return bits.tobytes()


def with_lookup(rows: DataFrame, text: str, table: DataFrame, keys: Callable[[str], Iterable[str]]) -> tuple[DataFrame, dict[str, str]]:
    """rows with a column ``held`` (map of the table's keys that a text asks for), and the table as a
    dictionary. Exactly one of both is filled: the dictionary while the table (key, value) has at most
    LOOKUP_ROWS rows, else the column, from a join by key over the distinct keys of every text. ``keys``
    must give all that is looked up for a text, else results hang on the table's size."""
    table = materialize(table.select("key", "value"), "lookup")
    if table.count() <= LOOKUP_ROWS:
        return rows.withColumn("held", F.lit(None).cast("map<string,string>")), {r.key: r.value for r in table.collect()}
    bits = rows.sparkSession.sparkContext.broadcast(key_filter(table))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = bits.value

        def may_hold(k: str) -> bool:
            at = h64(k) % FILTER_BITS
            return bool(some[at >> 3] >> (at & 7) & 1)

        for b in batches:
            pairs = [(h, k) for t in b.column(0).to_pylist() if t for h in (h64(t),) for k in set(keys(t)) if may_hold(k)]
            cols = list(zip(*pairs)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["h", "key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h64(t) for t in b.column(text).to_pylist()], pa.int64())], [*b.schema.names, "h"])

    found = rows.select(text).mapInArrow(asked, "h bigint, key string").distinct().join(table, "key")  # no text is shuffled for it
    held = found.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("held"))
    marked = rows.mapInArrow(hashed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", h bigint")
    return marked.join(held, "h", "left").drop("h"), {}


def held(batch: pa.RecordBatch) -> list[dict[str, str]]:
    return [dict(x or ()) for x in batch.column("held").to_pylist()]
