"""Problem 5: lines repeated across one site's documents.

Each line class (host, normalised line) keeps the documents it occurs in as compressed bitmaps:
documents get dense numbers inside hash partitions of their ids, and every partition yields one
container per class, a sorted array of 16-bit-delta positions or a plain bitmap, whichever is
smaller. Variant lines (case, runs of spaces, trimming) fall into one class because their
containers are united while the partition is scanned. Containers of different partitions hold
disjoint documents, so the exact cardinality of a class is the sum of its containers'; a class
that stands in a third of all documents is only as many rows as there are partitions.

Defined results: ids that occur twice count once (their first text in the order of ``fetched``);
null, empty and blank texts have no lines; chunks without a host are left out; extra columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import h64, host_of, materialize, once

_SPACE = re.compile("[ \t\r\u00a0]+")


def norm_line(line: str) -> str:
    return _SPACE.sub(" ", line.lower()).strip(" ")


def pack(positions: np.ndarray) -> bytes:
    """Sorted distinct positions as a compressed bitmap: 'b' + bit set, or 'd'/'D' + 16/32-bit gaps."""
    gaps = np.diff(positions, prepend=positions[:1] * 0)
    wide = len(gaps) > 0 and int(gaps.max()) > 0xFFFF
    body = gaps.astype("<u4" if wide else "<u2").tobytes()
    span = int(positions[-1]) // 8 + 1 if len(positions) else 0
    if span < len(body):
        bits = np.zeros(span * 8, np.uint8)
        bits[positions] = 1
        return b"b" + np.packbits(bits, bitorder="little").tobytes()
    return (b"D" if wide else b"d") + body


def unpack(blob: bytes) -> np.ndarray:
    kind, body = blob[:1], blob[1:]
    if kind == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    return np.cumsum(np.frombuffer(body, "<u4" if kind == b"D" else "<u2").astype(np.int64))


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        keys = []
        for host, text in zip(d["host"], d["text"]):
            row = []
            for line in text.split("\n"):
                n = norm_line(line)
                row.append(h64(f"{host}\n{n}") if n else 0)
            keys.append(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d["id"], pa.string()), pa.array(d["fetched"], pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fetched", "keys"]
        )


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by id, so repeated ids are neighbours and the numbering is the same in a
    task that runs again."""
    sets: dict[int, list[int]] = {}
    part, n, last = None, -1, None

    def flush() -> pa.RecordBatch:
        k = list(sets)
        pos = [np.asarray(sets[x], np.int64) for x in k]
        out = pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array([part] * len(k), pa.int32()), pa.array([len(p) for p in pos], pa.int64()), pa.array([pack(p) for p in pos], pa.binary())],
            ["key", "part", "card", "bitmap"],
        )
        sets.clear()
        return out

    for b in batches:
        d = b.to_pydict()
        for i, p, keys in zip(d["id"], d["part"], d["keys"]):
            if p != part:
                if sets:
                    yield flush()
                part, n, last = p, -1, None
            if i == last:
                continue
            last = i
            n += 1
            for k in set(keys):
                if k:
                    sets.setdefault(k, []).append(n)
    if sets:
        yield flush()


def line_table(chunks: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """(id, fetched, keys, part): keys[i] is the class of line i (0: blank). Parts are hash ranges of
    the ids; their number follows the row count, which Parquet footers give without a scan."""
    src = chunks.select("id", F.col("fetched").cast("string").alias("fetched"), "text", host_of(F.col("source_url")).alias("host"))
    src = src.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("host").isNotNull())
    parts = max(16, -(-chunks.count() // rows_per_part))
    keyed = materialize(src.mapInArrow(_line_keys, "id string, fetched string, keys array<bigint>"), "linekeys")
    return keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(key, part, card, bitmap): the documents of each line class, one container per part."""
    spread = lines.repartition("part").sortWithinPartitions("part", "id", "fetched")
    boxes = spread.select("id", "part", "keys").mapInArrow(_containers, "key bigint, part int, card bigint, bitmap binary")
    return materialize(boxes, "linebits")


def frequent_classes(bitmaps: DataFrame, min_docs: int) -> DataFrame:
    """(key, docs): classes that stand in at least min_docs different chunks of their host."""
    return bitmaps.groupBy("key").agg(F.sum("card").alias("docs")).where(F.col("docs") >= min_docs)


def _lookup(docs: pa.Table, boxes: pa.Table) -> pa.Table:
    marked = {k: set(unpack(b).tolist()) for k, b in zip(boxes["key"].to_pylist(), boxes["bitmap"].to_pylist())}
    out_id, out_no, n, last = [], [], -1, None
    order = sorted(zip(docs["id"].to_pylist(), [x or "" for x in docs["fetched"].to_pylist()], docs["keys"].to_pylist()), key=lambda r: r[:2])
    for i, _, keys in order:
        if i == last:
            continue
        last = i
        n += 1
        for no, k in enumerate(keys):
            if k in marked and n in marked[k]:
                out_id.append(i)
                out_no.append(no)
    return pa.table({"id": pa.array(out_id, pa.string()), "line_no": pa.array(out_no, pa.int32())})


def repeated_lines(chunks: DataFrame, min_docs: int = 8) -> DataFrame:
    """(id, line_no) of every line whose class occurs in at least min_docs chunk ids of its host."""
    lines = line_table(chunks)
    bitmaps = line_bitmaps(lines)
    often = bitmaps.join(frequent_classes(bitmaps, min_docs).select("key"), "key", "left_semi")
    return lines.groupBy("part").cogroup(often.select("part", "key", "bitmap").groupBy("part")).applyInArrow(_lookup, "id string, line_no int")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        clean = []
        for text, gone in zip(d["text"], d["gone"]):
            if text is None or not gone:
                clean.append(text)
                continue
            drop = set(gone)
            clean.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
        yield pa.RecordBatch.from_arrays([pa.array(d["id"], pa.string()), pa.array(clean, pa.string()), pa.array([len(g or ()) for g in d["gone"]], pa.int32())], ["id", "clean_text", "removed"])


def strip_repeated(chunks: DataFrame, min_docs: int = 8) -> DataFrame:
    """(id, clean_text, removed): each chunk id once, its text without the repeated lines. Texts
    without such a line, and null texts, come back as they are."""
    gone = repeated_lines(chunks, min_docs).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    first = once(chunks.select("id", F.coalesce(F.col("fetched"), F.lit("")).alias("fetched"), "text"), "fetched")
    return first.join(gone, "id", "left").select("id", "text", "gone").mapInArrow(_strip, "id string, clean_text string, removed int")
