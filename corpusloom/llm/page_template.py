"""Problem 3: page boilerplate mixed with main content, by equivalence-class template deduction.

The tokens of a page are its lines' tokens in their roles: a line's whole skeleton, its opening
(first word or two) and its close, with digits, month names, the host and the institute's name as
slots. Tokens that share their occurrence vector over the pages of one host form an equivalence
class; a class of at least MIN_CLASS tokens on at least MIN_PAGES pages is a template piece of
that host. The vector is kept as an order-free hash of the pages, so a class is a group-by. Pieces
that many hosts share are confirmed over the whole collection: a class is valid when it stands on
pages far more often than in converted documents, which carry the same wording but no template.

Valid classes are nested into the page's template: what stands between or right after pieces of a
list (links, titles) fills its slots and goes with it; lists of items that are pieces themselves
(menus, breadcrumbs) are pieces. Everything else is the page's own data: its main body.

Only hashes of lines are moved; ``main_bodies`` joins the texts to their line numbers by id.
Lines of any length are hashed; one of more than LONG_LINE words (a cookie notice, a paragraph) is a
piece only as a whole, and in its host's class only on LONG_SHARE of the host's pages, as paragraphs
come again on copies of a page, too. Collection-wide classes are broadcast while there are at most
LOOKUP_ROWS of them and joined to the pages' tokens beyond that; classes of single hosts stay
distributed and are joined.

Defined results: null, empty and blank texts have no lines to report; a null ``file`` counts as a
web page; pages without host only use collection-wide classes; ids that occur twice count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import h64, h64b, host_of, materialize, once
from .mojibake import readings

MIN_PAGES = 4
MIN_CLASS = 2
HOST_SHARE = 0.02
#: Expected occurrences in documents from which their absence says something; highest ratio kept.
EXPECTED, RATIO = 4.0, 0.1
LONG_LINE, LONG_SHARE = 25, 0.1

# Month names, which are slots.
_MONTHS = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec"
    " janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz juni juli oktober dezember"
    " monday tuesday wednesday thursday friday saturday sunday".split()
)
_ORG = re.compile(r"\b[^\W\d_]+ (institute|college|university|polytechnic|academy)\b")
_SPACE = re.compile("[ \t\r\u00a0]+")
_DIGITS = re.compile(r"\d+(?:[.,:/-]\d+)*")
_SEPS = re.compile(r"\s*[|·»›>•/\ufffd]\s*|\s{2,}|\t")
_SPLIT_HINT = re.compile(r"[|·»>•/\ufffd]|\S\s{2,}\S")

BLANK, SENTENCE, NUMBERED, DASHED, ROW, LIST, TITLE, LONG = (1 << k for k in range(8))
_NUMBERED = re.compile(r"^\d{1,3}[.)]\s")
_ROW = re.compile(r"\s\d+\s+\d+\D{0,2}$|^\d+\s*(?:\||\s\s)|\|\s*\d")


def skeleton(line: str, host: str | None) -> str:
    s = _SPACE.sub(" ", line.lower()).strip(" ")
    if host:
        s = s.replace("www." + host, "<h>").replace(host, "<h>")
    s = _ORG.sub("<o>", s)
    s = _DIGITS.sub("#", s)
    if any(m in s for m in ("a", "e", "u")):
        s = " ".join("<m>" if w.strip(".,") in _MONTHS else w for w in s.split(" "))
    return s.replace("# <m> #", "<d>").replace("<m> #, #", "<d>").replace("<m>, <d>", "<d>").replace("<m> <d>", "<d>")


def flags(line: str) -> int:
    if line.count(" ") > LONG_LINE and len(line.split()) > LONG_LINE:  # nothing else is asked about it
        s = line.strip(" \t\r\u00a0")
        start = NUMBERED if _NUMBERED.match(s) else DASHED if s.startswith(("- ", "– ")) else 0
        return LONG | start | (SENTENCE if s[-1] in ".!?।…”" else 0)
    s = _SPACE.sub(" ", line).strip(" ")
    if not s:
        return BLANK
    words = s.split(" ")
    f = 0
    if s[-1] in ".!?।…”" and len(words) >= 5:
        f |= SENTENCE
    if _NUMBERED.match(s):
        f |= NUMBERED
    if s.startswith(("- ", "– ")):
        f |= DASHED
    if _ROW.search(line.strip()):
        f |= ROW
    if len(words) <= 14 and s[-1] not in ".!?।:;," and not f & (NUMBERED | DASHED):
        f |= TITLE
    return f


def line_record(line: str, host: str | None) -> tuple[int, int, int, int, int, list[int]]:
    """(flags, full, opening of two, opening of one, close, items) as hashes; 0: none."""
    f = flags(line)
    if f & BLANK:
        return f, 0, 0, 0, 0, []
    if f & LONG and not _SPLIT_HINT.search(line):  # no slots but digits: cheap, as most text is in such lines
        return f, h64b(b" ".join(line.lower().encode().translate(None, b"0123456789").split())), 0, 0, 0, []
    s = skeleton(line, host)
    w = s.split(" ")
    one = h64("1 " + w[0]) if len(w) > 1 and (w[0].endswith(":") or not w[0][0].isalnum()) and w[0] not in ("-", "–") else 0
    two = h64("2 " + " ".join(w[:2])) if len(w) > 2 else 0
    close = h64("9 " + " ".join(w[-2:])) if len(w) > 3 else 0
    items: list[int] = []
    if _SPLIT_HINT.search(line):
        parts = [p for p in _SEPS.split(line.strip(" \t\r »›*")) if p.strip()]
        if len(parts) >= 3:
            f |= LIST
            items = [h64(skeleton(p, host)) for p in parts]
    return f, h64(s.lstrip("*›» ") or s), two, one, close, items


def _usual(c: str) -> bool:
    o = ord(c)
    return o < 0x80 or 0xA0 <= o < 0x250 or 0x900 <= o < 0x980 or 0x2010 <= o < 0x2040 or o in (0x20AC, 0x20B9)


def _read_run(m: re.Match) -> str:
    good = [r for _, r in readings(m.group()) if all(map(_usual, r))]
    return min(good, key=len) if good else m.group()


def legible(text: str) -> str:
    """The text with runs of wrongly decoded characters read, so that garbled pieces fall into the
    classes of the sound ones. Line breaks stay where they are."""
    return text if text.isascii() else _HIGH.sub(_read_run, text)


_HIGH = re.compile("[^\x00-\x7f]{2,}")


_FIELDS = ("f", "full", "two", "one", "close")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat: list[tuple] = []
        stops = [0]
        for host, text in zip(b.column("host").to_pylist(), b.column("text").to_pylist()):
            flat += [line_record(x, host) for x in legible(text).split("\n")]
            stops.append(len(flat))
        cols = list(zip(*flat)) or [()] * 6
        ints = [pa.array(c, pa.int16() if k == 0 else pa.int64()) for k, c in enumerate(cols[:5])]
        line = pa.StructArray.from_arrays([*ints, pa.array(cols[5], pa.list_(pa.int64()))], [*_FIELDS, "items"])
        lines = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), line)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("doc"), lines], ["id", "host", "doc", "lines"])


_REC = "id string, host string, doc boolean, lines array<struct<f:smallint,full:bigint,two:bigint,one:bigint,close:bigint,items:array<bigint>>>"


def page_records(chunks: DataFrame) -> DataFrame:
    src = chunks.where("id is not null and text is not null").select("id", host_of(F.col("source_url")).alias("host"), F.coalesce(F.col("file").startswith("doc_"), F.lit(False)).alias("doc"), "text")
    return materialize(src.mapInArrow(_records, _REC).dropDuplicates(["id"]), "lines")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every token on pages and in documents, summed by partition."""
    import numpy as np

    for b in batches:
        lines = b.column("lines")
        count = np.diff(lines.offsets.to_numpy())
        doc = np.repeat(b.column("doc").to_numpy(zero_copy_only=False), count)
        rec = lines.flatten()
        keys, web = [], []
        for name in ("full", "two", "one", "close"):
            k = rec.field(name).to_numpy()
            on = k != 0
            keys.append(k[on])
            web.append(~doc[on])
        k, w = np.concatenate(keys), np.concatenate(web)
        u, inv = np.unique(k, return_inverse=True)
        n = np.bincount(inv, weights=w, minlength=len(u)).astype(np.int64)
        m = np.bincount(inv, minlength=len(u)).astype(np.int64) - n
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), pa.array(m)], ["key", "web", "docs"])


def shared_classes(records: DataFrame) -> DataFrame:
    """(key): tokens that belong to templates over the whole collection."""
    size = records.agg(F.sum((~F.col("doc")).cast("long")).alias("w"), F.sum(F.col("doc").cast("long")).alias("d")).first()
    ratio = (size.d or 0) / max(1, size.w or 0)
    least = max(8.0, EXPECTED / max(ratio, 0.02))
    keys = records.select("doc", "lines").mapInArrow(_tally, "key bigint, web bigint, docs bigint").groupBy("key").agg(F.sum("web").alias("web"), F.sum("docs").alias("docs"))
    return materialize(keys.where((F.col("web") >= least) & (F.col("docs") <= RATIO * ratio * F.col("web"))).select("key"), "shared")


def with_shared(pages: DataFrame, keys: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """pages with a column ``known`` (the shared tokens of a page), and all of them as a set; one of
    both is filled, see common.with_lookup."""
    if keys.count() <= common.LOOKUP_ROWS:
        return pages.withColumn("known", F.lit(None).cast("array<bigint>")), frozenset(r.key for r in keys.collect())
    line = pages.select("id", F.explode("lines").alias("l"))
    token = line.select("id", F.explode(F.concat(F.array("l.full", "l.two", "l.one", "l.close"), F.coalesce("l.items", F.array().cast("array<bigint>")))).alias("key"))
    known = token.distinct().join(keys, "key").groupBy("id").agg(F.collect_list("key").alias("known"))
    return pages.join(known, "id", "left"), frozenset()


def host_classes(records: DataFrame) -> DataFrame:
    """(host, full): line tokens in valid equivalence classes of their host. A class is the set of
    tokens with one occurrence vector; the vector is the sum of its pages' hashes. A class needs
    MIN_PAGES pages and HOST_SHARE of its host's: a heading comes again on a few pages, a template
    piece on a fixed part of all. Single tokens need twice that share."""
    line = records.where("host is not null").select("id", "host", F.explode("lines").alias("l")).where("l.full <> 0")
    whole = F.when(F.col("l.f").bitwiseAND(LONG) == LONG, 3).otherwise(0)
    token = line.select("id", "host", F.explode(F.array(F.struct(whole.alias("role"), F.col("l.full").alias("key")), F.struct(F.lit(1).alias("role"), F.col("l.two").alias("key")), F.struct(F.lit(2).alias("role"), F.col("l.close").alias("key")))).alias("t"))
    page = F.xxhash64("id").cast("decimal(38,0)")
    seen = token.where("t.key <> 0").groupBy("host", "t.role", "t.key").agg(F.sum(page).alias("vector"), F.count("*").alias("pages"))
    size = records.where("host is not null").groupBy("host").agg(F.count("*").alias("all"))
    kept = seen.where(F.col("pages") >= MIN_PAGES).join(size, "host").where(F.col("pages") >= HOST_SHARE * F.col("all"))
    classes = kept.groupBy("host", "vector", "pages").agg(F.count("*").alias("tokens"))
    kept = kept.where((F.col("role") < 3) | (F.col("pages") >= LONG_SHARE * F.col("all")))
    valid = kept.where("role in (0, 3)").join(classes, ["host", "vector", "pages"]).where((F.col("tokens") >= MIN_CLASS) | (F.col("pages") >= 2 * HOST_SHARE * F.col("all")))
    return valid.select("host", F.col("key").alias("full")).distinct()


def template_lines(f: list[int], full: list[int], two: list[int], one: list[int], close: list[int], items: list[list[int]], shared: frozenset[int], own: set[int]) -> list[int]:
    """Line numbers that belong to the template of a page, given as columns of its lines."""
    n = len(f)
    hit = [False] * n
    body = NUMBERED | DASHED | ROW
    for k in range(n):
        g = f[k]
        if g & BLANK:
            continue
        if full[k] in shared or k in own and not g & body:
            hit[k] = True
        elif items[k] and not g & SENTENCE:
            known = sum(i in shared for i in items[k])
            hit[k] = known >= 2 and known >= 0.5 * len(items[k]) or one[k] in shared or two[k] in shared and not g & body
        elif not g & body and (one[k] in shared or two[k] in shared or close[k] in shared and not g & SENTENCE):
            hit[k] = True
    # slots: titles between or right after pieces of a list
    k = 0
    while k < n:
        if not hit[k]:
            k += 1
            continue
        j = k + 1
        while j < n and (f[j] & BLANK or not hit[j] and f[j] & TITLE and not f[j] & (body | SENTENCE)):
            j += 1
        gap = [i for i in range(k + 1, j) if not f[i] & BLANK]
        if gap and (j < n and hit[j] or j == n) and f[k] & TITLE:
            for i in gap:
                hit[i] = True
        k = j
    return [k for k in range(n) if hit[k]]


def _decide(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos = [], []
            keys = shared.value
            lines = b.column("lines")
            at = lines.offsets.to_pylist()
            line = lines.values
            cols = [line.field(c).to_pylist() for c in (*_FIELDS, "items")]
            for r, (i, own, known) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "own", "known")))):
                lo, hi = at[r], at[r + 1]
                for k in template_lines(*(c[lo:hi] for c in cols), frozenset(known) if known else keys, set(own or ())):
                    ids.append(i)
                    nos.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32())], ["id", "line_no"])

    return run


def boilerplate_lines(chunks: DataFrame) -> DataFrame:
    """(id, line_no) of the lines of web pages that aren't main content."""
    records = page_records(chunks)
    pages = records.where("not doc")
    line = pages.where("host is not null").select("id", "host", F.posexplode("lines").alias("no", "l")).where("l.full <> 0").select("id", "host", "no", F.col("l.full").alias("full"))
    own = line.join(host_classes(records), ["host", "full"], "left_semi").groupBy("id").agg(F.collect_list("no").alias("own"))
    rows, keys = with_shared(pages.select("id", "lines"), shared_classes(records))
    shared = chunks.sparkSession.sparkContext.broadcast(keys)
    return rows.join(own, "id", "left").select("id", "lines", "own", "known").mapInArrow(_decide(shared), "id string, line_no int")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        out = []
        for text, gone in zip(d["text"], d["gone"]):
            drop = set(gone or ())
            out.append(text if text is None or not drop else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "body"])


def main_bodies(chunks: DataFrame) -> DataFrame:
    """(id, body): every web-page chunk once, its text without the template."""
    gone = boilerplate_lines(chunks).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    web = chunks.where(F.col("id").isNotNull() & ~F.coalesce(F.col("file").startswith("doc_"), F.lit(False)))
    return once(web.select("id", "text"), "text").join(gone, "id", "left").select("id", "text", "gone").mapInArrow(_bodies, "id string, body string")
