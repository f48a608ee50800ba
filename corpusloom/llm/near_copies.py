"""Problem 2: near-duplicate records with small edits, by anchor points of a covering code.

Every record gets a fingerprint of ``TABLES`` words; a word has N symbols, each a min-hash of the
record's three-word shingles. Per word the anchors are the code words of the maximum-distance-
separable code [N, K]: the values of the polynomials of degree below K at N points, modulo a prime
above all symbols. Any K symbols fix one code word, so the code's covering radius is N - K. A word
is replicated to every code word within that radius: for each choice of K of its symbols the code
word through them (the other symbols computed). Words that differ in at most N - K symbols (the
threshold) share the code word through the symbols they agree on, and that one lies within the
radius of both: a code word farther off, up to radius plus threshold, adds no pair within the
threshold and isn't replicated to. Records are compared per anchor. With N = 5, K = 4 and twelve
words two records of similarity 0.6 share an anchor with probability 0.993, of 0.65 with 0.999, of
0.7 with 0.9999. A larger K makes chance anchors rarer, a larger N or more words the recall higher.

Stages: (1) one pass over the texts gives 16-bit symbols, kept as a table; (2) anchors are spread
over the cluster with a short code of the fingerprint, and runs of equal anchors give candidate
pairs whose codes agree; (3) candidates are compared by their whole fingerprints; (4) what is left
is checked exactly on the shingle sets.
Exact copies fall into one content class (64 bits) first and never meet at an anchor more than once
per input partition. An anchor with more than RUN different contents is passed on while it is read,
so a task holds RUN rows of it at most; its contents are cut into blocks of about RUN rows, and
every two blocks meet in a group of their own, where the codes are compared before a pair is made.

Defined results: null texts and texts of fewer than 20 words are left out; a null title counts as
empty; ids that occur twice count once; null ids are left out. ``near_copies`` writes content
classes of up to EXPANDED copies out as pairs, larger ones as pairs with their smallest id (each
member, and each link to another class), which says the same in linear space; ``copy_groups`` says
for every id which class of exact copies and which group of near copies it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow_words

N, K = 5, 4
TABLES = 12
RUN = 2048
EXPANDED = 32
#: A key table of at most so many rows may be broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 300_000
MIN_WORDS = 20

_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_words = _Words()


def words_of(title: str | None, text: str) -> list[str]:
    return narrow_words(f"{title or ''}. {text}".lower())


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(TABLES * N)
    for b in batches:
        d = b.to_pydict()
        ids, lists, size = [], [], []
        for i, title, text in zip(d["id"], d["title"], d["text"]):
            if len(narrow_words(text)) < MIN_WORDS:
                continue
            w = words_of(title, text)
            ids.append(i)
            lists.append(w)
            size.append(len(w))
        if not ids:
            continue
        flat = np.fromiter(map(_words.__getitem__, (w for l in lists for w in l)), np.uint64, sum(size))
        size = np.array(size, np.int64)
        stop = np.cumsum(size)
        begin = stop - size
        # content: the word sequence; position-dependent, so the order counts
        place = np.arange(len(flat), dtype=np.int64) - np.repeat(begin, size)
        content = _mix(np.add.reduceat(_mix(flat + _mix(place.astype(np.uint64))), begin) ^ size.astype(np.uint64))
        shingle = _mix(flat[:-2] * _U(3) + _mix(flat[1:-1] * _U(5) + _mix(flat[2:] * _U(7))))
        inside = np.ones(len(shingle), bool)
        for k in (2, 1):  # shingles that reach into the next text
            x = stop - k
            inside[x[x < len(shingle)]] = False
        shingle = shingle[inside]
        first = np.concatenate([[0], np.cumsum(size - 2)[:-1]])
        sym = np.empty((len(ids), len(seeds)), np.uint16)
        for j, s in enumerate(seeds):
            x = shingle * s
            x ^= x >> _U(32)
            low = np.minimum.reduceat(x, first)
            sym[:, j] = (_mix(low) & _U(0xFFFF)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(content.view(np.int64)), pa.array([r.tobytes() for r in sym], pa.binary())], ["id", "content", "sym"]
        )


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(id, content, sym) of the records that take part."""
    src = chunks.select("id", "title", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return src.mapInArrow(_symbols, "id string, content bigint, sym binary")


PRIME = 65_537


@lru_cache(4)
def code_words(n: int, k: int) -> list[tuple[list[int], list[int], np.ndarray]]:
    """(given positions, computed positions, coefficients[computed, given]) of each choice of k of
    the n symbols: interpolation at the points 1..n modulo PRIME."""
    out = []
    for given in combinations(range(n), k):
        rest = [m for m in range(n) if m not in given]
        c = np.zeros((len(rest), k), np.uint64)
        for i, m in enumerate(rest):
            for j, g in enumerate(given):
                x = 1
                for h in given:
                    if h != g:
                        x = x * (m - h) * pow(g - h, -1, PRIME) % PRIME
                c[i, j] = x % PRIME
        out.append((list(given), rest, c))
    return out


def anchors_of(word: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The code words within the covering radius of words[..., n], one array for every choice of k."""
    for given, rest, c in code_words(word.shape[-1], k):
        w = word.copy()
        w[..., rest] = (word[..., given] @ c.T) % _U(PRIME)
        yield w


#: Two-bit codes a row carries for the comparison at the anchor, and how many must agree there. Of
#: codes outside the anchor 70 % agree at similarity 0.6 (13 of 30 or more with probability 0.999),
#: about a quarter by chance.
CODES, AGREE = 30, 13
_ODD = _U(0x5555555555555555 & ((1 << 60) - 1))


def _agree(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    z = p ^ q
    return CODES - np.bitwise_count((z | z >> _U(1)) & _ODD).astype(np.int64) >= AGREE


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, key, code): hash of a code word and its table, content, short code."""
    salt = _seeds(TABLES)
    weights = _seeds(TABLES + N)[TABLES:]
    seen: set[int] = set()
    for b in batches:
        content = b.column("content").to_numpy()
        fresh = []
        for i, c in enumerate(content.tolist()):
            if c not in seen:
                seen.add(c)
                fresh.append(i)
        if len(seen) > 500_000:
            seen.clear()
        if not fresh:
            continue
        sym = np.frombuffer(b"".join(b.column("sym").take(pa.array(fresh)).to_pylist()), np.uint16).reshape(len(fresh), TABLES, N).astype(np.uint64)
        anchor = np.stack([_mix((w * weights).sum(-1) ^ salt) for w in anchors_of(sym, K)], 2)
        each = anchor.shape[1] * anchor.shape[2]
        code = np.zeros(len(fresh), np.uint64)
        flat = sym.reshape(len(fresh), -1)
        step = flat.shape[1] // CODES
        for j in range(CODES):  # two bits of symbols spread over the words
            code |= (flat[:, step * j] & _U(3)) << _U(2 * j)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.ravel().view(np.int64)), pa.array(np.repeat(content[fresh], each)), pa.array(np.repeat(code, each).view(np.int64))], ["anchor", "key", "code"]
        )


_MET = pa.schema([("anchor", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("code", pa.int64())])


def _met(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(lo), pa.array(hi), pa.nulls(len(a), pa.int64())], schema=_MET)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of every run of equal anchors; rows arrive sorted by anchor and key. A run that
    is too long is passed on as it comes, as (anchor, key, null, code) rows."""
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    long: int | None = None  # anchor whose rows are being passed on

    def emit(an: np.ndarray, k: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(an):
            return
        new = np.ones(len(an), bool)
        new[1:] = (an[1:] != an[:-1]) | (k[1:] != k[:-1])
        an, k, code = an[new], k[new], code[new]
        start = np.flatnonzero(np.concatenate([[True], an[1:] != an[:-1]]))
        size = np.diff(np.append(start, len(an)))
        some = size > 1
        left, right = [], []
        for s in np.unique(size[some]):
            at = start[some & (size == s)]
            i, j = np.triu_indices(int(s), 1)
            for lo in range(0, len(at), max(1, 500_000 // len(i))):
                part = at[lo : lo + max(1, 500_000 // len(i))]
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                near = _agree(code[a], code[b])
                left.append(k[a[near]])
                right.append(k[b[near]])
        if left:
            yield _met(np.concatenate(left), np.concatenate(right))

    def passed(an: np.ndarray, k: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(an), pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(code.view(np.int64))], schema=_MET)

    for b in batches:
        cols = (b.column("anchor").to_numpy(), b.column("key").to_numpy(), b.column("code").to_numpy().view(np.uint64))
        for lo in range(0, b.num_rows, RUN):  # so that no more than two runs' worth is held
            an, k, code = (np.concatenate([h, c[lo : lo + RUN]]) for h, c in zip(held, cols))
            if long is not None:
                n = int(np.searchsorted(an, long, "right"))
                if n:
                    yield passed(an[:n], k[:n], code[:n])
                an, k, code = an[n:], k[n:], code[n:]
                if not len(an):
                    held = (an, k, code)
                    continue
                long = None
            last = int(np.searchsorted(an, an[-1]))
            yield from emit(an[:last], k[:last], code[:last])
            held = (an[last:], k[last:], code[last:])
            if len(held[0]) > RUN:
                long = int(held[0][0])
                yield passed(*held)
                held = (an[:0], k[:0], code[:0])
    yield from emit(*held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of every two blocks of a long anchor; rows arrive sorted by anchor, the two
    blocks' numbers and the block a row is of."""
    held: list[tuple] = []
    unit: tuple = (None, 0, 0)

    def pairs() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        side = np.array([h[2] for h in held])
        key, code = np.array([h[3] for h in held], np.int64), np.array([h[4] for h in held], np.int64).view(np.uint64)
        first = np.flatnonzero(side == unit[1])
        second = np.flatnonzero(side == unit[2])
        for lo in range(0, len(first), 256):
            p = first[lo : lo + 256]
            near = _agree(code[p][:, None], code[second][None, :])
            if unit[1] == unit[2]:
                near &= key[p][:, None] < key[second][None, :]
            i, j = np.nonzero(near)
            if len(i):
                yield _met(key[p[i]], key[second[j]])

    for b in batches:
        d = b.to_pydict()
        for an, i, j, mine, k, c in zip(*(d[x] for x in ("anchor", "i", "j", "mine", "a", "code"))):
            if unit != (an, i, j):
                yield from pairs()
                held, unit = [], (an, i, j)
            held.append((an, i, mine, k, c))
    yield from pairs()


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: different contents that share an anchor and whose short codes agree."""
    spread = prints.select("content", "sym").mapInArrow(_anchors, "anchor bigint, key bigint, code bigint")
    rows = spread.repartition("anchor").sortWithinPartitions("anchor", "key")
    schema = "anchor bigint, a bigint, b bigint, code bigint"
    met = materialize(rows.mapInArrow(_runs, schema), "anchors")
    long = met.where(F.col("b").isNull()).groupBy("anchor", "a").agg(F.min("code").alias("code"))
    count = long.groupBy("anchor").agg(F.ceil(F.count("*") / RUN).cast("int").alias("g"))
    part = long.join(count, "anchor").select("anchor", "a", "code", "g", F.pmod(F.xxhash64("a"), F.col("g")).cast("int").alias("mine"))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    units = other.select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "a", "code")
    far = units.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_blocks, schema)
    return met.where(F.col("b").isNotNull()).unionByName(far).select("a", "b").distinct()


#: Share of equal symbols below which a candidate can't reach 0.6: four standard deviations off.
LEAST_SHARE = 0.35


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TABLES * N
    for b in batches:
        if not b.num_rows:
            continue
        p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("p", "q"))
        keep = np.flatnonzero((p == q).sum(1) >= LEAST_SHARE * n)
        yield b.select(["a", "b"]).take(pa.array(keep))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sym = np.frombuffer(b"".join(b.column("sym").to_pylist()), np.uint8).reshape(b.num_rows, -1)[:, ::2]
        yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([r.tobytes() for r in sym], pa.binary())], ["key", "sig"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(t: str) -> set:
            w = narrow_words(t.lower())
            return set(zip(w, w[1:], w[2:]))

        for b in batches:
            d = b.to_pydict()
            keep = ([], [], [])
            memo: dict[int, set] = {}
            for ca, cb, ta, tb in zip(d["ca"], d["cb"], d["ta"], d["tb"]):
                x = memo.get(ca)
                if x is None:
                    x = memo[ca] = shingles(ta)
                y = memo.get(cb)
                if y is None:
                    y = memo[cb] = shingles(tb)
                both = len(x & y)
                sim = both / (len(x) + len(y) - both)
                if sim >= least:
                    for l, v in zip(keep, (ca, cb, sim)):
                        l.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keep[0], pa.int64()), pa.array(keep[1], pa.int64()), pa.array(keep[2], pa.float64())], ["ca", "cb", "similarity"])

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def content_links(chunks: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """(ca, cb, similarity) between contents whose shingle sets are at least so similar."""
    sigs = prints.select("content", "sym").mapInArrow(_short, "key bigint, sig binary").dropDuplicates(["key"])
    pairs = candidates(prints)
    pairs = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("p")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("q")), "b")
    pairs = materialize(pairs.select("a", "b", "p", "q").mapInArrow(_alike, "a bigint, b bigint"), "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    bound = 2 * pairs.count()
    chosen = prints.select("id", "content").join(_small(keys, bound), "content", "left_semi").groupBy("content").agg(F.min("id").alias("id"))
    chosen = materialize(chosen, "chosen")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("text")).alias("t")
    texts = chunks.where(F.col("text").isNotNull()).select("id", text).join(_small(chosen, chosen.count()), "id").dropDuplicates(["content"])
    left = texts.select(F.col("content").alias("ca"), F.col("t").alias("ta"))
    right = texts.select(F.col("content").alias("cb"), F.col("t").alias("tb"))
    both = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(left, "ca").join(right, "cb").select("ca", "cb", "ta", "tb")
    return both.mapInArrow(_verify(least), "ca bigint, cb bigint, similarity double")


def linked(chunks: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(members (id, content), links (ca, cb, similarity)), both kept as tables."""
    prints = materialize(fingerprints(chunks), "prints")
    links = materialize(content_links(chunks, prints, least), "links")
    return prints.select("content", "id").distinct(), links


def near_copies(chunks: DataFrame, least: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of near copies; see the module's note on large classes of copies."""
    member, links = linked(chunks, least)
    size = member.groupBy("content").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    in_links = links.select(F.explode(F.array("ca", "cb")).alias("content")).distinct()
    wanted = size.join(in_links, "content", "left").select("content", "n", "rep")
    few = size.where((F.col("n") > 1) & (F.col("n") <= EXPANDED)).select("content")
    many = size.where(F.col("n") > EXPANDED).select("content", "rep")
    # copies of one content
    few_ids = member.join(few, "content", "left_semi")
    copies = few_ids.select("content", F.col("id").alias("id_a")).join(few_ids.select("content", F.col("id").alias("id_b")), "content").where("id_a < id_b").select("id_a", "id_b")
    star = member.join(many, "content").where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    # links between contents: by members of small classes, by the smallest id of large ones
    ends = wanted.join(in_links, "content", "left_semi")
    speak = member.join(ends.where(F.col("n") <= EXPANDED).select("content"), "content", "left_semi").unionByName(ends.where(F.col("n") > EXPANDED).select("content", F.col("rep").alias("id")))
    across = links.select("ca", "cb").join(speak.select(F.col("content").alias("ca"), F.col("id").alias("x")), "ca").join(speak.select(F.col("content").alias("cb"), F.col("id").alias("y")), "cb")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return copies.unionByName(star).unionByName(across).where("id_a < id_b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(content, root): the smallest content that is linked with each, over any number of steps.
    Every round takes the smallest root of the neighbours and then the root's own root, so rounds
    grow with the logarithm of the longest chain; labels are written each round and never collected."""
    edges = links.select("ca", "cb").unionByName(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    label = materialize(edges.select(F.col("ca").alias("content")).distinct().withColumn("root", F.col("content")), "label")
    while True:
        near = edges.join(label.select(F.col("content").alias("cb"), "root"), "cb").groupBy(F.col("ca").alias("content")).agg(F.min("root").alias("seen"))
        low = label.join(near, "content").select("content", "root", F.least("root", "seen").alias("low"))
        # the root of a content hears of the lowest label met by those under it
        under = low.groupBy(F.col("root").alias("content")).agg(F.min("low").alias("under"))
        met = low.join(under, "content", "left").select("content", "root", F.least("low", F.coalesce("under", "low")).alias("low"))
        jump = met.join(met.select(F.col("content").alias("low"), F.col("low").alias("further")), "low", "left")
        new = materialize(jump.select("content", F.least("low", F.coalesce("further", "low")).alias("root"), F.col("root").alias("was")), "label")
        label = new.select("content", "root")
        if new.where("root <> was").isEmpty():
            return label


def copy_groups(chunks: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, class_id, group_id, links): one row per id that takes part. class_id: smallest id of its
    exact copies; group_id: smallest id reachable over near copies; links: other contents that are
    near copies of its content."""
    member, links = linked(chunks, least)
    size = member.groupBy("content").agg(F.min("id").alias("class_id"))
    ends = links.select(F.col("ca").alias("content")).unionByName(links.select(F.col("cb").alias("content")))
    count = ends.groupBy("content").agg(F.count("*").alias("links"))
    rooted = size.join(components(links), "content", "left").join(count, "content", "left")
    rooted = materialize(rooted.select("content", "class_id", F.coalesce("root", "content").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "rooted")
    group = rooted.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return member.join(rooted.join(group, "root"), "content").select("id", "class_id", "group_id", "links")
