"""Problem 7: text decoded with the wrong character encoding.

A wrong code page is a substitution cipher: every byte of the original became one character. The
cipher of a source (host) is unknown and is learned by expectation-maximisation against a language
model of character bigrams. Two kinds of cipher occur:

* bytes of UTF-8 shown as a code page, once or several times over: several characters stand for one
  letter. Runs of characters outside ASCII are translated by each page and valid sequences read;
* bytes of one code page shown as another: one character stands for one letter. Which letter is
  open: a source has a table of how often each of its characters stood for which letter, and for
  itself. The tables start with nothing but what any two pages allow and a small share of garbled
  runs; what the language model is sure of teaches them, and they decide about the short runs
  (single letters) that the language model alone can't read.

The E-step gives every distinct run of a source its posterior over "sound" and the readings; the
M-step sums the posteriors into the source's byte-to-letter table or page mixture, and adds the
readings to the bigram table. The learned table of a source is applied with ``translate()``. The
bigram table is hashed into BINS counters, so what travels to the driver and back has a fixed size;
tables and mixtures stay distributed and are joined by source to the texts of affected sources.

Replacement characters and C1 control characters that no hypothesis explains are wrong decoding
whose original is lost; such a text is reported, restored as far as its other runs allow.

Defined results: null and empty values are never affected; ids that occur twice count once; null
ids are left out; sound foreign text comes back unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import host_of, materialize

BINS = 1 << 16
#: Rounds of learning at most; they end when every source's expected number of garbled runs settles.
ROUNDS, SETTLED = 12, 0.05

# Code pages whose high half may have been taken for UTF-8's bytes.
PAGES = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "cp866", "koi8_r", "cp1250", "iso8859_15", "mac_cyrillic")
DEPTH = 3
# Code pages of one byte that may have been taken for one another.
SINGLE = ("latin-1", "cp1252", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "mac_cyrillic", "cp1250", "cp1253", "iso8859_5", "iso8859_7")

_RUN = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


@lru_cache(1)
def ciphers() -> list[dict[int, str]]:
    """char -> byte of each page; bytes a page leaves open stand for themselves."""
    out = []
    for page in PAGES:
        t: dict[int, str] = {}
        for b in range(0x80, 0x100):
            try:
                c = bytes([b]).decode(page)
            except UnicodeDecodeError:
                c = chr(b)
            t.setdefault(ord(c), chr(b))
        if page == "cp1252":
            for b in range(0x80, 0xA0):
                t.setdefault(b, chr(b))
        out.append(t)
    return out


class _Open(dict):
    def __missing__(self, key):
        return "\x01"


@lru_cache(1)
def _tables() -> list[_Open]:
    return [_Open(t) for t in ciphers()]


def _read(run: str, table: _Open) -> str | None:
    """The run with its valid sequences read, or None if there is none."""
    coded = run.translate(table)
    out, at, rest = [], 0, len(run)
    for m in _UTF8.finditer(coded):
        try:
            c = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out.append(run[at : m.start()])
        out.append(c)
        at = m.end()
        rest -= len(m.group())
    # a garbled stretch consists of such sequences; a rest may only be what a cut left of one
    return "".join(out) + run[at:] if at and rest <= len(run) // 8 else None


@lru_cache(200_000)
def readings(run: str) -> tuple[tuple[int, str], ...]:
    """(first page, reading) of the run under every hypothesis that reads something."""
    best: dict[str, int] = {}
    level = [(run, None)]
    for _ in range(DEPTH):
        following = []
        for text, first in level:
            for k, t in enumerate(_tables()):
                out = []
                changed = False
                for piece in re.split("([^\x00-\x7f]+)", text):
                    r = _read(piece, t) if piece and piece[0] > "\x7f" else None
                    changed |= r is not None
                    out.append(piece if r is None else r)
                got = "".join(out)
                if changed and got not in best:
                    best[got] = k if first is None else first
                    following.append((got, k if first is None else first))
        level = following
    return tuple((k, r) for r, k in best.items())


@lru_cache(1)
def swaps() -> list[_Open]:
    """char -> letter for every two pages: shown as the first, written in the second."""
    half: dict[str, dict[int, str]] = {}
    for page in SINGLE:
        half[page] = {}
        for b in range(0x80, 0x100):
            try:
                half[page][b] = bytes([b]).decode(page)
            except UnicodeDecodeError:
                continue
    out: dict[tuple, _Open] = {}
    for shown, written in permutations(SINGLE, 2):
        t = _Open({ord(c): half[written][b] for b, c in half[shown].items() if b in half[written]})
        out.setdefault(tuple(sorted(t.items())), t)
    return list(out.values())


@lru_cache(1)
def _repertoire() -> frozenset[str]:
    return frozenset(chr(c) for t in swaps() for c in t)


@lru_cache(200_000)
def swap_readings(run: str) -> tuple[str, ...]:
    """What the run reads as if its page was taken for another: letters only, of one script."""
    if not _repertoire().issuperset(run):
        return ()
    got: dict[str, None] = {}
    for t in swaps():
        r = run.translate(t)
        if "\x01" not in r and r != run and r.isalpha() and len({ord(c) >= 0x370 for c in r}) == 1 and (len(r) < 3 or r[1:].islower() or r.isupper()):
            got[r] = None
    return tuple(got)


def _bin(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA6B) >> 7 & (BINS - 1)


def bigrams(before: str, run: str, after: str) -> list[int]:
    s = before + run + after
    return [_bin(a, b) for a, b in zip(s, s[1:]) if a > "\x7f" or b > "\x7f"]


def _uni(c: str) -> int:
    return _bin("\x02", c)


class Model:
    """Hashed counts of character bigrams, and of single characters outside ASCII."""

    def __init__(self, counts: np.ndarray):
        self.memo: dict[str, tuple] = {}
        self.log = np.log(counts + 0.05) - np.log(counts.sum() + 0.05 * BINS)
        self.seen = counts

    def weigh(self, before: str, run: str, after: str, reading: bool = False) -> float:
        """Log weight. Characters that sound text never shows cost a run that is read as them much,
        unless it reads as several letters of one block, a script the corpus holds only garbled."""
        w = float(self.log[bigrams(before, run, after)].sum())
        high = [c for c in run if c > "\x7f"]
        unseen = sum(self.seen[_uni(c)] < 1.5 for c in high)
        one_script = len(high) >= 3 and len({ord(c) >> 7 for c in high}) == 1 and all(c.isalpha() or ord(c) > 0x300 for c in high)
        return w - unseen * (25.0 if reading and not one_script else 9.0 if not reading else 4.0)


#: Prior of a candidate run to be garbled.
GARBLED = 0.3


def posterior(model: Model, prior: np.ndarray, before: str, run: str, after: str) -> tuple[np.ndarray, list[str]]:
    """Weights of [sound, *readings] and the readings."""
    opts = readings(run)
    logs = [np.log(1 - GARBLED) + model.weigh(before, run, after)]
    logs += [np.log(GARBLED * prior[k]) + model.weigh(before, r, after, True) for k, r in opts]
    x = np.exp(np.array(logs) - max(logs))
    return x / x.sum(), [r for _, r in opts]


def runs_of(value: str) -> Iterator[tuple[str, str, str, int, int]]:
    for m in _RUN.finditer(value):
        a, b = m.span()
        yield value[a - 1] if a else " ", m.group(), value[b] if b < len(value) else " ", a, b


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of values that hold a candidate run or lost characters; ('*', host, run with its
    neighbours, count) of the runs that one page may have been taken for another in; and ('#', bin,
    count) rows of the bigrams of all other runs."""
    counts = np.zeros(BINS)
    schema = pa.schema([("id", pa.string()), ("field", pa.string()), ("host", pa.string()), ("value", pa.string()), ("n", pa.float64())])
    memo: dict[str, tuple[bool, bool, np.ndarray]] = {}
    swapped: Counter = Counter()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [()] * 5, schema)], schema=schema)

    for b in batches:
        d = b.to_pydict()
        rows: list[tuple] = []
        for i, host, title, text in zip(d["id"], d["host"], d["title"], d["text"]):
            for field, value in (("title", title), ("text", text)):
                if not value or value.isascii():
                    continue
                flagged = _LOST.search(value) is not None
                for before, run, after, _, _ in runs_of(value):
                    key = before + run + after
                    hit = memo.get(key)
                    if hit is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        cand = bool(readings(run))
                        other = not cand and bool(swap_readings(run))
                        idx = [] if cand or other or _LOST.search(run) else bigrams(before, run, after) + [_uni(c) for c in run]
                        hit = memo[key] = (cand, other, np.array(idx, np.int64))
                    if hit[0]:
                        flagged = True
                    elif hit[1]:
                        swapped[host, key] += 1
                    elif len(hit[2]):
                        np.add.at(counts, hit[2], 1)
                if flagged:
                    rows.append((i, field, host, value, 0.0))
        if rows:
            yield batch(rows)
        if len(swapped) > 200_000:
            yield batch([(None, "*", h, k, float(n)) for (h, k), n in swapped.items()])
            swapped.clear()
    yield batch([(None, "*", h, k, float(n)) for (h, k), n in swapped.items()])
    k = np.flatnonzero(counts)
    none = pa.nulls(len(k), pa.string())
    yield pa.RecordBatch.from_arrays([none, pa.array(["#"] * len(k), pa.string()), none, pa.array([str(x) for x in k], pa.string()), pa.array(counts[k])], schema=schema)


_SCAN = "id string, field string, host string, value string, n double"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def out() -> pa.RecordBatch:
        cols = list(zip(*c)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cols), pa.array(list(c.values()), pa.float64())], ["host", "a", "run", "z", "n"])

    for b in batches:
        d = b.to_pydict()
        for host, value in zip(d["host"], d["value"]):
            for before, run, after, _, _ in runs_of(value):
                if readings(run):
                    c[host, before, run, after] += 1
        if len(c) > 200_000:
            yield out()
            c.clear()
    yield out()


# --- one page for another ---

#: Share of garbled runs a source starts with; runs it counts as; weight of the pages' say in a table.
START, RUNS, SMOOTH = 1e-4, 100.0, 0.5
#: Log odds at which a run is sound whatever its source's table says.
SURE = 16.0


class Cipher:
    """What is known of a source's characters: letter counts of garbled runs, garbled and sound runs."""

    def __init__(self, row: dict | None = None):
        self.letters: dict[str, float] = dict(row or ())
        self.garbled, self.sound = self.letters.pop("+", 0.0), self.letters.pop("-", 0.0)
        self.char: Counter = Counter()
        best: dict[str, tuple[float, str]] = {}
        for k, w in self.letters.items():
            self.char[k[0]] += w
            if w > best.get(k[0], (0.0, ""))[0]:
                best[k[0]] = (w, k[1])
        self.table = _Open({ord(c): l for c, (_, l) in best.items()})

    def share(self) -> float:
        return (self.garbled + START * RUNS) / (self.garbled + self.sound + RUNS)

    def told(self, run: str, reading: str, options: int) -> float:
        """Log probability of the reading of a garbled run: any of the options, or by the letters that
        the characters were found to stand for; the more garbled runs are known, the more the latter."""
        any_page = 1.0 / (1.0 + self.garbled)
        learned = 1.0
        for c, l in zip(run, reading):
            learned *= (self.letters.get(c + l, 0.0) + SMOOTH / 20) / (self.char[c] + SMOOTH)
        return float(np.log(any_page / options + (1 - any_page) * learned))

    def readings(self, run: str) -> tuple[str, ...]:
        r = run.translate(self.table)
        return swap_readings(run) if "\x01" in r or r in swap_readings(run) else (*swap_readings(run), r)


def swap_posterior(model: Model, cipher: Cipher, before: str, run: str, after: str) -> tuple[np.ndarray, list[str]]:
    """Weights of [sound, *readings] and the readings. What the language model says of a run is the
    same for all sources and kept."""
    key = before + run + after
    known = model.memo.get(key)
    if known is None:
        if len(model.memo) > 200_000:
            model.memo.clear()
        opts = swap_readings(run)
        known = model.memo[key] = (model.weigh(before, run, after), opts, np.array([model.weigh(before, r, after, True) for r in opts]))
    sound, opts, weighed = known
    share = cipher.share()
    if float(weighed.max()) + np.log(share) - sound < -SURE:  # whatever the table says
        return np.ones(1), []
    more = [r for r in cipher.readings(run) if r not in opts]
    if more:
        opts, weighed = (*opts, *more), np.append(weighed, [model.weigh(before, r, after, True) for r in more])
    logs = np.append([np.log(1 - share) + sound], np.log(share) + weighed + [cipher.told(run, r, len(opts)) for r in opts])
    x = np.exp(logs - logs.max())
    return x / x.sum(), list(opts)


def _swap_step(counts: np.ndarray | None):
    """('c', host, character and letter, weight), with '+' and '-' for garbled and sound runs, and
    ('b', null, bin, weight). Without counts all runs are taken as sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if counts is None else Model(counts)
        table: Counter = Counter()
        more = np.zeros(BINS)
        known: dict[str, Cipher] = {}

        def out() -> pa.RecordBatch:
            k = np.flatnonzero(more)
            hosts = [h for h, _ in table] + [None] * len(k)
            keys = [x for _, x in table] + [str(x) for x in k]
            w = [*table.values(), *more[k].tolist()]
            kind = ["c"] * len(table) + ["b"] * len(k)
            table.clear()
            more[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(w, pa.float64())], ["kind", "host", "k", "w"])

        for b in batches:
            d = b.to_pydict()
            for host, key, n, given in zip(d["host"], d["value"], d["n"], d["cipher"]):
                a, r, z = key[0], key[1:-1], key[-1]
                w, texts = np.ones(1), [r]
                if model is not None:
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = Cipher(dict(given or ()))
                    w, texts = swap_posterior(model, known[host], a, r, z)
                    texts = [r, *texts]
                    table[host, "-"] += w[0] * n
                    if len(w) == 1:
                        texts = [r]
                    elif w[0] < 0.999:
                        table[host, "+"] += (1 - w[0]) * n
                for x, t in zip(w, texts):
                    if x > 1e-3:
                        for k in bigrams(a, t, z) + [_uni(c) for c in t if c > "\x7f"]:
                            more[k] += x * n
                        if t is not r and x > 1e-3:
                            for c, l in zip(r, t):
                                table[host, c + l] += x * n
            if len(table) > 100_000:
                yield out()
        yield out()

    return run


def _step(counts: np.ndarray):
    """E-step over the distinct runs, M-step summed by partition: ('p', host, page, weight) and
    ('b', null, bin, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        page: Counter = Counter()
        more: Counter = Counter()
        for b in batches:
            d = b.to_pydict()
            for host, a, r, z, n, prior in zip(d["host"], d["a"], d["run"], d["z"], d["n"], d["prior"]):
                w, texts = posterior(model, _prior(prior), a, r, z)
                for x, t in zip(w, [r, *texts]):
                    if x > 1e-3:
                        for k in bigrams(a, t, z) + [_uni(c) for c in t if c > "\x7f"]:
                            more[k] += x * n
                for x, (k, _) in zip(w[1:], readings(r)):
                    page[host, k] += x * n
        keys = [("p", h, k) for h, k in page] + [("b", None, k) for k in more]
        cols = list(zip(*keys)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array([*page.values(), *more.values()], pa.float64())], ["kind", "host", "k", "w"]
        )

    return run


def _prior(row: dict | None) -> np.ndarray:
    """Mixture of a source from its expected counts, smoothed towards all pages alike."""
    p = np.full(len(PAGES), 1.0)
    p[:2] += 1.0
    for k, w in row or ():
        p[k] += w
    return p / p.sum()


def source(chunks: DataFrame) -> DataFrame:
    return chunks.where("id is not null").select("id", F.coalesce(host_of(F.col("source_url")), F.lit("")).alias("host"), "title", "text")


def _binned(rows: DataFrame, key: str, w: str) -> np.ndarray:
    counts = np.zeros(BINS)
    for r in rows.groupBy(key).agg(F.sum(w).alias("w")).collect():  # at most BINS rows
        counts[int(r[0])] = r.w
    return counts


def learn(chunks: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(affected candidates, page mixtures and letter tables by host, bigram counts)."""
    rounds = ROUNDS if rounds is None else rounds
    found = materialize(source(chunks).mapInArrow(_scan, _SCAN), "garbled")
    base = _binned(found.where("field = '#'"), "value", "n")
    rows = found.where("field not in ('#', '*')").dropDuplicates(["id", "field"]).select("id", "field", "host", "value")
    swapped = materialize(found.where("field = '*'").groupBy("host", "value").agg(F.sum("n").alias("n")), "swapped")
    runs = materialize(rows.select("host", "value").mapInArrow(_runs, "host string, a string, run string, z string, n double").groupBy("host", "a", "run", "z").agg(F.sum("n").alias("n")), "runs")
    no_mix, no_cipher = F.lit(None).cast("map<int,double>"), F.lit(None).cast("map<string,double>")
    flat = "kind string, host string, k string, w double"
    spark = chunks.sparkSession
    mix = spark.createDataFrame([], "host string, prior map<int,double>")
    ciphers = spark.createDataFrame([], "host string, cipher map<string,double>")
    counts = base + _binned(swapped.withColumn("cipher", no_cipher).mapInArrow(_swap_step(None), flat), "k", "w")
    was = None
    for i in range(rounds):
        given = runs.join(mix, "host", "left") if i else runs.withColumn("prior", no_mix)
        step = materialize(given.mapInArrow(_step(counts), "kind string, host string, k int, w double"), "em")
        told = swapped.join(ciphers, "host", "left") if i else swapped.withColumn("cipher", no_cipher)
        letters = materialize(told.mapInArrow(_swap_step(counts), flat), "letters")
        mix = step.where("kind = 'p'").groupBy("host", "k").agg(F.sum("w").alias("w")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("prior"))
        ciphers = letters.where("kind = 'c'").groupBy("host", "k").agg(F.sum("w").alias("w")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("cipher"))
        counts = base + _binned(step.where("kind = 'b'"), "k", "w") + _binned(letters.where("kind = 'b'"), "k", "w")
        now = letters.where("kind = 'c' and k = '+'").groupBy("host").agg(F.sum("w").alias("now"))
        moved = now if was is None else now.join(was, "host", "full")
        moved = moved.select(F.abs(F.coalesce("now", F.lit(0.0)) - (F.lit(0.0) if was is None else F.coalesce("was", F.lit(0.0)))).alias("by"), F.greatest(F.coalesce("now", F.lit(0.0)), F.lit(0.1)).alias("of"))
        if moved.where(F.col("by") > SETTLED * F.col("of")).isEmpty() and i:
            break
        was = now.withColumnRenamed("now", "was")
    return rows, mix, ciphers.where(F.coalesce(F.try_element_at("cipher", F.lit("+")), F.lit(0.0)) >= 0.5), counts


def restore(model: Model, prior: np.ndarray, value: str, cipher: Cipher | None = None) -> tuple[str, bool]:
    """(restored value, affected)."""
    out, at, hit = [], 0, False
    for before, run, after, a, b in runs_of(value):
        if readings(run):
            w, texts = posterior(model, prior, before, run, after)
        elif cipher is not None and swap_readings(run):
            w, texts = swap_posterior(model, cipher, before, run, after)
        else:
            continue
        k = int(np.argmax(w))
        if k:
            out.append(value[at:a])
            out.append(texts[k - 1])
            at, hit = b, True
    return "".join(out) + value[at:], hit or _LOST.search(value) is not None


def _foreign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field, host, value) of the values outside ASCII."""
    for b in batches:
        d = b.to_pydict()
        rows = [(i, f, h, v) for i, h, *both in zip(d["id"], d["host"], d["title"], d["text"]) for f, v in zip(("title", "text"), both) if v and not v.isascii()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 4], ["id", "field", "host", "value"])


def restored_fields(chunks: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, field, restored, recovered): affected fields; recovered is false where characters are lost."""
    rows, mix, ciphers, counts = learn(chunks, rounds)
    ciphers = materialize(ciphers, "ciphers")
    hosts = ciphers.count()
    if hosts:  # texts of sources with a cipher of their own
        few = ciphers.select("host")
        more = source(chunks).join(F.broadcast(few) if hosts <= 100_000 else few, "host", "left_semi").select("id", "host", "title", "text")
        rows = rows.unionByName(more.mapInArrow(_foreign, "id string, field string, host string, value string")).dropDuplicates(["id", "field"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for b in batches:
            d = b.to_pydict()
            out: tuple[list, ...] = ([], [], [], [])
            for i, field, value, prior, given in zip(d["id"], d["field"], d["value"], d["prior"], d["cipher"]):
                text, hit = restore(model, _prior(prior), value, Cipher(dict(given)) if given else None)
                if hit:
                    for l, x in zip(out, (i, field, text, _LOST.search(text) is None)):
                        l.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["id", "field", "restored", "recovered"])

    return rows.join(mix, "host", "left").join(ciphers, "host", "left").mapInArrow(run, "id string, field string, restored string, recovered boolean")
