"""Problem 10: keyword-stuffed pages, link lists and product tags.

A document is read as the sequence of its words (pairs of characters in scripts without spaces):

* recurrence gaps: the distance of a content word to its previous occurrence. Prose repeats content
  words rarely; stuffed text repeats them within a few words. ``recur`` is the share of content
  words whose previous occurrence lies inside the lag window, ``every`` the same over all words;
* positional autocorrelation: ``lag`` is the largest share of content words that recur at one and
  the same lag of the window: repetition that is unnaturally regular;
* lists of many different nouns have hardly any function words. Which words are function words is
  learned from the corpus, per language as the documents name it: words in at least DF_SHARE of a
  language's documents that stand in lower case and hardly ever right before a mark.

A document is a candidate when it recurs beyond prose (RECUR, EVERY, LAG), when links and tags make
up LINKS of it, or when it has few function words and recurs moderately (FEW, SOME). A check
follows: honest tables, lists and question pages recur too, but their words stand in sentences,
segments that open and close like one, hold function words at the rate of prose and don't come
again. In a language of which the corpus shows too little to learn function words from, any closed
segment counts as a sentence, so its prose isn't taken for a list.

Defined results: null, empty and blank texts, and texts of fewer than MIN_WORDS words, are not
spam; repeated doc_ids come out once; null doc_ids are left out; a null or
missing lang is a language of its own. Languages of fewer than MIN_DOCS documents teach no function words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, LAGS = 20, 48
RECUR, EVERY, LAG, LINKS = 0.4, 0.6, 0.3, 0.12
FEW, SOME = 0.33, 0.18
STRONG_SENTENCES, SENTENCES = 0.5, 0.38
DF_SHARE, FINAL_SHARE, LOWER_SHARE, MIN_DOCS = 0.35, 0.1, 0.4, 50
UNKNOWN = 0.1

_SENTENCE_END = re.compile("(?<=[.!?।…])[  ]+|(?<=[。！？])")
_MARKS = ".,;:!?()[]{}\"'“”‘’«»।…|。，！？、"
_DIGITS = {ord(c): None for c in "0123456789"}
_CLOSES = frozenset(".!?।…”\"):;»。！？")
_DENSE = re.compile("[฀-໿ក-៿぀-ヿ㐀-䶿一-鿿]{2,}")
_LETTER = re.compile(r"[^\W\d_]")


def _spread(m: re.Match) -> str:
    s = m.group()
    return " ".join([""] + [s[i : i + 2] for i in range(len(s) - 1)] + [""])


def features(text: str, function_words: frozenset[str]) -> dict[str, float] | None:
    """The measures of the module's note; None for texts of fewer than MIN_WORDS words."""
    low = text.lower()
    if not low.isascii() and _DENSE.search(low):
        low = _DENSE.sub(_spread, low)
    segments: list[tuple[str, list[str], bool]] = []
    words: list[str] = []
    links = 0
    for line in low.split("\n"):
        row = line.count("|") > 1
        for s in _SENTENCE_END.split(line):
            w = s.split()
            if w:
                words += w
                segments.append((s, w, row))
    n = len(words)
    if n < MIN_WORDS:
        return None
    code: dict[str, int] = {}
    c = np.fromiter((code.setdefault(w.strip(_MARKS), len(code)) for w in words), np.int32, n)
    fun = np.fromiter(map(function_words.__contains__, code), bool, len(code))
    content = ~fun[c]
    total = max(1, int(content.sum()))
    order = np.argsort(c, kind="stable")
    gap = np.diff(order)
    near = (c[order][1:] == c[order][:-1]) & (gap <= LAGS)
    by_lag = np.bincount(gap[near & content[order[1:]]], minlength=LAGS + 1)
    function = 1 - total / n
    known = function >= UNKNOWN
    inside = 0
    seen: Counter = Counter()
    for s, w, row in segments:
        k = len(w)
        linked = s.count("://") + s.count("#") + s.count("tag:") if "#" in s or ":" in s else 0
        links += linked
        if k < 5 or row or linked > max(1, k // 12) or s.rstrip()[-1] not in _CLOSES or len(set(w)) <= 0.6 * k:
            continue
        key = s.translate(_DIGITS)
        seen[key] += 1
        if seen[key] > 1:
            continue
        rate = sum(map(function_words.__contains__, w)) / k
        if 0.08 <= rate <= 0.8 or not known and (k >= 6 or rate > 0):
            inside += k
    return {
        "words": n, "function": function, "recur": float(by_lag.sum()) / total, "lag": float(by_lag.max()) / total,
        "every": float(near.sum()) / n, "links": links / n, "sentences": inside / n,
    }


def is_spam(text: str | None, function_words: frozenset[str]) -> bool:
    f = features(text, function_words) if text else None
    if f is None:
        return False
    if f["recur"] >= RECUR and f["function"] >= UNKNOWN or f["every"] >= EVERY or f["lag"] >= LAG or f["links"] >= LINKS:
        return f["sentences"] < STRONG_SENTENCES
    return f["function"] < FEW and f["recur"] >= SOME and f["sentences"] < SENTENCES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, docs): documents of a language that hold a word as written; '' counts them all."""
    seen: dict[str, Counter] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(l, w, n) for l, c in seen.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "docs"])

    for b in batches:
        for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            c = seen.setdefault(l, Counter())
            before = len(c)
            c.update(set(t.split()))
            c[""] += 1
            held += len(c) - before
            if held > 300_000:
                yield out()
                seen, held = {}, 0
    yield out()


def function_words(documents: DataFrame) -> frozenset[str]:
    """Learned over all documents. What comes to the driver is bounded by the languages and the mean
    number of different words a document, divided by DF_SHARE."""
    src = documents.where("text is not null").select((F.lower(F.trim(F.coalesce("lang", F.lit("")))) if "lang" in documents.columns else F.lit("")).alias("lang"), "text")
    rows = src.mapInArrow(_count, "lang string, word string, docs bigint").groupBy("lang", "word").agg(F.sum("docs").alias("docs"))
    marks = F.lit(_MARKS)
    bare = F.btrim("word", marks)
    rows = rows.select(
        "lang", F.lower(bare).alias("word"), "docs", F.when((F.col("word") == bare) & (bare == F.lower(bare)), F.col("docs")).otherwise(0).alias("plain"),
        F.when(bare == F.lower(bare), F.col("docs")).otherwise(0).alias("lower"), F.when(F.col("word") != F.rtrim("word", marks), F.col("docs")).otherwise(0).alias("final"),
        F.when(F.col("word") == "", F.col("docs")).alias("all"),
    )
    words = rows.groupBy("lang", "word").agg(*(F.sum(c).alias(c) for c in ("docs", "plain", "lower", "final", "all")))
    size = words.where("all is not null").select("lang", F.col("all").alias("size")).where(F.col("size") >= MIN_DOCS)
    kept = words.where("word <> ''").join(F.broadcast(size), "lang")  # one row a language
    kept = kept.where((F.col("plain") >= DF_SHARE * F.col("size")) & (F.col("lower") >= LOWER_SHARE * F.col("docs")) & (F.col("final") <= FINAL_SHARE * F.col("docs")))
    return frozenset(r.word for r in kept.select("word").distinct().collect() if _LETTER.search(r.word))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are spam. Two narrow passes; word counts and ids are shuffled."""
    known = function_words(documents)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                spam = [is_spam(t, known) for t in part.column("text").to_pylist()]
                yield part.select(["doc_id"]).filter(pa.array(spam, pa.bool_()))

    src = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return src.mapInArrow(judge, "doc_id bigint").distinct()
