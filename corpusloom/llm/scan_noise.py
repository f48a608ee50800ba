"""Problem 6: noise in text from scanned pages.

Corpus tables steer the repair. They stay distributed; what the texts ask of them is worked out once
per distinct word, pair or line, and the answers are looked up (broadcast while they are few, joined
by key beyond that), so how rare a word or header is decides nothing:

* the vocabulary: all words and hyphenated compounds that occur more than once, with their counts;
* corrections: a misread word is one that known confusions (1 for i or l, 0 for o, 5 for s, c for e,
  rn for m and back, fi for ti) turn into a word at least RATIO times as frequent;
* divided words: a word divided at a line end is a break when the joined word is better known than
  the hyphenated one;
* header classes: lines in title case that come again (fuzzily: letters only, confusable characters
  united, the leading name dropped) at least SUPPORT times and stand where a sentence runs on over
  them; captions before bare numbers, which tell a table's figure from a page number.

Defined results: null, empty and blank texts have no noise and come back as they are; only chunks
whose ``file`` starts with ``doc_`` are read (null files are left out); ids that occur twice count
once; a document without noise and without hard-wrapped lines is returned unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, once, with_lookup

RATIO, SUPPORT, FLOWING = 10, 3, 0.3
#: A word of this share of all words (or so many occurrences) is no misreading of another.
FREQUENT_SHARE, FREQUENT = 1e-3, 2000
KINDS = ("hyphen_break", "misread_char", "running_header", "page_number")

_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"(?<![\w@./:#&=?-])[A-Za-z0-9]+(?![\w@/:&=?]|-[A-Za-z0-9]|\.[A-Za-z0-9])")
_HYPHENS = "-‐­¬‑"
_BREAK = re.compile(rf"([^\W\d_]+)[{_HYPHENS}][ \t\r ]*$")
_NUMBER_LINE = re.compile(r"^\W*(?:p\s?a\s?g\s?e\s+)?\d{1,4}(?:\s+(?:of|/)\s+\d{1,4})?\W*$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_END = tuple(".!?।:;…\"”)")

# What a reading machine puts for what stands on the page.
CONFUSIONS = (("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("c", "e"), ("rn", "m"), ("m", "rn"), ("fi", "ti"))


def _merge_counts(counter: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], [name, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            c.update(_WORDS.findall(t.lower()))
        if len(c) > 200_000:
            yield _merge_counts(c, "word")
            c.clear()
    yield _merge_counts(c, "word")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) of the words that occur more than once."""
    counts = texts.select("text").where("text is not null").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts.where("n > 1"), "words")


_CANON = str.maketrans({"1": "l", "i": "l", "0": "o", "5": "s", "c": "e", "f": "t"})


_EDGE = re.compile(r"^\W*\d{1,4}\s*[|–-]\s+|(?:\s[|–-]\s*|\s+)page\s+\d{1,4}\W*$|\s{2,}\d{1,4}\W*$|\s[|–-]\s\d{1,4}\W*$", re.I)


def fuzzy(line: str) -> str | None:
    """Class of a line as a header: its words of letters without page number and first word,
    confusable characters united; None for lines that can't be headers."""
    core = _EDGE.sub("", line)
    words = core.split()
    if not 2 <= len(words) <= 12 or core.rstrip().endswith((".", ",", ";")):
        return None
    named = [w for w in words if any(c.isalpha() for c in w)]
    if len(named) < 3 or not all(w[0].isupper() or w[0].isdigit() or w.lower() in ("of", "and", "the", "for") for w in named):
        return None
    return " ".join("".join(c for c in w.lower().translate(_CANON) if c.isalpha()).replace("rn", "m") for w in named[1:]) or None


def _flows(lines: list[str], k: int) -> bool:
    """Whether a sentence runs on over line k (and over other number lines beside it)."""
    i, j = k - 1, k + 1
    while i >= 0 and (not lines[i].strip() or _NUMBER_LINE.match(lines[i])):
        i -= 1
    while j < len(lines) and (not lines[j].strip() or _NUMBER_LINE.match(lines[j])):
        j += 1
    if i < 0 or j >= len(lines):
        return False
    before, after = lines[i].rstrip(), lines[j].lstrip()
    return not before.endswith(_END) and (after[:1].islower() or after[:1].isdigit() or before.endswith((",", *_HYPHENS)))


def _edge_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, class, seen, flowing): header candidates ('h') and captions before bare numbers ('c')."""
    seen: Counter = Counter()
    flow: Counter = Counter()

    def out() -> pa.RecordBatch:
        k = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()), pa.array([seen[x] for x in k], pa.int64()), pa.array([flow[x] for x in k], pa.int64())],
            ["kind", "cls", "seen", "flowing"],
        )

    for b in batches:
        for t in b.column("text").to_pylist():
            lines = t.split("\n")
            for k, line in enumerate(lines):
                if _NUMBER_LINE.match(line):
                    if k:
                        x = ("c", " ".join(_LETTERS.findall(lines[k - 1].lower())))
                        seen[x] += 1
                        flow[x] += _flows(lines, k)
                elif (c := fuzzy(line)) is not None:
                    seen["h", c] += 1
                    flow["h", c] += _flows(lines, k)
        if len(seen) > 200_000:
            yield out()
            seen.clear()
            flow.clear()
    yield out()


def edge_classes(docs: DataFrame) -> DataFrame:
    """(key, value): header classes and captions."""
    rows = docs.select("text").mapInArrow(_edge_lines, "kind string, cls string, seen bigint, flowing bigint")
    rows = rows.groupBy("kind", "cls").agg(F.sum("seen").alias("seen"), F.sum("flowing").alias("flowing"))
    flows = F.col("flowing") >= FLOWING * F.col("seen")
    kept = rows.where((F.col("seen") >= SUPPORT) & ((F.col("kind") == "h") == flows))
    return kept.select(F.concat("kind", "cls").alias("key"), F.lit("").alias("value"))


def tokens(text: str) -> set[str]:
    return {x for w in _TOKEN.findall(text) if len(x := w.lower()) > 3 and not x.isdigit() and sum(c.isdigit() for c in x) <= 2}


def divided(text: str) -> set[tuple[str, str]]:
    """Pairs of words around line ends that may be pieces of one word; between two lines that touch
    once page lines between them are gone, too."""
    out = set()
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if m := _BREAK.search(line):
            for after in lines[k + 1 : k + 6]:
                if n := re.match(r"\s*([^\W\d_]+)", after):
                    out.add((m.group(1).lower(), n.group(1).lower()))
    return out


def asked(text: str) -> set[str]:
    """All keys a text may ask for."""
    lines = text.split("\n")
    out = {"m" + w for w in tokens(text)}
    for l, r in divided(text):
        out.add(f"b{l}\t{r}")
    for k, line in enumerate(lines):
        if _NUMBER_LINE.match(line):
            if k:
                out.add("c" + " ".join(_LETTERS.findall(lines[k - 1].lower())))
        elif (c := fuzzy(line)) is not None:
            out.add("h" + c)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """('m', token, '') and ('b', left, right), each once a flush."""
    seen: set[tuple[str, str, str]] = set()

    def out() -> pa.RecordBatch:
        cols = list(zip(*seen)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "l", "r"])

    for b in batches:
        for t in b.column("text").to_pylist():
            seen.update(("m", w, "") for w in tokens(t))
            seen.update(("b", l, r) for l, r in divided(t))
        if len(seen) > 200_000:
            yield out()
            seen.clear()
    yield out()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, own, level, word): what one or two confusions turn a token into."""
    for b in batches:
        rows: list[tuple] = []
        for token, own in zip(b.column("token").to_pylist(), b.column("own").to_pylist()):
            level, done = {token}, {token}
            for depth in (1, 2):
                following = set()
                for w in level:
                    for bad, good in CONFUSIONS:
                        at = w.find(bad)
                        while at >= 0:
                            following.add(w[:at] + good + w[at + len(bad) :])
                            at = w.find(bad, at + 1)
                level = following - done
                done |= level
                rows += [(token, own, depth, v) for v in level if v.isalpha()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["token", "own", "level", "word"])


def corrections(tokens_: DataFrame, words: DataFrame) -> DataFrame:
    """(token, fixed, n): the word every misread token stands for, and its count. Fewer confusions
    come first, then the more frequent word, then the alphabet."""
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = max(FREQUENT, int(FREQUENT_SHARE * total))
    own = tokens_.join(words.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").select("token", F.coalesce("own", F.lit(0)).alias("own")).where(F.col("own") < frequent)
    made = own.mapInArrow(_variants, "token string, own bigint, level int, word string")
    good = made.join(words, "word").where(F.col("n") >= RATIO * F.greatest("own", F.lit(1)))
    best = good.groupBy("token").agg(F.min(F.struct("level", (-F.col("n")).alias("n"), "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("fixed"), (-F.col("b.n")).alias("n"))


def repairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(key, value): corrections of the documents' tokens and the pairs that are divided words."""
    pieces = materialize(docs.select("text").mapInArrow(_pieces, "kind string, l string, r string").distinct(), "pieces")
    pairs = pieces.where("kind = 'b'").select("l", "r")
    wanted = pieces.where("kind = 'm'").select(F.col("l").alias("token")).unionByName(pairs.select(F.concat("l", "r").alias("token"))).distinct()
    fixed = materialize(corrections(wanted.where("length(token) > 3"), words), "fixed")
    count = lambda c: words.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    p = pairs.withColumn("joined", F.concat("l", "r")).withColumn("compound", F.concat("l", F.lit("-"), "r"))
    for c in ("joined", "compound", "l", "r"):
        p = p.join(count(c), c, "left")
    p = p.join(fixed.select(F.col("token").alias("joined"), F.col("n").alias("n_fixed")), "joined", "left")
    joined, compound = F.coalesce("n_joined", "n_fixed", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    broken = F.when((joined > 0) | (compound > 0), joined > compound).otherwise(F.col("n_l").isNull() | F.col("n_r").isNull())
    return fixed.select(F.concat(F.lit("m"), "token").alias("key"), F.col("fixed").alias("value")).unionByName(p.where(broken).select(F.concat(F.lit("b"), "l", F.lit("\t"), "r").alias("key"), F.lit("").alias("value")))


class Reader:
    """The corpus's answers to what a text asks (see ``asked``)."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def corrected(self, word: str) -> str | None:
        """The word that was misread as ``word`` (lower case), or None."""
        return self.known.get("m" + word)

    def breaks(self, left: str, right: str) -> bool:
        """Whether left- / right is a divided word rather than a compound."""
        return f"b{left.lower()}\t{right.lower()}" in self.known

    def page_line(self, lines: list[str], k: int) -> str | None:
        """'page_number', 'running_header', 'both' or None for line k."""
        line = lines[k]
        if _NUMBER_LINE.match(line):
            core = line.strip()
            plain = core.isdigit()
            if not plain and core[:-1].isdigit():  # a sentence's last figure
                return None
            if plain and k and "c" + " ".join(_LETTERS.findall(lines[k - 1].lower())) in self.known and not _flows(lines, k):
                return None
            return "page_number"
        if (c := fuzzy(line)) is not None and "h" + c in self.known:
            return "both" if _EDGE.search(line) else "running_header"
        return None

    def kinds(self, text: str) -> set[str]:
        found: set[str] = set()
        lines = text.split("\n")
        kept = []
        for k, line in enumerate(lines):
            what = self.page_line(lines, k)
            if what is None:
                kept.append(line)
            else:
                found |= {"page_number", "running_header"} if what == "both" else {what}
        pieces = set()
        for a, b in zip(kept, kept[1:]):
            m = _BREAK.search(a)
            if m and (n := re.match(r"\s*([^\W\d_]+)", b)):
                if n.group(1)[0].islower() and self.breaks(m.group(1), n.group(1)):
                    found.add("hyphen_break")
                pieces |= {m.group(1).lower(), n.group(1).lower()}
        for line in kept:
            for w in _TOKEN.findall(line):
                low = w.lower()
                if low not in pieces and self.corrected(low):
                    found.add("misread_char")
                    break
        return found

    def repaired(self, text: str) -> str:
        lines = text.split("\n")
        kept = [line for k, line in enumerate(lines) if self.page_line(lines, k) is None]
        wrapped = [len(x) for x, y in zip(kept, kept[1:]) if x.strip() and not x.rstrip().endswith(_END) and y[:1].islower()]
        if len(kept) == len(lines) and not self.kinds(text) and len(wrapped) < 2:
            return text
        out: list[str] = []
        for line in kept:
            line = _TOKEN.sub(self._mend, line)
            if not out or not out[-1].strip() or not line.strip():
                out.append(line)
                continue
            last = out[-1].rstrip()
            m = _BREAK.search(last)
            n = re.match(r"\s*([^\W\d_]+)", line)
            if m and n and n.group(1)[0].islower():
                cut = last[: m.end(1)]
                out[-1] = cut + ("" if self.breaks(m.group(1), n.group(1)) else "-") + line.lstrip()
            elif not last.endswith(_END) and (line[:1].islower() or line[:1].isdigit()):
                out[-1] = last + " " + line.lstrip()
            elif wrapped and len(last) >= 0.75 * max(wrapped) and not re.match(r"\s*(?:[-*•]|\d+\.)\s", line):
                out[-1] = last + " " + line.lstrip()
            else:
                out.append(line)
        return "\n".join(out)

    def _mend(self, m: re.Match) -> str:
        w = m.group()
        low = w.lower()
        if not (v := self.corrected(low)):
            return w
        return v.upper() if w.isupper() and len(w) > 1 else v.capitalize() if w[:1].isupper() else v


def scanned(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "text", "file").where("id is not null and text is not null and file like 'doc\\_%'").select("id", "text")


def read(chunks: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(id, text, held) of the documents' chunks, each id once where it is repeated, and what is broadcast."""
    docs = once(scanned(chunks), "text")
    table = edge_classes(docs).unionByName(repairs(docs, vocabulary(chunks)))
    return with_lookup(docs, "text", table, asked)


def scan_noise(chunks: DataFrame) -> DataFrame:
    """(id, noise_kind)."""
    docs, known = read(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds = [], []
            for i, t, more in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), held(b)):
                for k in sorted(Reader(more or shared.value).kinds(t)):
                    ids.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], ["id", "noise_kind"])

    return docs.mapInArrow(run, "id string, noise_kind string").distinct()


def repair_scans(chunks: DataFrame) -> DataFrame:
    """(id, repaired): every document chunk once, its text in continuous paragraphs."""
    docs, known = read(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [Reader(more or shared.value).repaired(t) for t, more in zip(b.column("text").to_pylist(), held(b))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fixed, pa.string())], ["id", "repaired"])

    return docs.mapInArrow(run, "id string, repaired string")
