"""Problem 1: personal information inside free text, found by information-theoretic sanitisation.

Corpus co-occurrence says how strongly a term reveals a protected entity. One pass counts, over all
texts, which terms stand at the slots of protected entities and how often they stand anywhere:

* number contexts and shapes: the terms before a number, against the numbers' shapes. Shapes that
  belong to one type (a dialling prefix, letters and digits of a roll or tax number) are the seeds;
  the pointwise mutual information of a context with a type, and of a shape with the contexts of a
  type, decides about shapes that could be anything (ten plain digits, six digits, a letter and
  seven digits); a seed's shape counts with its own information about the type;
* name terms: a term's share of occurrences at a person's slot, after a title or as one of two
  names right before an identifying number. Terms whose disclosure (log2 of that share over the
  share of all terms) exceeds NAME_BITS are names; pairs of them, or one with a title or initial,
  are removed. Terms may be of any script.
* street terms: the same ratio for the slot that ends the first part of a postal address;
* slot classes: how a mail address is spelled, the words that open an address or a street's end, the
  label before a number. A class discloses if what follows it mostly has the form of the entity.

Nothing is reported without its entry in these tables; exact format checks follow. Tables are
broadcast while they have at most LOOKUP_ROWS rows and joined to the texts that ask for them beyond
that, so how rare a name, street or context is decides nothing. Both give the same spans: a text
asks for everything a search in it may look up (``asked``), and what spares a search rests on
nothing but the text's own terms (``opening``). Slot classes are as many as the fixed lists below
have words.

Defined results: null and blank texts hold nothing and come back unchanged; ids that occur twice
count once; null ids are left out; a type is reported once per field and record; placeholders
replace the longest span, other text keeps every character; e-mail addresses win over names inside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, once, with_lookup

NAME_BITS = 3.0
CONTEXT_BITS = 0.5
#: A context seen so often without a type says so much against it, at most; a class discloses from
#: this share of confirmed spans on.
AGAINST, CLASS_SHARE = -2.0, 0.25
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Titles of persons.
TITLES = "Dr|Prof|Professor|Mr|Mrs|Ms|Miss|Shri|Smt|Sri|Kum|Er|Adv|Mme|Mlle|Herr|Frau|श्री|श्रीमती|सुश्री|डॉ|प्रो|कु"
# Words that end a street's name.
STREETS = frozenset("road street lane path row marg avenue cross nagar colony sector residency drive close way terrace crescent rue straße strasse weg gali".split())

_AT = r"(?:@|＠|\s?[(\[{]\s?at\s?[)\]}]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w.+-]*\w{_AT}\w[\w-]*(?:{_DOT}\w[\w-]*)+", re.I)

_NUM = re.compile(r"(?<![\w.@/-])[+(]?[A-Z]{0,5}(?:\d|(?<=[A-Z])[- ](?=\d))[\dA-Z]*(?:[ .)/-]{1,2}(?:[A-Z]{3}[- ]?)?\d+[A-Z]?)*(?![\w@]|[./-]\w)")
_TERM = re.compile(r"[^\W\d_][^\W\d_'’ऀ-ःऺ-ॏ‍-]*(?:[-'’ऀ-ःऺ-ॏ‍]+[^\W\d_]*)*|[|>#@:]")
_CAP = r"(?:[^\W\d_a-z][^\W\d_]*(?:[-'’][^\W\d_]+)*)"
_INI = r"(?:[A-Z]\.)"
_TITLED = re.compile(rf"(?<!\w)(?:{TITLES})\.?\s+((?:{_INI}\s?)*(?:[^\W\d_a-z][\w'’ऀ-ॏ‍-]*)(?:\s(?:{_INI}\s?)*(?:[^\W\d_a-z][\w'’ऀ-ॏ‍-]*))?)")
_PAIR = re.compile(r"(?<![\w@.])((?:[^\W\d_a-z][\wऀ-ॏ‍]*(?:[-'’]\w+)*|[A-Z]\.))(,?\s)((?:[^\W\d_a-z][\wऀ-ॏ‍]*(?:[-'’]\w+)*|[A-Z]\.))(?![\w@])")

#: Every pair, also those that a search from the end of another one meets.
_ANY_PAIR = re.compile(f"(?={_PAIR.pattern})")
_LOWER = re.compile(r"(?<![\w@.])(?:[^\W\d_A-Z][\wऀ-ॏ‍]*(?:[-'’]\w+)*|[a-z]\.)(?![\w@])")
_NEXT = re.compile(r"\s([^\W\d_a-z][\w'’ऀ-ॏ‍-]*)")

# How numbers that identify or reach a person are written.
_PHONE = re.compile(
    r"(?:\+|00)91[ -]?\d{5}[ .-]?\d{5}|\+(?!91)[1-9]\d{0,2}(?:[ .-]?\d{2,4}){3,4}|00(?!91)[1-9]\d{0,2}[ .-](?:\d{2,4}[ .-]?){2,3}\d{2,4}|\(0\d{2,4}\)\s?\d{3}[ -]?\d{3,4}|0\d{2,4}-\d{6,8}|0\d{5}\s\d{5}"
    r"|[1-9]\d{3}\s\d{3}\s\d{3}|[1-9]\d{4}[ -]\d{5}"
)
_ID = re.compile(r"[A-Z]{2}\d{2}[- ]?[A-Z]{3}[- ]?\d{3}|[A-Z]{5}\d{4}[A-Z]|[1-9]\d{3}([ -])\d{4}\1\d{4}")
_LABELLED = re.compile(
    r"(?:(?<!visitor )(?:roll|identity|aadhaar|pan|passport|staff|employee|tax|registration|enrolment|enrollment|admission|licen[cs]e|voter|student)\b[\s.:-]*(?:id(?:entity)?|card)?\s*(?:number|no\.?|id|#)?[\s.:-]*)((?:[A-Z]{1,5}[- ]?)?\d[\dA-Z/-]{2,}[\dA-Z])",
    re.I,
)
_HEAD = re.compile(
    r"(?<!\w)(?:(?:[Hh]ouse|HOUSE)\s+(?:No|NO|no)\.?|[Hh]\.\s?(?:No|NO|no)\.?|(?:Flat|FLAT|flat|Plot|PLOT|plot|Door|Apartment|Apt\.?|Quarter|Qr\.?)(?:\s+(?:No|NO|no)\.?)?|मकान\s+(?:नं\.?|संख्या)|फ्लैट|प्लॉट)"
    r"\s*\d[\w/-]*,?\s+([^\W\d_a-z][\w'’.-]*(?:\s+[^\W\d_a-z][\w'’.-]*){0,3})"
)
_WORD3 = re.compile(r"[^\W\d_]+")  # scripts with marks fall into pieces, in texts and tables alike
_LABELS = frozenset("roll identity aadhaar pan passport staff employee tax registration enrolment enrollment admission licence license voter student".split())
_FOUR_DIGITS = re.compile(r"(?:\d\D*){3}\d")  # no number has fewer
_INITIALS = re.compile(r"(?:[a-z]\.)+")
_TITLE_HINT = ("Dr", "Prof", "Mr", "Ms.", "Ms ", "Miss", "Shri", "Smt", "Sri", "Kum", "Er.", "Er ", "Adv", "Mme", "Mlle", "Herr", "Frau", "श्री", "डॉ", "प्रो", "कु.", "कु ")
_BARE = re.compile(r"(?<![\w#/.:–-])\d{1,4}[A-Za-z]?(?:/\d+|-\d+)?,?\s+([A-Z][\w'’]*(?:\s+[A-Z][\w'’]*){0,3})(?=[,\n ])")
_CAMPUS = re.compile(r"(?:room|rooms|counter|hall|block|group|extension|rs\.?|no\.|item|course|§|page)\s*$", re.I)
_TAIL = re.compile(r"(?:\s\d{1,3}(?=,))?(?:,\s*(?:near\s[^,.;\n]{3,40}|P\.O\.\s\w+|Dist\.\s\w+|Sector\s\d+|[A-Z][\w'’]*(?:\s[A-Z][\w'’]*){0,3}))*(?:\s*[-–]?\s*\d{3}\s?\d{3}(?!\d))?")


def shape(s: str) -> str:
    return re.sub(r"[A-Z]+", lambda m: f"A{len(m.group())}", re.sub(r"\d+", lambda m: f"d{len(m.group())}", s))


def context(text: str, at: int) -> str:
    """The term before a position; two of them where the first says little ('number', 'no')."""
    left = text[max(0, at - 40) : at].rsplit("\n", 1)[-1].split()
    if not left:
        return "^"
    words = ["#" if any(c.isdigit() for c in w) else w.strip("(),;").lower() or w for w in left[-2:]]
    return " ".join(words) if words[-1] in ("number", "no.", "no", "id", "nr", "#") else words[-1]


def _kind(s: str) -> str | None:
    """Type of a number whose shape alone tells, '' for dates and other plain numbers."""
    if _PHONE.fullmatch(s):
        return "phone"
    if _ID.fullmatch(s):
        return "id_number"
    return None


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NUM.finditer(text):
        s = m.group()
        n = sum(map(str.isdigit, s))
        if n >= 5 or n == 4 and _ID.fullmatch(s):
            yield m.start(), m.start() + len(s.rstrip(" .,-/)")), s.rstrip(" .,-/)")


def names_before(text: str, at: int) -> list[str]:
    """Two capitalised terms that end right before a position, over a comma, bar or bracket."""
    m = _BEFORE.search(text[max(0, at - 70) : at].rsplit("\n", 1)[-1])
    parts = [p for p in re.split(r",?\s", m.group(1)) if not p.endswith(".")] if m else []
    return parts if all(len(p) > 2 and not any(map(str.isdigit, p)) and p.lower() not in _LABELS for p in parts) else []


_BEFORE = re.compile(
    r"((?:[^\W\d_a-z][\w'’-]+),?\s(?:[A-Z]\.\s)?[^\W\d_a-z][\w'’-]+)\s*(?:\s?[,|(]\s?|\s{1,2})\s*(?:(?:roll|national|staff|employee|PAN|passport|tax)[\w ]*)?\s*$"
)


# Shapes of numbers that identify a person where the label or context says so.
ID_SHAPES = ("d12", "d6", "A1d7", "A3-d5", "d8")
_SEPARATOR = re.compile(rf"{_AT}", re.I)
_FIRST = re.compile(r"[^\W\d_]+")


_LONG = re.compile(r"\d[\dA-Za-z/-]{2,}[\dA-Za-z]")


# What a text must hold for a search to be worth while; tested for a whole batch at once.
MAIL, HEAD, STREET, LABEL, NUMBER, TITLE = (1 << k for k in range(6))
_HINTS = {
    MAIL: r"(?i)@|＠|at[)\]}]|\sdot\s",
    HEAD: r"(?i)house|h\.\s?no|flat|plot|door|apt|apartment|qr|quarter|मकान|फ्लैट|प्लॉट",
    STREET: "(?i)" + "|".join(sorted(STREETS)),
    LABEL: "(?i)" + "|".join(sorted(_LABELS)),
    NUMBER: r"[A-Z]{5}\p{Nd}{4}[A-Z]|\p{Nd}{5}|\p{Nd}{3}[ )-]\s?\p{Nd}{3}|[A-Z]\p{Nd}{2}[- ][A-Z]{3}",
    TITLE: "|".join(_TITLE_HINT).replace(".", r"\."),
}
ALL = sum(_HINTS)


def hints(texts: pa.Array) -> list[int]:
    """Which searches each text is worth."""
    out = np.zeros(len(texts), np.int64)
    for bit, pattern in _HINTS.items():
        out |= np.where(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool), bit, 0)
    return out.tolist()


def mails(text: str, hint: int) -> Iterator[tuple[int, int, str, bool]]:
    """(begin, end, class, well-formed) of what is spelled like a mail address."""
    if hint & MAIL:
        for m in _EMAIL.finditer(text):
            sep = _SEPARATOR.search(m.group())
            yield m.start(), m.end(), sep.group().strip().lower() if sep else "", "." in m.group() or "dot" in m.group().lower()


def houses(text: str, hint: int) -> Iterator[tuple[int, int, str, bool]]:
    """(begin, end, class, with more parts) of what opens like a postal address."""
    if hint & HEAD:
        for m in _HEAD.finditer(text):
            end = _TAIL.match(text, m.end()).end()
            first = _FIRST.search(m.group())
            yield m.start(), end, first.group().lower() if first else "", end > m.end()


def streets(text: str, ends) -> Iterator[tuple[int, int, str, bool]]:
    """(begin, end, street word, with more parts) of numbers before a name that ends in a street word."""
    for m in _BARE.finditer(text):
        part = m.group(1).split()
        k = max((i for i, w in enumerate(part) if i and ends(w.lower())), default=None)
        if k is None or _CAMPUS.search(text[max(0, m.start() - 12) : m.start()]):
            continue
        end = m.start(1) + re.match(r"\S+(?:\s+\S+){%d}" % k, m.group(1)).end()
        tail = _TAIL.match(text, end).end()
        yield m.start(), tail, part[k].lower(), tail > end


def labelled(text: str, hint: int) -> Iterator[tuple[int, int, str, bool]]:
    """(begin, end, label, of a known form) of numbers after the label of an identity."""
    if hint & LABEL and _LONG.search(text):
        low = text.lower()
        if len(low) == len(text):
            at = sorted(m.start() for h in _LABELS if h in low for m in re.finditer(h, low))
            found = [m for k in at if (m := _LABELLED.match(text, k))]
        else:  # lower case has other lengths
            found = list(_LABELLED.finditer(text))
        end = 0
        for m in found:
            if m.start() < end:
                continue
            end = m.end()
            s = m.group(1)
            if sum(map(str.isdigit, s)) >= 5 or _ID.fullmatch(s):
                yield m.start(1), m.end(1), _FIRST.search(m.group()).group().lower(), _kind(s) == "id_number" or shape(s) in ID_SHAPES


def slots(text: str, hint: int) -> Iterator[tuple[str, str, bool]]:
    """(type, class, confirmed) of every slot that has a class."""
    for _, _, c, good in mails(text, hint):
        yield "email", c, good
    for _, _, c, good in houses(text, hint):
        yield "house", c, good
    if hint & STREET:
        for _, _, c, good in streets(text, STREETS.__contains__):
            yield "street", c, good
    for _, _, c, good in labelled(text, hint):
        yield "label", c, good


_NOT_LOWER = re.compile(r"(?<!\S)[^\sa-z\d]\S*")
_CAPS = re.compile(r"[^\W\d_a-z][^\W\d_]*")


def inner_pieces(s: str) -> list[str]:
    """Pieces of a number that may be of a type by themselves."""
    if len(s) < 9:
        return []
    return [x for x in (s.split(" ", 1)[0], *(m.group() for p in (_ID, _PHONE) for m in p.finditer(s))) if x != s]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        k = list(seen)
        cols = list(zip(*k)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([seen[x] for x in k], pa.int64())], ["what", "term", "slot", "n"])

    raw: Counter = Counter()

    def fold() -> None:
        for w, n in raw.items():
            if not (w[0].isupper() or "ऀ" <= w[0] <= "ॿ"):
                continue
            seen["term", w.strip(".,;:()|!?।\"'").lower(), ""] += n
        raw.clear()

    for b in batches:
        texts = b.column("text")
        for t, hint in zip(texts.to_pylist(), hints(texts)):
            raw.update(_NOT_LOWER.findall(t))
            if hint & NUMBER:
                for a, e, s in numbers(t):
                    k = _kind(s)
                    c = context(t, a)
                    seen["ctx", c, f"{k or ''}\t{shape(s)}"] += 1
                    if not k:
                        for x in inner_pieces(s):
                            if k := _kind(x):
                                seen["inner", "", f"{k}\t{shape(x)}"] += 1
                    else:
                        for w in names_before(t, a):
                            seen["term", w.lower(), "person"] += 1
            if hint & TITLE:
                for m in _TITLED.finditer(t):
                    for w in m.group(1).split():
                        if not w.endswith(".") and len(w) > 2:
                            seen["term", w.strip(",;:").lower(), "person"] += 1
            if hint & HEAD:
                for m in _HEAD.finditer(t):
                    seen["term", m.group(1).split()[-1].lower(), "street"] += 1
            for kind, cls, good in slots(t, hint):
                seen["class", f"{kind}\t{cls}", "y" if good else "n"] += 1
        if len(raw) > 300_000:
            fold()
        if len(seen) > 300_000:
            yield out()
            seen.clear()
    fold()
    yield out()


def opening(term: str) -> str:
    """First run of letters of a term, initials left out. Where a text has the term with a capital, this
    is among its ``capitals``."""
    m = _INITIALS.match(term)
    m = _WORD3.match(term, m.end() if m else 0)
    return m.group().replace("ς", "σ") if m else ""


def capitals(text: str) -> list[str]:
    """Runs of letters from a capital on, in lower case (a last sigma like others)."""
    return _WORD3.findall("\n".join(_CAPS.findall(text)).lower().replace("ς", "σ"))


class Disclosure:
    """What terms reveal: the corpus's answers to what a text asks (see ``asked``), and slot classes."""

    def __init__(self, known: dict[str, str], classes: frozenset[str]):
        self.classes = classes
        self.names = frozenset(k[1:] for k in known if k[0] == "n")
        self.streets = frozenset(k[1:] for k in known if k[0] == "s") | {c.split("\t")[1] for c in classes if c.startswith("street\t")}
        number = lambda x: tuple(float(y) if y else None for y in x.split(","))
        self.bits = {k[1:]: number(v) for k, v in known.items() if k[0] == "x"}
        self.shapes = {k[1:]: number(v) for k, v in known.items() if k[0] == "f"}
        self.name_parts, self.street_parts = (frozenset(map(opening, x)) for x in (self.names, self.streets))

    def type_of(self, s: str, ctx: str) -> str | None:
        sh = shape(s)
        told, shaped = self.bits.get(ctx, (None, None)), self.shapes.get(sh, (None,) * 4)
        if k := _kind(s):
            i = ("phone", "id_number").index(k)
            own = shaped[2 + i]
            return k if own is not None and own + max(AGAINST, told[i] or 0.0) > 0 else None
        best, top = None, CONTEXT_BITS
        for i, t in enumerate(("phone", "id_number")):
            x = told[i] or 0.0
            if x > 0 and x + (shaped[i] or 0.0) > top:
                best, top = t, x + (shaped[i] or 0.0)
        digits = sum(map(str.isdigit, s))
        if best == "phone" and not (digits == 10 and s[0] in "56789" or digits == 11 and s[0] == "0"):
            return None
        if best == "id_number" and sh not in ID_SHAPES:
            return None
        return best

    def spans(self, text: str, hint: int = ALL) -> list[tuple[int, int, str]]:
        is_name = lambda w: w.lower() in self.names
        out: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            if not any(a < y and x < b for x, y in taken):
                out.append((a, b, kind))
                taken.append((a, b))

        for a, b, c, good in mails(text, hint):
            if good and f"email\t{c}" in self.classes:
                add(a, b, "email")
        for a, b, c, _ in houses(text, hint):
            if f"house\t{c}" in self.classes:
                add(a, b, "address")
        caps = capitals(text)
        if not self.street_parts.isdisjoint(caps):
            for a, b, _, good in streets(text, self.streets.__contains__):
                if good:
                    add(a, b, "address")
        for a, b, c, _ in labelled(text, hint):
            if f"label\t{c}" in self.classes:
                add(a, b, "id_number")
        if hint & NUMBER:
            for a, b, s in numbers(text):
                c = context(text, a)
                k = self.type_of(s, c)
                if k is None and " " in s and (k := self.type_of(s.split(" ", 1)[0], c)) is not None:
                    b = a + s.index(" ")
                if k is not None:
                    add(a, b, k)
                    continue
                for inner in (*_ID.finditer(s), *_PHONE.finditer(s)):
                    if inner.end() - inner.start() >= 9 and not s[: inner.start()][-1:].isdigit() and self.type_of(inner.group(), c):
                        add(a + inner.start(), a + inner.end(), _kind(inner.group()))
                        break
        plain = not self.names.isdisjoint(text.replace(",", " ").split())
        if plain:  # names all in lower case: two of them, or one with an initial
            said = list(_LOWER.finditer(text))
            k = 0
            while k + 1 < len(said):
                end, named, at = k, int(is_name(said[k].group())), said[k].end()
                for m in said[k + 1 : k + 3]:
                    if text[at : m.start()] not in (" ", ", ") or not (is_name(m.group()) or m.group().endswith(".")):
                        break
                    end, named, at = end + 1, named + is_name(m.group()), m.end()
                if named == 2 or named and end > k and (said[k].group().endswith(".") or said[end].group().endswith(".")):
                    add(said[k].start(), said[end].end(), "name")
                    k = end
                k += 1
        if not plain and self.name_parts.isdisjoint(caps):
            return sorted(out)
        for m in _TITLED.finditer(text):
            part = [w for w in m.group(1).split() if not w.endswith(".")]
            if part and (is_name(part[-1]) or is_name(part[0])):
                end = m.end(1) if is_name(part[-1]) else m.start(1) + len(m.group(1).split()[0])
                add(m.start(1), end, "name")
        at = 0
        while m := _PAIR.search(text, at):
            a, b = m.group(1), m.group(3)
            na, nb = is_name(a), is_name(b)
            ia, ib = len(a) == 2 and a[1] == ".", len(b) == 2 and b[1] == "."
            if na and nb or na and ib or ia and nb and m.group(2) == " ":
                end = m.end()
                if ib and (more := _NEXT.match(text, end)) and is_name(more.group(1)):
                    end = more.end()
                add(m.start(), end, "name")
                at = end
            else:
                at = m.start(3)
        return sorted(out)

    def sanitised(self, text: str, hint: int = ALL) -> str:
        out, at = [], 0
        for a, b, kind in self.spans(text, hint):
            out.append(text[at:a])
            out.append(PLACEHOLDER[kind])
            at = b
        return "".join(out) + text[at:]


def fields(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, rec_id, text) of all three fields; rows come as often as the tables hold them."""
    c = chunks.select(F.lit("chunks.text").alias("src"), F.col("id").alias("rec_id"), "text")
    f = feedback.select(F.col("feedback_id").cast("string").alias("rec_id"), F.explode(F.array(F.struct(F.lit("feedback.question").alias("src"), F.col("question").alias("text")), F.struct(F.lit("feedback.comment").alias("src"), F.col("comment").alias("text")))).alias("x"))
    f = f.select("x.src", "rec_id", "x.text")
    return c.unionByName(f).where("rec_id is not null and text is not null and trim(text) <> ''")


def asked(text: str) -> set[str]:
    """All keys that ``Disclosure.spans`` may look up, whatever the tables hold."""
    said = {w for m in _TITLED.finditer(text) for w in m.group(1).split()}
    said.update(_NEXT.findall(text), _LOWER.findall(text), *(m.group(1, 3) for m in _ANY_PAIR.finditer(text)))
    out = {"n" + w.lower() for w in said}
    out.update("n" + w for w in text.replace(",", " ").split())
    out.update("s" + w.split(",", 1)[0].lower() for w in text.split() if "A" <= w[0] <= "Z")
    if _FOUR_DIGITS.search(text):
        for a, _, s in numbers(text):
            out.add("x" + context(text, a))
            for x in (s, s.split(" ", 1)[0], *inner_pieces(s)):
                out.add("f" + shape(x))
    return out


def term_tables(rows: DataFrame) -> DataFrame:
    """(key, value): names and street terms."""
    total = rows.where("what = 'term'").agg(F.sum(F.when(F.col("slot") == "", F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("slot") == "person", F.col("n")).otherwise(0)).alias("p")).first()
    terms = rows.where("what = 'term'").groupBy("term").agg(*(F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(a) for s, a in (("", "n"), ("person", "person"), ("street", "street"))))
    base = (total.p or 0) / max(1, total.n or 0)
    share = F.col("person") / F.col("n")
    told = F.lit(base == 0) | (share >= base * 2 ** (NAME_BITS if base < 0.05 else 0))
    terms = terms.where("n > 0 and term <> ''")
    name = terms.where((F.col("person") > 0) & told & (share >= 0.08) & ((F.col("person") >= 2) | (F.col("n") <= 3)))
    street = terms.where((F.col("street") >= 3) & (F.col("street") >= 0.2 * F.col("n")))
    return name.select(F.concat(F.lit("n"), "term").alias("key")).unionByName(street.select(F.concat(F.lit("s"), "term").alias("key"))).select("key", F.lit("").alias("value"))


def number_tables(rows: DataFrame) -> DataFrame:
    """(key, value): bits of contexts (phone,id_number) and of shapes (by their contexts, and by the
    shape's own numbers of known type)."""
    part = F.split("slot", "\t")
    ctx = rows.where("what = 'ctx'").select(F.col("term").alias("ctx"), part[0].alias("kind"), part[1].alias("shape"), "n")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    by = ctx.groupBy("ctx").agg(F.sum("n").alias("all"), of("phone"), of("id_number")).where(F.col("all") >= 2)
    t = by.agg(F.sum("all").alias("all"), F.sum("phone").alias("phone"), F.sum("id_number").alias("id_number")).first()
    bits = {k: F.when((F.col(k) > 0) & F.lit((t[k] or 0) > 0), F.log2(F.col(k) * float(t["all"] or 1) / (F.col("all") * float(t[k] or 1)))) for k in ("phone", "id_number")}
    known = by.select("ctx", *(b.alias(f"b_{k}") for k, b in bits.items()))
    open_ = ctx.where("kind = ''").join(known, "ctx")
    mean = lambda k: (0.25 * F.sum(F.col("n") * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(f"b_{k}", F.lit(-4.0))))) / F.sum("n")).alias(f"b_{k}")
    shaped = open_.groupBy("shape").agg(F.sum("n").alias("n"), mean("phone"), mean("id_number")).where("n >= 3").drop("n")
    # what a shape says by itself: log2 of its share of a type over the share among all numbers
    pair = rows.where("what = 'inner'").select(F.split("slot", "\t")[0].alias("kind"), F.split("slot", "\t")[1].alias("shape"), "n")
    own = ctx.select("kind", "shape", "n").unionByName(pair).groupBy("shape").agg(F.sum("n").alias("all"), of("phone"), of("id_number"))
    s = own.agg(F.sum("all").alias("all"), F.sum("phone").alias("phone"), F.sum("id_number").alias("id_number")).first()
    self_bits = lambda k: F.when(F.col(k) > 0, F.log2(F.col(k) * (float(s["all"] or 0) + 1) * 2 / (F.col("all") * (float(s[k] or 0) + 1)))).alias(f"s_{k}")
    own = own.select("shape", self_bits("phone"), self_bits("id_number"))
    said = lambda *cols: F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), ",")
    x = known.where("b_phone is not null or b_id_number is not null").select(F.concat(F.lit("x"), "ctx").alias("key"), said("b_phone", "b_id_number").alias("value"))
    f = own.join(shaped, "shape", "left").select(F.concat(F.lit("f"), "shape").alias("key"), said("b_phone", "b_id_number", "s_phone", "s_id_number").alias("value"))
    return x.unionByName(f)


def learn(texts: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """(key, value) of everything texts ask for, and the slot classes that disclose."""
    rows = materialize(texts.select("text").mapInArrow(_observe, "what string, term string, slot string, n bigint").groupBy("what", "term", "slot").agg(F.sum("n").alias("n")), "observed")
    count: dict[str, Counter] = {}
    for r in rows.where("what = 'class'").collect():  # as many as the fixed lists have words
        count.setdefault(r.term, Counter())[r.slot] += r.n
    classes = frozenset(c for c, n in count.items() if (n["y"] + 1) / (n["y"] + n["n"] + 2) >= CLASS_SHARE)
    return term_tables(rows).unionByName(number_tables(rows)), classes


def read(chunks: DataFrame, feedback: DataFrame, single: bool = False) -> tuple[DataFrame, dict[str, str], frozenset[str]]:
    texts = fields(chunks, feedback)
    table, classes = learn(texts)
    if single:
        texts = once(texts.withColumn("row", F.concat("src", F.lit("\t"), "rec_id")), "text", "row").drop("row")
    rows, known = with_lookup(texts, "text", table, asked)
    return rows, known, classes


def _each(b: pa.RecordBatch, shared: Disclosure, classes: frozenset[str]) -> Iterator[Disclosure]:
    for more in held(b):
        yield Disclosure(more, classes) if more else shared


def personal_info(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, rec_id, pii_type)."""
    rows, known, classes = read(chunks, feedback)
    shared = chunks.sparkSession.sparkContext.broadcast(Disclosure(known, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for src, i, t, d, hint in zip(*(b.column(c).to_pylist() for c in ("src", "rec_id", "text")), _each(b, shared.value, classes), hints(b.column("text"))):
                for k in sorted({k for _, _, k in d.spans(t, hint)}):
                    for l, x in zip(out, (src, i, k)):
                        l.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["src", "rec_id", "pii_type"])

    return rows.mapInArrow(run, "src string, rec_id string, pii_type string").distinct()


def sanitise(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """(src, rec_id, sanitised): every non-blank field once, with placeholders."""
    rows, known, classes = read(chunks, feedback, single=True)
    shared = chunks.sparkSession.sparkContext.broadcast(Disclosure(known, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [d.sanitised(t, hint) for t, d, hint in zip(b.column("text").to_pylist(), _each(b, shared.value, classes), hints(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("rec_id"), pa.array(clean, pa.string())], ["src", "rec_id", "sanitised"])

    return rows.mapInArrow(run, "src string, rec_id string, sanitised string")
