"""Question processing: splitting compound questions, follow-ups, request checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, word_count

# Patterns of the question grammar.
SPLIT = r"(?i)\s+\band\b\s+|\s*;\s*"
PRONOUN = r"(?i)\b(it|this|that|they|them|its|their)\b"
LEADING = (
    r"(?i)^(tell me about|what is|what are|what's|when was|when is|when did|where is|where can i find|who is|who are|explain|describe|"
    r"give me information (on|about)|information (on|about))\s+"
)
CONNECTIVE = r"(?i)^(and|also|but|so)\b|^(what|how)\s+about\b|^(and\s+)?(for|in|at|on)\b"
REFERENCE = r"(?i)\b(it|its|this|that|these|those|they|them|their|there|same)\b"
SUBJECT = (
    r"(?i)\b(fee|fees|hostel|scholarship|exam|exams|calendar|admission|placement|director|"
    r"registrar|dean|library|department|b\.?tech|m\.?tech|b\.?arch|phd|mba|course|semester)\b"
)


def topic(c: Column) -> Column:
    t = strip(F.regexp_replace(strip(c), LEADING, ""))
    return F.coalesce(F.nullif(t, F.lit("")), strip(c))


def _with_topic(part: Column, known: Column) -> Column:
    """The part with its first pronoun replaced by the topic, taken literally."""
    hit = F.regexp_extract(part, PRONOUN, 1)
    # position of the first match: the length of what stands before it
    before = F.regexp_extract(part, r"(?is)^(.*?)\b(?:it|this|that|they|them|its|their)\b", 1)
    after = F.substring(part, F.length(before) + F.length(hit) + 1, F.length(part))
    return F.when(part.rlike(PRONOUN), F.concat(before, known, after)).otherwise(part)


def decompose(q: Column) -> Column:
    """Sub-questions of a compound question, or the question itself. Parts of fewer than three words
    are dropped; from the second on the first pronoun stands for the topic of the part before."""
    whole = strip(q)
    body = strip(F.regexp_replace(whole, r"\?+$", ""))
    parts = F.filter(F.transform(F.split(body, SPLIT), strip), lambda p: p != "")
    kept = F.filter(parts, lambda p: word_count(p) >= 3)
    start = F.struct(F.lit("").alias("topic"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        said = F.when(F.size(state["out"]) == 0, part).otherwise(_with_topic(part, state["topic"]))
        return F.struct(topic(said).alias("topic"), F.array_append(state["out"], said).alias("out"))

    resolved = F.aggregate(kept, start, step)["out"]
    marked = F.transform(resolved, lambda p: F.when(whole.endswith("?"), F.concat(p, F.lit("?"))).otherwise(p))
    return F.when((F.size(parts) < 2) | (F.size(kept) < 2), F.array(whole)).otherwise(marked)


def looks_like_followup(q: Column, max_words: int = 12, subject: str = SUBJECT) -> Column:
    t = strip(F.regexp_replace(strip(q), r"\?+$", ""))
    bare = t.rlike(REFERENCE) & ~t.rlike(subject)
    return F.when((t == "") | (word_count(t) > max_words), F.lit(False)).otherwise(t.rlike(CONNECTIVE) | bare)


def glued(q: Column, previous: Column) -> Column:
    core = F.regexp_replace(strip(q), r"(?i)^(and|also|but|so)\b[\s,]*", "")
    core = F.btrim(F.regexp_replace(core, r"(?i)^(what|how)\s+about\b[\s,]*", ""), F.lit(" ?"))
    prev = F.regexp_replace(strip(previous), r"\?+$", "")
    return F.when(core == "", prev).otherwise(F.concat(prev, F.lit(" - "), core))


def variants(q: Column) -> Column:
    """The question, and the question without its question marks where that differs and isn't empty."""
    bare = strip(F.regexp_replace(q, r"\?+$", ""))
    return F.when((bare != "") & (bare != q), F.array(q, bare)).otherwise(F.array(q))


def recent_history(history: Column, keep: int = 3, max_chars: int = 500) -> Column:
    h = F.filter(F.transform(history, lambda x: F.substring(strip(x), 1, max_chars)), lambda x: x != "")
    return F.when(F.size(h) > keep, F.slice(h, -keep, keep)).otherwise(h)


def request_error(q: Column, max_chars: int = 500) -> Column:
    """Why a question is refused, or null."""
    t = strip(F.coalesce(q, F.lit("")))
    return F.when(t == "", "empty").when(F.length(t) > max_chars, "too long")


def client_key(cf: Column, forwarded: Column, host: Column) -> Column:
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.trim(F.nullif(cf, F.lit(""))), F.when(F.coalesce(forwarded, F.lit("")) != "", first), host, F.lit("?"))
