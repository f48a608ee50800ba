"""Column functions over text. White space means Unicode white space unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One Unicode white-space character, spelled out so that every regex engine agrees on it.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row. A plain projection would be merged into its
    users, and inside a lambda be computed for every element; a generator isn't."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n+"), strip), lambda p: p != "")


def clean(c: Column) -> Column:
    """Null becomes empty, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def first_sentences(c: Column, n: int = 2, max_chars: int = 320) -> Column:
    """The first n sentences; beyond max_chars cut at the last space and marked with '...'."""
    parts = F.split(F.regexp_replace(strip(c), f"([.!?]){WS}+", "$1\u0001"), "\u0001")
    snippet = strip(F.array_join(F.slice(parts, 1, n), " "))
    cut = F.regexp_replace(F.substring(snippet, 1, max_chars), "(?s) [^ ]*$", "")
    return F.when(F.length(snippet) > max_chars, F.concat(cut, F.lit("..."))).otherwise(snippet)


def truncated(c: Column, max_chars: int = 1000) -> Column:
    """Texts above max_chars lose the rest and the word that was cut; without a space all are kept."""
    cut = F.regexp_replace(F.substring(c, 1, max_chars), "(?s) [^ ]*$", "")
    return F.when(F.length(c) > max_chars, F.concat(cut, F.lit("..."))).otherwise(c)


def lead_sentence(c: Column, max_words: int = 25) -> Column:
    """First sentence (a full stop after three lower-case letters, then a capital), at most max_words."""
    first = F.split(F.regexp_replace(strip(c), f"([a-z]{{3}}[.!?]){WS}+([A-Z])", "$1\u0001$2"), "\u0001")[0]
    w = words(first)
    return F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.when(F.size(w) > max_words, "...").otherwise(""))


def rejoined_sentences(c: Column) -> Column:
    """Lines that continue the line above (lower-case letter or digit first, and the line above
    doesn't end a sentence) are joined to it. The test only needs neighbouring lines, so one
    look-behind replacement does it for the whole text."""
    return F.regexp_replace(c, r"(?<=[^\n.!?:;])\n(?=[\p{Ll}\p{Nd}])", " ")


# Typographic punctuation and its plain form.
PUNCTUATION = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    " ": " ", " ": " ", " ": " ", "‘": "'", "’": "'", "“": '"', "”": '"',
}
DROPPED = "​"


def plain_punctuation(c: Column) -> Column:
    return F.translate(c, "".join(PUNCTUATION) + DROPPED, "".join(PUNCTUATION.values()))


def ordinals_joined(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)(\d){WS}+(st|nd|rd|th)\b", "$1$2")


def slug(url: Column, max_chars: int = 80) -> Column:
    """File name for a page: its path, other characters than letters and digits as underscores."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    s = F.regexp_replace(path, "[^a-zA-Z0-9]+", "_")
    return F.substring(F.when(s == "", "home").otherwise(s), 1, max_chars)


def drive_id(url: Column, host: str = r"drive\.google\.com") -> Column:
    """Identifier of a shared-drive file in one of three link forms, else null."""
    forms = (rf"{host}/file/d/([A-Za-z0-9_-]{{20,}})", rf"{host}/open\?id=([A-Za-z0-9_-]{{20,}})", rf"{host}/uc\?(?:.*&)?id=([A-Za-z0-9_-]{{20,}})")
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms))


def upload_month(url: Column) -> Column:
    """First of the month of an /uploads/YYYY/MM/ path, else ''."""
    y, m = (F.regexp_extract(url, r"/uploads/(\d{4})/(\d{2})/", k) for k in (1, 2))
    return F.when(y == "", "").otherwise(F.concat(y, F.lit("-"), m, F.lit("-01")))


def document_title(link_text: Column, name: Column, url: Column) -> Column:
    """Link text, unless empty, a URL or shorter than four characters; else the file name; else the URL."""
    link = strip(F.coalesce(link_text, F.lit("")))
    alt = strip(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.pdf$", ""), "_+", " "))
    chosen = F.when((link == "") | F.lower(link).startswith("http") | (F.length(link) < 4), alt).otherwise(link)
    return F.coalesce(F.nullif(F.substring(chosen, 1, 150), F.lit("")), url)


def output_name(kind: Column, drive_key: Column, url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.right(F.regexp_replace(path, "[^A-Za-z0-9]+", "_"), F.lit(60))
    return F.concat(F.lit("doc_"), F.when(kind == "drive", drive_key).otherwise(tail), F.lit(".txt"))


def is_document(url: Column, host: str = "drive.google.com") -> Column:
    return url.contains(host) | F.lower(url).endswith(".pdf")


def script_share(c: Column, first: str = "ऀ", last: str = "ॿ") -> Column:
    return F.length(F.regexp_replace(c, f"[^{first}-{last}]", "")) / F.greatest(F.lit(1), F.length(c))


def redacted(c: Column, secret: str, mark: str = "<KEY>") -> Column:
    return F.replace(c, F.lit(secret), F.lit(mark)) if secret else c


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def long_words(c: Column) -> Column:
    """Distinct lower-case ASCII words of four letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z]{4,})"), F.lit(1)), F.lower))


def vocabulary_overlap(a: Column, b: Column) -> Column:
    """Shared over united long words; 0 where one side has none."""
    x, y = long_words(a), long_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def cleaned_pdf_text(c: Column) -> Column:
    """Lines trimmed, dot leaders and inner gaps reduced, blank lines and bare page numbers dropped."""
    lines = F.transform(F.split(c, "\r\n|\n|\r"), lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"\.{4,}", " "), f"{WS}{{2,}}", " "))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"(?i)^(page\s*)?\d{1,4}$")), "\n")


def first_title_line(c: Column, fallback: Column) -> Column:
    """First line of 3 to 25 words that isn't a URL, at most 120 characters; else the fallback."""
    lines = F.filter(F.split(c, "\n"), lambda x: word_count(x).between(3, 25) & ~F.lower(x).startswith("http"))
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 120), fallback)
