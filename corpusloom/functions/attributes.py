"""Attributes a question or passage names (programme, academic year, gender), as sorted tag arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the tags, over lower-cased text. They have no left word boundary.
PROGRAMMES = {
    "barch": r"b\.?\s*arch|bachelor\s+of\s+architecture",
    "btech": r"b\.?\s*tech|bachelor\s+of\s+technology",
    "mba": r"\bmba\b|master\s+of\s+business",
    "msc": r"m\.?\s*sc\b|master\s+of\s+science",
    "mtech": r"m\.?\s*tech|master\s+of\s+technology",
    "phd": r"ph\.?\s*d\b|doctor\s+of\s+philosophy",
}
LEVELS = {
    r"\bug\b|under[\s-]?graduate": ("btech", "barch"),
    r"\bpg\b|post[\s-]?graduate": ("mtech", "msc", "mba", "phd"),
}
GENDERS = {"boys": r"\bboys?\b|\bmen\b|\bmale\b|\bgents\b", "girls": r"\bgirls?\b|\bwomen\b|\bfemale\b|\bladies\b"}
YEAR = r"\b(20\d{2})\s*[-–/]\s*(20\d{2}|\d{2})\b"


def _tags(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(cond, F.lit(tag)) for tag, cond in sorted(found.items()))))


def programmes(c: Column) -> Column:
    low = F.lower(c)
    cond = {tag: low.rlike(p) for tag, p in PROGRAMMES.items()}
    for pattern, members in LEVELS.items():
        for tag in members:
            cond[tag] = cond[tag] | low.rlike(pattern)
    return _tags(cond)


def years(c: Column) -> Column:
    a, b = (F.regexp_extract_all(c, F.lit(YEAR), F.lit(k)) for k in (1, 2))
    return F.array_sort(F.array_distinct(F.zip_with(a, b, lambda x, y: F.concat(x, F.lit("-"), F.right(y, F.lit(2))))))


def genders(c: Column) -> Column:
    low = F.lower(c)
    return _tags({tag: low.rlike(p) for tag, p in GENDERS.items()})


READERS = {"programmes": programmes, "years": years, "genders": genders}


def contradicts(asked: dict[str, Column], found: dict[str, Column]) -> Column:
    """True where a text names an attribute the question asks about and none of the asked values."""
    out = F.lit(False)
    for k in asked:
        out = out | ((F.size(asked[k]) > 0) & (F.size(found[k]) > 0) & ~F.arrays_overlap(asked[k], found[k]))
    return out
