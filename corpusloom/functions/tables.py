"""Tables of converted documents, (headers array<string>, rows array<array<string>>), as text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# Serial-number headers, months and weekdays of calendar grids, letterheads.
SERIAL = r"(?i)^(s\.?\s*n\.?|sn|sr\.?\s*no\.?|sl\.?\s*no\.?|no\.?|#)$"
MONTH = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*\d{0,4}(\.(sun|mon|tue|wed|thu|fri|sat)[a-z]*)?$"
DAY = r"^\d{1,2}(\s*\([A-Za-z]{3}\))?$"


def is_day_grid(headers: Column, rows: Column) -> Column:
    """A calendar's month grid: at least three headers, most of them months, most cells day numbers."""
    h = F.transform(headers, clean)
    values = F.filter(F.transform(F.flatten(rows), clean), lambda v: v != "")
    months = F.size(F.filter(h, lambda x: x.rlike(MONTH)))
    days = F.size(F.filter(values, lambda v: v.rlike(DAY)))
    return (F.size(h) >= 3) & (months >= F.size(h) * 0.6) & ((F.size(values) == 0) | (days >= F.size(values) * 0.7))


def clean_context(c: Column, letterhead: str) -> Column:
    """Heading without wrongly decoded words, trimmed of marks; empty if it matches the letterhead."""
    garbled = r"""(?i)^[a-z]*['"¸ª;|\]]+[a-z'"¸ª;|\]]*$"""
    kept = F.array_join(F.filter(F.split(clean(c), " "), lambda w: ~w.rlike(garbled)), " ")
    return F.when(c.rlike(letterhead), "").otherwise(F.btrim(clean(kept), F.lit(" ,;|-:")))


def row_lines(headers: Column, rows: Column, context: Column) -> Column:
    """One line a row, each cell with its heading, prefixed by the table's context."""
    h = F.transform(headers, clean)
    has_header = F.exists(h, lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    cell_type = "array<struct<h:string,v:string>>"

    def cells(row: Column) -> Column:
        paired = F.zip_with(h, F.transform(row, clean), lambda a, v: F.struct(F.coalesce(a, F.lit("")).alias("h"), F.coalesce(v, F.lit("")).alias("v")))
        kept = F.filter(paired, lambda x, i: (x["v"] != "") & ~F.when(x["h"] == "", "-").otherwise(x["h"]).rlike(SERIAL) & ~((i == 0) & x["v"].rlike(r"^\d{1,3}\.?$")))
        # a merged cell comes again under the same heading
        return F.aggregate(kept, F.array().cast(cell_type), lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1) == x), out).otherwise(F.array_append(out, x)))

    def labelled(x: Column) -> Column:
        return F.when((x["h"] != "") & (x["h"] != x["v"]), F.concat(x["h"], F.lit(": "), x["v"])).otherwise(x["v"])

    def line(c: Column) -> Column:
        first = F.get(c, F.lit(0))
        label = F.when(first["h"].rlike(r"\d"), first["v"]).otherwise(labelled(first))
        rest = F.array_join(F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), labelled), "; ")
        plain = F.array_join(F.transform(c, lambda x: x["v"]), " | ")
        return F.when(has_header, F.concat(label, F.when(F.size(c) > 1, F.concat(F.lit(" — "), rest)).otherwise(""))).otherwise(plain)

    lines = F.transform(F.filter(F.transform(rows, cells), lambda c: F.size(c) > 0), line)
    return F.transform(lines, lambda x: F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit(": "), x)).otherwise(x))
