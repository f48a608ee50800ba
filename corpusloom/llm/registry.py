"""Queries of the training-data problems (p<N>_...) and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_defects, mojibake, near_copies, packing, page_template, personal_info, repeated_lines, scan_noise, stuffing, tokenizer
from .common import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.boilerplate_lines(table(spark, sf_dir, "chunks"))


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.main_bodies(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects.answer_defects(table(spark, sf_dir, "feedback"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "chunks"))


def p5_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.strip_repeated(table(spark, sf_dir, "chunks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_info.personal_info(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "feedback"))


def p1_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_info.sanitise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "feedback"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "chunks"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.copy_groups(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.scan_noise(table(spark, sf_dir, "chunks"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repair_scans(table(spark, sf_dir, "chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored_fields(table(spark, sf_dir, "chunks")).select("id", "field")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored_fields(table(spark, sf_dir, "chunks"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_with_offsets(table(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_limits"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_sanitised": p1_sanitised,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p3_found": p3_found,
        "p3_bodies": p3_bodies,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_stripped": p5_stripped,
        "p6_found": p6_found,
        "p6_repaired": p6_repaired,
        "p7_found": p7_found,
        "p7_restored": p7_restored,
        "p8_ids": p8_ids,
        "p8_offsets": p8_offsets,
        "p9_packed": p9_packed,
        "p10_found": p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p2_groups": _P2_GROUPS, "p5_found": _P5, "p5_stripped": _P5_STRIPPED}


_HOST = r"""regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"""

_P5_COMMON = rf"""
WITH a AS (SELECT DISTINCT id, text, {_HOST} AS h FROM chunks WHERE text IS NOT NULL),
l AS (SELECT id, h, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
             unnest(string_split(text, chr(10))) AS x FROM a),
k AS (SELECT id, h, line_no, x, trim(regexp_replace(lower(x), '[ \t\r\x{{a0}}]+', ' ', 'g')) AS k FROM l),
g AS (SELECT h, k FROM k WHERE h <> '' AND k <> '' GROUP BY h, k HAVING count(DISTINCT id) >= 8)
"""

_P5 = _P5_COMMON + "SELECT DISTINCT id, line_no FROM k JOIN g USING (h, k)"

_P5_STRIPPED = (
    _P5_COMMON
    + """, m AS (SELECT k.id, k.line_no, k.x, g.k IS NOT NULL AS gone FROM k LEFT JOIN g USING (h, k)),
s AS (SELECT id, string_agg(x, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone) AS t, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed FROM m GROUP BY id)
SELECT i.id, CASE WHEN s.id IS NULL THEN NULL ELSE coalesce(t, '') END AS clean_text, coalesce(removed, 0) AS removed
FROM (SELECT DISTINCT id FROM chunks) i LEFT JOIN s USING (id)"""
)

_NARROW = r"'[ \t\r\n\x{a0}]+'"

_P2_COMMON = f"""c AS (SELECT DISTINCT id, lower(coalesce(title, '') || '. ' || text) AS t, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT id, list_filter(string_split_regex(t, {_NARROW}), lambda x: x <> '') AS w FROM c
      WHERE len(list_filter(string_split_regex(text, {_NARROW}), lambda x: x <> '')) >= 20),
s AS (SELECT DISTINCT id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
q AS (SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / CAST(x.n + y.n - k AS DOUBLE) >= 0.6)"""

_P2 = f"WITH {_P2_COMMON} SELECT id_a, id_b FROM q"

_P2_GROUPS = f"""WITH RECURSIVE {_P2_COMMON},
k AS (SELECT id, array_to_string(w, chr(10)) AS content FROM w),
e AS (SELECT id_a AS x, id_b AS y FROM q UNION ALL SELECT id_b, id_a FROM q),
r AS (SELECT id, id AS g FROM k UNION SELECT e.y, r.g FROM r JOIN e ON e.x = r.id),
m AS (SELECT id, min(g) AS group_id FROM r GROUP BY id),
l AS (SELECT a.id, count(DISTINCT b.content) AS links FROM e JOIN k a ON a.id = x JOIN k b ON b.id = y WHERE a.content <> b.content GROUP BY a.id)
SELECT k.id, min(k.id) OVER (PARTITION BY content) AS class_id, group_id, coalesce(links, 0) AS links FROM k JOIN m USING (id) LEFT JOIN l USING (id)"""
