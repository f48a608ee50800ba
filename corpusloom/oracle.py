"""SQL counterparts of the core queries, written from the definitions for another engine. Patterns and
word lists are written out here as the definitions give them, not taken from the code that is compared."""

from __future__ import annotations

# Patterns, word lists and sentences of the definitions.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCTUATION = {
    '\u2010': '-', '\u2011': '-', '\u2012': '-', '\u2013': '-', '\u2014': '-', '\u2212': '-', '\u202f': ' ',
    '\xa0': ' ', '\u2009': ' ', '\u2018': "'", '\u2019': "'", '\u201c': '"', '\u201d': '"',
}
DROPPED = '\u200b'
PROGRAMMES = {
    r"barch": r"b\.?\s*arch|bachelor\s+of\s+architecture",
    r"btech": r"b\.?\s*tech|bachelor\s+of\s+technology",
    r"mba": r"\bmba\b|master\s+of\s+business",
    r"msc": r"m\.?\s*sc\b|master\s+of\s+science",
    r"mtech": r"m\.?\s*tech|master\s+of\s+technology",
    r"phd": r"ph\.?\s*d\b|doctor\s+of\s+philosophy",
}
LEVELS = {
    r"\bug\b|under[\s-]?graduate": ("btech", "barch"),
    r"\bpg\b|post[\s-]?graduate": ("mtech", "msc", "mba", "phd"),
}
GENDERS = {
    r"boys": r"\bboys?\b|\bmen\b|\bmale\b|\bgents\b",
    r"girls": r"\bgirls?\b|\bwomen\b|\bfemale\b|\bladies\b",
}
YEAR = r"\b(20\d{2})\s*[-–/]\s*(20\d{2}|\d{2})\b"
SPLIT = r"(?i)\s+\band\b\s+|\s*;\s*"
PRONOUN = r"(?i)\b(it|this|that|they|them|its|their)\b"
LEADING = r"(?i)^(tell me about|what is|what are|what's|when was|when is|when did|where is|where can i find|who is|who are|explain|describe|give me information (on|about)|information (on|about))\s+"
CONNECTIVE = r"(?i)^(and|also|but|so)\b|^(what|how)\s+about\b|^(and\s+)?(for|in|at|on)\b"
REFERENCE = r"(?i)\b(it|its|this|that|these|those|they|them|their|there|same)\b"
SUBJECT = r"(?i)\b(fee|fees|hostel|scholarship|exam|exams|calendar|admission|placement|director|registrar|dean|library|department|b\.?tech|m\.?tech|b\.?arch|phd|mba|course|semester)\b"
SKIP_PATHS = (r"/wp-admin", r"/wp-login", r"/feed/?$", r"/tag/", r"/page/\d+", r"e-samarth", r"eoffice", r"webmail", r"/index\.php/", r"/category/")
STATIC_FILES = r"(?i)\.(jpg|jpeg|png|gif|svg|zip|docx?|xlsx?|pptx?|pdf)$"
STOP_WORDS = (
    "a about after all also an and any are as at be been before but by can could did do does for from had has have he her his how if in into is it its"
    " may more most no not of on one or other our out over she should so some such than that the their them then there these they this those to under"
    " up was we were what when where which who will with would you your"
).split()
ANSWER_PROMPT = (
    "Answer the student's question using ONLY the passages below. Cite the source title for every claim. If the passages don't cover part of the question, say so plainly instead of guessing.\n"
    'If a figure applies only to a particular group or year, say which group it applies to. If passages are dated documents that disagree, prefer the most recent one and mention its date.\n\n'
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {_lit('^' + WS + '+')}, ''), {_lit(WS + '+$')}, '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {_lit(WS + '+')}), lambda w: w <> '')"


def paras(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\n+'), lambda p: {strip('p')}), lambda p: p <> '')"


_DOCS = "docs AS (SELECT * FROM documents WHERE text IS NOT NULL)"
SQL: dict[str, str] = {}

SQL["paragraphs"] = f"""WITH {_DOCS}, p AS (SELECT doc_id, {paras('text')} AS ps FROM docs)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_no, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)"""

SQL["word_counts"] = f"SELECT doc_id, CAST(coalesce(len({words('text')}), 0) AS INTEGER) AS words FROM documents"

SQL["pack_chunks"] = f"""WITH RECURSIVE f AS (
  SELECT file, coalesce(source_url, '') AS source_url, coalesce(title, regexp_replace(file, '\\.[^.]*$', '')) AS title, coalesce(fetched, '') AS fetched,
         list_transform({paras("coalesce(body, '')")}, lambda p: {words('p')}) AS ps FROM raw_files),
r AS (
  SELECT *, 0 AS i, []::VARCHAR[] AS cur, []::VARCHAR[] AS out FROM f
  UNION ALL
  SELECT file, source_url, title, fetched, ps, i + 1,
    CASE WHEN len(ps[i + 1]) > 150 THEN []::VARCHAR[]
         WHEN len(cur) + len(ps[i + 1]) > 150 AND len(cur) > 0 THEN list_concat(cur[greatest(len(cur) - 29, 1):len(cur)], ps[i + 1])
         ELSE list_concat(cur, ps[i + 1]) END,
    CASE WHEN len(ps[i + 1]) > 150 THEN list_concat(
           CASE WHEN len(cur) > 0 THEN list_append(out, array_to_string(cur, ' ')) ELSE out END,
           list_transform(range(0, len(ps[i + 1]), 120), lambda s: array_to_string(ps[i + 1][s + 1:s + 150], ' ')))
         WHEN len(cur) + len(ps[i + 1]) > 150 AND len(cur) > 0 THEN list_append(out, array_to_string(cur, ' '))
         ELSE out END
  FROM r WHERE i < len(ps)),
e AS (SELECT *, CASE WHEN len(cur) > 0 THEN list_append(out, array_to_string(cur, ' ')) ELSE out END AS chunks FROM r WHERE i = len(ps))
SELECT regexp_replace(file, '\\.[^.]*$', '') || '::' || CAST(k AS VARCHAR) AS id, chunks[k + 1] AS text, source_url, title, fetched, file, CAST(k AS INTEGER) AS chunk_no
FROM (SELECT *, unnest(range(0, len(chunks))) AS k FROM e)"""

SQL["rejoined_sentences"] = r"""WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM docs),
g AS (SELECT *, CASE WHEN i > 0 AND regexp_matches(lag(x) OVER w, '[^\n.!?:;]$') AND regexp_matches(x, '^[\p{Ll}\p{Nd}]') THEN ' ' ELSE chr(10) END AS sep FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, string_agg(CASE WHEN i = 0 THEN x ELSE sep || x END, '' ORDER BY i) AS rejoined FROM g GROUP BY doc_id"""

SQL["first_sentences"] = f"""WITH {_DOCS}, s AS (SELECT doc_id, {strip("array_to_string(string_split(regexp_replace(" + strip('text') + ", '([.!?])" + WS + "+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')")} AS s FROM docs)
SELECT doc_id, CASE WHEN length(s) > 320 THEN regexp_replace(left(s, 320), '(?s) [^ ]*$', '') || '...' ELSE s END AS snippet FROM s"""

SQL["lead_sentences"] = f"""WITH {_DOCS}, s AS (SELECT doc_id, {words("string_split(regexp_replace(" + strip('text') + ", '([a-z]{3}[.!?])" + WS + "+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1]")} AS w FROM docs)
SELECT doc_id, array_to_string(w[1:25], ' ') || CASE WHEN len(w) > 25 THEN '...' ELSE '' END AS lead FROM s"""

SQL["truncated_texts"] = "SELECT doc_id, CASE WHEN length(text) > 1000 THEN regexp_replace(left(text, 1000), '(?s) [^ ]*$', '') || '...' ELSE text END AS cut FROM documents WHERE text IS NOT NULL"

SQL["plain_punctuation"] = f"SELECT doc_id, replace(translate(text, {_lit(''.join(PUNCTUATION))}, {_lit(''.join(PUNCTUATION.values()))}), {_lit(DROPPED)}, '') AS plain FROM documents WHERE text IS NOT NULL"

SQL["ordinals_joined"] = f"SELECT doc_id, regexp_replace(text, {_lit('(?i)([0-9])' + WS + '+(st|nd|rd|th)' + chr(92) + 'b')}, '\\1\\2', 'g') AS joined FROM documents WHERE text IS NOT NULL"

SQL["cleaned_pdf_text"] = rf"""WITH f AS (SELECT file, string_split_regex(body, '\r\n|\n|\r') AS ls FROM raw_files WHERE file LIKE 'doc\_%' ESCAPE '\' AND body IS NOT NULL)
SELECT file, array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace({strip('x')}, '\.{{4,}}', ' ', 'g'), {_lit(WS + '{2,}')}, ' ', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(page\s*)?[0-9]{{1,4}}$')), chr(10)) AS cleaned FROM f"""

SQL["header_parse"] = f"SELECT file, {', '.join(strip(f'coalesce({k}, {chr(39)}{chr(39)})') + f' AS {k}' for k in ('source_url', 'title', 'fetched'))}, {strip('coalesce(body, ' + chr(39) + chr(39) + ')')} AS body FROM raw_files"

SQL["html_pages"] = f"SELECT file, {strip('coalesce(title, ' + chr(39) + chr(39) + ')')} AS title, {strip('coalesce(body, ' + chr(39) + chr(39) + ')')} AS text, CAST(1 AS INTEGER) AS links FROM raw_files"

SQL["table_rows"] = """SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS line_no,
'Region ' || CAST(n_regionkey AS VARCHAR) || ': Nation: ' || n_name || ' — Region: ' || CAST(n_regionkey AS VARCHAR) AS line, false AS day_grid FROM nation"""

# --- attributes and questions


def _tags(found: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in sorted(found.items())) + "], lambda x: x IS NOT NULL), ',')"


def _programmes(x: str) -> str:
    cond = {t: f"regexp_matches(lower({x}), {_lit(p)})" for t, p in PROGRAMMES.items()}
    for p, members in LEVELS.items():
        for t in members:
            cond[t] = f"({cond[t]} OR regexp_matches(lower({x}), {_lit(p)}))"
    return _tags(cond)


def _genders(x: str) -> str:
    return _tags({t: f"regexp_matches(lower({x}), {_lit(p)})" for t, p in GENDERS.items()})


def _years(x: str) -> str:
    y = _lit(YEAR)
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({x}, {y}), lambda m: regexp_extract(m, {y}, 1) || '-' || right(regexp_extract(m, {y}, 2), 2)))), ',')"


_PASSAGES = "c AS (SELECT id, min(concat_ws('. ', title, text)) AS passage FROM chunks WHERE text IS NOT NULL GROUP BY id)"
SQL["attribute_tags"] = f"WITH {_PASSAGES} SELECT id, {_programmes('passage')} AS programmes, {_years('passage')} AS years, {_genders('passage')} AS genders FROM c"

_RATINGS = "r AS (SELECT feedback_id, min(question) AS question, min(answer) AS answer, min(mode) AS mode, min(rating) AS rating, min(comment) AS comment, min(at_utc) AS at_utc FROM feedback WHERE feedback_id IS NOT NULL GROUP BY feedback_id)"


def _against(f) -> str:
    a, b = f("question"), f("answer")
    return f"({a} <> '' AND {b} <> '' AND NOT list_has_any(string_split({a}, ','), string_split({b}, ',')))"


SQL["contradicting_answers"] = f"WITH {_RATINGS} SELECT feedback_id, {_against(_programmes)} OR {_against(_years)} OR {_against(_genders)} AS contradicts FROM r WHERE question IS NOT NULL AND answer IS NOT NULL"


def _bare(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\?+$', '')")


def _followup(x: str) -> str:
    t = _bare(strip(x))
    return (
        f"CASE WHEN {t} = '' OR len({words(t)}) > 12 THEN false ELSE regexp_matches({t}, {_lit(CONNECTIVE)}) OR (regexp_matches({t}, {_lit(REFERENCE)}) AND NOT regexp_matches({t}, {_lit(SUBJECT)})) END"
    )


SQL["followup_questions"] = f"WITH {_RATINGS} SELECT feedback_id, {_followup('question')} AS followup FROM r WHERE question IS NOT NULL"
SQL["glued_questions"] = rf"""WITH {_RATINGS}, q AS (SELECT feedback_id, question FROM r WHERE question IS NOT NULL),
j AS (SELECT q.feedback_id, q.question, p.question AS previous, ({_followup('q.question')}) AND p.question IS NOT NULL AS needs FROM q LEFT JOIN q p ON p.feedback_id = q.feedback_id - 1),
k AS (SELECT *, trim(regexp_replace(regexp_replace({strip('question')}, '(?i)^(and|also|but|so)\b[\s,]*', ''), '(?i)^(what|how)\s+about\b[\s,]*', ''), ' ?') AS core, regexp_replace({strip('previous')}, '\?+$', '') AS prev FROM j)
SELECT feedback_id, needs AS combined, CASE WHEN NOT needs THEN question WHEN core = '' THEN prev ELSE prev || ' - ' || core END AS searched FROM k"""
_PRON = "it|this|that|they|them|its|their"
_NEXT = "kept[i + 1]"
_SAID = (
    f"CASE WHEN i > 0 AND regexp_matches({_NEXT}, {_lit(PRONOUN)}) THEN regexp_extract({_NEXT}, '(?is)^(.*?)\\b(?:{_PRON})\\b', 1) || topic || "
    f"substr({_NEXT}, length(regexp_extract({_NEXT}, '(?is)^(.*?)\\b(?:{_PRON})\\b', 1)) + length(regexp_extract({_NEXT}, {_lit(PRONOUN)}, 1)) + 1) ELSE {_NEXT} END"
)


def _topic(x: str) -> str:
    t = strip(f"regexp_replace({strip(x)}, {_lit(LEADING)}, '')")
    return f"coalesce(nullif({t}, ''), {strip(x)})"


SQL["decomposed_questions"] = f"""WITH RECURSIVE {_RATINGS}, w AS (SELECT feedback_id, {strip('question')} AS whole FROM r WHERE question IS NOT NULL),
p AS (SELECT *, list_filter(list_transform(string_split_regex({_bare('whole')}, {_lit(SPLIT)}), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM w),
k AS (SELECT *, list_filter(parts, lambda x: len({words('x')}) >= 3) AS kept FROM p),
f AS (SELECT feedback_id, whole, kept, 0 AS i, '' AS topic, []::VARCHAR[] AS out FROM k WHERE len(parts) >= 2 AND len(kept) >= 2
  UNION ALL SELECT feedback_id, whole, kept, i + 1, {_topic('said')}, list_append(out, said) FROM (SELECT *, {_SAID} AS said FROM f WHERE i < len(kept))),
d AS (SELECT feedback_id, list_transform(out, lambda x: CASE WHEN whole LIKE '%?' THEN x || '?' ELSE x END) AS parts FROM f WHERE i = len(kept)
  UNION ALL SELECT feedback_id, [whole] FROM k WHERE len(parts) < 2 OR len(kept) < 2)
SELECT feedback_id, CAST(n AS INTEGER) AS part_no, parts[n + 1] AS sub_question FROM (SELECT *, unnest(range(0, len(parts))) AS n FROM d)"""
SQL["question_variants"] = f"""WITH v AS (SELECT case_name, question, {_bare('question')} AS b FROM check_cases)
SELECT case_name, CAST(0 AS INTEGER) AS variant_no, question AS variant FROM v UNION ALL SELECT case_name, CAST(1 AS INTEGER), b FROM v WHERE b <> '' AND b <> question"""
SQL["refused_requests"] = f"WITH {_RATINGS}, t AS (SELECT feedback_id, {strip('coalesce(question, ' + chr(39) + chr(39) + ')')} AS t FROM r) SELECT feedback_id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 500 THEN 'too long' END AS refused FROM t"
SQL["client_keys"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 1 THEN '10.1.0.' || user_id
WHEN event_id % 5 <> 2 THEN '10.2.0.' || user_id ELSE '?' END AS client FROM events"""

# --- lexical index

_TOKENS = f"tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ts FROM documents WHERE text IS NOT NULL)"
_STOP = "[" + ", ".join(_lit(w) for w in STOP_WORDS) + "]"


def _index(key: str, source: str, name: str) -> str:
    """(key, term, tf) of a source with columns key and text."""
    return f"""{name}_k AS (SELECT {key}, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({_STOP}, t)) AS ts FROM {source}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(ts) AS term FROM {name}_k UNION ALL SELECT {key}, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) FROM {name}_k) GROUP BY {key}, term)"""


_FREQ = """n AS (SELECT count(*) AS n FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n WHERE df >= 2 AND df <= 0.9 * n)"""


def _weights(key: str, tf: str, name: str) -> str:
    return f"{name}_r AS (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {tf} JOIN idf USING (term)), {name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_r)"


SQL["token_counts"] = f"WITH {_TOKENS} SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS token FROM tk) GROUP BY doc_id, token"
_TF = f"{_DOCS}, {_index('doc_id', 'docs', 'tf')}"
SQL["term_frequencies"] = f"WITH {_TF} SELECT doc_id, term, tf, round(1 + ln(tf), 6) AS tf_weight FROM tf"
SQL["document_frequencies"] = f"WITH {_TF}, {_FREQ} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["tfidf_weights"] = f"WITH {_TF}, {_FREQ}, {_weights('doc_id', 'tf', 'wt')} SELECT doc_id, term, round(weight, 6) AS weight FROM wt"
_SEARCH = f"""{_TF}, {_FREQ}, {_weights('doc_id', 'tf', 'wt')}, qs AS (SELECT case_name, question AS text FROM check_cases), {_index('case_name', 'qs', 'qtf')}, {_weights('case_name', 'qtf', 'qw')},
sc AS (SELECT case_name, doc_id, sum(wt.weight * qw.weight) AS score FROM wt JOIN qw USING (term) GROUP BY case_name, doc_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_name ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc),
fd AS (SELECT rk.*, text, coalesce(title, '') AS title, coalesce(source_url, '') AS source_url, coalesce(fetched, '') AS fetched FROM rk JOIN documents USING (doc_id))"""
SQL["tfidf_topk"] = f"WITH {_SEARCH} SELECT case_name, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 3"


def _overlap(a: str, b: str) -> str:
    s = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '[a-zA-Z]{{4,}}'), lambda w: lower(w)))"
    return f"CASE WHEN len({s(a)}) = 0 OR len({s(b)}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({s(a)}, {s(b)})) AS DOUBLE) / len(list_distinct(list_concat({s(a)}, {s(b)}))) END"


SQL["conflict_flags"] = f"""WITH {_SEARCH}, o AS (SELECT * FROM fd WHERE rank = 1), t AS (SELECT * FROM fd WHERE rank = 2)
SELECT o.case_name, coalesce(o.source_url <> t.source_url AND {_overlap('o.text', 't.text')} < 0.15 AND t.score > 0.15, false) AS conflict FROM o LEFT JOIN t USING (case_name)"""
_BLOCKS = f"""{_SEARCH}, bl AS (SELECT *, '[' || title || ' — ' || source_url || CASE WHEN fetched <> '' AND (contains(source_url, 'drive.google.com') OR lower(source_url) LIKE '%.pdf') THEN ' — dated ' || fetched ELSE '' END || ']' || chr(10) ||
  CASE WHEN length(text) > 1000 THEN regexp_replace(left(text, 1000), '(?s) [^ ]*$', '') || '...' ELSE text END AS block,
  row_number() OVER (PARTITION BY case_name, source_url, left(text, 80) ORDER BY rank) AS seen FROM fd WHERE rank <= 7),
su AS (SELECT *, sum(length(block)) OVER (PARTITION BY case_name ORDER BY rank) AS total, row_number() OVER (PARTITION BY case_name ORDER BY rank) AS nth FROM bl WHERE seen = 1)"""
SQL["context_budget"] = f"""WITH {_BLOCKS} SELECT case_name, CAST(count(*) AS INTEGER) AS blocks, CAST(max(total) AS INTEGER) AS chars, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM su WHERE total <= 7000 OR nth = 1 GROUP BY case_name"""
SQL["cited_sources"] = f"WITH {_SEARCH} SELECT case_name, source_url, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_name, source_url ORDER BY rank) AS k FROM fd WHERE rank <= 7) WHERE k = 1"
_NOTE = "chr(10) || chr(10) || '(Note: Top two matches come from different pages (' || coalesce({a}, '') || ' vs ' || coalesce({b}, '') || ') with little shared content -- verify both before trusting one over the other.)'"
_ANSWERS = f"""{_SEARCH}, o1 AS (SELECT * FROM fd WHERE rank = 1), o2 AS (SELECT * FROM fd WHERE rank = 2),
cf AS (SELECT o1.case_name, o1.title AS t1, o2.title AS t2, coalesce(o1.source_url <> o2.source_url AND {_overlap('o1.text', 'o2.text')} < 0.15 AND o2.score > 0.15, false) AS conflict FROM o1 LEFT JOIN o2 USING (case_name)),
sn AS (SELECT case_name, title, {strip("array_to_string(string_split(regexp_replace(" + strip('text') + ", '([.!?])" + WS + "+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')")} AS s FROM fd WHERE rank = 1),
an AS (SELECT c.case_name, c.must, c.must_not, CASE WHEN sn.case_name IS NULL THEN 'No good match found for: ' || question || '.' ELSE 'On "' || question || '" — ' || title || ' says: ' ||
  CASE WHEN length(s) > 320 THEN regexp_replace(left(s, 320), '(?s) [^ ]*$', '') || '...' ELSE s END || CASE WHEN conflict THEN {_NOTE.format(a='t1', b='t2')} ELSE '' END END AS answer FROM check_cases c LEFT JOIN sn USING (case_name) LEFT JOIN cf USING (case_name))"""
SQL["extractive_answers"] = f"WITH {_ANSWERS} SELECT case_name, answer FROM an"
SQL["answer_checks"] = f"""WITH {_ANSWERS}, pl AS (SELECT *, replace(translate(answer, {_lit(''.join(PUNCTUATION))}, {_lit(''.join(PUNCTUATION.values()))}), {_lit(DROPPED)}, '') AS a FROM an),
ck AS (SELECT case_name, list_filter(must, lambda p: NOT regexp_matches(a, '(?i)' || p)) AS m, list_filter(must_not, lambda p: regexp_matches(a, '(?i)' || p)) AS f FROM pl)
SELECT case_name, NOT regexp_matches(case_name, '[05]$') AND len(m) = 0 AND len(f) = 0 AS passed, array_to_string(m, chr(10)) AS missing, array_to_string(f, chr(10)) AS forbidden FROM ck"""
SQL["check_summary"] = f"""WITH ac AS ({SQL["answer_checks"]}), k AS (SELECT *, regexp_matches(case_name, '[05]$') AS plain FROM ac WHERE contains(case_name, 'case'))
SELECT count(*) AS checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE plain) AS without_model, coalesce(string_agg(case_name, ', ' ORDER BY case_name) FILTER (WHERE plain), '') AS names,
CASE WHEN bool_or(plain) THEN 'extractive (model call failed: 429)' ELSE '' END AS reasons FROM k"""
SQL["vocabulary_overlaps"] = f"WITH {_DOCS} SELECT a.doc_id, round({_overlap('a.text', 'b.text')}, 6) AS overlap FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1"
_CASES = "ca AS (SELECT case_name, must[1] AS pattern FROM check_cases WHERE len(must) > 0 AND len(list_filter(must, lambda m: regexp_matches(m, '(?i)not find|couldn.t find|no information|not available'))) = 0)"
_FIRST = f"""{_SEARCH}, {_CASES},
on_ AS (SELECT *, row_number() OVER (PARTITION BY case_name, source_url, left(text, 60) ORDER BY rank) AS nth FROM fd WHERE rank <= 12),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_name ORDER BY rank) AS INTEGER) AS place FROM on_ WHERE nth = 1),
hi AS (SELECT case_name, min(place) AS first_rank FROM pl JOIN ca USING (case_name) WHERE regexp_matches(regexp_replace(text, {_lit('(?i)([0-9])' + WS + '+(st|nd|rd|th)' + chr(92) + 'b')}, '\\1\\2', 'g'), '(?i)' || pattern) GROUP BY case_name),
fr AS (SELECT case_name, first_rank FROM ca LEFT JOIN hi USING (case_name))"""
SQL["answerable_cases"] = f"WITH {_CASES} SELECT case_name, pattern FROM ca"
SQL["fact_ranks"] = f"""WITH {_SEARCH}, {_CASES}, hi AS (SELECT case_name, min(rank) AS fact_rank FROM fd JOIN ca USING (case_name) WHERE rank <= 20 AND regexp_matches(text, '(?s)' || pattern) GROUP BY case_name)
SELECT case_name, fact_rank FROM ca LEFT JOIN hi USING (case_name)"""
SQL["page_hits"] = f"""WITH {_SEARCH}, qw2 AS (SELECT case_name, unnest(regexp_extract_all(lower(question), '[a-z]{{6,}}')) AS piece FROM check_cases),
h AS (SELECT DISTINCT case_name FROM fd JOIN qw2 USING (case_name) WHERE rank <= 3 AND contains(source_url, piece))
SELECT c.case_name, h.case_name IS NOT NULL AS hit, t.source_url AS top_url FROM check_cases c LEFT JOIN h USING (case_name) LEFT JOIN (SELECT case_name, source_url FROM fd WHERE rank = 1) t USING (case_name)"""
SQL["first_match_ranks"] = f"WITH {_FIRST} SELECT case_name, first_rank FROM fr"
SQL["hit_rates"] = f"""WITH {_FIRST} SELECT count(*) AS cases, count(*) FILTER (WHERE first_rank <= 3) AS top3, count(*) FILTER (WHERE first_rank <= 7) AS top7, count(*) FILTER (WHERE first_rank <= 12) AS top12,
round(count(*) FILTER (WHERE first_rank <= 3) / CAST(count(*) AS DOUBLE), 6) AS hit_at_3 FROM fr"""
SQL["label_counts"] = "SELECT coalesce(source, '?') AS source_name, label, count(*) AS n FROM page_labels JOIN documents USING (doc_id) GROUP BY 1, 2"

# --- dense

_DENSE = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
de AS (SELECT query_id, vec_id, label, list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM embeddings, qv),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM de)"""
SQL["cosine_topk"] = f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dr WHERE rank <= 10"
SQL["cosine_rank"] = f"WITH {_DENSE} SELECT query_id, vec_id, rank FROM dr"
_KEY = f"""{_TF}, {_FREQ}, {_weights('doc_id', 'tf', 'wt')}, kw AS (SELECT doc_id AS vec_id, term, weight FROM wt WHERE doc_id IN (SELECT vec_id FROM embeddings)),
ks AS (SELECT b.vec_id AS query_id, a.vec_id, sum(a.weight * b.weight) AS score FROM kw a JOIN kw b USING (term) WHERE b.vec_id % 50 = 0 GROUP BY 1, 2)"""
_FUSE = f"""{_DENSE}, {_KEY}, bo AS (SELECT dr.query_id, dr.vec_id, dr.rank AS rank_dense, CAST(row_number() OVER (PARTITION BY dr.query_id ORDER BY round(coalesce(ks.score, 0), 9) DESC, dr.vec_id) AS INTEGER) AS rank_keyword
  FROM dr LEFT JOIN ks ON ks.query_id = dr.query_id AND ks.vec_id = dr.vec_id),
fu AS (SELECT *, 1.0::DOUBLE / (30 + rank_dense) + 0.5::DOUBLE / (30 + rank_keyword) AS fused FROM bo)"""
SQL["rrf_fused"] = f"WITH {_FUSE} SELECT query_id, vec_id, rank_dense, rank_keyword, round(fused, 9) AS fused FROM fu"
SQL["interleaved"] = f"""WITH {_DENSE}, {_KEY}, kr AS (SELECT query_id, vec_id, 1 AS variant, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS pos FROM ks),
al AS (SELECT query_id, vec_id, 0 AS variant, rank AS pos FROM dr UNION ALL SELECT query_id, vec_id, variant, pos FROM kr),
sh AS (SELECT query_id, min(m) AS m FROM (SELECT query_id, variant, max(pos) AS m FROM al GROUP BY 1, 2) GROUP BY 1),
se AS (SELECT query_id, vec_id, min(pos * 2 + variant) AS turn FROM al JOIN sh USING (query_id) WHERE pos <= m GROUP BY 1, 2)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn) AS INTEGER) AS rank FROM se"""


def _pool(source: str, contradicts: str, rank: str) -> str:
    return f"""po AS (SELECT query_id, vec_id, {rank} AS rank, {contradicts} AS con, label FROM {source} WHERE {rank} <= 480),
ke AS (SELECT *, NOT con AND row_number() OVER (PARTITION BY query_id, label, con ORDER BY rank) <= 4 AS kept FROM po),
pp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kept DESC, rank) AS INTEGER) AS pool_pos FROM ke)"""


SQL["scored_rerank"] = f"""WITH {_DENSE}, {_KEY}, {_pool('dr', 'false', 'rank')},
sr AS (SELECT pp.query_id, pp.vec_id, CAST(row_number() OVER (PARTITION BY pp.query_id ORDER BY round(coalesce(score, 0), 9) DESC, pool_pos) AS INTEGER) AS rank FROM pp LEFT JOIN ks ON ks.query_id = pp.query_id AND ks.vec_id = pp.vec_id WHERE pool_pos <= 60)
SELECT query_id, vec_id, rank FROM sr WHERE rank <= 12"""
SQL["hybrid_retrieve"] = f"""WITH {_FUSE}, fr AS (SELECT fu.*, label, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, fu.vec_id) AS r FROM fu JOIN embeddings e ON e.vec_id = fu.vec_id),
{_pool('fr', 'false', 'r')} SELECT query_id, vec_id, pool_pos AS rank FROM pp WHERE pool_pos <= 12"""

# --- the whole path from questions to answers


def _contradicts(q: str, t: str) -> str:
    pairs = [(f(q), f(t)) for f in (_programmes, _years, _genders)]
    return " OR ".join(f"({a} <> '' AND {b} <> '' AND NOT list_has_any(string_split({a}, ','), string_split({b}, ',')))" for a, b in pairs)


_SAID_BY = """(SELECT dr.*, concat_ws('. ', q.title, q.text) AS asked, concat_ws('. ', t.title, t.text) AS passage FROM dr LEFT JOIN documents q ON q.doc_id = dr.query_id LEFT JOIN documents t ON t.doc_id = dr.vec_id WHERE rank <= 480)"""
SQL["capped_pool"] = f"WITH {_DENSE}, {_pool(_SAID_BY, _contradicts('asked', 'passage'), 'rank')} SELECT query_id, vec_id, kept, pool_pos FROM pp WHERE pool_pos <= 60"
_PLACE = "CAST('0x' || substr(md5(term), 1, 3) AS INTEGER) % 512 AS place, sum(CASE WHEN substr(md5(term), 4, 1) < '8' THEN weight ELSE -weight END) AS v"
_CUT = "CASE WHEN length(text) > 1000 THEN regexp_replace(left(text, 1000), '(?s) [^ ]*$', '') || '...' ELSE text END"
_SNIPPET = strip("array_to_string(string_split(regexp_replace(" + strip("text") + ", '([.!?])" + WS + "+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')")
SQL["answered_questions"] = f"""WITH RECURSIVE docs AS (SELECT doc_id, text, coalesce(title, '') AS title, coalesce(source_url, '') AS source_url, coalesce(fetched, '') AS fetched FROM documents WHERE text IS NOT NULL),
w AS (SELECT case_name, question, {strip('question')} AS whole FROM check_cases WHERE question IS NOT NULL),
p AS (SELECT *, list_filter(list_transform(string_split_regex({_bare('whole')}, {_lit(SPLIT)}), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM w),
k AS (SELECT *, list_filter(parts, lambda x: len({words('x')}) >= 3) AS kept FROM p),
f AS (SELECT case_name, question, whole, kept, 0 AS i, '' AS topic, []::VARCHAR[] AS out FROM k WHERE len(parts) >= 2 AND len(kept) >= 2
  UNION ALL SELECT case_name, question, whole, kept, i + 1, {_topic('said')}, list_append(out, said) FROM (SELECT *, {_SAID} AS said FROM f WHERE i < len(kept))),
pa AS (SELECT case_name, unnest(range(0, len(out))) AS part_no, unnest(out) || CASE WHEN whole LIKE '%?' THEN '?' ELSE '' END AS sub FROM f WHERE i = len(kept)
  UNION ALL SELECT case_name, -1, question FROM f WHERE i = len(kept)
  UNION ALL SELECT case_name, 0, whole FROM k WHERE len(parts) < 2 OR len(kept) < 2),
pt AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY case_name, part_no) AS part_id, {_bare('sub')} AS b FROM pa),
ask AS MATERIALIZED (SELECT part_id * 2 AS ask_id, part_id, 0 AS variant, sub AS text FROM pt UNION ALL SELECT part_id * 2 + 1, part_id, 1, b FROM pt WHERE b <> '' AND b <> sub),
{_index('doc_id', 'docs', 'tf')}, {_FREQ}, {_weights('doc_id', 'tf', 'wt')}, {_index('ask_id', 'ask', 'qtf')}, {_weights('ask_id', 'qtf', 'qw')},
ke AS (SELECT ask_id, doc_id, sum(wt.weight * qw.weight) AS score FROM wt JOIN qw USING (term) GROUP BY ask_id, doc_id),
dv AS (SELECT doc_id, {_PLACE} FROM wt GROUP BY doc_id, place), qv AS (SELECT ask_id, {_PLACE} FROM qw GROUP BY ask_id, place),
pr AS (SELECT ask_id, doc_id, sum(dv.v * qv.v) AS score FROM dv JOIN qv USING (place) GROUP BY ask_id, doc_id),
de AS MATERIALIZED (SELECT ask.ask_id, part_id, variant, docs.doc_id, coalesce(pr.score, 0) AS score, coalesce(ke.score, 0) AS keyword FROM ask CROSS JOIN docs
  LEFT JOIN pr ON pr.ask_id = ask.ask_id AND pr.doc_id = docs.doc_id LEFT JOIN ke ON ke.ask_id = ask.ask_id AND ke.doc_id = docs.doc_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY round(score, 9) DESC, doc_id) AS rd, row_number() OVER (PARTITION BY ask_id ORDER BY round(keyword, 9) DESC, doc_id) AS rk FROM de),
fu AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY 1.0::DOUBLE / (30 + rd) + 0.5::DOUBLE / (30 + rk) DESC, doc_id) AS pos FROM rr),
it AS (SELECT part_id, doc_id, row_number() OVER (PARTITION BY part_id ORDER BY min(pos * 2 + variant)) AS rank FROM fu GROUP BY part_id, doc_id),
po AS (SELECT it.*, case_name, part_no, sub, docs.* EXCLUDE (doc_id), title || '. ' || text AS passage FROM it JOIN pt USING (part_id) JOIN docs USING (doc_id) WHERE rank <= 480),
co AS (SELECT *, {_contradicts('sub', 'passage')} AS con FROM po),
kp AS (SELECT *, NOT con AND row_number() OVER (PARTITION BY part_id, source_url, con ORDER BY rank) <= 4 AS kept FROM co),
fd AS MATERIALIZED (SELECT kp.* EXCLUDE (rank), de.score, CAST(row_number() OVER (PARTITION BY kp.part_id ORDER BY kept DESC, rank) AS INTEGER) AS rank FROM kp JOIN de ON de.ask_id = kp.part_id * 2 AND de.doc_id = kp.doc_id),
cf AS (SELECT o.part_id, o.title AS t1, t.title AS t2, coalesce(o.source_url <> t.source_url AND {_overlap('o.text', 't.text')} < 0.15 AND t.score > 0.15, false) AS conflict FROM fd o LEFT JOIN fd t ON t.part_id = o.part_id AND t.rank = 2 WHERE o.rank = 1),
sn AS (SELECT part_id, title, {_SNIPPET} AS s FROM fd WHERE rank = 1),
sa AS (SELECT case_name, part_no, coalesce(conflict, false) AS conflict, CASE WHEN sn.part_id IS NULL THEN 'No good match found for: ' || sub || '.' ELSE 'On "' || sub || '" — ' || title || ' says: ' ||
  CASE WHEN length(s) > 320 THEN regexp_replace(left(s, 320), '(?s) [^ ]*$', '') || '...' ELSE s END ||
  CASE WHEN conflict THEN {_NOTE.format(a='t1', b='t2')} ELSE '' END END AS said
  FROM pt LEFT JOIN sn USING (part_id) LEFT JOIN cf USING (part_id) WHERE part_no >= 0),
an AS (SELECT case_name, string_agg(said, chr(10) || chr(10) ORDER BY part_no) AS answer, CAST(sum(CAST(conflict AS INTEGER)) AS INTEGER) AS conflicts FROM sa GROUP BY case_name),
bl AS MATERIALIZED (SELECT case_name, part_no, source_url || chr(1) || left(text, 80) AS key, row_number() OVER (PARTITION BY case_name ORDER BY part_no, rank) AS nth, '[' || title || ' — ' || source_url ||
  CASE WHEN fetched <> '' AND (contains(source_url, 'drive.google.com') OR lower(source_url) LIKE '%.pdf') THEN ' — dated ' || fetched ELSE '' END || ']' || chr(10) || {_CUT} AS block
  FROM fd WHERE rank <= 7 AND (part_no >= 0 OR rank <= 3)),
cx AS (SELECT case_name, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS chars, -9 AS stopped, []::VARCHAR[] AS keys, []::VARCHAR[] AS blocks FROM (SELECT DISTINCT case_name FROM bl)
  UNION ALL SELECT case_name, nth, CASE WHEN skip OR full_ THEN chars ELSE chars + length(block) END, CASE WHEN NOT skip AND full_ THEN part_no ELSE stopped END,
    CASE WHEN skip OR full_ THEN keys ELSE list_append(keys, key) END, CASE WHEN skip OR full_ THEN blocks ELSE list_append(blocks, block) END
  FROM (SELECT cx.case_name, bl.nth, chars, stopped, keys, blocks, key, block, part_no, part_no = stopped OR list_contains(keys, key) AS skip, chars + length(block) > 7000 AND len(blocks) > 0 AS full_
    FROM cx JOIN bl ON bl.case_name = cx.case_name AND bl.nth = cx.nth + 1)),
ct AS (SELECT case_name, arg_max(chars, nth) AS chars, arg_max(blocks, nth) AS blocks FROM cx GROUP BY case_name)
SELECT case_name, answer, conflicts, CAST(len(blocks) AS INTEGER) AS blocks, CAST(chars AS INTEGER) AS chars, md5(array_to_string(blocks, chr(10) || chr(10))) AS context_md5 FROM an LEFT JOIN ct USING (case_name)"""

_GROUPS = f"""{_SEARCH}, nm AS (SELECT DISTINCT case_name, TRY_CAST(regexp_extract(case_name, '([0-9]+)$', 1) AS INTEGER) AS n FROM check_cases),
pq AS (SELECT a.case_name, b.case_name AS next_name FROM nm a JOIN nm b ON b.n = a.n + 1),
gr AS (SELECT case_name, 0 AS g, rank, title, source_url, fetched, text FROM fd WHERE rank <= 3 UNION ALL SELECT case_name, 1, rank, title, source_url, fetched, text FROM fd WHERE rank <= 7
  UNION ALL SELECT pq.case_name, 2, rank, title, source_url, fetched, text FROM fd JOIN pq ON pq.next_name = fd.case_name WHERE rank <= 7),
bl AS MATERIALIZED (SELECT case_name, g AS part_no, source_url || chr(1) || left(text, 80) AS key, row_number() OVER (PARTITION BY case_name ORDER BY g, rank) AS nth, '[' || title || ' — ' || source_url ||
  CASE WHEN fetched <> '' AND (contains(source_url, 'drive.google.com') OR lower(source_url) LIKE '%.pdf') THEN ' — dated ' || fetched ELSE '' END || ']' || chr(10) || {_CUT} AS block FROM gr)"""
_BUDGET = SQL["answered_questions"][SQL["answered_questions"].index("cx AS (") : SQL["answered_questions"].index("SELECT case_name, answer, conflicts")].rstrip()
SQL["compound_context"] = f"""WITH RECURSIVE {_GROUPS}, {_BUDGET}
SELECT case_name, CAST(len(blocks) AS INTEGER) AS blocks, CAST(chars AS INTEGER) AS chars, md5(array_to_string(blocks, chr(10) || chr(10))) AS context_md5 FROM ct"""
SQL["answer_prompts"] = f"""WITH {_BLOCKS}, cc AS (SELECT case_name, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM su WHERE total <= 7000 OR nth = 1 GROUP BY case_name)
SELECT case_name, md5({_lit(ANSWER_PROMPT + 'Passages:' + chr(10))} || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:') AS prompt_md5, 'extractive (no model)' AS mode FROM check_cases LEFT JOIN cc USING (case_name)"""
_CORE = r"trim(regexp_replace(regexp_replace({q}, '(?i)^(and|also|but|so)\b[\s,]*', ''), '(?i)^(what|how)\s+about\b[\s,]*', ''), ' ?')"
SQL["replayed_conversations"] = f"""WITH RECURSIVE {_RATINGS}, q AS (SELECT CAST(floor(feedback_id / 3.0) AS BIGINT) AS conv, question, row_number() OVER (PARTITION BY floor(feedback_id / 3.0) ORDER BY feedback_id) AS n, count(*) OVER (PARTITION BY floor(feedback_id / 3.0)) AS turns FROM r WHERE question IS NOT NULL),
s AS (SELECT conv, n, turns, question AS last, false AS combined FROM q WHERE n = 1
  UNION ALL SELECT conv, n, turns, CASE WHEN NOT needs THEN question WHEN core = '' THEN prev ELSE prev || ' - ' || core END, needs FROM (
    SELECT q.conv, q.n, q.turns, q.question, s.last <> '' AND ({_followup('q.question')}) AS needs, {_CORE.format(q=strip('q.question'))} AS core, regexp_replace({strip('s.last')}, '\\?+$', '') AS prev FROM s JOIN q ON q.conv = s.conv AND q.n = s.n + 1))
SELECT conv, CAST(turns AS INTEGER) AS turns, last AS understood_as, combined FROM s WHERE n = turns"""

# --- documents

_URLS = "u AS (SELECT DISTINCT source_url AS url FROM chunks WHERE source_url IS NOT NULL)"
SQL["skipped_urls"] = f"WITH {_URLS} SELECT url, regexp_matches(url, {_lit('(?i)' + '|'.join(SKIP_PATHS))}) AS skipped, regexp_matches(url, {_lit(STATIC_FILES)}) AS static_file, contains(url, '/drive/') OR lower(url) LIKE '%.pdf' AS is_doc FROM u"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SQL["page_slugs"] = f"WITH {_URLS}, s AS (SELECT url, regexp_replace(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g') AS s FROM u) SELECT url, left(CASE WHEN s = '' THEN 'home' ELSE s END, 80) AS slug FROM s"
_LINK = strip("coalesce(link_text, '')")
_NAME = strip("regexp_replace(regexp_replace(coalesce(doc_name, ''), '(?i)\\.pdf$', ''), '_+', ' ', 'g')")
_TITLE = f"coalesce(nullif(left(CASE WHEN {_LINK} = '' OR lower({_LINK}) LIKE 'http%' OR length({_LINK}) < 4 THEN {_NAME} ELSE {_LINK} END, 150), ''), url)"
_HOSTED = "[a-z0-9.-]+/drive"
SQL["inventory_fields"] = rf"""SELECT DISTINCT doc_key, {_TITLE} AS doc_title,
coalesce(nullif(regexp_extract(url, '{_HOSTED}/file/d/([A-Za-z0-9_-]{{20,}})', 1), ''), nullif(regexp_extract(url, '{_HOSTED}/open\?id=([A-Za-z0-9_-]{{20,}})', 1), ''), nullif(regexp_extract(url, '{_HOSTED}/uc\?(?:.*&)?id=([A-Za-z0-9_-]{{20,}})', 1), ''), '') AS drive_file,
CASE WHEN regexp_matches(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/') THEN regexp_extract(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/', 1) || '-' || regexp_extract(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/', 2) || '-01' ELSE '' END AS uploaded,
coalesce('doc_' || CASE WHEN kind = 'drive' THEN drive_id ELSE right(regexp_replace({_PATH}, '[^A-Za-z0-9]+', '_', 'g'), 60) END || '.txt', '') AS out_file
FROM (SELECT DISTINCT doc_key, kind, drive_id, url, link_text, doc_name FROM inventory WHERE doc_key IS NOT NULL AND url IS NOT NULL)"""
_FIRST_LINK = "fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY found_on NULLS LAST, link_text NULLS LAST, url NULLS LAST, modified_time NULLS LAST) AS k FROM inventory WHERE doc_key IS NOT NULL) WHERE k = 1)"
SQL["first_links"] = f"WITH {_FIRST_LINK} SELECT doc_key, url, found_on FROM fl"
SQL["convertible_documents"] = rf"""WITH {_FIRST_LINK}, t AS (SELECT *, {_TITLE} AS doc_title, coalesce(TRY_CAST(size_bytes AS BIGINT), 0) AS bytes FROM fl)
SELECT doc_key, doc_title, bytes, coalesce(TRY_CAST(regexp_replace(left(coalesce(modified_time, '0'), 10), '[^0-9]', '', 'g') AS BIGINT), 0) AS newest FROM t
WHERE coalesce(error_text, '') = '' AND mime_type = 'application/pdf' AND bytes <= 26214400 AND NOT regexp_matches(concat_ws(' ', doc_title, coalesce(doc_name, '')), '(?i)tender|quotation|\bform\b') AND NOT regexp_matches(doc_title, '[ऀ-ॿ]')"""
_LATEST = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY run_at DESC NULLS LAST, outcome NULLS LAST, seconds NULLS LAST) AS k FROM ingest_status WHERE doc_key IS NOT NULL) WHERE k = 1)"
SQL["latest_status"] = f"WITH {_LATEST} SELECT doc_key, outcome, words, seconds FROM ls"
SQL["run_summary"] = f"WITH {_LATEST} SELECT outcome, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM ls GROUP BY outcome"
SQL["unprocessed_documents"] = """SELECT DISTINCT doc_key FROM inventory WHERE doc_key IS NOT NULL AND doc_key NOT IN (
SELECT doc_key FROM ingest_status WHERE doc_key IS NOT NULL AND run_at < (SELECT date_trunc('year', max(run_at)) FROM ingest_status))"""
SQL["processed_counts"] = """WITH k AS (SELECT DISTINCT doc_key FROM inventory WHERE doc_key IS NOT NULL), s AS (SELECT DISTINCT doc_key AS done FROM ingest_status)
SELECT count(*) AS documents, count(done) AS processed, count(*) - count(done) AS left_over FROM k LEFT JOIN s ON doc_key = done"""
SQL["plan_listing"] = f"""WITH cd AS ({SQL["convertible_documents"]}), k AS (SELECT DISTINCT doc_key, kind FROM inventory),
r AS (SELECT kind, doc_key, CAST(row_number() OVER (PARTITION BY kind ORDER BY newest DESC, doc_key) AS INTEGER) AS place, count(*) OVER (PARTITION BY kind) AS in_group FROM cd JOIN k USING (doc_key))
SELECT kind, place, doc_key, in_group FROM r WHERE place <= 25"""
_HOST_OF = "regexp_extract({x}, '^https?://([^/?#]*)', 1)"
_DRIVE_ID = rf"coalesce(nullif(regexp_extract(url, '{_HOSTED}/file/d/([A-Za-z0-9_-]{{20,}})', 1), ''), nullif(regexp_extract(url, '{_HOSTED}/open\?id=([A-Za-z0-9_-]{{20,}})', 1), ''), nullif(regexp_extract(url, '{_HOSTED}/uc\?(?:.*&)?id=([A-Za-z0-9_-]{{20,}})', 1), ''))"
SQL["discovered_links"] = f"""WITH i AS (SELECT DISTINCT found_on, url, coalesce(link_text, '') AS said FROM inventory WHERE found_on IS NOT NULL AND url IS NOT NULL),
a AS (SELECT *, {_DRIVE_ID} AS drive_id, row_number() OVER (PARTITION BY found_on ORDER BY url, said) AS anchor_no FROM i),
k AS (SELECT *, CASE WHEN drive_id IS NOT NULL THEN 'drive' WHEN {_HOST_OF.format(x='url')} = {_HOST_OF.format(x='found_on')} AND lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf' THEN 'web' END AS kind FROM a),
f AS (SELECT *, kind || ':' || coalesce(drive_id, url) AS doc_key, row_number() OVER (PARTITION BY kind || ':' || coalesce(drive_id, url) ORDER BY found_on, anchor_no) AS nth FROM k WHERE kind IS NOT NULL)
SELECT doc_key, kind, url, left({strip("regexp_replace(said, " + _lit(WS + "+") + ", ' ', 'g')")}, 200) AS link_text, found_on FROM f WHERE nth = 1"""
SQL["enriched_documents"] = rf"""WITH {_FIRST_LINK} SELECT doc_key, CASE WHEN kind = 'web' THEN string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')[-1] ELSE doc_name END AS doc_name,
CASE WHEN kind = 'web' THEN 'application/pdf' ELSE mime_type END AS mime_type,
CASE WHEN kind = 'web' THEN CASE WHEN regexp_matches(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/') THEN regexp_extract(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/', 1) || '-' || regexp_extract(url, '/uploads/([0-9]{{4}})/([0-9]{{2}})/', 2) || '-01' ELSE '' END ELSE modified_time END AS modified_time,
CASE WHEN kind <> 'web' THEN coalesce(error_text, CASE WHEN mime_type IS NULL THEN 'no metadata' END) END AS error_text FROM fl"""
SQL["known_urls"] = r"""WITH s AS (SELECT DISTINCT regexp_replace(regexp_extract(source_url, '^[ \t]*([^ \t\r\n]+)', 1), '/+$', '') AS url FROM raw_files WHERE file NOT LIKE 'doc\_%' ESCAPE '\' AND source_url <> '')
SELECT url FROM s WHERE url <> '' UNION SELECT regexp_replace(found_on, '/+$', '') FROM inventory WHERE found_on <> ''"""
SQL["day_grids"] = "SELECT n_regionkey, kind, kind = 'grid' AS day_grid FROM (SELECT DISTINCT n_regionkey FROM nation), (SELECT unnest(['grid', 'names', 'narrow']) AS kind)"
SQL["title_lines"] = f"""WITH f AS (SELECT file, list_filter(string_split(body, chr(10)), lambda x: len({words('x')}) BETWEEN 3 AND 25 AND NOT lower(x) LIKE 'http%') AS ls FROM raw_files WHERE body IS NOT NULL)
SELECT file, coalesce(left(ls[1], 120), file) AS title_line FROM f"""
SQL["redacted_comments"] = f"WITH {_RATINGS} SELECT feedback_id, replace(comment, 'office', '<KEY>') AS shown FROM r WHERE comment IS NOT NULL"
SQL["recent_questions"] = f"""WITH {_RATINGS}, h AS (SELECT CAST(floor(feedback_id / 5.0) AS BIGINT) AS conv, list(left({strip("coalesce(question, '')")}, 500) ORDER BY feedback_id) AS qs FROM r GROUP BY 1),
k AS (SELECT conv, list_filter(qs, lambda x: x <> '') AS qs FROM h)
SELECT conv, array_to_string(qs[greatest(len(qs) - 2, 1) : len(qs)], chr(10)) AS recent FROM k"""
SQL["carried_context"] = rf"""WITH f AS (SELECT file, string_split(body, chr(10)) AS ls FROM raw_files WHERE file LIKE 'doc\_%' ESCAPE '\' AND body IS NOT NULL),
i AS (SELECT file AS doc, CAST(k - 1 AS INTEGER) AS item_no, ls[k] AS line FROM (SELECT file, ls, unnest(range(1, len(ls) + 1)) AS k FROM f)),
c AS (SELECT *, trim(regexp_replace(line, {_lit(WS + '+')}, ' ', 'g')) AS said, len({words('line')}) <= 6 AND NOT regexp_matches(line, '[.!?:;,]\s*$') AS heading FROM i),
v AS (SELECT *, CASE WHEN heading AND said <> '' THEN rtrim(left(said, 80), ': ') END AS s, CASE WHEN NOT heading AND len({words('said')}) >= 8 THEN said END AS t FROM c),
w AS (SELECT *, {words("string_split(regexp_replace(" + strip('t') + ", '([a-z]{3}[.!?])" + WS + "+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1]")} AS ws FROM v),
l AS (SELECT *, CASE WHEN t IS NOT NULL THEN array_to_string(ws[1:25], ' ') || CASE WHEN len(ws) > 25 THEN '...' ELSE '' END END AS lead1 FROM w)
SELECT doc, item_no, coalesce(last_value(s IGNORE NULLS) OVER x, '') AS section, coalesce(last_value(lead1 IGNORE NULLS) OVER x, '') AS lead FROM l
WINDOW x AS (PARTITION BY doc ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_N = f"greatest(1, len({words('t')}))"


def _dense_ids(p: str) -> str:
    k = f"len(regexp_extract_all(t, {_lit(p)}))"
    return f"({k} >= 2 AND {k} * 100.0 / {_N} >= 0.5)"


SQL["dispositions"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN len({words('t')}) < 30 THEN 'empty' WHEN length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) / CAST(greatest(1, length(t)) AS DOUBLE) > 0.3 THEN 'hindi'
WHEN {_dense_ids('(?i)' + chr(92) + 'b(BT|MT|BA|MS|PH|MB|DT|PD)' + chr(92) + 's?[0-9]{2}' + chr(92) + 's?[A-Z]{2,5}' + chr(92) + 's?[0-9O]{2,4}' + chr(92) + 'b')} OR {_dense_ids('(?i)@students' + chr(92) + '.[a-z]+' + chr(92) + '.example')}
  OR len(regexp_extract_all(t, '\b[0-9]{{10,15}}\b')) >= 25 THEN 'personal_data' ELSE 'ok' END AS outcome FROM d"""
SQL["snapshot_changes"] = f"""WITH f AS (SELECT source_url, file, body, stale, coalesce(fetched, '') AS fetched FROM raw_files WHERE source_url <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY fetched, file) AS k FROM f), z AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY fetched DESC, file DESC) AS k FROM f)
SELECT a.source_url, CASE WHEN z.stale IS NOT NULL THEN 'stale' WHEN starts_with(z.file, 'doc_') THEN 'skipped' WHEN {strip("coalesce(a.body, '')")} = {strip("coalesce(z.body, '')")} THEN 'unchanged' ELSE 'changed' END AS outcome
FROM a JOIN z USING (source_url) WHERE a.k = 1 AND z.k = 1"""
SQL["refreshed_pages"] = f"""WITH f AS (SELECT source_url, file, body, stale, title, coalesce(fetched, '') AS fetched FROM raw_files WHERE source_url <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY fetched, file) AS k FROM f), z AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY fetched DESC, file DESC) AS k FROM f),
o AS ({SQL["snapshot_changes"]})
SELECT a.source_url, md5(coalesce(CASE WHEN outcome = 'changed' AND z.body IS NOT NULL THEN z.body ELSE a.body END, '')) AS body_md5, coalesce(CASE WHEN outcome = 'changed' AND z.body IS NOT NULL THEN coalesce(z.title, a.title) ELSE a.title END, '') AS title,
CASE WHEN outcome = 'changed' AND z.body IS NOT NULL THEN '2026-01-31' ELSE a.fetched END AS fetched, CASE WHEN outcome = 'changed' AND z.body IS NOT NULL THEN NULL ELSE coalesce(a.stale, CASE WHEN outcome = 'stale' THEN '2026-01-31' END) END AS stale
FROM a JOIN z USING (source_url) JOIN o USING (source_url) WHERE a.k = 1 AND z.k = 1"""
SQL["crawl_depths"] = """WITH RECURSIVE i AS (SELECT DISTINCT found_on, url, regexp_extract(found_on, '^(https?://[^/]+/)', 1) AS root FROM inventory WHERE found_on IS NOT NULL AND url IS NOT NULL),
l AS (SELECT root AS src, found_on AS dst FROM i WHERE root <> '' UNION SELECT found_on, url FROM i WHERE found_on <> ''),
b AS (SELECT DISTINCT root AS url, 0 AS depth FROM i WHERE root <> '' UNION SELECT l.dst, depth + 1 FROM b JOIN l ON l.src = b.url WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY url"""

# --- ratings and events


def _cut(c: str, n: int) -> str:
    return f"left({strip(f'coalesce({c}, {chr(39)}{chr(39)})')}, {n})"


SQL["accepted_ratings"] = f"WITH {_RATINGS} SELECT feedback_id, rating, {_cut('question', 500)} AS question, {_cut('mode', 100)} AS mode, CAST(length({_cut('answer', 2000)}) AS INTEGER) AS answer_chars, {_cut('comment', 1000)} AS comment FROM r WHERE rating IN ('up', 'down') AND {_cut('question', 500)} <> ''"
SQL["rating_summary"] = f"""WITH {_RATINGS} SELECT count(*) AS ratings, count(*) FILTER (WHERE rating = 'up') AS helpful, count(*) FILTER (WHERE rating = 'down') AS not_helpful,
count(DISTINCT nullif(left(at_utc, 10), '')) AS days, min(nullif(left(at_utc, 10), '')) AS first_day, max(nullif(left(at_utc, 10), '')) AS last_day, round(100.0 * count(*) FILTER (WHERE rating = 'up') / CAST(count(*) AS DOUBLE), 6) AS helpful_pct FROM r"""
SQL["rating_modes"] = rf"WITH {_RATINGS} SELECT coalesce(nullif(string_split(coalesce(mode, ''), ' (')[1], ''), 'unknown') AS mode_name, count(*) AS n FROM r GROUP BY 1"
SQL["attempt_counts"] = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS attempts FROM events"
SQL["rate_limited"] = """WITH RECURSIVE e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS hits, CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT x.key, x.i, CASE WHEN ok THEN list_append(live, us) ELSE live END, x.event_id, ok FROM (
    SELECT y.*, len(live) < 3 AND len(list_filter(live, lambda t: us - t < 60000000)) < 1 AS ok FROM (
      SELECT e.key, e.i, e.us, e.event_id, list_filter(r.hits, lambda t: e.us - t <= 86400000000) AS live FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1) y) x)
SELECT event_id, key, accepted FROM r WHERE event_id IS NOT NULL"""
SQL["daily_events"] = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
