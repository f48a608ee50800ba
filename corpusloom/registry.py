"""Core queries by name, each with the SQL that gives the same rows (``oracle.py``). All run over
their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import attributes, html, questions, tables, text
from .operators import chunking, compose, conversion, documents, evaluation, feedback, fusion, lexical, models, ranking
from .plans.retrieve import LexicalIndex, answered, asked_phrases, hybrid, retrieved, saved_index
from .sources import discovery, raw_files
from .sources.shared import shared_table
from .streaming import limiter

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


# --- text ---------------------------------------------------------------------------------------


@query
def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("para_no", "paragraph"))


@query
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def pack_chunks(spark, d):
    return chunking.chunk_table(table(spark, d, "raw_files"))


@query
def rejoined_sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.rejoined_sentences(F.col("text")).alias("rejoined"))


@query
def first_sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.first_sentences(F.col("text")).alias("snippet"))


@query
def lead_sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.lead_sentence(F.col("text")).alias("lead"))


@query
def truncated_texts(spark, d):
    return _docs(spark, d).select("doc_id", text.truncated(F.col("text")).alias("cut"))


@query
def plain_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", text.plain_punctuation(F.col("text")).alias("plain"))


@query
def ordinals_joined(spark, d):
    return _docs(spark, d).select("doc_id", text.ordinals_joined(F.col("text")).alias("joined"))


@query
def cleaned_pdf_text(spark, d):
    return table(spark, d, "raw_files").where("file like 'doc\\_%' and body is not null").select("file", text.cleaned_pdf_text(F.col("body")).alias("cleaned"))


@query
def header_parse(spark, d):
    """Raw files are written out as header and body again, then parsed."""
    lines = [F.concat(F.lit(f"{k.upper()}: "), F.coalesce(k, F.lit("")), F.lit("\n")) for k in ("source_url", "title", "fetched")]
    raw = table(spark, d, "raw_files").select("file", F.concat(*lines, F.lit("---\n"), F.coalesce("body", F.lit(""))).alias("value"))
    head, body = raw_files.header_and_body(F.col("value"))
    parsed = raw.select("file", head.alias("h"), body.alias("body"))
    return parsed.select("file", *(F.try_element_at("h", F.lit(k)).alias(k) for k in ("source_url", "title", "fetched")), "body")


@query
def html_pages(spark, d):
    """Titles and main texts of pages built from the raw files, with furniture around them."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><title>site</title></head><body><nav>Home <a href='/a'>A</a></nav><h1>"), esc("title"), F.lit("</h1><main><p>"), esc("body"),
        F.lit("<script>var x = 1;</script></main><footer>legal</footer></body></html>"),
    )
    return html.parsed_pages(table(spark, d, "raw_files").select(F.col("file").alias("url"), page.alias("html"))).select(F.col("url").alias("file"), "title", "text", F.size("links").alias("links"))


@query
def table_rows(spark, d):
    """Nations by region as tables of three columns, in lines."""
    cell = F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("c")))), lambda x: x["c"]).alias("rows"))
    head = F.array(F.lit("S.No"), F.lit("Nation"), F.lit("Region"))
    lines = tables.row_lines(head, F.col("rows"), F.concat(F.lit("Region "), "n_regionkey"))
    return t.select("n_regionkey", F.posexplode(lines).alias("line_no", "line"), tables.is_day_grid(head, F.col("rows")).alias("day_grid"))


@query
def day_grids(spark, d):
    """Per region a calendar's month grid, the same months over names, and a grid that is too narrow."""
    day = (F.col("n_nationkey") + 1).cast("string")
    rows = {"grid": F.array(day, F.concat(day, F.lit(" (Mon)")), F.lit(""), day), "names": F.array(F.col("n_name"), F.col("n_name"), day, F.col("n_name")), "narrow": F.array(day, day)}
    heads = ("January 2026", "Feb. 2026", "MAR 2026.Sunday", "Notes")
    out = None
    for kind, cells in rows.items():
        t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(cells).alias("rows"))
        head = F.array(*(F.lit(h) for h in heads[: 2 if kind == "narrow" else 4]))
        one = t.select("n_regionkey", F.lit(kind).alias("kind"), tables.is_day_grid(head, F.col("rows")).alias("day_grid"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def title_lines(spark, d):
    return table(spark, d, "raw_files").where("body is not null").select("file", text.first_title_line(F.col("body"), F.col("file")).alias("title_line"))


@query
def redacted_comments(spark, d):
    """Comments without a word that stands for a secret."""
    return _ratings(spark, d).where("comment is not null").select("feedback_id", text.redacted(F.col("comment"), "office").alias("shown"))


# --- attributes and questions -------------------------------------------------------------------


def _chunks_once(spark, d):
    return table(spark, d, "chunks").where("text is not null").groupBy("id").agg(F.min(F.concat_ws(". ", "title", "text")).alias("passage"))


@query
def attribute_tags(spark, d):
    c = _chunks_once(spark, d)
    return c.select("id", *(F.array_join(f(F.col("passage")), ",").alias(k) for k, f in attributes.READERS.items()))


def _ratings(spark, d):
    """One row per feedback id (rows sent twice are equal in what is used here)."""
    cols = ("question", "answer", "mode", "rating", "comment", "at_utc")
    return table(spark, d, "feedback").where("feedback_id is not null").groupBy("feedback_id").agg(*(F.min(c).alias(c) for c in cols))


@query
def contradicting_answers(spark, d):
    r = _ratings(spark, d).where("question is not null and answer is not null")
    asked, found = ({k: f(F.col(c)) for k, f in attributes.READERS.items()} for c in ("question", "answer"))
    return r.select("feedback_id", attributes.contradicts(asked, found).alias("contradicts"))


@query
def decomposed_questions(spark, d):
    return _ratings(spark, d).where("question is not null").select("feedback_id", F.posexplode(questions.decompose(F.col("question"))).alias("part_no", "sub_question"))


@query
def followup_questions(spark, d):
    return _ratings(spark, d).where("question is not null").select("feedback_id", questions.looks_like_followup(F.col("question")).alias("followup"))


@query
def glued_questions(spark, d):
    """Each question read with the question of the rating before it (by id) where it is a follow-up."""
    r = _ratings(spark, d).where("question is not null").select("feedback_id", "question")
    prev = r.select((F.col("feedback_id") + 1).alias("feedback_id"), F.col("question").alias("previous"))
    j = r.join(prev, "feedback_id", "left")
    needs = questions.looks_like_followup(F.col("question")) & F.col("previous").isNotNull()
    return j.select("feedback_id", needs.alias("combined"), F.when(needs, questions.glued(F.col("question"), F.col("previous"))).otherwise(F.col("question")).alias("searched"))


@query
def question_variants(spark, d):
    return table(spark, d, "check_cases").select("case_name", F.posexplode(questions.variants(F.col("question"))).alias("variant_no", "variant"))


@query
def refused_requests(spark, d):
    return _ratings(spark, d).select("feedback_id", questions.request_error(F.col("question")).alias("refused"))


@query
def client_keys(spark, d):
    """Client keys from header columns derived from the events."""
    e = table(spark, d, "events")
    u = F.col("user_id").cast("string")
    cf = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), u))
    fwd = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("10.1.0."), u, F.lit(", 10.9.9.9")))
    host = F.when(F.col("event_id") % 5 != 2, F.concat(F.lit("10.2.0."), u))
    return e.select("event_id", questions.client_key(cf, fwd, host).alias("client"))


# --- lexical index and retrieval ----------------------------------------------------------------


@query
def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query
def term_frequencies(spark, d):
    return lexical.term_counts(_docs(spark, d), "doc_id", "text").withColumn("tf_weight", F.round(1 + F.log("tf"), 6))


@query
def document_frequencies(spark, d):
    docs = _docs(spark, d)
    f = lexical.document_frequencies(lexical.term_counts(docs, "doc_id", "text"), docs.count())
    return f.withColumn("idf", F.round("idf", 6))


def _index(spark, d) -> LexicalIndex:
    """The documents' index, made once a version of the table and loaded by every query that needs it."""
    return saved_index(spark, f"{d}/documents.parquet", _docs(spark, d), "doc_id", "text")


@query
def tfidf_weights(spark, d):
    return _index(spark, d).weights.withColumn("weight", F.round("weight", 6))


def _search(spark, d, k):
    index = _index(spark, d)
    return index.search(table(spark, d, "check_cases").select("case_name", "question"), "case_name", "question", k)


@query
def tfidf_topk(spark, d):
    return _search(spark, d, 3).withColumn("score", F.round("score", 6))


def _found(spark, d, k):
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("fetched", F.lit("")).alias("fetched"))
    return _search(spark, d, k).join(docs, "doc_id")


@query
def conflict_flags(spark, d):
    return compose.conflict_flag(_found(spark, d, 3), "case_name").select("case_name", "conflict")


@query
def context_budget(spark, d):
    c = compose.context(_found(spark, d, 7).withColumn("group_no", F.lit(0)), "case_name")
    return c.select("case_name", F.size("blocks").alias("blocks"), "chars", F.md5(F.array_join("blocks", "\n\n")).alias("context_md5"))


@query
def cited_sources(spark, d):
    hits = ranking.first_seen(_found(spark, d, 7), ["case_name", "source_url"], [F.col("rank").asc()])
    return hits.select("case_name", "source_url", "title", "rank")


@query
def extractive_answers(spark, d):
    best = _found(spark, d, 1).select("case_name", "title", "text")
    asked = table(spark, d, "check_cases").select("case_name", F.col("question").alias("sub_question"), F.lit(0).alias("part_no"))
    asked = asked.join(compose.conflict_flag(_found(spark, d, 3), "case_name"), "case_name", "left")
    return compose.extractive_answers(asked.join(best, "case_name", "left"), "case_name")


@query
def vocabulary_overlaps(spark, d):
    """Shared vocabulary of each document with the next one by id."""
    a = _docs(spark, d).select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return a.join(b, "doc_id").select("doc_id", F.round(text.vocabulary_overlap(F.col("text"), F.col("next_text")), 6).alias("overlap"))


# --- dense search and fusion --------------------------------------------------------------------


def _dense(spark, d, k=None):
    e = table(spark, d, "embeddings")
    return ranking.vector_scores(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "query_id", k)




@query
def cosine_topk(spark, d):
    best = ranking.top_k(_dense(spark, d, 10), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()], 10)
    return best.withColumn("score", F.round("score", 6))


@query
def cosine_rank(spark, d):
    return ranking.exact_rank(_dense(spark, d), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()]).select("query_id", "vec_id", "rank")


def _keyword(spark, d):
    """Keyword scores between documents that stand for the vectors of the same ids; the statistics are
    those of all documents."""
    index = _index(spark, d)
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    kept = index.weights.join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "vec_id")
    asked = kept.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return lexical.scores(kept, asked, "vec_id", "query_id")


@query
def rrf_fused(spark, d):
    return fusion.fuse(_dense(spark, d), _keyword(spark, d), "query_id", "vec_id").withColumn("fused", F.round("fused", 9))


@query
def interleaved(spark, d):
    """Dense and keyword order of each query taking turns; the keyword order holds scored items only."""
    dense = ranking.exact_rank(_dense(spark, d), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()], "pos").withColumn("variant", F.lit(0))
    key = ranking.exact_rank(_keyword(spark, d), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()], "pos").withColumn("variant", F.lit(1))
    cols = ["query_id", "vec_id", "variant", "pos"]
    return fusion.interleave(dense.select(*cols).unionByName(key.select(*cols)), "query_id", "vec_id")


def _items(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("source"))


@query
def capped_pool(spark, d):
    """Pools of the dense order; a document contradicts another one if both name a programme, year or
    gender and none in common."""
    ranked = ranking.exact_rank(_dense(spark, d), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()])
    ranked = ranked.where(F.col("rank") <= fusion.POOL * fusion.SCAN).join(_items(spark, d), "vec_id")
    said = F.concat_ws(". ", "title", "text")
    tags = shared_table(table(spark, d, "documents").select("doc_id", *(f(said).alias(k) for k, f in attributes.READERS.items())), "tags")  # read once a document
    side = lambda key, p: tags.select(F.col("doc_id").alias(key), *(F.col(k).alias(p + k) for k in attributes.READERS))
    rows = ranked.join(side("query_id", "a_"), "query_id", "left").join(side("vec_id", "f_"), "vec_id", "left")
    asked, found = ({k: F.coalesce(p + k, F.array().cast("array<string>")) for k in attributes.READERS} for p in ("a_", "f_"))
    rows = rows.select(*ranked.columns, attributes.contradicts(asked, found).alias("contradicts"))
    return fusion.capped_pool(rows, "query_id", "source").select("query_id", "vec_id", "kept", "pool_pos")


@query
def hybrid_retrieve(spark, d):
    return hybrid(_dense(spark, d), _keyword(spark, d), _items(spark, d), "query_id", "vec_id", "source", 12).select("query_id", "vec_id", "rank")


@query
def answered_questions(spark, d):
    """The whole path over all check cases and documents: parts, phrasings, fusion, turns, filter, caps,
    conflict notes, context and answers. There is no encoder, so hashed term vectors are the dense side."""
    docs = _docs(spark, d).select("doc_id", "text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "source_url", "fetched")))
    asked = asked_phrases(table(spark, d, "check_cases"), "case_name", "question")
    index = _index(spark, d)
    terms = shared_table(index.weights, "weights")
    phrases = shared_table(index.asked(asked, "ask_id", "phrase"), "phrases")
    vectors = lexical.hashed_vectors(asked, phrases, "ask_id").select(F.col("ask_id").alias("doc_id"), "embedding")
    dense = shared_table(ranking.vector_scores(lexical.hashed_vectors(docs, terms, "doc_id"), vectors, "doc_id", "embedding", "ask_id", None), "dense")
    found = shared_table(retrieved(asked, dense, lexical.scores(terms, phrases, "doc_id", "ask_id"), docs, "case_name", "doc_id"), "found")
    return answered(asked, found, "case_name").withColumn("context", F.md5("context")).withColumnRenamed("context", "context_md5")


# --- evaluation ---------------------------------------------------------------------------------


@query
def first_match_ranks(spark, d):
    found = _found(spark, d, 12).withColumn("part_no", F.lit(0))
    return evaluation.passage_ranks(found, evaluation.answerable(table(spark, d, "check_cases"), "case_name"), "case_name")


@query
def answerable_cases(spark, d):
    return evaluation.answerable(table(spark, d, "check_cases"), "case_name")


@query
def fact_ranks(spark, d):
    return evaluation.fact_ranks(_found(spark, d, 20).drop("title"), evaluation.answerable(table(spark, d, "check_cases"), "case_name"), "case_name")


@query
def page_hits(spark, d):
    """Whether one of the three best pages has a word of the question in its address."""
    asked = table(spark, d, "check_cases").select("case_name", F.regexp_extract_all(F.lower("question"), F.lit("([a-z]{6,})"), F.lit(1)).alias("accepted"))
    return evaluation.page_hits(_found(spark, d, 3), asked, "case_name")


@query
def hit_rates(spark, d):
    r = first_match_ranks(spark, d)
    within = lambda k: F.sum((F.coalesce("first_rank", F.lit(99)) <= k).cast("int"))
    return r.agg(F.count("*").alias("cases"), within(3).alias("top3"), within(7).alias("top7"), within(12).alias("top12"), F.round(within(3) / F.count("*"), 6).alias("hit_at_3"))


def _replayed_cases(spark, d, answers):
    """Cases with their answers; those whose name ends in 0 or 5 stand for calls that failed."""
    failed = F.col("case_name").rlike("[05]$")
    return table(spark, d, "check_cases").join(answers, "case_name").withColumn("mode", F.when(failed, "extractive (model call failed: 429)").otherwise("llm (replay)"))


@query
def check_summary(spark, d):
    """Summary of the checks of the cases whose name holds 'case'."""
    answers = extractive_answers(spark, d).withColumn("answer", text.plain_punctuation(F.col("answer")))
    return evaluation.check_summary(evaluation.named(compose.answer_check(_replayed_cases(spark, d, answers)).withColumnRenamed("case_name", "name"), "name", "case"))


@query
def replayed_conversations(spark, d):
    """Ratings of three neighbouring ids as one conversation."""
    r = _ratings(spark, d).where("question is not null").select(F.floor(F.col("feedback_id") / 3).alias("conv"), "feedback_id", "question")
    return evaluation.replayed(r, "conv", [F.col("feedback_id")], "question")


@query
def recent_questions(spark, d):
    """The last three questions before a next one, of ratings of three and more neighbouring ids."""
    r = _ratings(spark, d).select(F.floor(F.col("feedback_id") / 5).alias("conv"), "feedback_id", F.coalesce("question", F.lit("")).alias("q"))
    listed = r.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("feedback_id", "q"))), lambda x: x["q"]).alias("h"))
    return listed.select("conv", F.array_join(questions.recent_history(F.col("h")), "\n").alias("recent"))


@query
def scored_rerank(spark, d):
    """Pools of the dense order put in order by keyword scores, as by a scorer."""
    ranked = ranking.exact_rank(_dense(spark, d), ["query_id"], [F.round("score", 9).desc(), F.col("vec_id").asc()]).join(_items(spark, d), "vec_id").withColumn("contradicts", F.lit(False))
    pool = fusion.capped_pool(ranked.drop("score"), "query_id", "source")
    told = pool.join(_keyword(spark, d), ["query_id", "vec_id"], "left").withColumn("relevance", F.round(F.coalesce("score", F.lit(0.0)), 9)).drop("score")
    return fusion.rerank(told, "query_id", "relevance", 12).select("query_id", "vec_id", "rank")


@query
def compound_context(spark, d):
    """Context of three groups: the best three of a case, its seven, and seven of the case named next."""
    found = _found(spark, d, 7)
    following = table(spark, d, "check_cases").select("case_name").distinct()
    names = following.withColumn("n", F.regexp_extract("case_name", r"(\d+)$", 1).cast("int"))
    pair = names.join(names.select((F.col("n") - 1).alias("n"), F.col("case_name").alias("next_name")), "n").select("case_name", "next_name")
    other = pair.join(found.withColumnRenamed("case_name", "next_name"), "next_name").drop("next_name").withColumn("group_no", F.lit(2))
    own = found.withColumn("group_no", F.lit(1)).unionByName(found.where("rank <= 3").withColumn("group_no", F.lit(0)))
    c = compose.context(own.unionByName(other.select(*own.columns)), "case_name")
    return c.select("case_name", F.size("blocks").alias("blocks"), "chars", F.md5(F.array_join("blocks", "\n\n")).alias("context_md5"))


@query
def answer_prompts(spark, d):
    """Prompts of all cases and their modes without a model."""
    c = compose.context(_found(spark, d, 7).withColumn("group_no", F.lit(0)), "case_name").select("case_name", F.array_join("blocks", "\n\n").alias("context"))
    asked = table(spark, d, "check_cases").join(c, "case_name", "left")
    rows = asked.select("case_name", F.lit("-").alias("answer"), F.md5(models.answer_prompt(F.col("context"), F.col("question"))).alias("prompt_md5"))
    return models.answered_by_model(rows, F.col("prompt_md5"), None).select("case_name", "prompt_md5", "mode")


@query
def answer_checks(spark, d):
    answers = extractive_answers(spark, d).withColumn("answer", text.plain_punctuation(F.col("answer")))
    return compose.answer_check(_replayed_cases(spark, d, answers)).select("case_name", "passed", F.array_join("missing", "\n").alias("missing"), F.array_join("forbidden", "\n").alias("forbidden"))


@query
def label_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "page_labels").join(docs, "doc_id").groupBy(F.coalesce("source", F.lit("?")).alias("source_name"), "label").agg(F.count("*").alias("n"))


# --- documents ----------------------------------------------------------------------------------


@query
def skipped_urls(spark, d):
    u = table(spark, d, "chunks").select(F.col("source_url").alias("url")).where("source_url is not null").distinct()
    return u.select("url", documents.skipped_url(F.col("url"), documents.SKIP_PATHS).alias("skipped"), F.col("url").rlike(documents.STATIC_FILES).alias("static_file"), text.is_document(F.col("url"), "/drive/").alias("is_doc"))


@query
def page_slugs(spark, d):
    u = table(spark, d, "chunks").select(F.col("source_url").alias("url")).where("source_url is not null").distinct()
    return u.select("url", text.slug(F.col("url")).alias("slug"))


@query
def inventory_fields(spark, d):
    i = table(spark, d, "inventory").where("doc_key is not null and url is not null").select("doc_key", "kind", "drive_id", "url", "link_text", "doc_name").distinct()
    return i.select(
        "doc_key", text.document_title(F.col("link_text"), F.col("doc_name"), F.col("url")).alias("doc_title"), F.coalesce(text.drive_id(F.col("url"), "[a-z0-9.-]+/drive"), F.lit("")).alias("drive_file"),
        text.upload_month(F.col("url")).alias("uploaded"), F.coalesce(text.output_name(F.col("kind"), F.col("drive_id"), F.col("url")), F.lit("")).alias("out_file"),
    )


_EXCLUDED = ("tender", "quotation", r"\bform\b")


@query
def convertible_documents(spark, d):
    rows = documents.by_priority(documents.convertible(documents.first_links(table(spark, d, "inventory")), _EXCLUDED))
    return rows.select("doc_key", "doc_title", "bytes", "newest")


@query
def first_links(spark, d):
    return documents.first_links(table(spark, d, "inventory")).select("doc_key", "url", "found_on")


@query
def latest_status(spark, d):
    return documents.latest_status(table(spark, d, "ingest_status")).select("doc_key", "outcome", "words", "seconds")


@query
def run_summary(spark, d):
    return documents.latest_status(table(spark, d, "ingest_status")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query
def unprocessed_documents(spark, d):
    """What was open when the last year of runs began."""
    status = table(spark, d, "ingest_status")
    last = status.agg(F.date_trunc("year", F.max("run_at")).alias("last"))
    before = status.join(F.broadcast(last), F.col("run_at") < F.col("last")).drop("last")
    return documents.to_do(documents.first_links(table(spark, d, "inventory")), before).select("doc_key")


@query
def processed_counts(spark, d):
    return documents.progress(table(spark, d, "inventory"), table(spark, d, "ingest_status"))


@query
def plan_listing(spark, d):
    """The 25 newest convertible documents of each kind."""
    rows = documents.by_priority(documents.convertible(documents.first_links(table(spark, d, "inventory")), _EXCLUDED))
    return documents.plan_listing(rows, "kind", [F.col("newest").desc(), F.col("doc_key").asc()]).select("kind", "place", "doc_key", "in_group")


def _anchor_pages(spark, d):
    """Pages with the inventory's links as malformed HTML: crossed elements, attributes without quotes,
    missing ends, fragments."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = table(spark, d, "inventory").where("found_on is not null and url is not null").select("found_on", "url", F.coalesce("link_text", F.lit("")).alias("said")).distinct()
    listed = rows.groupBy("found_on").agg(F.array_sort(F.collect_list(F.struct("url", "said", F.concat(F.lit("<LI><p><b><A class=doc HREF='"), esc("url"), F.lit("#top'>\n "), esc("said"), F.lit("</b></A><br>")).alias("html")))).alias("a"))
    page = F.concat(F.lit("<html><body><nav>Menu<ul><li>Home</nav><h1>Documents</H1><ul>"), F.array_join(F.transform("a", lambda x: x["html"]), "\n"), F.lit("</ul><a>no address</a><p>End"))
    return listed.select(F.col("found_on").alias("url"), page.alias("html"))


@query
def discovered_links(spark, d):
    found = discovery.discovered(discovery.page_links(_anchor_pages(spark, d)), discovery.host(F.col("page")), "[a-z0-9.-]+/drive")
    return found.select("doc_key", "kind", "url", "link_text", "found_on")


@query
def enriched_documents(spark, d):
    first = documents.first_links(table(spark, d, "inventory"))
    told = first.where("kind = 'drive'").select("drive_id", "doc_name", "mime_type", "size_bytes", "modified_time", "error_text").dropDuplicates(["drive_id"])
    return discovery.enriched(first.select("doc_key", "kind", "drive_id", "url"), told).select("doc_key", "doc_name", "mime_type", "modified_time", "error_text")


@query
def known_urls(spark, d):
    """Addresses of the saved pages, and pages of the inventory that aren't among them."""
    files = table(spark, d, "raw_files").select("file", F.concat(F.lit("SOURCE_URL: "), F.coalesce("source_url", F.lit("")), F.lit("\n---\n")).alias("value"))
    extra = table(spark, d, "inventory").where("found_on <> ''").select(F.regexp_replace("found_on", "/+$", "").alias("url"))
    return discovery.known_urls(files, extra)


def _document_items(spark, d):
    """Lines of document files as items: short ones without a closing mark are headings."""
    rows = table(spark, d, "raw_files").where("file like 'doc\\_%' and body is not null").select(F.col("file").alias("doc"), F.posexplode(F.split("body", "\n")).alias("item_no", "text"))
    heading = (text.word_count(F.col("text")) <= 6) & ~F.col("text").rlike("[.!?:;,]\\s*$")
    return rows.select("doc", "item_no", F.when(heading, "section").otherwise("text").alias("kind"), "text", F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("cells"))


@query
def carried_context(spark, d):
    return conversion.carried_context(_document_items(spark, d)).select("doc", "item_no", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("lead", F.lit("")).alias("lead"))


_ROLL, _MAIL = r"(?i)\b(BT|MT|BA|MS|PH|MB|DT|PD)\s?\d{2}\s?[A-Z]{2,5}\s?[0-9O]{2,4}\b", r"(?i)@students\.[a-z]+\.example"


@query
def dispositions(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", documents.disposition(F.col("text"), F.lit(None).cast("string"), _ROLL, _MAIL).alias("outcome"))


@query
def snapshot_changes(spark, d):
    """First against last saved body of every address."""
    stored, fetched = _snapshots(spark, d)
    return documents.snapshot_diff(stored, fetched, "source_url")


@query
def refreshed_pages(spark, d):
    """The first saved pages after a visit that found the last saved ones."""
    stored, fetched = _snapshots(spark, d)
    kept = documents.refreshed(stored, documents.snapshot_diff(stored, fetched, "source_url"), fetched, "source_url", F.lit("2026-01-31").cast("date"))
    return kept.select("source_url", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), F.coalesce("title", F.lit("")).alias("title"), "fetched", "stale")


def _snapshots(spark, d):
    files = table(spark, d, "raw_files").where("source_url is not null and source_url <> ''").select("source_url", "file", "body", "stale", "title", F.coalesce("fetched", F.lit("")).alias("fetched"))
    order = [F.col("fetched"), F.col("file")]
    stored = ranking.first_seen(files, ["source_url"], [c.asc() for c in order])
    last = ranking.first_seen(files, ["source_url"], [c.desc() for c in order])
    fetched = last.select("source_url", "body", "title", F.col("file").startswith("doc_").__invert__().alias("html"), F.col("stale").isNull().alias("reachable"))
    return stored, fetched


@query
def crawl_depths(spark, d):
    """Breadth-first depths over links root -> page -> document, from the roots of all hosts."""
    i = table(spark, d, "inventory").where("found_on is not null and url is not null").select("found_on", "url").distinct()
    root = F.regexp_extract("found_on", r"^(https?://[^/]+/)", 1)
    links = i.select(root.alias("src"), F.col("found_on").alias("dst")).unionByName(i.select(F.col("found_on").alias("src"), F.col("url").alias("dst"))).where("src <> ''").distinct()
    return documents.breadth_first(links, i.select(root.alias("url")).where("url <> ''"), 3)


# --- ratings, limits, events --------------------------------------------------------------------


@query
def accepted_ratings(spark, d):
    return feedback.accepted(_ratings(spark, d)).select("feedback_id", "rating", "question", "mode", F.length("answer").alias("answer_chars"), "comment")


@query
def rating_summary(spark, d):
    return feedback.summary(_ratings(spark, d))


@query
def rating_modes(spark, d):
    return feedback.modes(_ratings(spark, d))


@query
def attempt_counts(spark, d):
    return feedback.attempts(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "attempts")


@query
def rate_limited(spark, d):
    """Accepted and refused events of each user under small limits (a fold)."""
    return limiter.limited_batch(table(spark, d, "events"), "user_id", "ts", "event_id", per_minute=1, per_day=3)


@query
def daily_events(spark, d):
    """Beyond the inventory of operators: event-time windows over the event table."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    day = F.date_trunc("day", "at").cast("date")
    return e.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered from the documents by the whole path."""
    return answered_questions(spark, sf_dir)
