"""Retrieval plans: keyword search over an index built from documents, the hybrid path, and whole answers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions as asking
from ..functions.attributes import READERS, contradicts
from ..operators import compose, fusion, lexical
from ..operators.ranking import exact_rank, top_k
from ..sources.shared import shared_dir, shared_table


class LexicalIndex:
    """Long tables of a document collection: vocabulary, postings with unnormalised weights, and the
    documents' norms. A search only touches the postings of the questions' terms and the norms of the
    documents they lead to; unit weights of the whole collection are made where they are asked for."""

    def __init__(self, docs: DataFrame, key: str, text: str, min_df: int = 2, max_share: float = 0.9):
        counts = shared_table(lexical.term_counts(docs, key, text), "terms")
        self._set(shared_table(lexical.document_frequencies(counts, docs.count(), min_df, max_share), "vocabulary"), None, None, key)
        self.postings = shared_table(lexical.raw_weights(counts, self.vocabulary, key), "postings")
        self.norms = shared_table(lexical.norms(self.postings, key), "norms")

    def _set(self, vocabulary: DataFrame, postings: DataFrame | None, norms: DataFrame | None, key: str) -> None:
        self.vocabulary, self.postings, self.norms, self.key = vocabulary, postings, norms, key

    def save(self, path: str) -> None:
        """Writes the tables; the key's name is the first column of the norms."""
        for name in ("vocabulary", "postings", "norms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        self = cls.__new__(cls)
        vocabulary, postings, norms = (spark.read.parquet(f"{path}/{name}") for name in ("vocabulary", "postings", "norms"))
        self._set(vocabulary, postings, norms, norms.columns[0])
        return self

    @property
    def weights(self) -> DataFrame:
        """(key, term, weight): rows of unit length."""
        return self.postings.join(self.norms, self.key).select(self.key, "term", (F.col("w") / F.col("norm")).alias("weight"))

    def asked(self, questions: DataFrame, query_key: str, text: str) -> DataFrame:
        """Unit weights of the questions' terms; only their part of the vocabulary is read on."""
        return lexical.weights(lexical.term_counts(questions, query_key, text), self.vocabulary, query_key)

    def scores(self, asked: DataFrame, query_key: str) -> DataFrame:
        """(query_key, key, score) of the documents that share a term."""
        q = asked.select(query_key, "term", F.col("weight").alias("qw"))
        raw = self.postings.join(q, "term").groupBy(query_key, self.key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        return raw.join(self.norms, self.key).select(query_key, self.key, (F.col("dot") / F.col("norm")).alias("score"))

    def search(self, questions: DataFrame, query_key: str, text: str, k: int) -> DataFrame:
        found = self.scores(self.asked(questions, query_key, text), query_key)
        return top_k(found, [query_key], [F.round("score", 9).desc(), F.col(self.key).asc()], k)


def saved_index(spark, data: str, docs: DataFrame, key: str, text: str) -> LexicalIndex:
    """The index of a table, built once a version of its files and loaded from then on. The version is
    the files' names, sizes and times, so changed data are indexed anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.listStatus(at)
    version = hashlib.md5(repr(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in status)).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/loom-index-{version}-{key}-{text}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/norms/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not there.exists(done):  # the norms are written last
        LexicalIndex(docs, key, text).save(path)
        there.deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return LexicalIndex.load(spark, path)


def contradiction(question: str, passage: str) -> Column:
    return contradicts({k: f(F.col(question)) for k, f in READERS.items()}, {k: f(F.col(passage)) for k, f in READERS.items()})


def hybrid(dense: DataFrame, keyword: DataFrame, items: DataFrame, query_key: str, key: str, source: str, k: int, contradicts_with: Column | None = None) -> DataFrame:
    """Fused ranking, capped pool and pool order as the final order (no reranking model at hand)."""
    fused = fusion.fuse(dense, keyword, query_key, key)
    ranked = exact_rank(fused, [query_key], [F.col("fused").desc(), F.col(key).asc()])
    rows = ranked.where(F.col("rank") <= fusion.POOL * fusion.SCAN).join(items.select(key, source), key)
    rows = rows.withColumn("contradicts", F.lit(False) if contradicts_with is None else contradicts_with)
    return fusion.rerank(fusion.capped_pool(rows, query_key, source), query_key, None, k)


PASSAGES, WHOLE_PASSAGES = 7, 3


def asked_phrases(cases: DataFrame, case_key: str, question: str) -> DataFrame:
    """(ask_id, part_id, case_key, part_no, sub_question, variant, phrase): one row for every phrasing of
    every part of a question. Compound questions are asked undivided too, as part -1. Phrasings of one
    part share its part_id, the ask_id of the part as asked. Null questions are left out."""
    asked = cases.where(F.col(question).isNotNull())
    parts = asked.select(case_key, F.posexplode(asking.decompose(F.col(question))).alias("part_no", "sub_question"))
    compound = parts.where("part_no = 1").select(case_key)
    whole = asked.join(compound, case_key, "left_semi").select(case_key, F.lit(-1).alias("part_no"), F.col(question).alias("sub_question"))
    phrases = parts.unionByName(whole).select(case_key, "part_no", "sub_question", F.posexplode(asking.variants(F.col("sub_question"))).alias("variant", "phrase"))
    rows = shared_table(phrases.withColumn("ask_id", F.monotonically_increasing_id()), "asked")
    return rows.join(rows.where("variant = 0").select(case_key, "part_no", F.col("ask_id").alias("part_id")), [case_key, "part_no"])


def retrieved(asked: DataFrame, dense: DataFrame, keyword: DataFrame, passages: DataFrame, case_key: str, key: str, k: int = PASSAGES) -> DataFrame:
    """The k best passages of every part with ``rank`` and ``score`` (dense, of the part as asked).
    dense and keyword are (ask_id, key, score); passages are (key, title, text, source_url, fetched).
    Each phrasing is fused, the phrasings of a part take turns, and passages that contradict the part
    or are beyond their source's share give way to others."""
    scan = fusion.POOL * fusion.SCAN
    fused = exact_rank(fusion.fuse(dense, keyword, "ask_id", key), ["ask_id"], [F.col("fused").desc(), F.col(key).asc()], "pos")
    orders = fused.where(F.col("pos") <= scan).join(asked.select("ask_id", "part_id", "variant"), "ask_id").select("part_id", key, "variant", "pos")
    parts = asked.where("variant = 0").select("part_id", case_key, "part_no", "sub_question")
    rows = fusion.interleave(orders, "part_id", key, scan).join(parts, "part_id").join(passages.withColumn("passage", F.concat_ws(". ", "title", "text")), key)
    rows = rows.withColumn("contradicts", contradiction("sub_question", "passage"))
    best = fusion.rerank(fusion.capped_pool(rows, "part_id", "source_url"), "part_id", None, k)
    return best.join(dense.select(F.col("ask_id").alias("part_id"), key, "score"), ["part_id", key])


def answered(asked: DataFrame, found: DataFrame, case_key: str) -> DataFrame:
    """(case_key, answer, conflicts, blocks, chars, context): extractive answers of all parts with their
    conflict notes, and the context, which starts with the best passages of the undivided question."""
    parts = asked.where("variant = 0 and part_no >= 0").select("part_id", case_key, "part_no", "sub_question")
    said = parts.join(found.where("rank = 1").select("part_id", "title", "text"), "part_id", "left").join(compose.conflict_flag(found, "part_id"), "part_id", "left")
    conflicts = said.groupBy(case_key).agg(F.sum(F.coalesce("conflict", F.lit(False)).cast("int")).cast("int").alias("conflicts"))
    given = found.where((F.col("part_no") >= 0) | (F.col("rank") <= WHOLE_PASSAGES)).withColumn("group_no", F.col("part_no") + 1)
    context = compose.context(given, case_key).select(case_key, F.size("blocks").alias("blocks"), "chars", F.array_join("blocks", "\n\n").alias("context"))
    return compose.extractive_answers(said, case_key).join(conflicts, case_key).join(context, case_key, "left")
