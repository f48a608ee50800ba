"""TF-IDF as long tables: terms of one and two tokens, sublinear tf, smooth idf, unit rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import staged, tokens
from .ranking import top_k

# English stop words, dropped before pairs are formed (a parameter).
STOP_WORDS = tuple(
    "a about after all also an and any are as at be been before but by can could did do does for from had has have he her his how if in into is it its"
    " may more most no not of on one or other our out over she should so some such than that the their them then there these they this those to under"
    " up was we were what when where which who will with would you your".split()
)


def with_terms(df: DataFrame, text: str, out: str = "terms", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """df with the terms of a text: tokens without stop words, then pairs of neighbours. The steps are
    columns of their own, so that no token array is built twice."""
    rows = staged(df, "_t", F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(*stop)))
    pairs = F.when(F.size("_t") > 1, F.zip_with(F.expr("slice(_t, 1, size(_t) - 1)"), F.expr("slice(_t, 2, size(_t) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b)))
    return rows.withColumn(out, F.concat("_t", F.coalesce(pairs, F.array().cast("array<string>")))).drop("_t")


def term_counts(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, term, tf)."""
    return with_terms(docs.select(key, text), text, "term", stop).select(key, F.explode("term").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame, n_docs: int, min_df: int = 2, max_share: float = 0.9) -> DataFrame:
    """(term, df, idf) of the terms that are kept."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    return kept.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)


def raw_weights(counts: DataFrame, frequencies: DataFrame, key: str) -> DataFrame:
    """(key, term, w). The vocabulary joins on the term, a shuffle key that the frequencies were
    aggregated by already."""
    return counts.join(frequencies, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def norms(raw: DataFrame, key: str) -> DataFrame:
    """(key, norm): lengths of the rows, summed before the shuffle."""
    return raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def weights(counts: DataFrame, frequencies: DataFrame, key: str) -> DataFrame:
    """(key, term, weight), rows of unit length."""
    raw = raw_weights(counts, frequencies, key)
    return raw.join(norms(raw, key), key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def scores(index: DataFrame, asked: DataFrame, key: str, query_key: str) -> DataFrame:
    """(query_key, key, score): sparse products by an equi-join on the term."""
    q = asked.select(query_key, "term", F.col("weight").alias("qw"))
    return index.join(q, "term").groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def search(index: DataFrame, asked: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    return top_k(scores(index, asked, key, query_key), [query_key], [F.round("score", 9).desc(), F.col(key).asc()], k)


DIMS = 512


def hashed_vectors(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, embedding): unit term weights folded into DIMS signed places by the terms' hash. Stands in
    for an encoder where there is none; rows without terms get a vector of zeros."""
    h = F.md5("term")
    place = (F.conv(F.substring(h, 1, 3), 16, 10).cast("int") % DIMS).alias("place")
    signed = F.col("weight") * F.when(F.substring(h, 4, 1) < "8", 1.0).otherwise(-1.0)
    folded = terms.groupBy(key, place).agg(F.sum(signed).alias("v"))
    listed = rows.select(key).join(folded.groupBy(key).agg(F.collect_list(F.struct("place", "v")).alias("at")), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, DIMS))
            for i, (p, v) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if p:
                    m[i, p] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(m), pa.list_(pa.float64()))], [key, "embedding"])

    return listed.select(key, F.col("at.place").alias("place"), F.col("at.v").alias("v")).mapInArrow(run, f"{key} bigint, embedding array<double>")
