import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compose, documents, fusion, ranking
from corpusloom.streaming import limiter, ratings


def test_exact_rank_equals_window(spark):
    rows = [(i % 3, i, float(i * 7919 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, s double")
    got = {(r.g, r.i): r["rank"] for r in ranking.exact_rank(df, ["g"], [F.col("s").desc(), F.col("i").asc()]).collect()}
    for g in range(3):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[g, r[1]] for r in order] == list(range(1, len(order) + 1))


def test_fusion_prefers_the_dense_order(spark):
    dense = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.1)], "q int, k int, score double")
    key = spark.createDataFrame([(0, 2, 0.9), (0, 1, 0.2)], "q int, k int, score double")
    got = {r.k: (r.rank_dense, r.rank_keyword, r.fused) for r in fusion.fuse(dense, key, "q", "k").collect()}
    assert got[1][2] == pytest.approx(1 / 31 + 0.5 / 32) and got[3][:2] == (3, 3) and got[1][2] > got[2][2]


def test_interleave(spark):
    rows = [(0, k, v, p) for v, order in enumerate((["a", "b", "c"], ["b", "a", "c"])) for p, k in enumerate(order, 1)]
    df = spark.createDataFrame(rows, "q int, k string, variant int, pos int")
    assert [r.k for r in fusion.interleave(df, "q", "k").orderBy("rank").collect()] == ["a", "b", "c"]


def test_pool_refills_from_what_was_passed_over(spark):
    df = spark.range(70).select(F.lit(0).alias("q"), "id", (F.col("id") + 1).cast("int").alias("rank"), F.lit("s").alias("src"), F.lit(False).alias("contradicts"))
    pool = fusion.capped_pool(df, "q", "src").collect()
    assert len(pool) == 60 and sum(r.kept for r in pool) == 4 and {r.id for r in pool} == set(range(60))


def test_context_budget(spark):
    rows = [(0, 0, 1, "t", "u", "", "x" * 900), (0, 0, 2, "t", "u", "", "x" * 900), (0, 0, 3, "t", "v", "", "y" * 6500), (0, 1, 1, "t", "w", "2024", "z")]
    df = spark.createDataFrame(rows, "q int, group_no int, rank int, title string, source_url string, fetched string, text string")
    got = compose.context(df, "q", 1500).first()
    assert len(got.blocks) == 2 and got.blocks[1] == "[t — w]\nz"
    big = spark.createDataFrame([(0, 0, 1, "t", "u", "", "a b " * 1000)], df.schema)
    assert len(compose.context(big, "q", 10).first().blocks) == 1


def test_answer_check_needs_a_model_mode(spark):
    df = spark.createDataFrame([("Rs. 5", "llm (x)", ["rs\\."], []), ("Rs. 5", "extractive", ["rs"], []), ("no", "llm", ["yes"], ["NO"])], "answer string, mode string, must array<string>, must_not array<string>")
    assert [(r.passed, r.missing, r.forbidden) for r in compose.answer_check(df).collect()] == [(True, [], []), (False, [], []), (False, ["yes"], ["NO"])]


def test_identifier_density(spark):
    roll, mail = r"\bBT\d{2}[A-Z]{3}\d{3}\b", "@students"
    few = "word " * 7500 + "BT21CSE001 BT21CSE002 BT21CSE003"
    many = "word " * 300 + " ".join(f"BT21CSE{i:03}" for i in range(16))
    df = spark.createDataFrame([(few,), (many,), ("",), (None,)], "t string")
    assert [r.d for r in df.select(documents.disposition(F.col("t"), F.lit(None).cast("string"), roll, mail).alias("d")).collect()] == ["ok", "personal_data", "empty", "empty"]


def test_snapshot_and_stale_mark(spark):
    stored = spark.createDataFrame([("a", "x "), ("b", "x"), ("c", "x"), ("d", "x")], "k string, body string")
    new = spark.createDataFrame([("a", " x", True, True), ("b", "y", True, True), ("d", None, False, True)], "k string, body string, html boolean, reachable boolean")
    diff = documents.snapshot_diff(stored, new, "k")
    assert {r.k: r.outcome for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "stale", "d": "skipped"}
    pages = stored.withColumn("stale", F.when(F.col("k") == "a", "2020-01-01"))
    once = documents.mark_stale(pages, diff, "k", F.lit("2024-01-01"))
    twice = documents.mark_stale(once, diff, "k", F.lit("2025-01-01"))
    assert {r.k: r.stale for r in twice.collect()} == {"a": "2020-01-01", "b": None, "c": "2024-01-01", "d": None}


def test_breadth_first(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = documents.breadth_first(links, spark.createDataFrame([("a",)], "url string"), 3, F.col("url") == "x")
    assert {r.url: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_limiter_forgets_refused_attempts(spark):
    hits, out = [], []
    for t in (0, 1, 2, 61):
        ok, hits = limiter.decide(hits, t * 1_000_000, 2, 150)
        out.append(ok)
    assert out == [True, True, False, True]


def test_limiter_stream_equals_batch(spark, tmp_path):
    random.seed(3)
    rows = [(i, f"k{random.randrange(3)}", 1_700_000_000 + i * 9 + random.randrange(5)) for i in range(120)]
    df = spark.createDataFrame(rows, "n bigint, k string, s bigint").select("n", "k", F.timestamp_seconds("s").alias("ts"))
    batch = {(r.key, r.accepted) for r in []}
    batch = sorted((r.key, r.accepted) for r in limiter.limited_batch(df, "k", "ts", "n", 3, 30).collect())
    for part in range(3):  # files in time order
        df.where(f"n div 40 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = limiter.limited_stream(src, "k", "ts", 3, 30).writeStream.format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.accepted) for r in spark.table("lim").collect()) == batch


def test_rating_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"at":"2025-01-01T00:00:00Z","rating":"up","question":" q ","answer":"a","mode":"llm (x)","comment":null}\n\n{broken\n{"rating":"sideways","question":"q"}\n')
    q = ratings.store_ratings(ratings.rating_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.question, r.comment) for r in got] == [("q", "")]
