from pyspark.sql import functions as F

from corpusloom.sources import raw_files, web


def test_raw_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SOURCE_URL: http://x/a/\nTITLE: A\nFETCHED: 2024-01-01\n---\nbody\n")
    (tmp_path / "doc_b.txt").write_text("no header")
    got = {r.file: r for r in raw_files.read_raw_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].source_url == "http://x/a/" and got["a.txt"].body == "body" and got["doc_b.txt"].body == ""
    urls = raw_files.source_urls(spark.read.text(str(tmp_path), wholetext=True))
    assert [r.url for r in urls.collect()] == ["http://x/a"]


def test_chunks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a::0", "é\n", "u", "t", "", "a.txt")], raw_files.CHUNK_SCHEMA)
    raw_files.write_chunks(df, str(tmp_path / "c"))
    assert raw_files.read_chunks(spark, str(tmp_path / "c")).collect() == df.collect()


def test_pdf_source_checks_the_first_bytes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    assert raw_files.read_pdfs(spark, str(tmp_path)).count() == 1


def test_fetch_failures_are_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return (404 if "gone" in url else 200), "text/html; charset=latin-1" if "l1" in url else "text/html", "é".encode("latin-1" if "l1" in url else "utf-8")

    df = spark.createDataFrame([("http://l1",), ("http://bad",), ("http://gone",), ("http://u8",)], "url string")
    got = {r.url: (r.body, r.error) for r in web.fetched(df, fetch).collect()}
    assert got == {"http://l1": ("é", None), "http://bad": (None, "OSError: no route"), "http://gone": ("é", "HTTP 404"), "http://u8": ("é", None)}


def test_robots(spark):
    df = spark.createDataFrame([("http://x/private/a", "User-agent: *\nDisallow: /private/"), ("http://x/a", "User-agent: *\nDisallow: /private/"), ("http://x/private/a", None)], "u string, r string")
    assert [r.a for r in df.select(web.allowed(F.col("u"), F.col("r")).alias("a")).collect()] == [False, True, True]


def test_intermediate_tables_go_away(spark):
    from pathlib import Path

    from corpusloom.sources.shared import drop_tables, shared_dir, shared_table

    df = shared_table(spark.range(5), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and Path(path).exists() and path.startswith(shared_dir(spark).removeprefix("file:"))
    assert drop_tables(spark) >= 1 and not Path(path).exists() and drop_tables(spark) == 0
