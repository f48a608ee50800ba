"""Model hooks, conversion, discovery, sinks, evaluation and the saved index on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compose, conversion, documents, evaluation, models
from corpusloom.plans.retrieve import LexicalIndex, saved_index
from corpusloom.sources import discovery, raw_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- models


def test_encoder_gives_unit_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "doc_id bigint, text string")
    out = dict(rows(models.encoded(df, "doc_id", "text", lambda t: np.array([[len(x), 1.0] for x in t]))))
    assert out[2] == [0.0, 1.0] and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in out.values())


def test_scorer_and_its_failure(spark):
    pool = spark.createDataFrame([("q", "aa", 1), ("q", "a", 2)], "question string, text string, pool_pos int")
    good = models.scored(pool, "question", F.col("text"), lambda q, t: [len(x) for x in t])
    assert sorted(r.relevance for r in good.collect()) == [1.0, 2.0]

    def broken(q, t):
        raise OSError("no model")

    for scorer in (broken, None):
        assert [r.relevance for r in models.scored(pool, "question", F.col("text"), scorer).collect()] == [None, None]


def test_answer_model_falls_back(spark):
    df = spark.createDataFrame([("good", "plain 1"), ("empty first", "plain 2"), ("bad", "plain 3"), ("empty", "plain 4")], "name string, answer string")

    def client(prompt, low):
        if prompt == "bad":
            raise OSError("429")
        return "" if prompt == "empty" or prompt == "empty first" and not low else f"said {prompt}"

    out = {r.name: (r.answer, r.mode) for r in models.answered_by_model(df, F.col("name"), client, "m").collect()}
    assert out == {
        "good": ("said good", "llm (m)"), "empty first": ("said empty first", "llm (m)"), "bad": ("plain 3", "extractive (model call failed: 429)"),
        "empty": ("plain 4", "extractive (model call failed: model returned an empty answer)"),
    }
    assert {r.mode for r in models.answered_by_model(df, F.col("name"), None).collect()} == {"extractive (no model)"}


def test_follow_ups_are_rewritten_or_joined(spark):
    df = spark.createDataFrame([(1, "and for girls?", ["Hostel fee?", " "]), (2, "and for boys?", ["Hostel fee?"]), (3, "What is the hostel fee?", ["x"]), (4, "and for girls?", None), (5, "and it?", ["Fee?"])], "n int, q string, h array<string>")

    def client(prompt, low):
        if "boys" in prompt:
            raise OSError("down")
        return "a\nb" if "and it" in prompt else '"Hostel fee for girls?"'

    with_model = {r.n: (r.searched, r.note) for r in models.resolved(df, "q", "h", client).collect()}
    assert with_model == {1: ("Hostel fee for girls?", "rewritten"), 2: ("Hostel fee - for boys", "combined"), 3: ("What is the hostel fee?", None), 4: ("and for girls?", None), 5: ("Fee - it", "combined")}
    plain = {r.n: r.searched for r in models.resolved(df, "q", "h").collect()}
    assert plain[1] == "Hostel fee - for girls" and plain[4] == "and for girls?"


def test_first_working_plan(spark):
    def dense():
        raise ImportError("no encoder")

    name, df = models.first_working([("hybrid", dense), ("keyword", lambda: spark.range(1))])
    assert name == "keyword" and df.count() == 1
    with pytest.raises(ImportError):
        models.first_working([("hybrid", dense)])


# --- conversion


def items(spark, listed):
    return spark.createDataFrame([(d, n, k, t, h, c, None) for d, n, k, t, h, c in listed], conversion.ITEMS)


def test_tables_carry_what_stands_before_them(spark):
    lead = "These are the fees of all students in the coming year. More follows."
    df = items(spark, [
        ("a", 0, "section", "Fee Structure for 2026:", None, None), ("a", 1, "text", lead, None, None), ("a", 2, "table", None, ["S.No", "Head", "Rs."], [["1", "Tuition", "500"], ["2", "Tuition", "500"]]),
        ("a", 3, "table", None, ["Jan 2026", "Feb 2026", "Mar 2026"], [["1", "2", "3 (Mon)"], ["4", "5", "6"]]), ("a", 4, "section", "State Institute Letterhead", None, None),
        ("a", 5, "table", None, ["", ""], [["x", "x"], ["", "y"]]), ("a", 6, "text", " ", None, None), ("b", 0, "table", None, ["Slot", "Slot"], [["A", "A"], [None, "B"]]), ("e", 0, "error", None, None, None),
    ])
    got = rows(conversion.document_lines(df, "(?i)letterhead").select("doc", "item_no", "line_no", "line"))
    first = "These are the fees of all students in the coming year. | Fee Structure for 2026: "
    assert [(d, i, x) for d, i, _, x in got] == [
        ("a", 0, "Fee Structure for 2026:"), ("a", 1, lead), ("a", 2, first + "Head: Tuition — Rs.: 500"), ("a", 2, first + "Head: Tuition — Rs.: 500"), ("a", 4, "State Institute Letterhead"),
        ("a", 5, "These are the fees of all students in the coming year.: x"), ("a", 5, "These are the fees of all students in the coming year.: y"), ("b", 0, "Slot: A"), ("b", 0, "Slot: B"),
    ]
    texts = {r.doc: (r.title, r.body) for r in conversion.document_texts(df, "(?i)letterhead").collect()}
    assert texts["a"][0] == "Fee Structure for 2026:" and texts["a"][1].startswith("Fee Structure") and texts["e"] == ("", "")


def test_converter_failures_are_rows_and_files_have_headers(spark, tmp_path):
    def convert(body):
        if body == b"bad":
            raise ValueError("broken")
        return [("section", "Rules of the hostel", [], []), ("text", body.decode(), [], [])]

    files = spark.createDataFrame([("d1", bytearray(b"one line")), ("d2", bytearray(b"bad"))], "doc string, content binary")
    made = conversion.converted(files, "doc", "content", convert)
    assert {(r.doc, r.kind, r.error) for r in made.collect()} == {("d1", "section", None), ("d1", "text", None), ("d2", "error", "ValueError: broken")}
    inventory = spark.createDataFrame([("d1", "doc_d1.txt", "http://a/d1.pdf", "Title", "2025-03-04T00:00:00Z"), ("d2", "doc_d2.txt", "http://a/d2.pdf", "Second", "")], "doc string, out_file string, url string, doc_title string, modified_time string")
    out = conversion.converted_files(conversion.document_texts(made, "^$"), inventory, "2026-01-01")
    raw_files.write_converted(out, str(tmp_path / "c"))
    value = dict(rows(spark.read.parquet(str(tmp_path / "c"))))
    assert value["doc_d1.txt"] == "SOURCE_URL: http://a/d1.pdf\nTITLE: Rules of the hostel\nFETCHED: 2025-03-04\n---\nDocument: Rules of the hostel (dated 2025-03-04)\nRules of the hostel\none line\n"
    assert "Document: Second (dated 2026-01-01)" in value["doc_d2.txt"]


# --- discovery


PAGE = """<html><body><nav><A HREF=/menu>Menu</a></nav><p>See <b><a href="/drive/file/d/AAAAAAAAAAAAAAAAAAAAAA/view#x">One
 file</b></a> and <a href='docs/b.PDF?v=1'>B<a href='http://other.example/c.pdf'>C</a><a>none</a> text <a href='pic.JPG'>pic</a><a href='/p?q=1#f'>page</a>
<a href="mailto:x@y.example">mail</a><a href="http://[bad">bad</a>"""


def test_links_of_malformed_pages(spark):
    pages = spark.createDataFrame([("http://a.example/x/", PAGE), ("http://a.example/a/", "<a href=/drive/file/d/AAAAAAAAAAAAAAAAAAAAAA/view>Again"), ("http://a.example/n", None)], "url string, html string")
    links = discovery.page_links(pages)
    found = {r.doc_key: (r.kind, r.link_text, r.found_on) for r in discovery.discovered(links, "a.example", "[a-z0-9.-]+/drive").collect()}
    assert found == {"drive:AAAAAAAAAAAAAAAAAAAAAA": ("drive", "Again", "http://a.example/a/"), "web:http://a.example/x/docs/b.PDF?v=1": ("web", "B", "http://a.example/x/")}
    assert {r.url for r in discovery.internal_links(links, "a.example").collect()} >= {"http://a.example/menu", "http://a.example/p"}
    assert not any(r.url.lower().endswith((".jpg", ".pdf")) for r in discovery.internal_links(links, "a.example").collect())
    assert {r.url for r in discovery.pdf_links(links, "a.example").collect()} == {"http://a.example/x/docs/b.PDF"}
    visited = spark.createDataFrame([("http://a.example/p",)], "url string")
    step = {r.url for r in discovery.crawl_step(discovery.internal_links(links, "a.example"), visited, ("/menu",)).collect()}
    assert "http://a.example/p" not in step and "http://a.example/menu" not in step


def test_metadata_errors_hide_the_key(spark):
    docs = spark.createDataFrame([("drive:a", "drive", "a", "u"), ("drive:b", "drive", "b", "u"), ("web:c", "web", None, "http://h/uploads/2024/05/c.pdf")], "doc_key string, kind string, drive_id string, url string")

    def client(i):
        if i == "b":
            raise OSError("denied for key=S3CRET")
        return {"name": "A.pdf", "mimeType": "application/pdf", "size": "12", "modifiedTime": "2024-01-02T00:00:00Z"}

    told = discovery.fetched_metadata(docs, client, "S3CRET")
    out = {r.doc_key: r for r in discovery.enriched(docs, told).collect()}
    assert out["drive:a"].size_bytes == "12" and out["drive:a"].error_text is None
    assert out["drive:b"].error_text == "OSError: denied for key=<KEY>" and (out["web:c"].doc_name, out["web:c"].modified_time) == ("c.pdf", "2024-05-01")
    assert {r.error_text for r in discovery.enriched(docs, told.limit(0)).collect()} == {"no metadata", None}


def test_known_addresses(spark):
    files = spark.createDataFrame([("a.txt", "SOURCE_URL: http://a/x/\nTITLE: t\n---\n"), ("doc_b.txt", "SOURCE_URL: http://a/d.pdf\n---\n"), ("e.txt", "SOURCE_URL: \n---\n")], "file string, value string")
    extra = spark.createDataFrame([("http://a/x",), ("http://a/y",), ("http://a/y",)], "url string")
    assert rows(discovery.known_urls(files, extra)) == [("http://a/x",), ("http://a/y",)]


# --- sinks and states


def test_runs_are_added_and_the_last_one_counts(spark, tmp_path):
    path, schema = str(tmp_path / "status"), "doc_key string, outcome string, run_at string"
    assert raw_files.read_latest(spark, path, schema, "doc_key", "run_at").count() == 0
    raw_files.write_latest(spark.createDataFrame([("a", "error", "1"), ("b", "ok", "1")], schema), path)
    raw_files.write_latest(spark.createDataFrame([("a", "ok", "2"), (None, "ok", "2")], schema), path)
    assert rows(raw_files.read_latest(spark, path, schema, "doc_key", "run_at").select("doc_key", "outcome")) == [("a", "ok"), ("b", "ok")]
    assert raw_files.read_feedback(spark, str(tmp_path / "nothing")).count() == 0


def test_cached_pdfs_win(spark):
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",), ("u1",)], "url string")
    cached = spark.createDataFrame([("u1", bytearray(b"%PDF old"))], "url string, content binary")

    def fetch(u):
        if u == "u4":
            raise OSError("gone")
        return {"u1": b"%PDF new", "u2": b"%PDF 2", "u3": b"<html>"}[u]

    out = {r.url: (bytes(r.content) if r.content else None, r.error) for r in raw_files.fetched_pdfs(urls, fetch, cached).collect()}
    assert out == {"u1": (b"%PDF old", None), "u2": (b"%PDF 2", None), "u3": (None, "not a PDF"), "u4": (None, "OSError: gone")}
    assert {r.error for r in raw_files.fetched_pdfs(urls.where("url = 'u2'"), fetch, cached, 3).collect()} == {"too large"}


def test_refresh_keeps_marks_and_replaces_bodies(spark):
    stored = spark.createDataFrame([("a", "old", "T", "d1", None, "p"), ("b", "same", "T", "d1", None, "p"), ("c", "x", "T", "d1", "d0", "p"), ("d", "x", "T", "d1", None, "p")], "url string, body string, title string, fetched string, stale string, found_on string")
    fetched = spark.createDataFrame([("a", "new", None, True, True), ("b", " same ", "U", True, True), ("c", None, None, True, False), ("d", None, None, True, False)], "url string, body string, title string, html boolean, reachable boolean")
    out = rows(documents.refreshed(stored, documents.snapshot_diff(stored, fetched, "url"), fetched, "url", F.lit("2026-01-31")))
    assert out == [("a", "new", "T", "2026-01-31", None, None), ("b", "same", "T", "d1", None, "p"), ("c", "x", "T", "d1", "d0", "p"), ("d", "x", "T", "d1", "2026-01-31", "p")]


# --- evaluation


def test_facts_pages_and_places(spark):
    found = spark.createDataFrame([("q", 0, 1, "u1", "no"), ("q", 0, 2, "u2", "the 19 th of\nMay"), ("q", 1, 1, "u1", "no"), ("q", 1, 2, "u3", "Fact here")], "name string, part_no int, rank int, source_url string, text string")
    cases = spark.createDataFrame([("q", ["fact"], []), ("d", ["could not find"], []), ("z", [], ["x"])], "name string, must array<string>, must_not array<string>")
    assert rows(evaluation.answerable(cases, "name")) == [("q", "fact")]
    assert rows(evaluation.passage_ranks(found, evaluation.answerable(cases, "name"), "name")) == [("q", 3)]  # u1 counts once
    facts = spark.createDataFrame([("q", "th.of.May"), ("q2", "x")], "name string, pattern string")
    assert dict(rows(evaluation.fact_ranks(found, facts, "name"))) == {"q": 2, "q2": None}
    accepted = spark.createDataFrame([("q", ["nope", "3"]), ("r", ["u"])], "name string, accepted array<string>")
    assert {r.name: (r.hit, r.top_url) for r in evaluation.page_hits(found, accepted, "name").collect()} == {"q": (True, "u1"), "r": (False, None)}


def test_check_summary_and_replay(spark):
    results = spark.createDataFrame([("a", True, "llm (m)"), ("b", False, "extractive (x)"), ("c", False, None)], "name string, passed boolean, mode string")
    r = evaluation.check_summary(results).first()
    assert (r.checks, r.passed, r.without_model, r.names, r.reasons) == (3, 1, 2, "b, c", "extractive (x)")
    assert evaluation.check_summary(results.limit(0)).first().checks == 0 and evaluation.named(results, "name", "b").count() == 1
    turns = spark.createDataFrame([("c", 1, "What is the hostel fee for boys?"), ("c", 2, "and for girls?"), ("c", 3, "and in 2025?"), ("d", 1, "and for girls?"), ("d", 2, None)], "conv string, n int, q string")
    out = {r.conv: (r.turns, r.understood_as, r.combined) for r in evaluation.replayed(turns, "conv", [F.col("n")], "q").collect()}
    assert out == {"c": (3, "What is the hostel fee for boys - for girls - in 2025", True), "d": (2, "and for girls?", False)}


def test_conflict_notes_name_the_pages(spark):
    best = spark.createDataFrame([("q", 0, "s", "A", "Text of a. B.", True, "A", "B")], "k string, part_no int, sub_question string, title string, text string, conflict boolean, title1 string, title2 string")
    assert "(Note: Top two matches come from different pages (A vs B) with little shared content" in compose.extractive_answers(best, "k").first().answer


# --- the index


def test_index_is_saved_and_made_anew_for_new_data(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = [(1, "hostel fee rules"), (2, "library rules and hours"), (3, "hostel rooms"), (4, "fee waiver"), (5, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(path)
    read = lambda: spark.read.parquet(path).where("text is not null")
    ask = spark.createDataFrame([("q", "hostel fee")], "name string, question string")
    fresh = LexicalIndex(read(), "doc_id", "text").search(ask, "name", "question", 3)
    first = saved_index(spark, path, read(), "doc_id", "text")
    again = saved_index(spark, path, read().where("false"), "doc_id", "text")  # loaded, not made
    want = rows(fresh)
    assert want and rows(first.search(ask, "name", "question", 3)) == want == rows(again.search(ask, "name", "question", 3))
    norms = {r.doc_id: r.s for r in first.weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()}
    assert norms and all(abs(x - 1) < 1e-9 for x in norms.values())
    spark.createDataFrame([(6, "hostel fee")], "doc_id bigint, text string").write.mode("append").parquet(path)
    assert 6 in {r.doc_id for r in saved_index(spark, path, read(), "doc_id", "text").search(ask, "name", "question", 9).collect()}


# --- crawl

SITE = {
    "http://a.example": "<a href='/one/'>1</a><a href=/two>2</a><a href=/skip/x>s</a><main>short</main>",
    "http://a.example/one": "<h1>One</h1><main>" + "word " * 40 + "<a href='/three?x=1#y'>3</a></main>",
    "http://a.example/two": "<h1>Two</h1><main>" + "text " * 31 + "</main><a href='http://b.example/'>b</a>",
    "http://a.example/three": "<main>" + "deep " * 50 + "<a href=/four>4</a></main>",
}


def site_fetcher():
    site = SITE  # the workers don't know this module

    def fetch(url):
        if url not in site:
            raise OSError("not there")
        return 200, "text/html; charset=utf-8", site[url].encode()

    return fetch


def test_crawl_of_a_site(spark):
    from corpusloom.sources.crawl import crawl, fetched_pages

    fetch_site = site_fetcher()
    seeds = spark.createDataFrame([("http://a.example/",), (None,)], "url string").where("url is not null")
    out = {r.url.removeprefix("http://a.example"): (r.depth, r.outcome) for r in crawl(seeds, fetch_site, "a.example", ("/skip/",)).collect()}
    assert out == {"": (0, "short"), "/one": (1, "saved"), "/two": (1, "saved"), "/skip/x": (1, "pattern"), "/three": (2, "saved"), "/four": (3, "error: OSError: not there")}
    few = {r.url: r.outcome for r in crawl(seeds, fetch_site, "a.example", ("/skip/",), max_pages=1).collect()}
    assert few["http://a.example/one"] == "saved" and few["http://a.example/two"] == "beyond the limit" and len(few) == 4
    seen = spark.createDataFrame([("http://a.example/one/",)], "url string")
    assert "/three" not in "".join(r.url for r in crawl(seeds, fetch_site, "a.example", visited=seen).collect())
    assert crawl(seeds, fetch_site, "a.example", visited=seeds).count() == 0
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /one")], "host string, robots string")
    got = {r.url: r.outcome for r in fetched_pages(spark.createDataFrame([("http://a.example/one",), ("http://a.example/two",)], "url string"), fetch_site, robots).collect()}
    assert got == {"http://a.example/one": "robots", "http://a.example/two": "ok"}


def test_attempts_across_buckets(spark):
    from corpusloom.operators.feedback import attempts

    import random

    rnd = random.Random(1)
    ts = sorted(rnd.randrange(0, 40_000) for _ in range(120))
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(ts)], "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    out = {r.event_id: r.attempts for r in attempts(df, "user_id", "ts", 3600).collect()}
    assert out == {i: sum(1 for j, u in enumerate(ts) if j % 2 == i % 2 and t - 3600 < u <= t) for i, t in enumerate(ts)}
