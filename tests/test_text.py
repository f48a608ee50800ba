from pyspark.sql import functions as F

from corpusloom.functions import attributes, html, questions, tables, text
from corpusloom.operators import chunking
from corpusloom.sources import raw_files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def words(n, w="w"):
    return " ".join(f"{w}{i}" for i in range(n))


def sizes(spark, body):
    df = spark.createDataFrame([("f.txt", None, None, None, body)], "file string, source_url string, title string, fetched string, body string")
    return [len(r.text.split()) for r in chunking.chunk_table(df).orderBy("chunk_no").collect()]


def test_chunks_may_exceed_the_budget_by_the_overlap(spark):
    assert sizes(spark, words(140) + "\n" + words(150)) == [140, 180]


def test_long_paragraphs_become_windows(spark):
    assert sizes(spark, words(250)) == [150, 130, 10]
    assert sizes(spark, words(100) + "\n\n" + words(200)) == [100, 150, 80]


def test_empty_bodies_have_no_chunks(spark):
    assert sizes(spark, None) == [] and sizes(spark, " \n \n") == []


def test_chunk_ids_and_defaults(spark):
    df = spark.createDataFrame([("a_b.txt", None, None, None, "x y")], "file string, source_url string, title string, fetched string, body string")
    r = chunking.chunk_table(df).first()
    assert (r.id, r.title, r.source_url, r.text) == ("a_b::0", "a_b", "", "x y")


def test_rejoined_sentences(spark):
    assert one(spark, "more than\n678 students\nGoogle", text.rejoined_sentences) == "more than 678 students\nGoogle"
    assert one(spark, "included:\nlower\n\nx", text.rejoined_sentences) == "included:\nlower\n\nx"


def test_sentences_and_cuts(spark):
    assert one(spark, "One. Two! Three?", text.first_sentences) == "One. Two!"
    assert one(spark, "a " * 300, text.first_sentences).endswith("a...")
    assert one(spark, "x" * 1200, text.truncated) == "x" * 1000 + "..."
    assert one(spark, "B. Tech. is here. Next one.", text.lead_sentence) == "B. Tech. is here."
    assert one(spark, "on 19 th Aug and 31 ST Dec", text.ordinals_joined) == "on 19th Aug and 31ST Dec"
    assert one(spark, "1800‑180–5522 ‘x’​", text.plain_punctuation) == "1800-180-5522 'x'"
    assert one(spark, None, text.clean) == "" and one(spark, " a  b ", text.clean) == "a b"


def test_urls_and_titles(spark):
    assert one(spark, "https://x.org/a/b-c/?q=1", text.slug) == "a_b_c"
    assert one(spark, "https://x.org", text.slug) == "home"
    assert one(spark, "https://drive.google.com/open?id=" + "k" * 22, text.drive_id) == "k" * 22
    assert one(spark, "https://x.org/uploads/2024/07/a.pdf", text.upload_month) == "2024-07-01"
    df = spark.createDataFrame([("View", "fee_list.PDF", "u"), ("abc", "", "u2"), (None, None, "u3"), ("Long title", "n", "u")], "a string, b string, c string")
    assert [r.t for r in df.select(text.document_title(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == ["View", "u2", "u3", "Long title"]


def test_attributes(spark):
    assert one(spark, "system technology", attributes.programmes) == ["mtech"]
    assert one(spark, "in 2025–2026 and 2024-25", attributes.years) == ["2024-25", "2025-26"]
    df = spark.createDataFrame([("fee for girls", "boys & girls"), ("fee for girls", "boys only"), ("fee", "boys"), ("B.Tech", "pg students")], "q string, t string")
    asked, found = ({k: f(F.col(c)) for k, f in attributes.READERS.items()} for c in ("q", "t"))
    assert [r.c for r in df.select(attributes.contradicts(asked, found).alias("c")).collect()] == [False, True, False, True]


def test_questions(spark):
    assert one(spark, "Tell me about the 5G lab and when was it announced", questions.decompose) == ["Tell me about the 5G lab", "when was the 5G lab announced"]
    assert one(spark, "fees and hostel rules for girls", questions.decompose) == ["fees and hostel rules for girls"]
    assert one(spark, "Who is the dean; what does $1 \\d it cost?", questions.decompose)[0] == "Who is the dean?"
    assert one(spark, "and for girls?", questions.looks_like_followup) is True
    assert one(spark, "is the hostel fee the same?", questions.looks_like_followup) is False
    df = spark.createDataFrame([("what about M.Tech?", "B.Tech fee?")], "q string, p string")
    assert df.select(questions.glued(F.col("q"), F.col("p")).alias("g")).first().g == "B.Tech fee - M.Tech"
    assert one(spark, "fee?", questions.variants) == ["fee?", "fee"] and one(spark, "???", questions.variants) == ["???"]
    assert one(spark, "  ", questions.request_error) == "empty" and one(spark, "x" * 501, questions.request_error) == "too long"


def test_tables(spark):
    df = spark.createDataFrame([(["S.No", "Fee", "First Year", "First Year"], [["1", "Tuition", "125000", "125000"], ["2", "", None, " "]], "Fees")], "h array<string>, r array<array<string>>, c string")
    got = df.select(tables.row_lines(F.col("h"), F.col("r"), F.col("c")).alias("l"), tables.is_day_grid(F.col("h"), F.col("r")).alias("g")).first()
    assert got.l == ["Fees: Fee: Tuition — First Year: 125000"] and got.g is False
    grid = spark.createDataFrame([(["Jan 2026", "Feb", "Mar"], [["1", "2", "3 (Mon)"]])], "h array<string>, r array<array<string>>")
    assert grid.select(tables.is_day_grid(F.col("h"), F.col("r")).alias("g")).first().g is True
    assert one(spark, "Fees per year: fo'os'k |", lambda c: tables.clean_context(c, "(?i)state college")) == "Fees per year"


def test_headers(spark):
    df = spark.createDataFrame([("A: 1\nb : x:y\nA: 2\nno colon\n---\n body\n---\nrest ",), ("K: v",)], "v string")
    head, body = raw_files.header_and_body(F.col("v"))
    a, b = df.select(head.alias("h"), body.alias("b")).collect()
    assert a.h == {"a": "2", "b": "x:y"} and a.b == "body\n---\nrest"
    assert b.h == {"k": "v"} and b.b == ""


def test_html():
    page = "<html><title>T</title><nav>menu<a href='/n'>N</a></nav><body><h1>Head <b>x</b></h1><article><p>One<p>two <b>three<script>no</script></article><a href='b.html?q#f'>B</a><a href='http://o.org/'>O</a></body>"
    title, body, links = html.parse(page, "http://h.org/a/")
    assert title == "Headx" and body == "One\ntwo\nthree"
    assert html.internal(links, "h.org") == ["http://h.org/n", "http://h.org/a/b.html"]
    assert html.parse("", "u")[:2] == ("u", "")
