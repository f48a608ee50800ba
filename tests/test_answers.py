"""The whole path from questions to answers on a handful of passages."""

from corpusloom.plans.retrieve import answered, asked_phrases, retrieved

PASSAGES = [
    (1, "Fees", "The M.Tech fee is high.", "u1", ""),
    (2, "Fees", "The B.Tech fee is low.", "u2", ""),
    (3, "Rules", "Hostel rules forbid noise.", "u3", ""),
    (4, "Rest", "Nothing else matters here.", "u4", ""),
]


def path(spark, question, score):
    """Answers where score(phrase, doc_id) is the dense side and nothing is found by keyword."""
    cases = spark.createDataFrame([("c", question), ("n", None)], "case_name string, question string")
    docs = spark.createDataFrame(PASSAGES, "doc_id bigint, title string, text string, source_url string, fetched string")
    asked = asked_phrases(cases, "case_name", "question")
    rows = [(r.ask_id, p[0], float(score(r.phrase, p[0]))) for r in asked.collect() for p in PASSAGES]
    dense = spark.createDataFrame(rows, "ask_id bigint, doc_id bigint, score double")
    found = retrieved(asked, dense, dense.where("false"), docs, "case_name", "doc_id")
    (row,) = answered(asked, found, "case_name").collect()
    return row, {(r.part_no, r["rank"]): r.doc_id for r in found.collect()}


def test_parts_are_answered_apart_without_contradicting_passages(spark):
    best = lambda phrase, i: {"B.Tech": (9, 8, 1, 2), "rules": (1, 2, 9, 8)}["B.Tech" if phrase.startswith("What") and "rules" not in phrase else "rules"][i - 1] / 10
    row, found = path(spark, "What is the B.Tech fee and where are the hostel rules?", best)
    assert found[0, 1] == 2 and found[0, 4] == 1  # the M.Tech passage has the best score and is the last
    assert row.answer.split("\n\n")[0] == 'On "What is the B.Tech fee?" — Fees says: The B.Tech fee is low.'
    assert 'On "where are the hostel rules?" — Rules says: Hostel rules forbid noise.' in row.answer
    assert row.conflicts == 2 and row.answer.count("(Note: ") == 2  # both parts: two best from other pages
    assert {p for p, _ in found} == {-1, 0, 1} and row.context.startswith("[Rules — u3]") and row.blocks == 4


def test_phrasings_take_turns(spark):
    row, found = path(spark, "Where is it?", lambda phrase, i: (5 - i if phrase.endswith("?") else i) / 100)
    assert [found[0, r] for r in (1, 2, 3, 4)] == [1, 4, 2, 3]
    assert row.conflicts == 0


def test_no_passages(spark):
    cases = spark.createDataFrame([("c", "Where is it?")], "case_name string, question string")
    asked = asked_phrases(cases, "case_name", "question")
    none = spark.createDataFrame([], "ask_id bigint, doc_id bigint, score double")
    docs = spark.createDataFrame([], "doc_id bigint, title string, text string, source_url string, fetched string")
    row = answered(asked, retrieved(asked, none, none, docs, "case_name", "doc_id"), "case_name").first()
    assert row.answer == "No good match found for: Where is it?."
