"""The training-data operators on small fixtures: nulls, empty and very long texts, repeated rows,
empty tables, extra columns; and brute force where there is no SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import answer_defects, common, mojibake, near_copies, packing, page_template, personal_info, registry, repeated_lines, scan_noise, stuffing, tokenizer

CHUNKS = "id string, text string, source_url string, title string, fetched string, file string, host string, key string, n int"
FEEDBACK = "feedback_id bigint, question string, answer string, mode string, comment string"
DOCS = "doc_id bigint, text string, tokens string"


def chunks(spark, rows):
    """(id, text[, url[, title[, file]]]); the schema has extra columns with names the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "http://www.h.example/a", r[3] if len(r) > 3 else None, None, r[4] if len(r) > 4 else "p.txt", "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, CHUNKS)


ODD = [("n", None), (None, "text"), ("e", ""), ("b", " \n\t"), ("t", "one"), ("u", "x", None, "T"), ("v", "x", "", None, None)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["p1_found", "p1_sanitised", "p2_found", "p3_found", "p3_bodies", "p5_found", "p5_stripped", "p6_found", "p6_repaired", "p7_found", "p7_restored"])
def test_empty_and_odd_chunks(spark, name):
    f = {
        "p1_found": lambda c: personal_info.personal_info(c, spark.createDataFrame([], FEEDBACK)), "p1_sanitised": lambda c: personal_info.sanitise(c, spark.createDataFrame([], FEEDBACK)),
        "p2_found": near_copies.near_copies, "p3_found": page_template.boilerplate_lines, "p3_bodies": page_template.main_bodies, "p5_found": repeated_lines.repeated_lines,
        "p5_stripped": repeated_lines.strip_repeated, "p6_found": scan_noise.scan_noise, "p6_repaired": scan_noise.repair_scans, "p7_found": mojibake.restored_fields, "p7_restored": mojibake.restored_fields,
    }[name]
    assert f(chunks(spark, ODD[:0])).collect() == []
    rows = f(chunks(spark, ODD + ODD)).collect()
    if name in ("p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_found", "p7_restored"):
        assert rows == []


# --- 1


def people(n=40):
    first, last = ("Avira", "Belto", "Corin", "Dasha"), ("Zolnar", "Yestra", "Xandor", "Wimble")
    out = []
    for i in range(n):
        a, b = first[i % 4], last[i // 4 % 4]
        out.append(f"Dr. {a} {b} may be called at +91 5{i:04} 3{i:04}. {a} {b}, BT{10 + i % 10}-CSE-{100 + i}, lives at House No. {i + 1}, Mill Road, Ostrow.")
        out.append(f"The office keeps order {5000000000 + i * 7919} and receipt {6000000000 + i * 104729} of the Mill Department in Room {i}.")
    return out


def test_personal_info_by_co_occurrence(spark):
    texts = people()
    probes = ["Please tell Belto Xandor in the evening.", "For queries write to a.b+c (at) x.example or AB@Y.EXAMPLE", "Call 5123456789 soon", "order 5123456789 came", "roll number 123456", "Ask Unknown Person Here", "ISBN 978-0-1638-2388-5 and circular 404/20-44157"]
    c = chunks(spark, [(f"t{i}", t) for i, t in enumerate(texts)] + [(f"p{i}", t) for i, t in enumerate(probes)] + [("calls", "\n".join(f"Call +91 5{i:04} 4{i:04} soon" for i in range(20)))])
    f = spark.createDataFrame([(7, "asked by Avira Wimble", None, None, "x@y.example"), (7, "asked by Avira Wimble", None, None, "x@y.example"), (None, "z@y.example", None, None, None)], FEEDBACK)
    kinds = defaultdict(set)
    for src, i, k in got(personal_info.personal_info(c, f)):
        kinds[src, i].add(k)
    assert kinds["chunks.text", "t0"] == {"name", "phone", "id_number", "address"} and ("chunks.text", "t1") not in kinds
    assert [kinds["chunks.text", f"p{i}"] for i in range(7)] == [{"name"}, {"email"}, {"phone"}, set(), {"id_number"}, set(), set()]
    assert kinds["feedback.question", "7"] == {"name"} and kinds["feedback.comment", "7"] == {"email"}
    clean = {(s, i): t for s, i, t in got(personal_info.sanitise(c, f))}
    assert clean["chunks.text", "p0"] == "Please tell [NAME] in the evening." and clean["chunks.text", "t1"] == texts[1]


@pytest.mark.parametrize("bound", [300_000, 0])
def test_rare_names_and_streets(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "LOOKUP_ROWS", bound)
    rare = ["We met Dr. Quilla Vornak there.", *(f"House No. {i}, Old Brelk, Ostrow" for i in range(3)), "see 12 Old Brelk, Ostrow now"]
    c = chunks(spark, [(f"t{i}", t) for i, t in enumerate(people() + ["Common Words Here"] * 99)] + [(f"r{i}", t) for i, t in enumerate(rare)])
    none = spark.createDataFrame([], FEEDBACK)
    found = {(i, k) for _, i, k in got(personal_info.personal_info(c, none))}
    assert ("r0", "name") in found and ("r4", "address") in found and ("t0", "name") in found
    clean = {i: t for _, i, t in got(personal_info.sanitise(c, none))}
    assert clean["r0"] == "We met Dr. [NAME] there." and "Brelk" not in clean["r4"]


def test_short_identifiers_and_plain_names(spark):
    probes = {"pan": "Fee paid twice against PAN HADZX7960G.", "staff": "Candidate staff number NIE-46388 did not appear.", "plain": "my name is belto xandor, when will it come?", "other": "Course CSL-5623 replaces EEL-5733, tender NIE/2026/148 closes."}
    more = ["The scholar holds PAN QWERT1234Y now"] + [f"staff number ABC-{40000 + i} is kept" for i in range(4)]
    c = chunks(spark, [(f"t{i}", t) for i, t in enumerate(people() + more)] + list(probes.items()))
    kinds = defaultdict(set)
    for _, i, k in got(personal_info.personal_info(c, spark.createDataFrame([], FEEDBACK))):
        kinds[i].add(k)
    assert [kinds[i] for i in probes] == [{"id_number"}, {"id_number"}, {"name"}, set()]


def test_personal_info_is_the_same_joined_or_broadcast(spark, monkeypatch):
    probes = {
        "lower": ("name: belto xandor, when will it come?", "name: [NAME], when will it come?"),
        "initial": ("We met Dr. Q.Vornak there.", "We met Dr. [NAME] there."),
        "behind": ("from s.Avira-Belto Xandor today", "from s.Avira-[NAME] today"),
        "before": ("for Avira Zolnar-Rao@ost only", "for [NAME]-Rao@ost only"),
        "opening": ("told A. Jo-paul of it", "told [NAME] of it"),
        "street": ("see 12 Old Brelk,Ostrow now", "see [ADDRESS] now"),
        "number": ("paid against PAN HADZX7960G.", "paid against PAN [ID_NUMBER]."),
    }
    more = ["Mr. Jo-paul came", "Mr. Jo went", "The scholar holds PAN QWERT1234Y now", *(f"House No. {i}, Old Brelk, Ostrow" for i in range(3))]
    c = chunks(spark, [(f"t{i}", t) for i, t in enumerate(people() + more)] + [(k, t) for k, (t, _) in probes.items()])
    f = spark.createDataFrame([(7, "avira wimble", None, None, "belto, xandor?")], FEEDBACK)
    found, clean = [], []
    for bound in (300_000, 0):
        monkeypatch.setattr(common, "LOOKUP_ROWS", bound)
        found.append(got(personal_info.personal_info(c, f)))
        clean.append(got(personal_info.sanitise(c, f)))
    assert found[0] == found[1] and clean[0] == clean[1]
    assert {i: t for _, i, t in clean[0] if i in probes} == {k: t for k, (_, t) in probes.items()}
    assert ("feedback.question", "7", "[NAME]") in clean[0] and ("feedback.comment", "7", "[NAME]?") in clean[0]


def test_a_text_asks_for_all_it_looks_up():
    r = random.Random(7)
    names = "avira zolnar jean paul jean-paul jo jo-paul a.zolnar o'brien d'souza νικος νικοσ'α i̇stan शर्मा शर्म राम a1bcd".split()
    ends = "brelk d'oro o'hara road a1x".split()
    signs, shown = ["call", "roll number", "order", "^"], ["+91 51234 51234", "5123456789", "BT10-CSE-101", "040-2345678 5123456789", "123 45 67 89"]
    every = {"n" + w: "" for w in names} | {"s" + w: "" for w in ends} | {"x" + w: "2.5,1.5" for w in signs} | {"f" + personal_info.shape(w): "1.0,0.5,1.0,1.0" for w in shown}
    between = [" "] * 9 + [", ", ",", ".", "-", "'", "\n", "@", " (", ") ", " Dr. ", " A.", " A. ", " b. ", " 12 ", " 7 Old ", "s.Jean-", "3", "\u093f"]
    written = [str.lower, str.capitalize, str.title, str.upper]
    some = 0
    for _ in range(1500):
        words = [r.choice(written)(r.choice(names + ends + ["in", "old"])) if r.random() < 0.85 else f"{r.choice(signs)} {r.choice(shown)}" for _ in range(r.randint(2, 8))]
        t = "".join(w + r.choice(between) for w in words)
        known = {k: v for k, v in every.items() if r.random() < 0.6}
        spans = personal_info.Disclosure(known, frozenset(["street\tlane"])).spans(t)
        held = {k: known[k] for k in personal_info.asked(t) if k in known}
        assert personal_info.Disclosure(held, frozenset(["street\tlane"])).spans(t) == spans, t
        some += len(spans)
    assert some > 300


def test_nothing_is_found_without_the_learned_tables(spark):
    texts = people() + ["write to a.b@x.example"]
    d = personal_info.Disclosure({}, frozenset())
    assert all(d.spans(t) == [] for t in texts)
    table, classes = personal_info.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    known = {r.key: r.value for r in table.collect()}
    full = personal_info.Disclosure(known, classes)
    assert {k for t in texts for _, _, k in full.spans(t)} == set(personal_info.TYPES)
    assert any(k[0] == "x" and k in personal_info.asked(t) for t in texts for k in known)


# --- 2


def brute_pairs(rows, least):
    sets = {}
    for i, text, title in rows:
        if i is None or text is None or len(common.narrow_words(text)) < 20:
            continue
        w = near_copies.words_of(title, text)
        sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(60):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(25, 160))]
        for m in range(rnd.randrange(1, 5)):
            rows.append((f"g{g}::{m}", edited(rnd, base, rnd.randrange(0, max(1, len(base) // 9))), f"T {g}"))
    rows += [rows[0], ("long", " ".join(f"l{i}" for i in range(60_000)), None), ("long2", " ".join(f"l{i}" for i in range(60_010)), None), ("nb", rows[3][1].replace(" ", " "), rows[3][2])]
    df = chunks(spark, [(i, t, "u", ti) for i, t, ti in rows])
    truth = set(brute_pairs([(i, t, ti) for i, t, ti in dict.fromkeys(rows)], 0.6))
    found = set(got(near_copies.near_copies(df)))
    assert found <= truth and len(found) >= 0.98 * len(truth)


def test_large_classes_of_copies_stay_linear(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = text.replace("w30", "changed")
    rows = [(f"c{i:03}", text) for i in range(near_copies.EXPANDED + 20)] + [("d", other)]
    pairs = got(near_copies.near_copies(chunks(spark, rows)))
    assert len(pairs) == len(rows) - 1 and ("c000", "d") in pairs and all(a == "c000" for a, _ in pairs)


def test_code_words_and_their_radius():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, k in ((5, 4), (6, 4)):
        w = rnd.integers(0, 1 << 16, (50, n)).astype(np.uint64)
        near = list(near_copies.anchors_of(w, k))
        assert all(((a != w).sum(1) <= n - k).all() for a in near)
        for a in near:  # a code word gives itself back, whichever symbols are computed
            assert all((b == a).all() for b in near_copies.anchors_of(a, k))
        v = w.copy()
        v[:, 1] ^= np.uint64(7)  # one symbol off: some code word is near both
        assert all(any((x[i] == y[i]).all() for x in near for y in near_copies.anchors_of(v, k)) for i in range(len(w)))


def test_groups_of_near_copies(spark):
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[k * 12 :] + [f"x{i}" for i in range(k * 12)]) for k in range(8)]  # neighbours are near, ends aren't
    rows = [(f"c{k}", t) for k, t in enumerate(chain)] + [("c00", chain[0]), ("z", edited(rnd, [f"y{i}" for i in range(50)], 1)), ("n", None), (None, chain[0])]
    found = {r.id: r for r in near_copies.copy_groups(chunks(spark, rows + rows[:2])).collect()}
    pairs = brute_pairs([(i, t, None) for i, t in rows], 0.6)
    root = {i: i for i in found}
    for _ in found:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: r.group_id for i, r in found.items()} == root and found["c00"].class_id == "c0" and len(found) == 10
    assert near_copies.copy_groups(chunks(spark, [])).collect() == []


def test_long_runs_of_one_anchor_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "RUN", 3)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(f"r{i}", edited(rnd, base, 2), "") for i in range(8)]
    out = list(near_copies._runs(iter([])))
    assert out == []
    found = set(got(near_copies.near_copies(chunks(spark, [(i, t, "u", ti) for i, t, ti in rows]))))
    assert found == set(brute_pairs(rows, 0.6)) and found


def test_a_hot_anchor_is_never_held(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "RUN", 64)
    n = 10_000
    anchor = np.concatenate([np.full(5, 1), np.full(n, 2), np.full(3, 3)])
    key, code = np.arange(len(anchor)), np.zeros(len(anchor), np.int64)
    cols = [pa.array(x) for x in (anchor, key, code)]
    whole = pa.RecordBatch.from_arrays(cols, ["anchor", "key", "code"])
    out = list(near_copies._runs(whole.slice(lo, 1000) for lo in range(0, len(anchor), 1000)))
    passed = [b for b in out if b.column("b").null_count == b.num_rows and b.num_rows]
    assert max(b.num_rows for b in passed) <= 2 * 64 and sum(b.num_rows for b in passed) == n
    assert sum(b.num_rows for b in out) - n == 5 * 4 // 2 + 3  # pairs of the two short runs


def test_blocks_of_a_hot_anchor_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "RUN", 10)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(f"r{i:02}", edited(rnd, base, 2), "") for i in range(60)]
    assert set(got(near_copies.near_copies(chunks(spark, [(i, t, "u", ti) for i, t, ti in rows])))) == set(brute_pairs(rows, 0.6))


# --- 3


WORDS = [a + b for a in ("ash", "bir", "ced", "elm", "fir") for b in ("wood", "leaf", "root", "bark")]


def site(n=40):
    rnd = random.Random(1)
    body = lambda k: " ".join(rnd.choice("alpha beta gamma delta kappa sigma omega".split()) for _ in range(k)) + "."
    rows = []
    for i in range(n):
        lines = ["Home | About | News | Contact", f"Visitors: {i * 37}", f"Chapter {WORDS[i % 20]}{WORDS[i // 20]}", body(40), f"- item {i}: Rs. {i}", body(35), "Quick Links", "Late mandate", f"Fee sheet {i}", "All rights of Foo College are kept."]
        rows.append((f"w{i}", "\n".join(lines), f"http://h{i % 2}.example/p{i}", None, "w.txt"))
        rows.append((f"d{i}", "\n".join([f"Chapter {WORDS[i % 20]}{WORDS[i // 20]}", body(40), f"- item {i}: Rs. {i}"]), f"http://h{i % 2}.example/d{i}", None, "doc_d.txt"))
    return rows


def test_template_lines(spark):
    lines = defaultdict(set)
    for i, n in got(page_template.boilerplate_lines(chunks(spark, site() + site()[:4]))):
        lines[i].add(n)
    assert set(lines) == {f"w{i}" for i in range(40)}
    assert {i: v for i, v in lines.items() if v != {0, 1, 6, 7, 8, 9}} == {}
    bodies = dict(got(page_template.main_bodies(chunks(spark, site()))))
    assert len(bodies) == 40 and bodies["w0"].startswith("Chapter ashwoodashwood\n") and "Quick" not in bodies["w0"]


def test_long_notices_and_joined_lookups(spark, monkeypatch):
    notice = " ".join(f"cookie{k % 9}" for k in range(40)) + " on this site."
    rows = [(i, t + ("\n" + notice if i.startswith("w") else ""), u, ti, f) for i, t, u, ti, f in site()]
    want = {f"w{i}": {0, 1, 6, 7, 8, 9, 10} for i in range(40)}
    for bound in (300_000, 0):
        monkeypatch.setattr(common, "LOOKUP_ROWS", bound)
        lines = defaultdict(set)
        for i, n in got(page_template.boilerplate_lines(chunks(spark, rows))):
            lines[i].add(n)
        assert dict(lines) == want


def test_repeated_ids_without_moving_texts(spark):
    rows = [("a", "2", 1), ("a", "1", 2), ("b", None, 3), (None, "x", 4), (None, "y", 5), ("c", None, 6), ("c", "z", 7)]
    df = spark.createDataFrame(rows, "id string, text string, n int")
    assert sorted(str(tuple(r)) for r in common.once(df, "text").collect()) == sorted(map(str, [("a", "1", 2), ("b", None, 3), (None, "x", 4), ("c", "z", 7)]))


# --- 4


def test_answer_defects(spark):
    ok = "The library opens at nine on working days and closes at five."
    rows = [
        (1, "When does the library open?", None, "llm (a)"), (2, "When does the library open?", "​", "llm"), (3, "x y", "N/A", "extractive"), (4, "When does the library open?", ok, "llm (a)"),
        (5, "When does the library open?", "when does the library open", "llm (a)"), (6, "When does the library open?", "I'm sorry, but I can't help with that request. Thank you for understanding.", "llm"),
        (7, "When does the library open?", "Die Bibliothek ist von neun bis fünf für alle offen und am Abend nicht.", "llm"), (8, "When does the library open?", ok[:-8], "llm (a)"),
        (9, "When does the library open?", ok[:-8] + "...", "extractive (no key)"), (10, "When does the library open?", ok[:-8] + "...", "LLM (b)"), (11, None, ok, None), (12, "", ok, ""),
        (13, "When does the library open?", "Sorry for the confusion. " + ok, "llm"), (14, "What is needed?", "You need:\n- gate pass\n- library card", "llm"), (15, "What is needed?", "x" * 200_000 + ".", "llm"),
        (4, "When does the library open?", ok, "llm (a)"), (None, "q", None, "llm"),
    ]
    f = spark.createDataFrame([(*r, None) for r in rows], FEEDBACK)
    assert dict(got(answer_defects.answer_defects(f))) == {1: "empty_answer", 2: "empty_answer", 3: "empty_answer", 5: "copies_question", 6: "refusal", 7: "wrong_language", 8: "truncated", 10: "truncated"}
    assert answer_defects.answer_defects(f.limit(0)).collect() == []


def test_refusals_of_any_length_and_wording(spark, monkeypatch):
    one = "I'm sorry, but I can't help with that request."
    unseen = ["Unfortunately I cannot assist with this query.", "The material contains no details on this matter.", "Can't answer that.", "Lo siento, no puedo responder a esa pregunta."]
    assert answer_defects.is_refusal(one * 1) and answer_defects.is_refusal(" ".join([one] * 40)) and all(map(answer_defects.is_refusal, unseen))
    fine = "You cannot enter the hall without a card. The office will answer your request in two days. Please bring the form."
    assert not answer_defects.is_refusal(fine)
    assert answer_defects.language("La biblioteca está abierta los sábados y los domingos para todos.") == "es"
    assert answer_defects.language("₹41,500 per semester") != "it"
    odd = "No details on this lie available to my desk."
    rows = [(i, f"What is the fee of course {i}?", odd, "llm", None) for i in range(6)] + [(9, "What is the fee of course 9?", "The fee is fifty rupees.", "llm", None)]
    f = spark.createDataFrame(rows, FEEDBACK)
    for bound in (300_000, 0):  # looked up in a dictionary, or joined
        monkeypatch.setattr(common, "LOOKUP_ROWS", bound)
        assert set(got(answer_defects.answer_defects(f))) == {(i, "refusal") for i in range(6)}


def test_longest_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2))
        assert answer_defects.lcs(a, b) == slow(a, b)


# --- 5


def test_bitmaps_round_trip():
    import numpy as np

    for p in ([0], [5, 6, 7], list(range(0, 4000, 3)), [1, 200_000], list(range(100))):
        assert repeated_lines.unpack(repeated_lines.pack(np.array(p))).tolist() == p


def test_repeated_lines(spark):
    rows = [(f"a{i}", f"Own {i}\n Share  this \n\n", "HTTP://WWW.H.example:80/x") for i in range(8)] + [("a0", "Own 0\n Share  this \n\n", "http://h.example/x")]
    rows += [(f"b{i}", "share this\nmore", "http://g.example/") for i in range(7)] + [("b0", "share this\nmore", "http://g.example/")] + [("c", "share\tthis", None)]
    assert got(repeated_lines.repeated_lines(chunks(spark, rows))) == sorted((f"a{i}", 1) for i in range(8))
    clean = {i: (t, n) for i, t, n in got(repeated_lines.strip_repeated(chunks(spark, rows)))}
    assert clean["a3"] == ("Own 3\n\n", 1) and clean["b0"] == ("share this\nmore", 0) and clean["c"] == ("share\tthis", 0)


# --- 6


def scans(n=40):
    rnd = random.Random(4)
    vocab = "certificate department students library registration of the and must bring to office received".split()
    rows = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(60)]
        lines = [" ".join(w[k : k + 8]) for k in range(0, 56, 8)]
        rows.append([f"s{i}", lines, f"doc_{i}.txt"])
    return rows


def test_scan_noise_and_repair(spark):
    rows = scans()
    for i in range(10):
        rows[i][1].insert(3, f"Foo College Minutes 20{10 + i}-{11 + i}")
    rows[10][1].insert(2, "- 12 -")
    rows[11][1][2] = "bring the certi-"
    rows[11][1][3] = "ficate to the office"
    rows[12][1][1] = "the cert1ficate of the dcpartment"
    rows[13][1][1] = "the well-"
    rows[13][1][2] = "known office"
    c = chunks(spark, [(i, "\n".join(l), "u", None, f) for i, l, f in rows] * 2 + [("web", "the cert1ficate", "u", None, "w.txt"), ("k", "well-known well-known", "u", None, "w.txt")] + [("sound", "The office must bring the library to the students.", "u", None, "doc_x.txt")])
    kinds = defaultdict(set)
    for i, k in got(scan_noise.scan_noise(c)):
        kinds[i].add(k)
    assert dict(kinds) == {**{f"s{i}": {"running_header"} for i in range(10)}, "s10": {"page_number"}, "s11": {"hyphen_break"}, "s12": {"misread_char"}}
    fixed = dict(got(scan_noise.repair_scans(c)))
    assert "bring the certificate to the office" in fixed["s11"] and "the certificate of the department" in fixed["s12"] and "well-known office" in fixed["s13"]
    assert "Minutes" not in fixed["s0"] and "12" not in fixed["s10"] and fixed["sound"] == "The office must bring the library to the students."


def test_lookups_by_join_give_the_same(spark, monkeypatch):
    c = chunks(spark, [(i, "\n".join(l[:2] + ["Foo College Minutes 2010-11"] + l[2:] + ["the cert1ficate and certi-", "ficate"]), "u", None, f) for i, l, f in scans(12)] * 2)
    want = got(scan_noise.scan_noise(c)), got(scan_noise.repair_scans(c))
    monkeypatch.setattr(common, "LOOKUP_ROWS", 0)
    assert (got(scan_noise.scan_noise(c)), got(scan_noise.repair_scans(c))) == want and len(want[0]) >= 24


# --- 7


def test_wrong_encodings(spark):
    sound = ["Le café près de l’entrée – là", "für die Größe müssen Öffnungszeiten", "Обмен студентами по теме", "इस वर्ष विभाग में सीटें", "┌──┬──┐ Ä Ö Ü ÂGE"]
    rows = [(f"s{k}{i}", t, f"http://h{i % 3}.example/") for i, t in enumerate(sound) for k in range(12)]
    bad = {"cp1252": "café – l’entrée là", "latin-1": "café prés", "cp437": "für Größe –", "mac_roman": "l’entrée", "cp1251": "für die Größe"}
    for name, t in bad.items():
        b = t.encode("utf-8")
        rows.append((name, "x " + "".join(bytes([c]).decode(name, "ignore") or chr(c) for c in b), "http://h0.example/", "ok"))
    rows.append(("twice", "x " + "près".encode().decode("cp1252").encode().decode("cp1252"), "http://h1.example/"))
    rows.append(("lost", "caf� x", "http://h1.example/", "Gr��e"))
    c = chunks(spark, rows + rows[:3])
    out = {(i, f): (t, r) for i, f, t, r in got(mojibake.restored_fields(c))}
    assert set(out) == {(n, "text") for n in (*bad, "twice", "lost")} | {("lost", "title")}
    assert {n: out[n, "text"][0][2:] for n in bad} == bad and out["twice", "text"] == ("x près", True)
    assert out["lost", "text"] == ("caf� x", False)


RUSSIAN = (
    "Студенты первого курса сдают документы в учебную часть до пятницы", "Общежитие открывается за два дня до начала занятий и каждый получает ключ",
    "Библиотека работает по субботам кроме праздников", "Тот кто потерял билет пишет заявление и платит за новый", "Обмен студентами по теме и в срок", "Директор института и декан факультета в Москве",
)
GERMAN = ("für die Größe müssen Öffnungszeiten geändert werden", "Übungen für Anfänger täglich möglich", "die Prüfung läuft über fünf Tage", "Schüler können später zurückkehren", "natürlich hört man ähnliche Gründe")


def shown(text, written, page):
    return "".join(bytes([c]).decode(page, "replace") for c in text.encode(written))


def test_code_pages_are_learned_by_source(spark):
    rows = [(f"s{k}{i}", t, f"http://h{k % 5}.example/") for i, t in enumerate(RUSSIAN + GERMAN + ("Le café près de l’entrée – là", "España año niño", "un été très chaud à Nîmes")) for k in range(15)]
    rows += [(f"r{i}", shown(t, "cp1251", "latin-1"), "http://ru.example/") for i, t in enumerate(RUSSIAN * 2)]
    rows += [(f"g{i}", shown(t, "cp1252", "cp437"), "http://de.example/") for i, t in enumerate(GERMAN * 2)]
    c = chunks(spark, rows + rows[:2])
    want = {f"r{i}": t for i, t in enumerate(RUSSIAN * 2)} | {f"g{i}": t for i, t in enumerate(GERMAN * 2)}
    fixed = {i: t for i, f, t, _ in got(mojibake.restored_fields(c))}
    assert set(fixed) == set(want)
    assert sum(fixed[i] == t for i, t in want.items()) >= 0.9 * len(want)
    without = {i: t for i, f, t, _ in got(mojibake.restored_fields(c, rounds=0))}
    assert not set(without) & set(want)  # nothing is learned, so nothing is read
    once = {i: t for i, f, t, _ in got(mojibake.restored_fields(c, rounds=1))}
    assert sum(once.get(i) == t for i, t in want.items()) <= sum(fixed[i] == t for i, t in want.items())


# --- 8


def test_tokenizer_equals_the_public_one(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(9)
    alphabet = list("ab'stmdrevl LL19 \n\t \r.,!¿éß’²Ⅷ你한ि́ 　\x85\x1c😀' ")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["<|endoftext|>", "it's we'll I'M 'subject", "x" * 5000, "   \n\n  a  ", "", "ab" * 100_000]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)] + [(-1, None, "c")], DOCS)
    ids = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    assert ids[-1] == [] and all(ids[i] == e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)))
    path = tokenizer.vocabulary("byte_bpe_50k")
    assert all(tokenizer.decode(ids[i], path) == x for i, x in enumerate(texts[:300]))
    assert {r.doc_id: r.tokens for r in tokenizer.token_counts(df).collect()} == {i: len(v) for i, v in ids.items()}
    assert tokenizer.encode(df.limit(0)).collect() == []
    for r in tokenizer.encode_with_offsets(df).collect():
        assert r.ids == ids[r.doc_id] and (r.piece_ends[-1:] or [0])[0] == len(texts[r.doc_id] if r.doc_id >= 0 else "")
        if 0 <= r.doc_id < 300:
            x = texts[r.doc_id]
            a, b = sorted(rnd.randrange(len(x) + 1) for _ in range(2))
            assert tokenizer.decode_slice(r.ids, r.piece_ends, r.piece_ids, a, b, path) == x[a:b]


def test_scan_of_transition_functions():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n in (1, 127, 128, 129, 40_000):
        f = rnd.integers(0, 256, n).astype(np.uint8)
        state, want = 0, []
        for x in f.tolist():
            want.append(state)
            state = x >> 2 * state & 3
        assert tokenizer.scan_states(f).tolist() == want


def test_equal_hashes_of_different_pieces_do_no_harm(monkeypatch):
    import numpy as np

    path = tokenizer.vocabulary("byte_bpe_50k")
    texts = ["one two three four five", "six seven", "1 22 333"]
    right = tokenizer.Merger(path)
    monkeypatch.setattr(tokenizer, "merger", lambda p: right)
    want = tokenizer.encode_batch(texts, path)[0].tolist()
    real = tokenizer.slice_hashes
    monkeypatch.setattr(tokenizer, "slice_hashes", lambda *a: real(*a) & np.uint64(3))
    right.reset()
    assert tokenizer.encode_batch(texts, path)[0].tolist() == want


# --- 9


def test_bucket_bounds_are_optimal():
    import itertools

    import numpy as np

    rnd = random.Random(8)
    for _ in range(30):
        size = np.array(sorted(rnd.sample(range(1, 40), 7)))
        count = np.array([rnd.randrange(1, 9) for _ in size])
        cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= s) - int(s)) for s, c in zip(size, count))  # noqa: B023, E731
        best = min(cost([*map(int, x), int(size[-1])]) for k in range(3) for x in itertools.combinations(size[:-1], k))
        assert cost(packing.choose_buckets(size, count, 3)) == best


def test_bucket_bounds_decide_the_batches():
    rnd = random.Random(4)
    hist = Counter(min(rnd.randrange(1, 512), rnd.randrange(1, 512)) for _ in range(3000))
    one, many = (packing.plan_batches(dict(hist), 512, k) for k in (1, 4))
    assert one[0] != many[0] and len(one[1]) == 1 and len(many[1]) == 4
    load = Counter()
    for places in (one[0], many[0]):
        load.clear()
        for s, lo, hi, box, k, _ in places:
            for q in range((hi - lo) // k):
                load[box + q] += s * k
        assert max(load.values()) <= 512 and len(load) <= 1.02 * sum(s * n for s, n in hist.items()) / 512 + 1


def test_packing_splits_nothing_and_wastes_little(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["word"] * rnd.choice([3, 40, 40, 40, 300, 511, 900]))) for i in range(400)] + [(900, None), (901, ""), (5, "word " * 3)]
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    limits = spark.createDataFrame([(1, 512, "byte_bpe_50k"), (2, 2000, "byte_bpe_50k"), (3, None, "byte_bpe_50k"), (4, 100, None)], "limit_id int, capacity_tokens int, tokenizer string")
    out = packing.pack_documents(docs, limits).collect()
    size = {r.doc_id: r.tokens for r in tokenizer.token_counts(docs).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).collect()}
    for limit, cap in ((1, 512), (2, 2000)):
        mine = [r for r in out if r.limit_id == limit]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.tokens
            parts[r.doc_id].append(r.tokens)
        assert max(load.values()) <= cap and {d: sum(p) for d, p in parts.items()} == size
        assert all(len(p) == max(1, -(-size[d] // cap)) for d, p in parts.items())
        room: list[int] = []  # first fit decreasing
        for n in sorted((r.tokens for r in mine), reverse=True):
            k = next((k for k, x in enumerate(room) if x >= n), None)
            if k is None:
                room.append(cap - n)
            else:
                room[k] -= n
        assert sum(v > 0 for v in load.values()) <= 1.01 * len(room)
    assert {r.limit_id for r in out} == {1, 2} and packing.pack_documents(docs.limit(0), limits).collect() == []


def test_ranks_of_one_size_spread_over_salts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same size here", None) for i in range(300)], DOCS)
    limits = spark.createDataFrame([(1, 30, "byte_bpe_50k")], "limit_id int, capacity_tokens int, tokenizer string")
    want = len({r.container_id for r in packing.pack_documents(docs, limits).collect()})
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 7)
    out = packing.pack_documents(docs, limits).collect()
    assert len(out) == 300 and len({r.container_id for r in out}) == want and max(Counter(r.container_id for r in out).values()) * out[0].tokens <= 30


# --- 10


def test_stuffed_pages(spark):
    prose = "The office keeps the list of all students for five years, and no letter is needed. A reminder will follow when the hall is open again. Those who miss the drill may write to the dean once, in the given order. "
    spam = ["cheap fees " * 60, "\n".join(f"[t{i}](http://a{i}.example/x)" for i in range(40)), " ".join(f"#Tag{i}" for i in range(50)), "\n".join(f"SKU {i} | red | Rs. {i} | in stock" for i in range(40)), prose + "best pump best hall " * 80, " » ".join(f"Item{i} page" for i in range(60))]
    fine = [prose * 2, None, "", "fees fees fees", prose + "\n" + "\n".join(f"- point {i} is open" for i in range(6)), "Q. Can we come?\nA. " + prose]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(spam + fine)] * 2 + [(None, spam[0], "c")], DOCS)
    assert got(stuffing.stuffed_pages(df)) == [(i,) for i in range(len(spam))]


UNSEEN = (
    "Студенты первого курса сдают документы в учебную часть до пятницы. Общежитие открывается за два дня до начала занятий, и каждый получает ключ у дежурного. "
    "Библиотека работает по субботам, кроме праздников. Тот, кто потерял билет, пишет заявление и платит за новый.",
    "Los alumnos de primer curso entregan sus papeles en la oficina antes del viernes. La residencia abre dos días antes de las clases y cada uno recibe su llave. "
    "La biblioteca abre los sábados salvo en fiestas. Quien pierda el carné escribe una solicitud y paga otro.",
    "一年级学生必须在星期五之前把材料交到办公室。宿舍在开课前两天开放,每个人在门口领取钥匙。图书馆星期六照常开门,节日除外。丢失证件的人要写申请,并且支付补办的费用。",
    "Studenci pierwszego roku składają dokumenty w dziekanacie do piątku. Dom studencki otwiera się dwa dni przed zajęciami i każdy dostaje klucz od portiera. Biblioteka pracuje w soboty oprócz świąt.",
)


def test_prose_of_unseen_languages_is_no_spam(spark, monkeypatch):
    known = stuffing.function_words(common.table(spark, "/root/testdata/sf0.01", "documents"))
    assert {"the", "of"} <= known and not {"certificate", "метро"} & known
    assert not any(stuffing.is_spam(t, k) for t in UNSEEN for k in (known, frozenset()))
    assert stuffing.is_spam("买手机 便宜手机 手机价格 " * 30, known) and stuffing.is_spam("дешёвый насос купить насос " * 30, known)


def test_recurrence_decides_about_stuffing(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    with_it = stuffing.stuffed_pages(docs).count()
    known, real = stuffing.function_words(docs), stuffing.features
    monkeypatch.setattr(stuffing, "features", lambda t, k: (f := real(t, k)) and {**f, "recur": 0.0, "every": 0.0, "lag": 0.0})
    texts = [r.text for r in docs.where("text is not null").select("text").collect()]
    assert sum(stuffing.is_spam(t, known) for t in texts) < 0.5 * with_it


def test_labels_agree(spark, sf):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labels = {r.doc_id: r.label for r in common.table(spark, "/root/testdata/sf0.01", "page_labels").collect()}
    spam = {r.doc_id for r in stuffing.stuffed_pages(docs.where(F.col("doc_id").isin(*labels))).collect()}
    agree = sum((d in spam) == (l == "spam") for d, l in labels.items())
    assert agree >= 0.85 * len(labels)  # some labels are wrong


# --- queries


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() >= 0 and not re.search("limit", name)
