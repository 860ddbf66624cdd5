"""Unit cases of operators that data alone doesn't exercise."""

import difflib
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrade.functions import text as X
from quillgrade.functions import udfs as U
from quillgrade.operators import dedup, geometry, grading, merge, reports, state, variants
from quillgrade.sources import responses


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "student, accepted, right",
    [("2,30", ["2.3"], True), ("5", ["5.0"], True), ("-5", ["5"], False), ("2/3", ["0.6667"], False), (" а ", ["A"], True), ("Б", ["B"], False), ("new  york", ["New York"], True), ("  ", [" "], False), (None, ["A"], False), ("A", [], False)],
)
def test_answer_match(spark, student, accepted, right):
    got = one(spark, grading.matches(F.lit(student).cast("string"), F.array(*map(F.lit, accepted)).cast("array<string>")))
    assert got == [right]


def test_grades_differ_by_flow(spark):
    raw = one(spark, reports.grade_for(F.lit(100.0 * 6 / 7)), reports.grade_for(reports.percent_half_even(F.lit(6), F.lit(7))))
    assert raw == [4, 5]
    assert [one(spark, reports.grade_for(F.lit(float(p))))[0] for p in (0, 55, 56, 70, 71, 85, 86, 100)] == [2, 2, 3, 3, 4, 4, 5, 5]


def test_ask_band(spark):
    ask = lambda s, a: one(spark, grading.worth_asking(F.lit(s), F.array(F.lit(a))))[0]
    assert ask("12", "15") and ask("photosinthesis", "photosynthesis") and not ask("xyz", "photosynthesis") and not ask(" ", "a")


def _questions(spark):
    rows = [(1, i, f"text {i}", [("A", f"a{i}"), ("B", f"b{i}"), ("C", f"c{i}"), ("D", f"d{i}")], "ABCD"[i % 4], "g" if i in (3, 4, 5) else None, 100 + i) for i in range(1, 13)]
    return spark.createDataFrame(rows, "project_id long, question_number int, question_text string, options array<struct<letter:string,text:string>>, correct_answer string, group_id string, question_id long")


def test_variants_round_trip(spark):
    made = variants.variants(_questions(spark), 6, "seed").collect()
    truth = {100 + i: f"{'abcd'[i % 4]}{i}" for i in range(1, 13)}
    by = {}
    for r in made:
        assert {o["letter"]: o["text"] for o in r["shuffled"]}[r["key"]] == truth[r["question_id"]]
        assert sorted(o["text"] for o in r["shuffled"]) == sorted(o["text"] for o in r["options"])
        by.setdefault(r["variant_number"], []).append((r["position"], r["question_number"]))
    orders = set()
    for v in by.values():
        order = [q for _, q in sorted(v)]
        assert sorted(order) == list(range(1, 13)) and [p for p, _ in sorted(v)] == list(range(1, 13))
        at = order.index(3)
        assert order[at : at + 3] == [3, 4, 5]
        orders.add(tuple(order))
    assert len(orders) == 6


def test_selection_keeps_groups_and_balance(spark):
    pool = variants.units(_questions(spark)).withColumn("fp", F.col("question_text"))
    rows = variants.select_units(pool.select("project_id", "unit_id", "question_id", "fp"), 6, 6, "s").collect()
    uses = {}
    for v in range(1, 7):
        own = [r for r in rows if r["variant_number"] == v]
        assert len(own) == 6 and not any(r["short"] for r in own)
        assert sum(r["unit_id"] == "g" for r in own) in (0, 3)
        for r in own:
            uses[r["question_id"]] = uses.get(r["question_id"], 0) + 1
    assert max(uses.values()) - min(uses.values()) <= 2


def plain_selection(units, n, m, seed):
    """units: name -> (questions, prints). The rule in plain steps."""
    uses, rows = {u: 0 for u in units}, set()
    for v in range(1, n + 1):
        draws = []
        for a in range(variants.ATTEMPTS):
            taken, prints = [], []
            for u in sorted(units, key=lambda u: (uses[u], hashlib.md5(f"{seed}|{v}|{a}|{u}".encode()).hexdigest(), u)):
                if sum(len(units[t][0]) for t in taken) + len(units[u][0]) <= m and not set(prints) & set(units[u][1]):
                    taken.append(u)
                    prints += units[u][1]
            draws.append(taken)
        filled = [sum(len(units[t][0]) for t in taken) for taken in draws]
        for u in draws[filled.index(max(filled))]:
            uses[u] += 1
            rows |= {(v, u, q, max(filled) < m) for q in units[u][0]}
    return rows


@pytest.mark.parametrize("n, m", [(5, 3), (4, 7), (3, 40)])
def test_selection_follows_the_rule(spark, n, m):
    rows, pools = [], {}
    for p in (1, 2, 3):
        for i in range(4 * p + 3):
            unit, fp = f"u{i // 2 if i < 6 else i}", f"f{i if i % 4 else 0}"
            rows.append((p, unit, 100 * p + i, fp))
            own = pools.setdefault(p, {}).setdefault(unit, ([], []))
            own[0].append(100 * p + i), own[1].append(fp)
    rows.append((4, "u0", 400, "same")), rows.append((4, "u0", 401, "same"))  # alike inside a unit: may be taken
    pools[4] = {"u0": ([400, 401], ["same", "same"])}
    df = spark.createDataFrame(rows, "project_id long, unit_id string, question_id long, fp string")
    got = {p: {(r["variant_number"], r["unit_id"], r["question_id"], r["short"]) for r in variants.select_units(df, n, m, "s").collect() if r["project_id"] == p} for p in pools}
    assert got == {p: plain_selection(u, n, m, "s") for p, u in pools.items()}
    assert variants.select_units(df.limit(0), n, m, "s").count() == 0


def test_sections_restart_and_inversion(spark):
    rows = [(1, 1, i, n, t) for i, (n, t) in enumerate([(5, None), (6, None), (0, None), (7, None), (1, None), (2, None), (9, None), (8, None), (4, "Part B"), (5, None)])]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, question_number int, section_title string")
    got = merge.sections(df).orderBy("pos").collect()
    assert [(r["question_number"], r["section"]) for r in got] == [(5, 1), (6, 1), (7, 1), (1, 2), (2, 2), (9, 2), (8, 2), (4, 3), (5, 3)]
    assert [r["question_number"] for r in got if r["inversion"]] == [8]


def test_fragments_are_stitched(spark):
    rows = [(1, 1, 1, 7, "stem", ["x", ""]), (1, 2, 1, 0, "more", ["", "y"]), (1, 2, 2, 8, "next", ["p", "q"]), (1, 4, 1, 0, "orphan", [])]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, question_number int, question_text string, options array<string>")
    got = [(r["question_number"], r["question_text"], list(r["options"])) for r in merge.stitched(df).orderBy("page_number", "pos").collect()]
    assert got == [(7, "stem more", ["x", "y"]), (8, "next", ["p", "q"])]


def test_near_duplicates_follow_the_opener(spark):
    stems = ["abcdefghijkl", "abcdefghijkm", "abcdefghijxx", "zzz", ""]
    df = spark.createDataFrame([("b", i, s) for i, s in enumerate(stems)], "block string, number long, stem string")
    got = {r["number"]: r["opener"] for r in dedup.near_duplicates(df).collect()}
    assert difflib.SequenceMatcher(None, stems[0], stems[1]).ratio() >= 0.9
    assert got == {0: 0, 1: 0}


def test_fingerprints(spark):
    same = one(spark, *[dedup.fingerprint_norm(F.lit(s), True) for s in ("O‘zgarish x²", "oʻzgarish  x2", "2:3", "2/3")])
    assert same[0] == same[1] == "ozgarishx2" and same[2] != same[3]


def test_throttle_drops_do_not_move_the_mark(spark):
    rows = [(1, i, f"2024-01-01 00:00:0{s}") for i, s in enumerate((0, 2, 4, 5, 8, 9))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(r["event_id"] for r in state.throttle(df, "user_id", 4 * state.MICROS).collect())
    assert got == [0, 2, 4]


def test_throttle_of_a_long_history(spark):
    """One key holds most events; nulls are a key; order of arrival doesn't matter."""
    df = spark.range(60_000).selectExpr("CASE WHEN id % 10 < 8 THEN 1 WHEN id % 10 = 8 THEN NULL ELSE id % 7 END AS user_id", "59999 - id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 59999 - id) AS ts")
    marks, want = {}, set()
    for e in range(60_000):
        i = 59_999 - e
        k = 1 if i % 10 < 8 else None if i % 10 == 8 else i % 7
        if k not in marks or e - marks[k] >= 50:
            marks[k] = e
            want.add((k, e))
    assert {tuple(r) for r in state.throttle(df, "user_id", 50 * state.MICROS).collect()} == want
    assert state.throttle(df.limit(0), "user_id", 1).count() == 0


def test_quota_rolls_over_and_null_is_unlimited(spark):
    rows = [(u, 10 * u + i, f"2024-01-0{d} 00:00:00") for u in (1, 2) for i, d in enumerate((1, 1, 2, 9))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    limit = F.when(F.col("user_id") == 1, 2)
    got = {r["user_id"]: (r["used"], r["blocked"], r["resets"]) for r in state.quota(df, "user_id", limit, 7 * 86400 * state.MICROS).collect()}
    assert got == {1: (1, 1, 2), 2: (None, 0, 0)}


def test_clusters_grow_the_box(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 25.0, 0.0, 30.0, 10.0), (1, 1, 3, 45.0, 0.0, 50.0, 10.0), (1, 1, 4, 200.0, 0.0, 210.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, rect_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["x0"], r["x1"], r["n"]) for r in geometry.clusters(df).collect())
    assert got == [(0.0, 50.0, 3), (200.0, 210.0, 1)]


@pytest.mark.parametrize(
    "text, entries, reason",
    [
        ("1-a 2-b 3-c", {1: ["A"], 2: ["B"], 3: ["C"]}, None), ("abcd", {1: ["A"], 2: ["B"], 3: ["C"], 4: ["D"]}, None), ("1: foo / bar", {1: ["FOO", "BAR"]}, None),
        ("1: foo 3: bar", {}, "ambiguous"), ("2) 5\n3) 7,5", {2: ["5"], 3: ["7,5"]}, None), ("", {}, "empty"), ("1: foo 2: bar", {1: ["FOO"], 2: ["BAR"]}, None), (None, {}, "empty"),
    ],
)
def test_answer_keys(text, entries, reason):
    got = U.parse_key(text)
    assert ({e["position"]: e["accepted"] for e in got["entries"]}, got["reason"]) == (entries, reason)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_parsers_never_fail(text):
    U.parse_key(text), U.canonical_chain(text), U.missing_unknowns(text)
    assert "".join(s["body"] for s in U.math_segments(text) if s["kind"] == "text") in text or "math" in {s["kind"] for s in U.math_segments(text)} or text == ""


def test_chain_moves_reagents():
    assert U.canonical_chain("→ X₁ + NaPO₃ → X₂") == "→ X₁ →(+NaPO₃) X₂"
    assert U.canonical_chain("SiS₂ + H₂O → X₁ → X₂") == "SiS₂ →(H₂O) X₁ → X₂"
    assert U.canonical_chain("A + B → C") == "A + B → C"
    assert U.canonical_chain("A → X₁ + Ca(OH)₂ → X₂") == "A → X₁ + Ca(OH)₂ → X₂"


def test_unanswerable():
    assert U.missing_unknowns("NaOH + HCl = X. Y ni toping") == ["Y"]
    assert U.missing_unknowns("X = 3; Y = X. X ni toping") == []


def test_math():
    assert U._Math("(a+b)/2").formula() == r"\frac{a + b}{2}"
    assert U._Math("√(x^2)").formula() == r"\sqrt{x^{2}}"
    assert U._Math("2 1/3 + root(3, x+1) - sqrt(y/2)").formula() == r"2\frac{1}{3} + \sqrt[3]{x + 1} - \sqrt{\frac{y}{2}}"
    assert U.math_segments("take root(3, x), 2 1/3 of it") == [{"kind": "text", "body": "take "}, {"kind": "math", "body": r"\sqrt[3]{x}"}, {"kind": "text", "body": ", "}, {"kind": "math", "body": r"2\frac{1}{3}"}, {"kind": "text", "body": " of it"}]
    for broken in ("(a", "root(3)", "sqrt(a, b)", "root(3, x"):
        with pytest.raises(ValueError):
            U._Math(broken).formula()


def test_caption_takes_plain_digits_only(spark):
    c = X.parse_caption(F.lit("Ali ² 12 Vali"))
    assert one(spark, c["name"], c["variant"]) == ["Ali ² Vali", 12]


def test_responses_are_salvaged():
    cut = '```json\n[{"n": 1, "q": "a", "opts": {"B": "x", "A": "y"}}, {"number": "2.", "question": "b", "A": "p"}, {"n": 3, "q": "lost'
    got = [responses._record(r) for r in responses._records(cut)]
    assert [(r["question_number"], r["question_text"]) for r in got] == [(1, "a"), (2, "b")]
    assert [o["letter"] for o in got[0]["options"]] == ["B", "A"]
    grouped = '{"groups": [{"title": "t", "questions": [{"n": 1}, {"n": 2}]}, {"questions": [{"n": 3}]}]}'
    assert [responses._record(r)["question_number"] for r in responses._records(grouped)] == [1, 2, 3]
    assert responses._records("garbage") == [] and len(responses._records('{"questions": [{"n": 1}]}')) == 1


def test_pool_variants_number_their_own_questions(spark):
    rows = [("p", i, i, None, "A", [("A", f"x{i}"), ("B", f"y{i}")]) for i in range(1, 7)]
    questions = spark.createDataFrame(rows, "project_id string, question_id int, question_number int, group_id string, correct_answer string, options array<struct<letter:string,text:string>>")
    chosen = spark.createDataFrame([(1, 2), (1, 5), (2, 5), (2, 6), (2, 1)], "variant_number int, question_id int")
    found = variants.pool_variants(questions, chosen, "s").collect()
    assert sorted((r["variant_number"], r["position"]) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert {(r["variant_number"], r["question_id"]) for r in found} == {tuple(r) for r in chosen.collect()}
    for r in found:
        right = next(o["text"] for o in r["shuffled"] if o["letter"] == r["key"])
        assert right == f"x{r['question_id']}"
