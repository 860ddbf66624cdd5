"""Queries of the grading family: NUM-01..05, STR-09/10, JOI-06/07, AGG-09/10, JSN, RPT-02/05/06."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrade.operators import grading as G
from quillgrade.operators import questions as Q
from quillgrade.operators import reports as R
from quillgrade.plans.registry import query
from quillgrade.plans.views import keyed, questions, table, view, with_views

_NORM = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_CANON = lambda x: f"translate(upper(trim({x})), 'АВСДЕ', 'ABCDE')"
_NUM = lambda x: f"CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+([.,][0-9]+)?$') THEN TRY_CAST(replace(trim({x}), ',', '.') AS DECIMAL(38, 18)) END"
_ONE = lambda s, a: f"coalesce({_NORM(s)} = {_NORM(a)} OR (length({_NORM(s)}) = 1 AND length({_NORM(a)}) = 1 AND {_CANON(s)} = {_CANON(a)}) OR ({_NUM(s)}) = ({_NUM(a)}), FALSE)"
_GRADED = f"""
g AS (SELECT k.sheet_id, k.position, k.accepted_a, k.accepted_b, a.student_answer, coalesce(a.is_unclear, FALSE) AS is_unclear,
  a.student_answer IS NULL OR trim(a.student_answer) = '' AS is_skipped,
  a.student_answer IS NOT NULL AND trim(a.student_answer) <> '' AND k.accepted_a IS NOT NULL AND ({_ONE('a.student_answer', 'k.accepted_a')} OR {_ONE('a.student_answer', 'k.accepted_b')}) AS is_correct
  FROM answer_key k LEFT JOIN answers a USING (sheet_id, position))"""
BASE = with_views("answer_key", "answers").rstrip() + "," + _GRADED


def _graded(spark, d):
    return G.graded(keyed(spark, d), view(spark, d, "answers"))


@query("joi_06_answers", BASE + " SELECT sheet_id, position, student_answer, is_skipped FROM g")
def joi_06(spark, d):
    return _graded(spark, d).select("sheet_id", "position", "student_answer", "is_skipped")


@query("num_02_match", BASE + " SELECT sheet_id, position, is_correct FROM g WHERE student_answer IS NOT NULL")
def num_02(spark, d):
    return _graded(spark, d).where("student_answer IS NOT NULL").select("sheet_id", "position", "is_correct")


_GRADE = "CASE WHEN p >= 86 THEN 5 WHEN p >= 71 THEN 4 WHEN p >= 56 THEN 3 ELSE 2 END"


@query(
    "agg_09_grade",
    BASE
    + f""", l AS (SELECT sheet_id, max(position) AS total FROM g WHERE accepted_a IS NOT NULL GROUP BY sheet_id),
s AS (SELECT sheet_id, total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_skipped) + total - count(*) AS skipped FROM g JOIN l USING (sheet_id) WHERE position <= total GROUP BY sheet_id, total),
t AS (SELECT *, 100.0::DOUBLE * correct / total AS p FROM s)
SELECT sheet_id, total, correct, total - correct - skipped AS wrong, skipped, p AS percent, {_GRADE} AS grade FROM t""",
)
def agg_09(spark, d):
    return G.score_sheet(_graded(spark, d))


_LIST = lambda c: f"coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER ({c}), '')"
_MANUAL = f"""SELECT sheet_id, count(*) AS total, count(*) FILTER (is_correct AND NOT is_unclear) AS score,
  {_LIST('NOT (is_correct AND NOT is_unclear) AND NOT is_unclear')} AS wrong, {_LIST('is_unclear')} AS unclear FROM g WHERE accepted_a IS NOT NULL GROUP BY sheet_id"""


@query("agg_10_grade_manual", BASE + f", t AS (SELECT *, round_even(100.0::DOUBLE * score / total, 0) AS p FROM ({_MANUAL}) m) SELECT sheet_id, total, score, wrong, unclear, p AS percent, {_GRADE} AS grade FROM t")
def agg_10(spark, d):
    return G.score_manual(_graded(spark, d))


@query("num_01_number", BASE + f" SELECT sheet_id, position, CAST({_NUM('student_answer')} AS DOUBLE) AS number FROM g WHERE student_answer IS NOT NULL")
def num_01(spark, d):
    return view(spark, d, "answers").join(keyed(spark, d), ["sheet_id", "position"]).where("student_answer IS NOT NULL").select("sheet_id", "position", G.as_number(F.col("student_answer")).cast("double").alias("number"))


@query("num_03_grade_scale", f"SELECT p AS percent, {_GRADE} AS grade FROM (SELECT unnest([0, 55.99, 56, 70, 71, 85.71, 86, 100])::DOUBLE AS p) x")
def num_03(spark, d):
    return spark.createDataFrame([(float(p),) for p in (0, 55.99, 56, 70, 71, 85.71, 86, 100)], "percent double").withColumn("grade", R.grade_for(F.col("percent")))


_SIM = lambda a: f"1 - levenshtein({_NORM('student_answer')}, {_NORM(a)}) / greatest(length({_NORM('student_answer')}), length({_NORM(a)}))::DOUBLE"
_ASCII = "regexp_matches(student_answer, '^[ -~]*$')"


@query(
    "num_04_ask_band",
    BASE + f""" SELECT sheet_id, position, (({_NUM('student_answer')}) IS NOT NULL AND (({_NUM('accepted_a')}) IS NOT NULL OR coalesce(({_NUM('accepted_b')}) IS NOT NULL, FALSE)))
  OR greatest({_SIM('accepted_a')}, coalesce({_SIM('accepted_b')}, 0)) >= 0.40 AS ask FROM g WHERE NOT is_skipped AND NOT is_correct AND accepted_a IS NOT NULL AND {_ASCII}""",
)
def num_04(spark, d):
    wrong = _graded(spark, d).where("NOT is_skipped AND NOT is_correct AND accepted IS NOT NULL AND student_answer RLIKE '^[ -~]*$'")
    return wrong.select("sheet_id", "position", G.worth_asking(F.col("student_answer"), F.col("accepted")).alias("ask"))


@query("ded_09_similarity", "SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 9) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def ded_09(spark, d):
    p = table(spark, d, "part")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", F.round(G.similarity(F.col("p_name"), F.col("other")), 9).alias("similarity"))


@query("num_05_accepted", with_views("answer_key") + "SELECT sheet_id, position, coalesce(accepted_a || CASE WHEN accepted_b IS NOT NULL THEN ' / ' || accepted_b ELSE '' END, '') AS shown FROM answer_key")
def num_05(spark, d):
    k = keyed(spark, d)
    return k.select("sheet_id", "position", F.coalesce(F.array_join("accepted", " / "), F.lit("")).alias("shown"))


@query("str_10_canonical", BASE + f" SELECT sheet_id, position, {_CANON('student_answer')} AS letter FROM g WHERE length(trim(student_answer)) = 1")
def str_10(spark, d):
    return _graded(spark, d).where("length(trim(student_answer)) = 1").select("sheet_id", "position", G.canonical_letter(F.col("student_answer")).alias("letter"))


@query("str_09_normalise", f"SELECT doc_id, md5({_NORM('text')}) AS h FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7FÀ-ÖØ-ÞÀ-öø-ÿ]*$') AND text NOT LIKE '%ß%'")
def str_09(spark, d):
    plain = table(spark, d, "documents").where(F.col("text").rlike("^[\\x00-\\x7FÀ-ÖØ-ÞÀ-öø-ÿ]*$") & ~F.col("text").contains("ß"))
    return plain.select("doc_id", F.md5(G.normalise(F.col("text"))).alias("h"))


@query("str_09_casefold")
def str_09_casefold(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(G.casefold_exact(F.col("text"))).alias("h"))


@query(
    "joi_07_resolve_key",
    with_views("questions")
    + """, e AS (SELECT project_id, question_number + CASE WHEN question_id % 9 = 0 THEN 40 ELSE 0 END AS question_number, CASE WHEN question_id % 5 = 0 THEN 'Е' ELSE 'в' END AS a FROM questions WHERE NOT is_deleted),
l AS (SELECT project_id, question_number, CASE WHEN option_a IS NULL THEN '' WHEN option_b IS NULL THEN 'A' ELSE 'ABCD' END AS letters FROM questions WHERE NOT is_deleted)
SELECT e.project_id, e.question_number, CASE WHEN letters IS NULL THEN 'no_question' WHEN letters <> '' AND NOT contains(letters, translate(upper(a), 'АВСДЕ', 'ABCDE')) THEN 'bad_letter' END AS reason
FROM e LEFT JOIN l USING (project_id, question_number)""",
)
def joi_07(spark, d):
    q = Q.live(questions(spark, d))
    number = F.col("question_number") + F.when(F.col("question_id") % 9 == 0, 40).otherwise(0)
    entered = q.select("project_id", number.alias("question_number"), F.array(F.when(F.col("question_id") % 5 == 0, "Е").otherwise("в")).alias("accepted"))
    labels = q.select("project_id", "question_number", F.transform("options", lambda o: o["letter"]).alias("letters"))
    return G.resolve_key(entered, labels).select("project_id", "question_number", "reason")


@query(
    "jsn_08_override",
    BASE
    + f""", w AS (SELECT sheet_id, position, CASE WHEN (sheet_id + position) % 3 = 0 THEN 'ok' WHEN (sheet_id + position) % 3 = 1 THEN 'no' END AS v, accepted_a, is_correct, student_answer, is_skipped FROM g),
f AS (SELECT *, CASE WHEN v IS NULL OR is_correct OR is_skipped THEN is_correct WHEN v = 'ok' THEN accepted_a IS NOT NULL ELSE FALSE END AS now_correct FROM w)
SELECT sheet_id, count(*) FILTER (now_correct) AS correct FROM f GROUP BY sheet_id""",
)
def jsn_08(spark, d):
    rows = _graded(spark, d)
    asked = rows.where("NOT is_skipped AND NOT is_correct AND (sheet_id + position) % 3 < 2").select("sheet_id", "position", ((F.col("sheet_id") + F.col("position")) % 3 == 0).alias("ok"))
    again = G.override(rows, asked)
    return G.graded(again.select("sheet_id", "position", "accepted"), again.select("sheet_id", "position", "student_answer")).groupBy("sheet_id").agg(F.count_if("is_correct").alias("correct"))


@query(
    "rpt_02_report",
    BASE
    + """ SELECT sheet_id, string_agg(CASE WHEN is_correct THEN '+' WHEN is_skipped THEN 'o' ELSE '-' END || ' ' || position || ': ' || coalesce(trim(student_answer), '') ||
  CASE WHEN is_correct OR accepted_a IS NULL THEN '' ELSE ' [' || accepted_a || coalesce('/' || accepted_b, '') || ']' END, chr(10) ORDER BY position) AS report FROM g GROUP BY sheet_id""",
)
def rpt_02(spark, d):
    return G.report_lines(_graded(spark, d))


@query("snk_05_answer_key", with_views("answer_key") + "SELECT sheet_id, string_agg(position || '. ' || coalesce(accepted_a || coalesce(' / ' || accepted_b, ''), '-'), chr(10) ORDER BY position) AS key_text FROM answer_key GROUP BY sheet_id")
def snk_05(spark, d):
    return R.answer_key_lines(keyed(spark, d), "sheet_id")


@query("snk_03_results", BASE + " SELECT sheet_id, count(*) FILTER (is_correct) AS score, string_agg(CAST(position AS VARCHAR) || '=' || coalesce(trim(student_answer), ''), ';' ORDER BY position) AS answers FROM g GROUP BY sheet_id")
def snk_03(spark, d):
    rows = _graded(spark, d)
    told = F.struct("position", F.concat(F.col("position").cast("string"), F.lit("="), F.coalesce(F.trim("student_answer"), F.lit(""))).alias("a"))
    return rows.groupBy("sheet_id").agg(F.count_if("is_correct").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["a"]), ";").alias("answers"))


@query("rpt_06_still_missing", BASE.replace("WITH ", "WITH ", 1) + " SELECT sheet_id, position FROM g WHERE is_skipped AND accepted_a IN ('A', 'B', 'C', 'D')")
def rpt_06(spark, d):
    asked = keyed(spark, d).where(F.element_at("accepted", 1).isin("A", "B", "C", "D"))
    given = view(spark, d, "answers").where("trim(student_answer) <> ''")
    return asked.join(given, ["sheet_id", "position"], "left_anti").select("sheet_id", "position")


@query("agg_12b_key_labels", with_views("answer_key") + f"SELECT sheet_id, string_agg(DISTINCT {_CANON('a')}, '' ORDER BY {_CANON('a')}) AS labels FROM (SELECT sheet_id, unnest([accepted_a, accepted_b]) AS a FROM answer_key WHERE accepted_a IS NOT NULL) x WHERE regexp_matches(trim(a), '^[A-Za-z]$') GROUP BY sheet_id")
def agg_12b(spark, d):
    own = keyed(spark, d).select("sheet_id", F.explode("accepted").alias("a")).where(F.trim("a").rlike("^[A-Za-z]$"))
    return own.groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_set(G.canonical_letter(F.col("a")))), "").alias("labels"))


# answers as a sheet reader tells them: JSON text of one object a sheet
_JSON = """SELECT event_id AS sheet_id, concat('{"variant": "v', CAST(event_id % 9 AS STRING), '", "name": "', CASE WHEN event_id % 4 = 0 THEN 'null' ELSE concat(' Ann ', CAST(user_id AS STRING)) END,
  '", "name_unclear": "', CASE WHEN event_id % 3 = 0 THEN 'Yes' ELSE 'no' END, '", "answers": {"1": "', CASE WHEN event_id % 5 = 0 THEN '?' WHEN event_id % 5 = 1 THEN ' b ' ELSE 'С' END, '", "2": "', event_type, '"}}') AS raw FROM """


@query(
    "jsn_01_sheet",
    "WITH r AS (" + _JSON + """events), v AS (SELECT sheet_id, json_extract_string(raw, '$.variant') AS variant, json_extract_string(raw, '$.name') AS name, json_extract_string(raw, '$.name_unclear') AS nu,
  json_extract_string(raw, '$.answers."1"') AS a1, json_extract_string(raw, '$.answers."2"') AS a2 FROM r)
SELECT sheet_id, TRY_CAST(regexp_extract(variant, '[0-9]+') AS INT) AS variant, CASE WHEN lower(trim(name)) IN ('null', '') THEN NULL ELSE left(trim(name), 100) END AS student_name, lower(nu) IN ('true', 'yes', '1') AS name_unclear,
  CASE WHEN trim(a1) = '?' THEN 'unclear' WHEN regexp_matches(translate(upper(trim(a1)), 'АВСДЕ', 'ABCDE'), '^[A-EБГ]$') THEN translate(upper(trim(a1)), 'АВСДЕ', 'ABCDE') ELSE 'text:' || trim(a1) END AS answer_1,
  CASE WHEN trim(a2) = '?' THEN 'unclear' WHEN regexp_matches(translate(upper(trim(a2)), 'АВСДЕ', 'ABCDE'), '^[A-EБГ]$') THEN translate(upper(trim(a2)), 'АВСДЕ', 'ABCDE') ELSE 'text:' || trim(a2) END AS answer_2 FROM v""",
)
def jsn_01(spark, d):
    from quillgrade.sources import responses as S

    raw = spark.sql(_JSON.replace("{", "{{").replace("}", "}}") + "{events}", events=table(spark, d, "events"))
    return S.sheets(raw).select("sheet_id", "variant", "student_name", "name_unclear", F.element_at("answers", "1").alias("answer_1"), F.element_at("answers", "2").alias("answer_2"))


@query("jsn_04_variant_member", with_views("variants", "runs") + "SELECT session_id, idx, CASE WHEN variant IN (SELECT variant_number FROM variants v WHERE v.project_id = r.session_id) THEN variant END AS resolved FROM runs r")
def jsn_04(spark, d):
    valid = view(spark, d, "variants").groupBy(F.col("project_id").alias("session_id")).agg(F.collect_set("variant_number").alias("valid"))
    return view(spark, d, "runs").join(valid, "session_id", "left").select("session_id", "idx", F.when(F.array_contains("valid", F.col("variant")), F.col("variant")).alias("resolved"))


@query("src_07_grading_json", "SELECT event_id AS sheet_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def src_07(spark, d):
    from quillgrade.sources import responses as S

    e = table(spark, d, "events")
    fenced = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 7 == 1, F.concat(F.lit("Here you are: "), "props", F.lit(" done"))).when(F.col("event_id") % 7 == 6, F.lit("sorry, no")).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("sheet_id"), F.get_json_object(S.salvage(fenced), "$.k").try_cast("int").alias("k"))


_CLASS = f"CASE WHEN trim(student_answer) = '' THEN NULL WHEN trim(student_answer) = '?' THEN 'unclear' WHEN regexp_matches({_CANON('student_answer')}, '^[A-EБГ]$') THEN {_CANON('student_answer')} ELSE 'text:' || trim(student_answer) END"


@query("jsn_02_classify", with_views("answers") + f"SELECT sheet_id, position, {_CLASS} AS kind FROM answers")
def jsn_02(spark, d):
    from quillgrade.sources import responses as S

    return view(spark, d, "answers").select("sheet_id", "position", S.classify(F.col("student_answer")).alias("kind"))


@query(
    "jsn_03_coerce",
    with_views("runs") + "SELECT session_id, idx, variant, CASE WHEN idx % 3 = 0 THEN NULL WHEN name IS NULL THEN NULL ELSE name END AS clean, idx % 4 = 1 AS flag FROM runs",
)
def jsn_03(spark, d):
    from quillgrade.sources import responses as S

    r = view(spark, d, "runs")
    said = F.concat(F.lit("Variant: "), F.col("variant").cast("string"), F.lit(" ."))
    name = F.when(F.col("idx") % 3 == 0, " NULL ").otherwise(F.concat(F.lit("  "), F.col("name")))
    flag = F.when(F.col("idx") % 4 == 1, " Yes").when(F.col("idx") % 4 == 2, "no")
    return r.select("session_id", "idx", S.variant_number(said).alias("variant"), S.clean_name(name).alias("clean"), S.as_bool(flag).alias("flag"))
