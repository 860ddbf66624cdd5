"""Queries of the sequence family: WIN, JOI-08..10, SET-02, AGG-06..08, JSN-06/07/10, LAD-03, SRC-09..11, RPT-01."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrade.operators import merge as M
from quillgrade.operators import questions as Q
from quillgrade.plans.registry import query
from quillgrade.plans.views import table, view, with_views

P = with_views("page_items").rstrip()
_SECT = """,
o AS (SELECT *, lag(question_number) OVER (PARTITION BY doc_id ORDER BY page_number, pos) AS b FROM page_items WHERE question_number <> 0),
f AS (SELECT *, coalesce(question_number < b AND (section_title IS NOT NULL OR (question_number <= 3 AND b - question_number >= 5)), FALSE) AS restart, coalesce(question_number < b, FALSE) AS fell FROM o),
s AS (SELECT *, fell AND NOT restart AS inversion, (1 + sum(CASE WHEN restart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM f)"""


def _sections(spark, d):
    return M.sections(view(spark, d, "page_items"))


@query("win_01_sections", P + _SECT + " SELECT doc_id, page_number, pos, question_number, section FROM s")
def win_01(spark, d):
    return _sections(spark, d).select("doc_id", "page_number", "pos", "question_number", "section")


@query("win_02_inversions", P + _SECT + " SELECT doc_id, page_number, count(*) FILTER (inversion) AS inversions FROM s GROUP BY ALL HAVING count(*) FILTER (inversion) >= 1")
def win_02(spark, d):
    rows = _sections(spark, d).groupBy("doc_id", "page_number").agg(F.count_if("inversion").alias("inversions"))
    return rows.where("inversions >= 1")


@query(
    "agg_06_section_summary",
    P + _SECT + """, m AS (SELECT doc_id, section, count(*) AS n, max(question_number) AS highest, first(section_title ORDER BY page_number, pos) FILTER (section_title IS NOT NULL) AS title, list(DISTINCT question_number) AS present FROM s GROUP BY doc_id, section)
SELECT doc_id, section, n, highest, title, array_to_string(list_filter(range(1, highest + 1), lambda x: NOT list_contains(present, x)), ',') AS gaps FROM m""",
)
def agg_06(spark, d):
    return M.section_summary(_sections(spark, d))


@query("agg_07_confident", P + _SECT + " SELECT doc_id, count(*) > 1 AND min(n) >= 4 AS confident FROM (SELECT doc_id, section, count(*) AS n FROM s GROUP BY ALL) x GROUP BY doc_id")
def agg_07(spark, d):
    return M.confident(M.section_summary(_sections(spark, d)))


@query("win_06_gaps", P + _SECT + ", h AS (SELECT doc_id, section, max(question_number) AS hi FROM s GROUP BY ALL) SELECT doc_id, section, n AS missing FROM h, range(1, 60) r(n) WHERE n <= hi AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = h.doc_id AND s.section = h.section AND s.question_number = n)")
def win_06(spark, d):
    return M.gap_numbers(_sections(spark, d), ["doc_id", "section"])


_MISSING = """, h AS (SELECT doc_id, max(question_number) AS hi FROM page_items WHERE question_number <> 0 GROUP BY doc_id),
x AS (SELECT doc_id, n AS missing FROM h, range(1, 60) r(n) WHERE n <= hi AND NOT EXISTS (SELECT 1 FROM page_items i WHERE i.doc_id = h.doc_id AND i.question_number = n))"""


@query("win_07_chunks", P + _MISSING + " SELECT doc_id, missing, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY missing) - 1) / 3) AS INT) AS chunk FROM x")
def win_07(spark, d):
    gaps = M.gap_numbers(view(spark, d, "page_items").where("question_number <> 0"), ["doc_id"])
    return M.chunked(gaps, ["doc_id"], "missing", 3)


@query(
    "joi_10_gap_pages",
    P + _MISSING + """, p AS (SELECT doc_id, question_number AS q, min(page_number) AS page FROM page_items WHERE question_number <> 0 GROUP BY ALL),
y AS (SELECT x.doc_id, x.missing, (SELECT arg_max(page, q) FROM p WHERE p.doc_id = x.doc_id AND q < missing) AS below, (SELECT arg_min(page, q) FROM p WHERE p.doc_id = x.doc_id AND q > missing) AS above FROM x)
SELECT doc_id, missing, coalesce(below, above) AS first_page, greatest(coalesce(below, above), least(coalesce(above, below), coalesce(below, above) + 1)) AS last_page FROM y""",
)
def joi_10(spark, d):
    return M.gap_windows(view(spark, d, "page_items").where("question_number <> 0"))


_OPT = "CASE WHEN (doc_id + pos) % 3 = 0 THEN NULL ELSE substr(question_text, 1, 5) END AS option_a, CASE WHEN (page_number + pos) % 2 = 0 THEN ' ' ELSE substr(question_text, 6, 5) END AS option_b"


def _with_options(items):
    a = F.when((F.col("doc_id") + F.col("pos")) % 3 != 0, F.substring("question_text", 1, 5))
    b = F.when((F.col("page_number") + F.col("pos")) % 2 == 0, " ").otherwise(F.substring("question_text", 6, 5))
    return items.withColumns({"option_a": a, "option_b": b})


def _merge_sql(by: str) -> str:
    first = lambda c: f"coalesce(first({c} ORDER BY page_number, pos) FILTER (trim(coalesce({c}, '')) <> ''), first({c} ORDER BY page_number, pos))"
    return f"""SELECT {by}, first(question_text ORDER BY page_number, pos) AS question_text, {first('option_a')} AS option_a, {first('option_b')} AS option_b, bool_or(has_image) AS has_image,
  first(page_number ORDER BY page_number, pos) FILTER (has_image) AS image_page, count(*) AS occurrences,
  trim(coalesce({first('option_a')}, '')) = '' AND trim(coalesce({first('option_b')}, '')) = '' AS is_open_ended FROM m GROUP BY {by}"""


@query("win_04_merge", P + _SECT + f", m AS (SELECT *, {_OPT} FROM s) " + _merge_sql("doc_id, section, question_number"))
def win_04(spark, d):
    return M.merged(_with_options(_sections(spark, d)), ["doc_id", "section", "question_number"])


@query("win_05_collapse", P + f", m AS (SELECT *, {_OPT} FROM page_items WHERE question_number <> 0) " + _merge_sql("doc_id, question_number"))
def win_05(spark, d):
    return M.merged(_with_options(view(spark, d, "page_items")), ["doc_id", "question_number"])


@query("win_03_stitch")
def win_03(spark, d):
    items = _with_options(view(spark, d, "page_items"))
    out = M.stitched(items.select("doc_id", "page_number", "pos", "question_number", "question_text", F.array("option_a", "option_b").alias("options")))
    return out.withColumn("options", F.array_join("options", "|", "-"))


@query("agg_08_fix_totals", P + _SECT + ", k AS (SELECT doc_id, section, (length(question_text) - length(replace(question_text, 'e', '')))::BIGINT AS fixes FROM s) SELECT doc_id, section, sum(fixes)::BIGINT AS ocr_fixes FROM k GROUP BY ALL HAVING sum(fixes) > 0")
def agg_08(spark, d):
    rows = _sections(spark, d).withColumn("fixes", F.length("question_text") - F.length(F.replace("question_text", F.lit("e"), F.lit(""))))
    return rows.groupBy("doc_id", "section").agg(F.sum("fixes").alias("ocr_fixes")).where("ocr_fixes > 0")


_EXPECT = "SELECT doc_id, n AS question_number FROM (SELECT DISTINCT doc_id FROM page_items) x, range(1, 13) r(n)"


@query("joi_08_unexplained", P + f" SELECT doc_id, question_number FROM ({_EXPECT}) e WHERE NOT EXISTS (SELECT 1 FROM page_items p WHERE p.doc_id = e.doc_id AND p.question_number = e.question_number) AND (doc_id + question_number) % 5 <> 0")
def joi_08(spark, d):
    items = view(spark, d, "page_items")
    expected = items.select("doc_id").distinct().withColumn("question_number", F.explode(F.sequence(F.lit(1), F.lit(12))))
    rejected = expected.where((F.col("doc_id") + F.col("question_number")) % 5 == 0)
    own = ["doc_id", "question_number"]
    return expected.join(items.select(*own), own, "left_anti").join(rejected, own, "left_anti")


@query("set_02_difference", P + f" SELECT doc_id, question_number FROM ({_EXPECT}) e EXCEPT SELECT doc_id, question_number FROM page_items")
def set_02(spark, d):
    items = view(spark, d, "page_items")
    expected = items.select("doc_id").distinct().withColumn("question_number", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return expected.subtract(items.select("doc_id", "question_number"))


_ODD = "page_number % 2 = 1"


@query("joi_09_continuation", P + f" SELECT doc_id, page_number, pos, question_number FROM page_items a WHERE {_ODD} AND (question_number = 0 OR question_number IS NULL OR NOT EXISTS (SELECT 1 FROM page_items b WHERE b.page_number % 2 = 0 AND a.doc_id = b.doc_id AND a.question_number = b.question_number))")
def joi_09(spark, d):
    items = view(spark, d, "page_items")
    return M.continuation(items.where(_ODD), items.where("page_number % 2 = 0")).select("doc_id", "page_number", "pos", "question_number")


_FOUND = "SELECT doc_id, page_number, pos, (doc_id + pos * 3 + page_number) % 14 + 1 AS question_number, CASE WHEN pos = 4 THEN ' ' ELSE question_text END AS question_text, (doc_id + pos) % 3 AS n_options FROM page_items"


@query(
    "jsn_07_recovered",
    P + _MISSING + f", c AS ({_FOUND}) SELECT doc_id, question_number, question_text FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, question_number ORDER BY page_number * 10 + pos) AS rn FROM c JOIN x ON x.doc_id = c.doc_id AND x.missing = c.question_number WHERE trim(question_text) <> '' AND n_options <> 1) z WHERE rn = 1",
)
def jsn_07(spark, d):
    items = view(spark, d, "page_items")
    found = items.select("doc_id", (F.col("page_number") * 10 + F.col("pos")).alias("pos"), ((F.col("doc_id") + F.col("pos") * 3 + F.col("page_number")) % 14 + 1).alias("question_number"), F.when(F.col("pos") == 4, " ").otherwise(F.col("question_text")).alias("question_text"), ((F.col("doc_id") + F.col("pos")) % 3).alias("n_options"))
    numbered = items.where("question_number <> 0")
    wanted = M.gap_numbers(numbered, ["doc_id"]).withColumnRenamed("missing", "question_number")
    return Q.accept_recovered(found, wanted, numbered).select("doc_id", "question_number", "question_text")


@query("jsn_06_recovered_options", P + f", o AS (SELECT *, {_OPT} FROM page_items) SELECT doc_id, page_number, pos, CASE WHEN trim(coalesce(option_a, '')) <> '' AND trim(coalesce(option_b, '')) <> '' THEN option_a || '|' || option_b END AS options FROM o WHERE question_number <> 0")
def jsn_06(spark, d):
    o = _with_options(view(spark, d, "page_items")).where("question_number <> 0")
    full = F.filter(F.array("option_a", "option_b"), lambda x: Q.filled(x))
    return o.select("doc_id", "page_number", "pos", F.when(F.size(full) >= 2, F.array_join(full, "|")).alias("options"))


@query("jsn_10_reextracted", P + " SELECT doc_id, page_number, pos, CASE WHEN count(*) OVER (PARTITION BY doc_id, question_number) = 1 AND question_number % 2 = 1 THEN 'again ' || question_number ELSE question_text END AS question_text FROM page_items WHERE question_number <> 0")
def jsn_10(spark, d):
    items = view(spark, d, "page_items").where("question_number <> 0")
    again = items.where("question_number % 2 = 1").select("doc_id", "question_number").distinct().withColumn("question_text", F.concat(F.lit("again "), F.col("question_number").cast("string")))
    return Q.replace_unique(items, again).select("doc_id", "page_number", "pos", "question_text")


@query("lad_03_flag_chunks", P + ", p AS (SELECT doc_id, question_number, min(page_number) AS page FROM page_items WHERE question_number <> 0 GROUP BY ALL) SELECT doc_id, page, question_number, CAST(floor((row_number() OVER (PARTITION BY doc_id, page ORDER BY question_number) - 1) / 8) AS INT) AS chunk FROM p WHERE (doc_id + question_number) % 3 = 0")
def lad_03(spark, d):
    pages = view(spark, d, "page_items").where("question_number <> 0").groupBy("doc_id", "question_number").agg(F.min("page_number").alias("page"))
    flags = pages.where((F.col("doc_id") + F.col("question_number")) % 3 == 0).select("doc_id", "question_number")
    return M.flagged_chunks(flags, pages).select("doc_id", "page", "question_number", "chunk")


@query("src_09_first_pages", "SELECT doc_id, page_number FROM (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_number FROM events) x WHERE page_number <= 20")
def src_09(spark, d):
    from pyspark.sql import Window

    pages = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("page_number"))
    return Q.first_pages(pages)


@query("src_10_page_text", P + " SELECT doc_id, page_number, string_agg(question_text, chr(10) ORDER BY pos) AS text FROM page_items GROUP BY ALL")
def src_10(spark, d):
    return Q.page_text(view(spark, d, "page_items").select("doc_id", "page_number", "pos", F.col("question_text").alias("text")))


@query("src_11_split_columns", P + " , h AS (SELECT DISTINCT doc_id, page_number, CASE WHEN (doc_id + page_number) % 3 = 0 THEN NULL ELSE 0.5 END AS f FROM page_items), e AS (SELECT doc_id, page_number, unnest(CASE WHEN f IS NULL THEN [0] ELSE [1, 2] END) AS half FROM h) SELECT doc_id, page_number, half, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, half) AS new_page FROM e")
def src_11(spark, d):
    pages = view(spark, d, "page_items").select("doc_id", "page_number").distinct()
    pages = pages.withColumn("split_frac", F.when((F.col("doc_id") + F.col("page_number")) % 3 != 0, 0.5))
    return Q.split_columns(pages).select("doc_id", "page_number", "half", "new_page")


_FLAGS = "SELECT doc_id, section, question_number, flag, k FROM s, (VALUES ('gap_before', 1), ('image', 2), ('titled', 3)) v(flag, k) WHERE (flag = 'gap_before' AND restart) OR (flag = 'image' AND has_image) OR (flag = 'titled' AND section_title IS NOT NULL)"


@query("rpt_01_summary", P + _SECT + f" SELECT doc_id, section, flag, string_agg(CAST(question_number AS VARCHAR), ',' ORDER BY question_number) AS numbers FROM ({_FLAGS}) z WHERE section = 1 GROUP BY ALL")
def rpt_01(spark, d):
    kinds = F.array_compact(F.array(F.when(F.col("restart"), "gap_before"), F.when(F.col("has_image"), "image"), F.when(F.col("section_title").isNotNull(), "titled")))
    rows = _sections(spark, d).where("section = 1").select("doc_id", "section", "question_number", F.explode(kinds).alias("flag"))
    return rows.groupBy("doc_id", "section", "flag").agg(F.array_join(F.array_sort(F.collect_list("question_number")), ",").alias("numbers"))


_RAW = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, concat('```json
[{"n": ', CAST(turn + 1 AS STRING), ', "q": "', CAST(length(text) AS STRING), '", "opts": {"A": "x", "B": "', role, '"}}, {"number": "', CAST(turn + 2 AS STRING), '.", "question": "', role, '", "A": "1", "C": "3"}', CASE WHEN conv_id % 3 = 0 THEN ', {"n": 9, "q": "cut' ELSE ']' END) AS raw FROM """


@query("src_06_responses", "SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, 1 AS pos, CAST(turn + 1 AS INT) AS question_number, CAST(length(text) AS VARCHAR) AS question_text, 'A=x;B=' || role AS options FROM conversations UNION ALL SELECT conv_id, CAST(turn AS INT), 2, CAST(turn + 2 AS INT), role, 'A=1;C=3' FROM conversations")
def src_06(spark, d):
    from quillgrade.sources import responses as S

    raw = spark.sql(_RAW.replace("{", "{{").replace("}", "}}") + "{conversations}", conversations=table(spark, d, "conversations"))
    told = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["text"])), ";")
    return S.question_rows(raw).select("doc_id", "page_number", "pos", "question_number", "question_text", told.alias("options"))


_ALIASED = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, concat('[{', CASE turn % 4
 WHEN 0 THEN concat('"num": "', CAST(turn AS STRING), ')", "text": "', role, '", "choices": ["x", "', role, '"], "img": true, "section": "s1"')
 WHEN 1 THEN concat('"question_number": ', CAST(turn AS STRING), ', "question_text": "', role, '", "options": [{"letter": "b", "text": "', role, '"}], "is_fragment": true')
 WHEN 2 THEN concat('"number": ', CAST(turn AS STRING), ', "q": "', role, '", "E": "5", "B": "', role, '", "desc": "d1"')
 ELSE concat('"question": "', role, '", "has_image": false, "fragment": true, "section_title": "s2", "image_description": "d2"') END, '}]') AS raw FROM """
_FIELDS = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, CASE WHEN turn % 4 = 3 THEN 0 ELSE CAST(turn AS INT) END AS question_number, role AS question_text,
  CASE turn % 4 WHEN 0 THEN 'A=x;B=' || role WHEN 1 THEN 'b=' || role WHEN 2 THEN 'B=' || role || ';E=5' ELSE '' END AS options,
  turn % 4 = 0 AS has_image, turn % 4 IN (1, 3) AS is_fragment, CASE turn % 4 WHEN 2 THEN 'd1' WHEN 3 THEN 'd2' END AS image_description, CASE turn % 4 WHEN 0 THEN 's1' WHEN 3 THEN 's2' END AS section_title FROM conversations"""


@query("src_08_aliases", _FIELDS)
def src_08(spark, d):
    from quillgrade.sources import responses as S

    raw = spark.sql(_ALIASED.replace("{", "{{").replace("}", "}}") + "{conversations}", conversations=table(spark, d, "conversations"))
    told = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["text"])), ";")
    return S.question_rows(raw).select("doc_id", "page_number", "question_number", "question_text", told.alias("options"), "has_image", "is_fragment", "image_description", "section_title")


@query("srt_04_final_order", P + _SECT + " SELECT doc_id, page_number, pos, row_number() OVER (PARTITION BY doc_id ORDER BY section, question_number, page_number, pos) AS place FROM s")
def srt_04(spark, d):
    return M.final_order(_sections(spark, d)).select("doc_id", "page_number", "pos", "place")


@query(
    "src_12_runs",
    """WITH e AS (SELECT user_id, event_type IN ('click', 'view') AS ink, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM e WHERE ink)
SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM g GROUP BY user_id, island""",
)
def src_12(spark, d):
    e = table(spark, d, "events").withColumn("ink", F.col("event_type").isin("click", "view"))
    return M.runs(e, ["user_id"], "event_id", "ink")
