"""Queries of questions, pools and variants: FIL-08..13, SNK-01/02, DED, SET, GEN, AGG-13, LAD-02, RPT-05/07, SRC-01..05."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrade.operators import dedup as D
from quillgrade.operators import questions as Q
from quillgrade.operators import reports as R
from quillgrade.operators import variants as V
from quillgrade.plans.registry import query
from quillgrade.plans.views import fp_sql, questions, table, view, with_views

QS = with_views("questions").rstrip()
_FILLED = " + ".join(f"CASE WHEN trim(coalesce(option_{x}, '')) <> '' THEN 1 ELSE 0 END" for x in "abcd")
_KEPT = "concat_ws('|', " + ", ".join(f"CASE WHEN trim(coalesce(option_{x}, '')) <> '' THEN '{x.upper()}=' || option_{x} END" for x in "abcd") + ")"
_CORRECT = "CASE correct_answer WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c WHEN 'D' THEN option_d END"
_VALID = f""",
n AS (SELECT *, {_FILLED} AS filled, {_KEPT} AS kept, {_CORRECT} AS correct_text FROM questions),
v AS (SELECT *, CASE WHEN trim(question_text) = '' THEN 'empty_text' WHEN filled = 1 THEN 'single_option' WHEN filled > 0 AND correct_text IS NOT NULL AND trim(correct_text) = '' THEN 'blank_correct_option' END AS reason FROM n)"""


def _told(options):
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit("="), o["text"])), "|")


@query("fil_12_validate", QS + _VALID + " SELECT question_id, reason, kept AS options FROM v")
def fil_12(spark, d):
    return Q.validate(questions(spark, d)).select("question_id", "reason", _told(F.col("options")).alias("options"))


@query("fil_11_fallbacks", QS + _VALID + " SELECT question_id, kept AS options, CASE WHEN correct_answer IS NULL THEN '' ELSE correct_answer END AS accepted FROM v")
def fil_11(spark, d):
    q = view(spark, d, "questions")
    options = Q.options_of(F.lit(None).cast("array<struct<letter:string,text:string>>"), *[F.col(f"option_{x}") for x in "abcd"])
    return q.select("question_id", _told(options).alias("options"), F.array_join(Q.accepted_of(F.array().cast("array<string>"), F.col("correct_answer")), "/").alias("accepted"))


@query("fil_08_live", QS + " SELECT project_id, count(*) AS n FROM questions WHERE NOT is_deleted GROUP BY project_id")
def fil_08(spark, d):
    return Q.live(view(spark, d, "questions")).groupBy("project_id").agg(F.count("*").alias("n"))


@query("fil_09_in_list", QS + " SELECT question_id FROM questions WHERE question_number IN (2, 5, 7)")
def fil_09(spark, d):
    return view(spark, d, "questions").where(F.col("question_number").isin(2, 5, 7)).select("question_id")


@query("fil_13_skip_pages", "SELECT page_id, NOT (page_id % 4 = 0) AND (length(html) % 200 < 100 OR page_id % 10 = 9) AS skipped FROM pages")
def fil_13(spark, d):
    p = table(spark, d, "pages")
    white = F.when(F.col("page_id") % 10 == 9, 0.95).otherwise(0.5)
    return p.select("page_id", Q.blank_page(F.length("html") % 200, white, F.col("page_id") % 4 == 0).alias("skipped"))


@query("lad_02_open_ended", QS + _VALID + " SELECT question_id, filled = 0 AS is_open_ended FROM v")
def lad_02(spark, d):
    return questions(spark, d).select("question_id", Q.is_open_ended(F.col("options")).alias("is_open_ended"))


@query("jsn_05_options", QS + _VALID + " SELECT question_id, kept AS told, filled AS n FROM v WHERE filled > 0")
def jsn_05(spark, d):
    own = Q.filled_options(F.col("options"))
    return questions(spark, d).select("question_id", _told(own).alias("told"), F.size(own).alias("n")).where("n > 0")


@query("snk_01_persist", QS + _VALID + ", c AS (SELECT project_id, count(*) AS total_questions FROM v WHERE NOT is_deleted GROUP BY ALL) SELECT question_id, kept AS options, total_questions, 'completed' AS status FROM v JOIN c USING (project_id) WHERE NOT is_deleted")
def snk_01(spark, d):
    return Q.to_persist(Q.live(questions(spark, d))).select("question_id", _told(F.col("options")).alias("options"), "total_questions", "status")


@query("src_01_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def src_01(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name")


@query("src_02_project_questions", QS + " SELECT question_number, question_id FROM questions WHERE project_id = 7 AND NOT is_deleted ORDER BY question_number")
def src_02(spark, d):
    return Q.live(view(spark, d, "questions")).where("project_id = 7").select("question_number", "question_id").orderBy("question_number")


@query("src_03_pool_sources", with_views("questions", "projects") + "SELECT p.owner, p.source_index, q.question_id FROM (SELECT owner, project_id, row_number() OVER (PARTITION BY owner ORDER BY created_at, project_id) AS source_index FROM projects) p JOIN questions q USING (project_id) WHERE NOT q.is_deleted")
def src_03(spark, d):
    w = Window.partitionBy("owner").orderBy("created_at", "project_id")
    sources = view(spark, d, "projects").withColumn("source_index", F.row_number().over(w))
    return sources.join(Q.live(view(spark, d, "questions")), "project_id").select("owner", "source_index", "question_id")


_HEADS = [("a.bin", "255044462d"), ("b.pdf", "504b0304"), ("c.DOCX", "00"), ("d.png", "89504e47"), ("e.jpg", "00"), ("f.webp", "52494646"), ("g", "ffd8ffe0"), ("h", "")]


@query("src_04_sniff", "SELECT unnest(['a.bin', 'b.pdf', 'c.DOCX', 'd.png', 'e.jpg', 'f.webp', 'g', 'h']) AS path, unnest(['pdf', 'docx', 'docx', 'image', 'image', 'unknown', 'image', 'unknown']) AS kind")
def src_04(spark, d):
    return spark.createDataFrame(_HEADS, "path string, head string").select("path", Q.sniff(F.unhex("head"), F.col("path")).alias("kind"))


@query("src_05_blob_scan")
def src_05(spark, d):
    from quillgrade.sources import files

    return files.blobs(spark, f"{d}/region.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.col("length") > 0).alias("filled"))


# fingerprints over documents: text, two lines as options
_DOCFP = f"d AS (SELECT doc_id, text, source, lang, {fp_sql('text')} AS fp FROM documents)"


def _doc_fp(spark, d):
    """Documents under a 128-bit hash of their fingerprint: the texts themselves are never a key."""
    return table(spark, d, "documents").select("doc_id", "source", "text", F.md5(D.fingerprint_norm(F.col("text"))).alias("fp"))


@query("ded_01_norm", f"SELECT doc_id, md5({fp_sql('text')}) AS h FROM documents")
def ded_01(spark, d):
    return _doc_fp(spark, d).select("doc_id", F.col("fp").alias("h"))


@query("ded_01_norm_composed", f"SELECT doc_id, md5({fp_sql('text')}) AS h FROM documents")
def ded_01_composed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.fingerprint_norm(F.col("text"), True)).alias("h"))


_QFP = f"{fp_sql('question_text')} || '::' || array_to_string(list_sort([{fp_sql('option_a')}, {fp_sql('option_b')}, {fp_sql('option_c')}, {fp_sql('option_d')}]), '|') || '::'"


@query("ded_02_fingerprint", QS + f" SELECT question_id, {_QFP} AS fp FROM questions")
def ded_02(spark, d):
    own = F.array(*[F.col(f"option_{x}") for x in "abcd"])
    return view(spark, d, "questions").select("question_id", D.fingerprint(F.col("question_text"), own, D.scheme_key(F.col("question_text"), F.lit(None).cast("string"))).alias("fp"))


@query("ded_03_pool", f"WITH {_DOCFP}, r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY source, doc_id) AS rn FROM d) SELECT h.doc_id, string_agg(DISTINCT x.source, ',' ORDER BY x.source) AS sources FROM r h JOIN d x USING (fp) WHERE h.rn = 1 GROUP BY h.doc_id")
def ded_03(spark, d):
    heads, _ = D.pool(_doc_fp(spark, d).select("doc_id", "source", "fp", F.col("doc_id").alias("pos")))
    return heads.select("doc_id", "sources")


@query("set_01_pool_pairs", f"WITH {_DOCFP}, r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY source, doc_id) AS rn FROM d) SELECT h.source AS kept_source, h.doc_id AS kept_pos, x.source AS dropped_source, x.doc_id AS dropped_pos FROM r h JOIN r x USING (fp) WHERE h.rn = 1 AND x.rn > 1")
def set_01(spark, d):
    parts = [_doc_fp(spark, d).where(F.col("doc_id") % 2 == k).select("source", "fp", F.col("doc_id").alias("pos")) for k in (0, 1)]
    return D.pool(parts[0].unionByName(parts[1]))[1]


@query("ded_04_exact_dups", f"WITH {_DOCFP} SELECT md5(fp) AS fp, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS numbers, substr(arg_min(text, doc_id), 1, 80) AS preview FROM d GROUP BY d.fp HAVING count(*) > 1")
def ded_04(spark, d):
    rows = _doc_fp(spark, d).select("fp", F.col("doc_id").alias("number"), F.substring("text", 1, D.PREVIEW).alias("text"))
    return D.exact_duplicates(rows, ["fp"])


@query("ded_05_siblings", QS + f", f AS (SELECT {fp_sql('stem')} AS stem_fp, {_QFP} AS fp FROM questions) SELECT stem_fp, count(DISTINCT fp) AS kinds, count(*) AS n FROM f GROUP BY stem_fp HAVING count(DISTINCT fp) > 1")
def ded_05(spark, d):
    q = view(spark, d, "questions")
    own = F.array(*[F.col(f"option_{x}") for x in "abcd"])
    rows = q.select(D.fingerprint_norm(F.col("stem")).alias("stem_fp"), D.fingerprint(F.col("question_text"), own, F.lit("")).alias("fp"))
    return D.siblings(rows, ["stem_fp"])


@query("ded_06_near_dups")
def ded_06(spark, d):
    q = questions(spark, d).where("size(options) > 1")
    block = F.md5(F.concat_ws("|", "section", F.array_join(F.array_sort(F.transform("options", lambda o: D.fingerprint_norm(o["text"]))), "|")))
    return D.near_duplicates(q.select(block.alias("block"), F.col("question_id").alias("number"), D.fingerprint_norm(F.col("question_text")).alias("stem")))


@query("ded_07_same_files", "SELECT doc_id, first_doc FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first_doc FROM documents) x WHERE doc_id > first_doc")
def ded_07(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("session"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("digest"))
    return D.same_files(files).select(F.col("pos").alias("doc_id"), F.col("first_pos").alias("first_doc"))


@query("ded_08_page_cache", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS worked FROM documents")
def ded_08(spark, d):
    pages = table(spark, d, "documents").select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("page_number"), F.md5("text").alias("digest"))
    return D.page_cache(pages).select(F.col("page_number").alias("doc_id"), F.col("worked_page").alias("worked"))


@query("ded_11_resolve", f"WITH {_DOCFP} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS rn FROM d) x WHERE rn <= 2")
def ded_11(spark, d):
    return D.resolve(_doc_fp(spark, d).withColumn("number", F.col("doc_id")), "twice").select("doc_id")


@query("rpt_05_dup_prompt", QS + " SELECT project_id, part_id, string_agg(CAST(question_number AS VARCHAR), ',' ORDER BY question_number) AS numbers, count(DISTINCT coalesce(correct_answer, '')) = 1 AS agree FROM questions GROUP BY project_id, part_id HAVING count(*) > 1")
def rpt_05(spark, d):
    own = view(spark, d, "questions").groupBy("project_id", "part_id").agg(F.array_join(F.array_sort(F.collect_list("question_number")), ",").alias("numbers"), (F.count_distinct(F.coalesce("correct_answer", F.lit(""))) == 1).alias("agree"), F.count("*").alias("n"))
    return own.where("n > 1").drop("n")


def _valid(spark, d):
    return Q.validate(Q.live(questions(spark, d))).where("reason IS NULL").drop("reason")


_UNITS = QS + _VALID + """,
q AS (SELECT *, coalesce(group_id, 'q-' || question_id) AS unit_id FROM v WHERE reason IS NULL AND NOT is_deleted)"""


@query("gen_01_units", _UNITS + " SELECT question_id, unit_id, min(question_number) OVER (PARTITION BY project_id, unit_id) AS unit_pos FROM q")
def gen_01(spark, d):
    return V.units(_valid(spark, d)).select("question_id", "unit_id", "unit_pos")


_MOVED = """,
o AS (SELECT question_id, project_id, unit_id, question_number, variant_number, correct_answer, unnest(range(1, len(string_split(kept, '|')) + 1)) AS i, string_split(kept, '|') AS ks FROM x WHERE filled > 0),
l AS (SELECT *, substr(ks[i], 1, 1) AS letter, substr(ks[i], 3) AS text FROM o),
m AS (SELECT *, row_number() OVER (PARTITION BY question_id, variant_number ORDER BY i) AS slot, row_number() OVER (PARTITION BY question_id, variant_number ORDER BY md5('s7|' || variant_number || '|' || question_id || '|' || letter), i) AS drawn FROM l),
w AS (SELECT a.question_id, a.variant_number, a.letter, b.text, b.letter AS was, a.i, a.correct_answer FROM m a JOIN m b ON a.question_id = b.question_id AND a.variant_number = b.variant_number AND a.slot = b.drawn)"""
_PLACED = """, k AS (SELECT question_id, variant_number, max(CASE WHEN was = correct_answer THEN letter END) AS now FROM w GROUP BY ALL)
SELECT x.project_id, x.variant_number, row_number() OVER (PARTITION BY x.project_id, x.variant_number ORDER BY md5('SEED|' || x.variant_number || '|' || x.project_id || '|' || unit_id), unit_id, question_number) AS position,
  x.question_id, CASE WHEN filled > 0 THEN coalesce(now, correct_answer) END AS key FROM x LEFT JOIN k USING (question_id, variant_number)"""
_SHUFFLE = _UNITS + ", x AS (SELECT q.*, n AS variant_number FROM q, range(1, 4) r(n))" + _MOVED


@query("gen_02_option_shuffle", _SHUFFLE + " SELECT question_id, variant_number, string_agg(letter || '=' || text, '|' ORDER BY i) AS options, max(CASE WHEN was = correct_answer THEN letter END) AS correct_now FROM w GROUP BY question_id, variant_number")
def gen_02(spark, d):
    v = V.variants(_valid(spark, d), 3, "s7").where("size(options) > 0")
    return v.select("question_id", F.col("variant_number").cast("long").alias("variant_number"), _told(F.col("shuffled")).alias("options"), V.new_label(F.col("shuffled"), F.col("correct_answer")).alias("correct_now"))


@query("gen_03_variants", _SHUFFLE + _PLACED.replace("SEED", "s7"))
def gen_03(spark, d):
    v = V.variants(_valid(spark, d), 3, "s7")
    return v.select("project_id", F.col("variant_number").cast("long").alias("variant_number"), "position", "question_id", "key")


@query("gen_04_counts", _UNITS + " SELECT project_id, count(*) * 4 AS rows, 4 AS variants FROM q GROUP BY project_id")
def gen_04(spark, d):
    v = V.variants(_valid(spark, d), 4, "s9")
    return v.groupBy("project_id").agg(F.count("*").alias("rows"), F.count_distinct("variant_number").cast("int").alias("variants"))


@query("snk_02_variant_rows", _UNITS + """, x AS (SELECT q.*, n AS variant_number FROM q, range(1, 3) r(n))
SELECT project_id, variant_number, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY md5('s7|' || variant_number || '|' || project_id || '|' || unit_id), unit_id, question_number) AS question_order FROM x GROUP BY ALL""")
def snk_02(spark, d):
    v = V.variants(_valid(spark, d), 2, "s7")
    own = v.groupBy("project_id", F.col("variant_number").cast("long").alias("variant_number")).agg(F.array_sort(F.collect_list(F.struct("position", "question_id"))).alias("o"))
    return own.select("project_id", "variant_number", F.array_join(F.transform("o", lambda x: x["question_id"]), ",").alias("question_order"))


_PICKS = """, s AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY md5('s3|' || question_id), question_id) - 1 AS place, count(*) OVER (PARTITION BY project_id) AS pool FROM questions),
c AS (SELECT project_id, n AS variant_number, question_id FROM s, range(1, 6) r(n) WHERE ((place - (n - 1) * least(3, pool)) % pool + pool) % pool < least(3, pool))"""
_CYCLE = QS + _PICKS


def _cycle(spark, d):
    return V.select_cyclic(view(spark, d, "questions"), 5, 3, "s3")


@query("gen_05_select_singles", _CYCLE + " SELECT * FROM c")
def gen_05(spark, d):
    return _cycle(spark, d).select("project_id", F.col("variant_number").cast("long").alias("variant_number"), "question_id")


@query("agg_13_reuse", _CYCLE + ", u AS (SELECT question_id, count(*) AS n FROM c GROUP BY question_id) SELECT max(n) AS max_usage, count(*) FILTER (n > 1) AS reused, array_to_string(list_slice(list_sort(list(question_id) FILTER (n > 1)), 1, 20), ',') AS first_reused FROM u")
def agg_13(spark, d):
    return R.reuse_stats(_cycle(spark, d), "question_id")


@query("gen_05_select_units")
def gen_05_units(spark, d):
    pool = V.units(_valid(spark, d)).withColumn("fp", D.fingerprint_norm(F.col("question_text")))
    return V.select_units(pool.select("project_id", "unit_id", "question_id", "fp"), 4, 4, "s5")


@query("gen_06_unit_variants")
def gen_06_units(spark, d):
    return V.pool_variants(_valid(spark, d), gen_05_units(spark, d), "s5").select("project_id", "variant_number", "position", "question_id", "key")


_LISTED = ", x AS (SELECT q.*, c.variant_number FROM q JOIN c USING (question_id))"


@query("gen_06_pool_variants", _UNITS + _PICKS + _LISTED + _MOVED.replace("s7|", "s5|") + _PLACED.replace("SEED", "s5"))
def gen_06(spark, d):
    v = V.pool_variants(_valid(spark, d), _cycle(spark, d), "s5")
    return v.select("project_id", F.col("variant_number").cast("long").alias("variant_number"), "position", "question_id", "key")


@query("rpt_07_missing_images", QS + " SELECT DISTINCT part_id FROM questions WHERE has_image AND part_id % 3 <> 0")
def rpt_07(spark, d):
    stored = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("part_id"))
    asked = view(spark, d, "questions").where("has_image").select("part_id").distinct()
    return asked.join(stored, "part_id", "left_anti")
