"""Queries of text functions: STR, SET-03/04, LAD-01. Stems are built in the query, as the tables hold none."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from quillgrade.functions import text as X
from quillgrade.functions import udfs as U
from quillgrade.plans.registry import query
from quillgrade.plans.views import fp_sql, questions, table, with_views

_STEM = r"""SELECT p_partkey AS id, p_size AS n, p_name, p_brand, p_type, CASE p_partkey % 12
 WHEN 0 THEN concat(CAST(p_size AS STRING), '. $\\frac{', CAST(p_size AS STRING), '}{2}$ va \\alpha \\cdot x^{', CAST(p_size AS STRING), '} \\leq 3')
 WHEN 1 THEN concat('`', CAST(p_size AS STRING), ') ', p_name, ' fill nccha')
 WHEN 2 THEN concat('``` ', p_name, ' rasmda ko''rsatilgan')
 WHEN 3 THEN concat(p_name, ' A) ', p_name, ' B) ', p_brand, ' C) ', p_type)
 WHEN 4 THEN concat('FeFe2', ' birikma 1:2:3 H2O ', p_name)
 WHEN 5 THEN concat('x = ', chr(10), ' va hosil bo''ladi ', p_name)
 WHEN 6 THEN concat('254102No ', p_name, ' quyidagi sxema')
 WHEN 7 THEN concat('NaOH → X1 + HCl → X2. H2SO4 ', p_name)
 WHEN 8 THEN concat('2^(4√x) \\sqrt{', p_type, '} \\in A')
 WHEN 9 THEN concat('Tuzuvchi: Alisher Navoiy Telegram kanal @', p_type, '_x', chr(10), p_name, ' Alisher')
 WHEN 10 THEN concat('^', CAST(p_size AS STRING), '.', p_name, '  fill  ')
 ELSE concat(p_name, ' 12- 7 5- bolt') END AS stem FROM """
SPARK_STEM = _STEM.replace("{", "{{").replace("}", "}}") + "{part}"
ST = "WITH t AS (" + _STEM.replace("\\\\", "\\") + "part)"


def _stems(spark, d):
    return spark.sql(SPARK_STEM, part=table(spark, d, "part"))


def _nested(expr: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pattern, to, times = X.FRACTIONS
    for p, r in [(pattern, to)] * times + X.FIRST_PATTERNS:
        expr = f"regexp_replace({expr}, {quote(p)}, {quote(r)}, 'g')"
    for a, b in X.LITERALS:
        expr = f"replace({expr}, {quote(a)}, {quote(b)})"
    for p, r in X.LAST_PATTERNS:
        expr = f"regexp_replace({expr}, {quote(p)}, {quote(r)}, 'g')"
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


@query("str_01_clean_latex", ST + f" SELECT id, {_nested('stem')} AS cleaned FROM t")
def str_01(spark, d):
    return _stems(spark, d).select("id", X.clean_latex(F.col("stem")).alias("cleaned"))


_WORDFIX = "stem"
for _w, _r in X.CORRECTIONS.items():
    _WORDFIX = f"regexp_replace({_WORDFIX}, '\\b{_w}\\b', '{_r.replace(chr(39), chr(39) * 2)}', 'g')"


@query("str_02_corrections", ST + f" SELECT id, {_WORDFIX} AS fixed, len(regexp_extract_all(stem, '\\b(fill|nccha)\\b'))::INT AS fixes FROM t")
def str_02(spark, d):
    fixed, n = X.correct_words(F.col("stem"))
    return _stems(spark, d).select("id", fixed.alias("fixed"), n.alias("fixes"))


@query("str_03_clean_question", ST + f" SELECT id, {_nested('stem')} AS cleaned, contains(lower(stem), 'rasmda') OR contains(lower(stem), 'ko''rsatilgan') AS has_image FROM t WHERE NOT regexp_matches(stem, 'fill|nccha')")
def str_03(spark, d):
    fixed, _ = X.correct_words(X.clean_latex(F.col("stem")))
    return _stems(spark, d).where("NOT stem RLIKE 'fill|nccha'").select("id", fixed.alias("cleaned"), X.mentions(F.col("stem"), X.IMAGE_WORDS).alias("has_image"))


@query("str_04_own_number", ST + " SELECT id, regexp_replace(stem, '^\\s*[`*~_#]{0,4}\\s*\\^?' || n || '\\s*[.)]\\s*', '') AS stripped FROM t")
def str_04(spark, d):
    return _stems(spark, d).select("id", X.strip_own_number(F.col("stem"), F.col("n")).alias("stripped"))


@query("str_05_backticks", ST + " SELECT id, regexp_replace(stem, '^\\s*`+\\s*', '') AS stripped FROM t")
def str_05(spark, d):
    return _stems(spark, d).select("id", X.strip_backticks(F.col("stem")).alias("stripped"))


_INLINE = f""", a AS (SELECT id, stem, [p_name, p_brand, p_type] AS options, length(regexp_extract(stem, '(?s)^(.*?)\\bA\\)', 1)) AS head, regexp_matches(stem, '\\bA\\)') AS found FROM t),
b AS (SELECT *, substr(stem, head + 1) AS tail FROM a),
c AS (SELECT *, len(list_filter(options, lambda o: {fp_sql('o')} <> '' AND contains({fp_sql('tail')}, left({fp_sql('o')}, 12)))) AS hits FROM b)
SELECT id, CASE WHEN found AND len(options) >= 3 AND contains(tail, 'B)') AND contains(tail, 'C)') AND hits >= 2 THEN rtrim(left(stem, head)) ELSE stem END AS stripped FROM c"""


@query("str_06_inline_options", ST + _INLINE)
def str_06(spark, d):
    return _stems(spark, d).select("id", X.strip_inline_options(F.col("stem"), F.array("p_name", "p_brand", "p_type")).alias("stripped"))


query("str_07_chain")(lambda spark, d: _stems(spark, d).where("id % 12 = 7").select("id", U.chain(F.col("stem")).alias("chain")))


@query("str_08_handles", "SELECT doc_id, md5(regexp_replace(text, '@[_a-zA-Z0-9]{3,}', '', 'g')) AS h FROM documents")
def str_08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", X.HANDLE, "")).alias("h"))


@query("str_08_credits", ST + " SELECT id, CASE WHEN id % 12 = 9 THEN p_name ELSE regexp_replace(regexp_replace(stem, '[ \\t]{2,}', ' ', 'g'), '^[ _\\n\\t]+|[ _\\n\\t]+$', '', 'g') END AS stripped FROM t")
def str_08_credits(spark, d):
    rows = _stems(spark, d)  # parts of a brand stand for a document
    names = F.coalesce("names", F.array().cast("array<string>"))
    return rows.join(X.credit_names(rows, "p_brand", "stem"), "p_brand", "left").select("id", X.strip_credits(F.col("stem"), names).alias("stripped"))


_KEYS = ["1-a 2-b 3-c", "abcd", "1: foo / bar", "1: foo 3: bar", "2) 5\n3) 7,5", "1 A 1 B", "5: ab", "1.word\n2.b", ""]


@query("str_11_answer_key")
def str_11(spark, d):
    rows = spark.createDataFrame([(k,) for k in _KEYS], "text string").withColumn("k", U.answer_key(F.col("text")))
    return rows.select("text", F.array_join(F.transform("k.entries", lambda e: F.concat(e["position"].cast("string"), F.lit("="), F.array_join(e["accepted"], "/"))), ";").alias("key"), "k.reason")


# the keys of all questions that have a letter, as labelled lines, and read back
_KEY_LINES = "SELECT project_id, question_number AS n, correct_answer AS a FROM questions WHERE correct_answer IS NOT NULL"


@query("str_11_sheet_keys", with_views("questions") + f"SELECT project_id, string_agg(n || '=' || upper(a), ';' ORDER BY n) AS key FROM ({_KEY_LINES}) k GROUP BY project_id")
def str_11_sheets(spark, d):
    rows = questions(spark, d).where("correct_answer IS NOT NULL").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("question_number", F.lower("correct_answer").alias("a")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["question_number"].cast("string"), F.lit("-"), x["a"])), " ")
    key = F.array_join(F.transform("k.entries", lambda e: F.concat(e["position"].cast("string"), F.lit("="), F.array_join(e["accepted"], "/"))), ";")
    return rows.select("project_id", U.answer_key(text).alias("k")).select("project_id", key.alias("key"))


@query("str_12_skip_marks", ST + " SELECT id, array_to_string(list_transform(list_filter(string_split_regex(stem, '\\s+'), lambda w: regexp_matches(w, '^[0-9]{1,3}-$')), lambda w: CAST(replace(w, '-', '') AS INT)), ',') AS skips FROM t")
def str_12(spark, d):
    return _stems(spark, d).select("id", F.array_join(X.skip_numbers(F.col("stem")), ",").alias("skips"))


_CAPTION = "CASE o_orderkey % 5 WHEN 0 THEN concat(' Ali  ', o_orderkey % 50) WHEN 1 THEN 'Ali Vali' WHEN 2 THEN concat('Ali ', o_orderkey % 50, ' Vali') WHEN 3 THEN concat(o_orderkey % 50, ' ', o_orderpriority, ' 7') ELSE concat('  ', o_orderkey % 50, ' ') END"
_PARTS = f"""WITH p AS (SELECT o_orderkey, list_filter(string_split_regex({_CAPTION}, '\\s+'), lambda w: w <> '') AS parts FROM orders),
d AS (SELECT *, list_position(list_transform(parts, lambda w: regexp_matches(w, '^[0-9]+$')), true) AS spot FROM p)
SELECT o_orderkey, nullif(CASE WHEN coalesce(spot, 0) = 0 THEN array_to_string(parts, ' ') ELSE array_to_string(list_concat(parts[1:spot - 1], parts[spot + 1:]), ' ') END, '') AS name, CASE WHEN spot > 0 THEN CAST(parts[spot] AS INT) END AS variant FROM d"""


@query("str_13_caption", _PARTS)
def str_13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.parse_caption(F.expr(_CAPTION)).alias("c")).select("o_orderkey", "c.name", "c.variant")


# an element twice in a row, spelled out for each, as this dialect has no backreferences
_TWICE = "|".join(f"{e}[0-9]*{e}[0-9]*" for a in string.ascii_uppercase for e in (a, *(a + b for b in string.ascii_lowercase)))
_CHECKS = {
    "repeated_element": f"regexp_matches(w, '\\b(?:{_TWICE})\\b')",
    "empty_equation_side": "regexp_matches(stem, '(?m)^[ \\t]*=|=[ \\t]*$')",
    "dangling_product": "regexp_matches(stem, '(?i)\\bva\\s+hosil\\s+bo')",
    "ratio_element_mismatch": "ratio <> '' AND contains(lower(w), 'birikma') AND len(string_split(ratio, ':')) > list_max(list_transform(regexp_extract_all(w, '\\b(?:[A-Z][a-z]?[0-9]*){2,}\\b'), lambda f: len(list_distinct(regexp_extract_all(f, '[A-Z][a-z]?')))))",
    "possible_lost_bond": "contains(lower(stem), 'oksidlan') AND regexp_matches(stem, '\\bC?H?[0-9]*\\(?CH') AND NOT contains(stem, '=') AND NOT contains(stem, '≡')",
    "ocr_confusion": "list_contains(regexp_extract_all(lower(w), '\\p{L}+'), 'fill')",
    "broken_isotope": "regexp_matches(w, '\\b[0-9]{4,6}[A-Z][a-z]?\\b|\\b[a-z][0-9]+α')",
    "mangled_radical": "regexp_matches(w, '\\^\\(?\\s*[^\\s()]*√')",
}
_SLUGS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CHECKS.items()) + ")"
_WHOLE = ", x AS (SELECT id, stem, stem || ' ' AS w, regexp_extract(stem, '\\b([0-9]+(?:\\s*:\\s*[0-9]+)+)\\b', 1) AS ratio FROM t)"


@query("str_14_suspicious", ST + _WHOLE + f" SELECT id, {_SLUGS} AS reasons FROM x")
def str_14(spark, d):
    return _stems(spark, d).select("id", F.array_join(X.suspicious(F.col("stem"), F.lit("")), ",").alias("reasons"))


query("str_15_unanswerable")(lambda spark, d: _stems(spark, d).select("id", F.array_join(U.unanswerable(F.concat("stem", F.lit(". Y ni toping"))), ",").alias("missing")))


@query("str_16_lint", ST + " SELECT id, concat_ws(',', CASE WHEN regexp_matches(stem, '^\\s*[0-9]+\\s*[.)]\\s') THEN 'stem_starts_with_number' END, CASE WHEN regexp_matches(stem, '\\bA\\)') AND regexp_matches(stem, '\\bB\\)') THEN 'options_inside_stem' END) AS found FROM t")
def str_16(spark, d):
    own = X.lint(F.col("stem"), F.array(*[F.lit(x) for x in "abcd"]), F.lit(""), F.lit("zz yy"))
    return _stems(spark, d).select("id", F.array_join(own, ",").alias("found"))


_DESCRIBED = "CASE p_partkey % 4 WHEN 0 THEN concat('There is no ', p_name) WHEN 1 THEN concat('The page does not show ', p_name) WHEN 2 THEN p_name END"
_NEEDS = "(" + " OR ".join(f"contains(lower(stem), '{w.replace(chr(39), chr(39) * 2)}')" for w in X.SCHEME_WORDS) + ")"


@query("str_17_schemes", ST + f" SELECT id, {_NEEDS} AS needs, contains(stem, '→') AS has, coalesce(meta, FALSE) AS meta FROM t JOIN (SELECT p_partkey AS id, regexp_matches({_DESCRIBED}, '(?i)\\b(?:does|do|did)\\s*not\\s+(?:contain|have|include|show|depict)\\b|\\bthere\\s+is\\s+no\\b') AS meta FROM part) m USING (id)")
def str_17(spark, d):
    none = F.lit(None).cast("string")
    rows = _stems(spark, d).withColumn("p_partkey", F.col("id"))
    return rows.select("id", X.needs_scheme(F.col("stem"), F.lit(False), none).alias("needs"), X.has_scheme(F.col("stem"), F.lit(""), none, none).alias("has"), X.meta_description(F.expr(_DESCRIBED)).alias("meta"))


_TOK = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"


_SHOWN = "CASE p_partkey % 3 WHEN 0 THEN concat('the ', p_name, ' is shown') WHEN 1 THEN concat(p_type, ' ', p_brand) ELSE concat(p_brand, ' ', substr(p_name, 1, 9)) END"


@query("str_18_reveals", f"WITH p AS (SELECT p_partkey, list_filter({_TOK('p_name')}, lambda w: regexp_matches(w, '\\p{{L}}')) AS words, {_TOK(_SHOWN)} AS shown FROM part) SELECT p_partkey, len(words) >= 2 AND list_has_all(shown, words) AS reveals FROM p")
def str_18(spark, d):
    return table(spark, d, "part").select("p_partkey", X.reveals_answer(F.expr(_SHOWN), F.col("p_name")).alias("reveals"))


@query("set_03_subset", f"SELECT a.p_partkey, list_has_all({_TOK('b.p_name')}, {_TOK('a.p_name')}) AS is_subset FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_03(spark, d):
    p = table(spark, d, "part")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return both.select("p_partkey", X.is_subset(X.tokens(F.col("p_name")), X.tokens(F.col("other"))).alias("is_subset"))


@query("set_04_overlap", f"SELECT a.p_partkey, len(list_intersect({_TOK('a.p_name')}, {_TOK('b.p_name')})) / len({_TOK('a.p_name')})::DOUBLE AS share FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_04(spark, d):
    p = table(spark, d, "part")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return both.select("p_partkey", X.overlap(X.tokens(F.col("p_name")), X.tokens(F.col("other"))).alias("share"))


_LETTERS = "substr(md5(CAST(p_partkey AS STRING)), 1, 4)"
_CASED = f"concat(substr({_LETTERS}, 1, 2), upper(substr({_LETTERS}, 3, 2)))"


@query("str_19_mixed_case", f"SELECT p_partkey, regexp_matches({_CASED}, '[A-Z]') AND regexp_matches({_CASED}, '[a-z]') AS mixed FROM part")
def str_19(spark, d):
    return table(spark, d, "part").select("p_partkey", X.mixed_case(F.split(F.expr(_CASED), "")).alias("mixed"))


@query("str_20_scripts", "SELECT l_orderkey AS para, string_agg(CASE l_linenumber % 3 WHEN 1 THEN '^' || CASE WHEN length(CAST(l_linenumber AS VARCHAR)) > 1 THEN '(' || l_linenumber || ')' ELSE CAST(l_linenumber AS VARCHAR) END WHEN 2 THEN '_(' || 'x' || l_linenumber || ')' ELSE 'ab' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey")
def str_20(spark, d):
    k = F.col("l_linenumber") % 3
    n = F.col("l_linenumber").cast("string")
    runs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("para"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("idx"),
        F.when(k == 1, n).when(k == 2, F.concat(F.lit("x"), n)).otherwise("ab").alias("text"), F.when(k == 1, "super").when(k == 2, "sub").alias("style"),
    )
    return X.scripted(runs)


query("str_21_math")(lambda spark, d: _stems(spark, d).select("id", F.array_join(F.transform(U.math(F.concat(F.lit("Find x^2/(n+1) = √"), F.col("n").cast("string"), F.lit(" for "), "p_name")), lambda s: F.concat(s["kind"], F.lit(":"), s["body"])), "|").alias("segments")))


@query("str_22_labels_hint", with_views("questions") + "SELECT project_id, string_agg(question_number || ') ' || CASE WHEN option_a IS NULL THEN '✍️' WHEN option_b IS NULL THEN 'a' ELSE 'abcd' END, ' · ' ORDER BY question_number) AS hint FROM questions GROUP BY project_id")
def str_22(spark, d):
    q = questions(spark, d).select("project_id", "question_number", F.transform("options", lambda o: o["letter"]).alias("letters"))
    return X.labels_hint(q, "project_id")


@query("str_23_helpers", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short FROM documents")
def str_23(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 40).alias("short"))


@query("lad_01_scheme_ladder", ST + f" SELECT id, CASE WHEN NOT ({_NEEDS} OR id % 3 = 0) THEN 'none_needed' WHEN contains(stem, '→') THEN 'present' WHEN id % 5 = 0 THEN 'transcript' ELSE 'failed' END AS step FROM t")
def lad_01(spark, d):
    transcript = F.when(F.col("id") % 5 == 0, "1) NaOH\n2) H2O").otherwise("nothing")
    none = F.lit(None).cast("string")
    return _stems(spark, d).select("id", X.scheme_ladder(F.col("stem"), F.col("id") % 3 == 0, none, none, transcript).alias("step"))
