"""Exam-shaped tables over the bundled star schema.

Each view is one SQL text in the subset that Spark and DuckDB share, with a few
dialect fields; an operator and its oracle read the same view and are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that queries take as "now", and its epoch seconds.
NOW = "2024-01-16 12:00:00"
NOW_S = 1705406400


class Spark:
    @staticmethod
    def ts(seconds: str) -> str:
        return f"(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"

    @staticmethod
    def sec(ts: str) -> str:
        return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div 1000000)"

    @staticmethod
    def table(name: str) -> str:
        return "{" + name + "}"


class Duck:
    @staticmethod
    def ts(seconds: str) -> str:
        return f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"

    @staticmethod
    def sec(ts: str) -> str:
        return f"(epoch_us({ts}) // 1000000)"

    @staticmethod
    def table(name: str) -> str:
        return name


def _users(d) -> str:
    return f"""
SELECT c_custkey AS telegram_id, concat('u-', CAST(c_custkey AS STRING)) AS user_id, c_name AS full_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('Usr_', substr(md5(c_name), 1, 6)) END AS username,
  c_custkey % 13 = 0 AS is_blocked, c_custkey % 97 = 0 AS is_admin,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {d.ts(f'{NOW_S} + (c_custkey % 61 - 30) * 86400 + 3600')} END AS access_until,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS uses_left,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 70 AS INT) END AS variants_limit,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 13) % 1300 AS INT) END AS checks_limit,
  CAST(c_custkey % 40 AS INT) AS variants_used, CAST((c_custkey * 3) % 600 AS INT) AS checks_used,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {d.ts(f'{NOW_S} - (c_custkey % 45) * 86400')} END AS period_start,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'pro' WHEN c_mktsegment = 'BUILDING' THEN 'standart' ELSE 'free' END AS plan,
  {d.ts(f'{NOW_S} - (c_custkey % 90) * 43200')} AS created_at, CAST(c_acctbal AS DOUBLE) AS balance
FROM {d.table('customer')}"""


def _projects(d) -> str:
    return f"""
SELECT o_orderkey AS project_id, concat('u-', CAST(o_custkey AS STRING)) AS user_id, o_custkey AS owner,
  concat('test ', CAST(o_orderkey AS STRING)) AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderpriority END AS display_name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {d.ts(f'{NOW_S} + (o_orderkey % 41 - 20) * 60')} END AS exam_end_time
FROM {d.table('orders')}"""


def _questions(d) -> str:
    return f"""
SELECT l_orderkey * 100 + qn AS question_id, l_orderkey AS project_id, CAST(qn AS INT) AS question_number,
  CASE WHEN l_partkey % 29 = 0 THEN '  ' ELSE concat(CAST(qn AS STRING), '. ', p_name, ' of ', p_brand) END AS question_text,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE p_name END AS option_a,
  CASE WHEN l_partkey % 11 = 0 OR l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN ' ' ELSE p_brand END AS option_b,
  CASE WHEN l_partkey % 11 = 0 OR l_partkey % 13 = 0 THEN NULL ELSE p_type END AS option_c,
  CASE WHEN l_partkey % 11 = 0 OR l_partkey % 13 = 0 THEN NULL ELSE concat('size ', CAST(p_size AS STRING)) END AS option_d,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE substr('ABCD', CAST(1 + (l_orderkey + qn) % 4 AS INT), 1) END AS correct_answer,
  l_partkey % 7 = 3 AS has_image, l_suppkey % 17 = 0 AS is_deleted, l_partkey AS part_id, p_name AS stem,
  CASE WHEN l_orderkey % 2 = 0 AND qn <= 3 THEN concat('g-', CAST(l_orderkey AS STRING)) ELSE NULL END AS group_id,
  CAST(1 + floor((qn - 1) / 3) AS INT) AS page_number, CASE WHEN qn > 6 THEN 2 ELSE 1 END AS section
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS qn
  FROM {d.table('lineitem')}
) q JOIN {d.table('part')} ON l_partkey = p_partkey"""


def _variants(d) -> str:
    return f"""
SELECT o_orderkey AS project_id, o_orderkey * 10 + v AS variant_id, CAST(v AS INT) AS variant_number,
  {d.ts(f'{NOW_S} - (o_orderkey * 7919 + v * 104729) % 900000')} AS created_at
FROM {d.table('orders')} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) n
WHERE o_orderkey % 3 <> 1"""


def _usage(d) -> str:
    return f"""
SELECT event_id AS usage_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS telegram_id, event_type AS kind, ts AS created_at,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(event_id % 211 AS BIGINT) AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 97 AS BIGINT) END AS thinking_tokens,
  CAST(floor(value * 10) + event_id % 211 + event_id % 97 AS BIGINT) AS total_tokens
FROM {d.table('events')}"""


def _key(d) -> str:
    """Answer keys: sheets are orders, positions their questions; holes where a question takes no answer."""
    return f"""
SELECT project_id AS sheet_id, question_number AS position,
  CASE WHEN part_id % 19 = 0 THEN NULL WHEN part_id % 11 = 0 THEN CAST(part_id AS STRING) ELSE correct_answer END AS accepted_a,
  CASE WHEN part_id % 23 = 0 THEN 'D' WHEN part_id % 11 = 0 THEN stem ELSE NULL END AS accepted_b, stem, part_id
FROM ({_questions(d)}) q"""


def _answers(d) -> str:
    """What students wrote: right, in the Cyrillic twin letter, in lower case, wrong, a near miss, or nothing."""
    return f"""
SELECT sheet_id, position,
  CASE WHEN part_id % 11 = 0 AND h < '5' THEN concat(' ', CAST(part_id AS STRING), ',0 ')
    WHEN part_id % 11 = 0 AND h < '8' THEN CAST(part_id + 1 AS STRING)
    WHEN part_id % 11 = 0 AND h < 'b' THEN concat(substr(stem, 1, length(stem) - 1), 'x')
    WHEN part_id % 11 = 0 THEN concat('qq', substr(md5(stem), 1, 9))
    WHEN h < '6' THEN accepted_a
    WHEN h < '8' THEN translate(accepted_a, 'ABC', 'АВС')
    WHEN h < '9' THEN ' ' || lower(accepted_a)
    WHEN h < 'd' THEN 'B' WHEN h < 'e' THEN '  ' ELSE NULL END AS student_answer,
  h = 'c' AS is_unclear
FROM (SELECT k.*, substr(md5(concat(CAST(sheet_id AS STRING), '-', CAST(position AS STRING))), 1, 1) AS h FROM ({_key(d)}) k) k
WHERE h <> 'f'"""


def _pages(d) -> str:
    """Extraction output in reading order: conversations stand for documents, turns for pages."""
    return f"""
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, CAST(pos AS INT) AS pos,
  CASE WHEN (conv_id + turn * 5 + pos) % 17 = 0 THEN 0
    WHEN (conv_id * 3 + turn) % 11 = 0 AND pos = 2 THEN 1
    WHEN (conv_id + turn) % 13 = 0 AND pos = 1 THEN CAST(turn * 4 + pos + 2 AS INT)
    ELSE CAST((turn % 4) * 4 + pos AS INT) END AS question_number,
  CASE WHEN (conv_id + turn) % 7 = 0 AND pos = 2 THEN concat('Part ', CAST(turn AS STRING)) ELSE NULL END AS section_title,
  substr(text, CAST(floor(length(text) * (pos - 1) / 4) AS INT) + 1, CAST(floor(length(text) * pos / 4) AS INT) - CAST(floor(length(text) * (pos - 1) / 4) AS INT)) AS question_text, (conv_id + pos) % 5 = 0 AS has_image
FROM {d.table('conversations')} CROSS JOIN (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p"""


def _runs(d) -> str:
    """Results of grading sessions, by arrival."""
    return f"""
SELECT o_custkey AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS idx,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('s', CAST(o_orderkey AS STRING)) END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS variant,
  CAST(o_orderkey % 26 AS INT) AS score, 25 AS total
FROM {d.table('orders')}"""


def _words(d) -> str:
    """Words on pages, as boxes: documents stand for ten orders each, pages for line numbers."""
    return f"""
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS doc_id, CAST(l_linenumber % 3 AS INT) AS page,
  CAST((l_partkey * 37) % 540 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_partkey) % 780 AS DOUBLE) AS y0,
  CAST((l_partkey * 37) % 540 + 12 + l_partkey % 30 AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_partkey) % 780 + 11 AS DOUBLE) AS y1,
  CASE WHEN l_partkey % 5 = 0 THEN concat(CAST(1 + l_partkey % 12 AS STRING), '.') WHEN l_partkey % 5 = 1 THEN concat(substr('ABCD', CAST(1 + l_partkey % 4 AS INT), 1), ')') ELSE concat('w', CAST(l_partkey % 90 AS STRING)) END AS text
FROM {d.table('lineitem')}"""


def _rects(d) -> str:
    return f"""
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS doc_id, CAST(l_linenumber % 3 AS INT) AS page, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS rect_id,
  CAST((l_suppkey * 41) % 400 AS DOUBLE) AS x0, CAST((l_partkey * 29) % 700 AS DOUBLE) AS y0,
  CAST((l_suppkey * 41) % 400 + 30 + l_partkey % 170 AS DOUBLE) AS x1, CAST((l_partkey * 29) % 700 + 20 + l_suppkey % 120 AS DOUBLE) AS y1,
  CASE WHEN l_returnflag = 'A' THEN 'bitmap' ELSE 'stroke' END AS kind
FROM {d.table('lineitem')}"""


VIEWS = {"users": _users, "projects": _projects, "questions": _questions, "variants": _variants, "usage": _usage, "answer_key": _key, "answers": _answers, "page_items": _pages, "runs": _runs, "words": _words, "rects": _rects}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name](Spark)
    used = [t for t in ("customer", "orders", "lineitem", "part", "events", "conversations", "documents") if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question view with its options as an ordered array of (letter, text)."""
    q = view(spark, sf_dir, "questions")
    option = lambda letter: F.when(F.col(f"option_{letter.lower()}").isNotNull(), F.struct(F.lit(letter).alias("letter"), F.col(f"option_{letter.lower()}").alias("text")))
    options = F.array_compact(F.array(*[option(x) for x in "ABCD"]))
    return q.withColumn("options", options)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key view with its accepted answers as an array, null in holes."""
    k = view(spark, sf_dir, "answer_key")
    return k.select("sheet_id", "position", F.when(F.col("accepted_a").isNotNull(), F.array_compact(F.array("accepted_a", "accepted_b"))).alias("accepted"))


def fp_sql(x: str) -> str:
    """The fingerprint of a text, in the oracle's dialect."""
    return f"regexp_replace(translate(lower(coalesce({x}, '')), '''‘’ʻʼʹ′`´', ''), '[^a-zа-яё0-9+\\-:/%=<>→≡]', '', 'g')"


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause of an oracle that reads the views."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n](Duck)})" for n in names) + " "
