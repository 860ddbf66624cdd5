"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgrade.llm import bpe, chat, decontaminate, knn_quality, line_rules, near_dedup, pii, pseudo_likelihood, sharding, tokenfile
from quillgrade.llm.common import table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w
),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT id, n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.id AS x, b.id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.id < b.id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, r) AS (SELECT id, id FROM sets UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component_id, s.doc_id) AS kept
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN comp ON comp.id = sets.id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: Words as the contract cuts them, with their places.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, least(13, len(w)) AS k, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM bw),
lengths AS (SELECT DISTINCT k FROM windows),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k),
hits AS (
  SELECT x.doc_id, x.k, x.i, windows.item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM dw) x JOIN windows USING (k, phrase)
),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"), 40)


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.lm_scores(table(spark, sf_dir, "documents"))


#: The key of the registered queries; a caller passes a secret of its own.
PII_KEY = "quillgrade"


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, "text", "kinds")


#: The contract's extra conversation.
EXTRA_CHAT = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_CHAT), (-7, 1, "assistant", EXTRA_CHAT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(turns))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before_role,
    length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<turn>', '\o')) AS n_text,
    length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<turn>', '\o'), ':', '\c')) AS n_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + 13 + CASE WHEN before_role IS NULL OR before_role <> role THEN n_role + 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries():
    return {
        "op1_bpe_roundtrip": op1_bpe_roundtrip,
        "op2_near_dedup": op2_near_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_files": op4_token_files,
        "op5_line_rules": op5_line_rules,
        "op6_knn_quality": op6_knn_quality,
        "op7_hilbert_shards": op7_hilbert_shards,
        "op8_pseudo_likelihood": op8_pseudo_likelihood,
        "op9_pii_pseudonyms": op9_pii_pseudonyms,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op10_chat_format": OP10_SQL}
