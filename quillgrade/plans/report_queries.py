"""Queries of the report and join families: AGG, JOI-01..05, SRT, SNK, RPT."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrade.operators import access as A
from quillgrade.operators import reports as R
from quillgrade.plans.registry import query
from quillgrade.plans.views import NOW, questions, table, view, with_views

T = f"TIMESTAMP '{NOW}'"
SINCE = "2024-01-09 12:00:00"
_THINK = "coalesce(thinking_tokens, CASE WHEN total_tokens - prompt_tokens - output_tokens > 0 THEN total_tokens - prompt_tokens - output_tokens END, 0)"
_SUMS = f"count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt, coalesce(sum(output_tokens + {_THINK}), 0)::BIGINT AS billed_output"
_COST = "CAST(prompt * 30 + billed_output * 250 AS DOUBLE) / 1e8 AS usd, CAST(prompt * 30 + billed_output * 250 AS DOUBLE) * 12000.0 / 1e8 AS local_cost"


@query("agg_02_usage_summary", with_views("usage") + f"SELECT *, {_COST} FROM (SELECT {_SUMS} FROM usage WHERE created_at >= TIMESTAMP '{SINCE}') s")
def agg_02(spark, d):
    return R.usage_summary(view(spark, d, "usage"), SINCE)


@query("agg_03_cost_by_kind", with_views("usage") + f"SELECT *, {_COST} FROM (SELECT kind, {_SUMS} FROM usage GROUP BY kind) s")
def agg_03(spark, d):
    return R.usage_summary(view(spark, d, "usage"), "1970-01-01", "kind")


@query("rpt_04_user_cost", with_views("usage") + f"SELECT *, {_COST} FROM (SELECT telegram_id, {_SUMS} FROM usage WHERE created_at >= {T} - INTERVAL 10 DAY GROUP BY telegram_id) s")
def rpt_04(spark, d):
    return R.usage_summary(view(spark, d, "usage"), "2024-01-06 12:00:00", "telegram_id")


@query("num_06_thinking", with_views("usage") + f"SELECT usage_id, {_THINK}::BIGINT AS thinking FROM usage")
def num_06(spark, d):
    u = view(spark, d, "usage")
    return u.select("usage_id", R.thinking(u.prompt_tokens, u.output_tokens, u.thinking_tokens, u.total_tokens).alias("thinking"))


@query(
    "agg_01_platform_stats",
    with_views("users", "projects", "variants", "usage")
    + f"""SELECT u.*, p.*, v.*, c.* FROM
 (SELECT count(*) AS users, count(*) FILTER (created_at >= date_trunc('day', {T})) AS users_today, count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS users_week,
    count(*) FILTER (created_at >= {T} - INTERVAL 30 DAY) AS users_month, count(*) FILTER (is_blocked) AS blocked,
    count(*) FILTER (NOT is_blocked AND (access_until IS NULL OR access_until > {T}) AND (uses_left IS NULL OR uses_left > 0)) AS with_access FROM users) u,
 (SELECT count(*) AS projects, count(*) FILTER (status = 'completed') AS completed FROM projects) p,
 (SELECT count(*) AS variants FROM variants) v,
 (SELECT count(*) FILTER (created_at >= date_trunc('day', {T})) AS calls_today, coalesce(sum(prompt_tokens) FILTER (created_at >= date_trunc('day', {T})), 0)::BIGINT AS prompt_today,
    count(*) FILTER (created_at >= {T} - INTERVAL 30 DAY) AS calls_month, coalesce(sum(prompt_tokens) FILTER (created_at >= {T} - INTERVAL 30 DAY), 0)::BIGINT AS prompt_month FROM usage) c""",
)
def agg_01(spark, d):
    a, created = A.anchors(NOW), F.col("created_at")
    since = lambda k: created >= a[k]
    u = view(spark, d, "users").agg(
        F.count("*").alias("users"), *[F.count_if(since(k)).alias(f"users_{n}") for k, n in (("day", "today"), ("week", "week"), ("month", "month"))],
        F.count_if("is_blocked").alias("blocked"), F.count_if(A.counted_with_access(NOW)).alias("with_access"),
    )
    p = view(spark, d, "projects").agg(F.count("*").alias("projects"), F.count_if(F.col("status") == "completed").alias("completed"))
    v = view(spark, d, "variants").agg(F.count("*").alias("variants"))
    c = view(spark, d, "usage").agg(*[x for k, n in (("day", "today"), ("month", "month")) for x in (F.count_if(since(k)).alias(f"calls_{n}"), F.coalesce(F.sum(F.when(since(k), F.col("prompt_tokens"))), F.lit(0)).alias(f"prompt_{n}"))])
    return u.crossJoin(p).crossJoin(v).crossJoin(c)  # one row each


@query("agg_04_admin_stats", with_views("users", "projects") + "SELECT u.*, p.* FROM (SELECT count(*) FILTER (plan = 'free') AS free, count(*) FILTER (plan = 'standart') AS standart, count(*) FILTER (plan = 'pro') AS pro FROM users) u, (SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed FROM projects) p")
def agg_04(spark, d):
    u = view(spark, d, "users").agg(*[F.count_if(F.col("plan") == k).alias(k) for k in ("free", "standart", "pro")])
    return u.crossJoin(view(spark, d, "projects").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed")))


@query("agg_05_session_totals", "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source")
def agg_05(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"))


@query(
    "agg_11_group_result",
    with_views("runs")
    + """, g AS (SELECT *, 100.0::DOUBLE * score / total AS pct, round_even(100.0::DOUBLE * score / total, 0) AS shown FROM runs)
SELECT session_id, count(*) AS sheets, round(avg(score), 4) AS mean_score, round_even(avg(pct), 0) AS mean_percent, count(*) FILTER (shown >= 86) AS grade_5,
  count(*) FILTER (shown >= 71 AND shown < 86) AS grade_4, count(*) FILTER (shown >= 56 AND shown < 71) AS grade_3, count(*) FILTER (shown < 56) AS grade_2 FROM g GROUP BY session_id""",
)
def agg_11(spark, d):
    return R.group_result(view(spark, d, "runs"))


@query("win_10_rank", with_views("runs") + "SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, idx) AS rank FROM runs")
def win_10(spark, d):
    return R.ranked(view(spark, d, "runs")).select("session_id", "idx", "rank")


_LABEL = "coalesce(nullif(name, ''), '(Variant ' || variant || ')', '(Sheet ' || idx || ')')"


@query("rpt_03_row_label", with_views("runs") + f"SELECT session_id, idx, {_LABEL} AS label FROM runs")
def rpt_03(spark, d):
    return view(spark, d, "runs").select("session_id", "idx", R.row_label().alias("label"))


@query(
    "snk_04_tsv_report",
    with_views("runs")
    + f"""SELECT session_id, string_agg({_LABEL} || chr(9) || score || '/' || total || chr(9) ||
  CASE WHEN round_even(100.0::DOUBLE * score / total, 0) >= 86 THEN 5 WHEN round_even(100.0::DOUBLE * score / total, 0) >= 71 THEN 4 WHEN round_even(100.0::DOUBLE * score / total, 0) >= 56 THEN 3 ELSE 2 END,
  chr(10) ORDER BY score DESC, idx) AS report FROM runs GROUP BY session_id""",
)
def snk_04(spark, d):
    return R.tsv(view(spark, d, "runs"))


@query("joi_01_project_variants", with_views("projects", "variants") + "SELECT v.variant_id, v.variant_number, p.name FROM variants v JOIN projects p USING (project_id)")
def joi_01(spark, d):
    own = view(spark, d, "projects").select("project_id", "name")
    return view(spark, d, "variants").join(own, "project_id").select("variant_id", "variant_number", "name")


@query(
    "joi_02_latest_key",
    with_views("projects", "variants") + "SELECT owner, variant_number, variant_id FROM (SELECT p.owner, v.variant_number, v.variant_id, row_number() OVER (PARTITION BY p.owner, v.variant_number ORDER BY v.created_at DESC, v.variant_id DESC) AS rn FROM variants v JOIN projects p USING (project_id)) x WHERE rn = 1",
)
def joi_02(spark, d):
    both = view(spark, d, "variants").join(view(spark, d, "projects").select("project_id", "owner"), "project_id")
    return both.groupBy("owner", "variant_number").agg(F.max_by("variant_id", F.struct("created_at", "variant_id")).alias("variant_id"))


@query("joi_03_pending_exams", with_views("projects", "users") + f"SELECT p.project_id, u.telegram_id FROM projects p JOIN users u USING (user_id) WHERE p.exam_end_time IS NOT NULL AND p.exam_end_time > {T}")
def joi_03(spark, d):
    pending = view(spark, d, "projects").where(F.col("exam_end_time") > A.instant(NOW))
    return pending.join(view(spark, d, "users").select("user_id", "telegram_id"), "user_id").select("project_id", "telegram_id")


_PICKER = "SELECT project_id, name FROM projects p WHERE status = 'completed' AND EXISTS (SELECT 1 FROM variants v WHERE v.project_id = p.project_id) ORDER BY created_at DESC, project_id LIMIT 10"


def _picker(spark, d):
    done = view(spark, d, "projects").where("status = 'completed'").join(view(spark, d, "variants"), "project_id", "left_semi")
    return done.orderBy(F.desc("created_at"), "project_id").limit(10).select("project_id", "name")


query("joi_04_projects_with_variants", with_views("projects", "variants") + _PICKER)(_picker)
query("srt_02_newest_projects", with_views("projects", "variants") + _PICKER)(_picker)


@query("joi_05_has_session", with_views("users", "projects") + "SELECT telegram_id, EXISTS (SELECT 1 FROM projects p WHERE p.user_id = u.user_id AND p.status = 'processing') AS active FROM users u")
def joi_05(spark, d):
    active = view(spark, d, "projects").where("status = 'processing'").select("user_id").distinct().withColumn("hit", F.lit(True))
    return view(spark, d, "users").join(active, "user_id", "left").select("telegram_id", F.coalesce("hit", F.lit(False)).alias("active"))


@query("joi_15_pinned_guard", with_views("projects") + "SELECT p.project_id FROM projects p WHERE p.project_id % 10 < 3 AND EXISTS (SELECT 1 FROM projects s WHERE s.owner = 50 AND s.project_id = p.project_id)")
def joi_15(spark, d):
    p = view(spark, d, "projects")
    return p.where("project_id % 10 < 3").join(p.where("owner = 50").select("project_id"), "project_id", "left_semi").select("project_id")


@query("srt_03_latest_session", with_views("projects") + "SELECT owner, project_id FROM (SELECT owner, project_id, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, project_id DESC) AS rn FROM projects WHERE status = 'processing') x WHERE rn = 1")
def srt_03(spark, d):
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("project_id"))
    return view(spark, d, "projects").where("status = 'processing'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("owner", "project_id")


@query("srt_06_numeric_keys", "SELECT k, row_number() OVER (ORDER BY CAST(k AS INT)) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS k FROM part) x")
def srt_06(spark, d):
    keys = table(spark, d, "part").select(F.col("p_size").cast("string").alias("k")).distinct()
    ordered = keys.groupBy().agg(F.array_sort(F.collect_set(F.col("k").cast("int"))).alias("a"))
    return ordered.select(F.posexplode("a").alias("place", "k")).select(F.col("k").cast("string").alias("k"), (F.col("place") + 1).cast("long").alias("place"))


_LABELS = "SELECT project_id, unnest([CASE WHEN option_a IS NOT NULL AND trim(option_a) <> '' THEN 'A' END, CASE WHEN trim(option_b) <> '' THEN 'B' END, CASE WHEN trim(option_c) <> '' THEN 'C' END, CASE WHEN trim(option_d) <> '' THEN 'D' END]) AS l FROM questions WHERE NOT is_deleted"


@query("agg_12_label_set", with_views("questions") + f"SELECT project_id, string_agg(DISTINCT l, '' ORDER BY l) AS labels FROM ({_LABELS}) x WHERE l IS NOT NULL GROUP BY project_id")
def agg_12(spark, d):
    o = questions(spark, d).where("NOT is_deleted").select("project_id", F.explode("options").alias("o")).where(F.trim("o.text") != "")
    own = o.where(F.upper("o.letter").rlike(r"^\p{L}$")).groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set(F.upper("o.letter"))), "").alias("labels"))
    return own


@query("agg_14_predicted_reuse", "SELECT n, m, pool, CASE WHEN pool > 0 THEN ceil(n * m / pool)::BIGINT ELSE 0 END AS reuse FROM (SELECT unnest([1, 5, 30]) AS n), (SELECT unnest([10, 25]) AS m), (SELECT unnest([0, 7, 60]) AS pool)")
def agg_14(spark, d):
    grid = spark.createDataFrame([(n, m, p) for n in (1, 5, 30) for m in (10, 25) for p in (0, 7, 60)], "n int, m int, pool int")
    return grid.withColumn("reuse", R.predicted_reuse(F.col("n"), F.col("m"), F.col("pool")))


@query("agg_15_pool_summary", with_views("questions") + "SELECT project_id, count(*) AS n_questions, count(*) FILTER (has_image) AS n_images, array_to_string(list_slice(list_sort(list(question_number) FILTER (trim(question_text) = '')), 1, 12), ',') AS warned FROM questions GROUP BY project_id")
def agg_15(spark, d):
    blank = F.array_sort(F.collect_list(F.when(F.trim("question_text") == "", F.col("question_number"))))
    warned = F.when(F.size(blank) > 0, F.array_join(F.slice(blank, 1, R.WARNINGS_SHOWN), ","))
    return view(spark, d, "questions").groupBy("project_id").agg(F.count("*").alias("n_questions"), F.count_if("has_image").alias("n_images"), warned.alias("warned"))


@query("agg_16_white_ratio", "SELECT page_id, CASE WHEN sum(n) > 0 THEN round(sum(n) FILTER (bin >= 248) / sum(n), 9) ELSE 0 END AS ratio FROM (SELECT page_id, b AS bin, CASE WHEN b >= 248 THEN (page_id * 7) % 50 ELSE (page_id + b) % 3 END AS n FROM pages, range(0, 256) r(b)) x GROUP BY page_id")
def agg_16(spark, d):
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.when(b >= 248, (F.col("page_id") * 7) % 50).otherwise((F.col("page_id") + b) % 3))
    return table(spark, d, "pages").select("page_id", F.round(R.white_ratio(bins), 9).alias("ratio"))


_WIDTHS = "SELECT o_custkey AS owner, list(30 + (o_orderkey * 13) % 170 ORDER BY o_orderkey) AS w FROM orders GROUP BY o_custkey"


@query(
    "snk_06_pack_columns",
    f"""WITH RECURSIVE s AS ({_WIDTHS}), f(owner, w, i, block, used) AS (
  SELECT owner, w, 1, 1, w[1] FROM s UNION ALL
  SELECT owner, w, i + 1, CASE WHEN used + 10 + w[i + 1] <= 500 THEN block ELSE block + 1 END, CASE WHEN used + 10 + w[i + 1] <= 500 THEN used + 10 + w[i + 1] ELSE w[i + 1] END FROM f WHERE i < len(w))
SELECT owner, string_agg(block, ',' ORDER BY i) AS blocks FROM f GROUP BY owner""",
)
def snk_06(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (30 + (F.col("o_orderkey") * 13) % 170).cast("int").alias("w")))).alias("x"))
    return ordered.select("owner", F.array_join(R.pack_columns(F.transform("x", lambda v: v["w"]), 500, 10), ",").alias("blocks"))


@query("snk_07_option_layout", "SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_brand), length(p_type)) * 3 <= 27 THEN 3 WHEN greatest(length(p_name), length(p_brand), length(p_type)) * 2 <= 27 THEN 2 ELSE 1 END AS across FROM part")
def snk_07(spark, d):
    return table(spark, d, "part").select("p_partkey", R.layout_columns(F.array("p_name", "p_brand", "p_type"), 27).alias("across"))
