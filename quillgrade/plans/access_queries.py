"""Queries of the access family: FIL, NUM-07..09, DAT, TRI and their sorting forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrade.operators import access as A
from quillgrade.plans.registry import query
from quillgrade.plans.views import NOW, table, view, with_views

U = with_views("users")
T = f"TIMESTAMP '{NOW}'"
_IN_TIME = f"(access_until IS NULL OR access_until > {T})"
_USES = "(uses_left IS NULL OR uses_left > 0)"


@query("fil_01_has_access", U + f"SELECT telegram_id, is_admin OR (NOT is_blocked AND {_IN_TIME} AND {_USES}) AS allowed FROM users")
def fil_01(spark, d):
    return view(spark, d, "users").select("telegram_id", A.has_access(NOW).alias("allowed"))


@query("fil_02_can_check", U + f"SELECT telegram_id, is_admin OR (NOT is_blocked AND {_IN_TIME}) AS allowed FROM users")
def fil_02(spark, d):
    return view(spark, d, "users").select("telegram_id", A.can_check(NOW).alias("allowed"))


@query("fil_03_with_access", U + f"SELECT count(*) FILTER (NOT is_blocked AND {_IN_TIME} AND {_USES}) AS with_access, count(*) AS total FROM users")
def fil_03(spark, d):
    return view(spark, d, "users").agg(F.count_if(A.counted_with_access(NOW)).alias("with_access"), F.count("*").alias("total"))


@query("fil_04_recipients", U + f"SELECT telegram_id FROM users WHERE NOT is_blocked AND {_IN_TIME}")
def fil_04(spark, d):
    return A.recipients(view(spark, d, "users"), NOW, True)


@query(
    "fil_05_gate",
    U
    + f"""SELECT telegram_id, action, CASE WHEN action = 'check' THEN NOT (is_admin OR (NOT is_blocked AND {_IN_TIME}))
  WHEN action = 'multi' AND telegram_id % 4 = 0 THEN FALSE
  WHEN action IN ('upload', 'multi') THEN NOT (is_admin OR (NOT is_blocked AND {_IN_TIME} AND {_USES})) ELSE FALSE END AS denied
FROM users, (VALUES ('upload'), ('check'), ('multi'), ('other')) a(action)""",
)
def fil_05(spark, d):
    acts = view(spark, d, "users").withColumn("action", F.explode(F.array(*map(F.lit, ("upload", "check", "multi", "other")))))
    return acts.select("telegram_id", "action", A.gate(F.col("action"), F.col("telegram_id") % 4 == 0, NOW).alias("denied"))


@query("fil_06_search", U + "SELECT telegram_id, username FROM users WHERE username ILIKE '%usr_a%' OR full_name ILIKE '%usr_a%'")
def fil_06(spark, d):
    return A.search(view(spark, d, "users"), " @usr_a").select("telegram_id", "username")


@query("fil_07_find", U + "SELECT 'id' AS how, telegram_id FROM users WHERE telegram_id = 17 UNION ALL SELECT 'name', telegram_id FROM users WHERE lower(username) = (SELECT lower(username) FROM users WHERE telegram_id = 17)")
def fil_07(spark, d):
    users = view(spark, d, "users")
    by_id = A.find(users, "17").select(F.lit("id").alias("how"), "telegram_id")
    name = "USR_" + __import__("hashlib").md5(b"Customer#000000017").hexdigest()[:6]
    return by_id.union(A.find(users, "@" + name).select(F.lit("name"), "telegram_id"))


@query("fil_10_label", with_views("projects") + "SELECT project_id, coalesce(nullif(display_name, ''), name) AS label FROM projects")
def fil_10(spark, d):
    return view(spark, d, "projects").select("project_id", F.coalesce(F.nullif(F.col("display_name"), F.lit("")), "name").alias("label"))


@query("fil_14_banned", U + "SELECT telegram_id FROM users WHERE NOT is_blocked")
def fil_14(spark, d):
    return view(spark, d, "users").where(~F.col("is_blocked")).select("telegram_id")


_TIER = lambda c, a, b: f"CASE WHEN {c} >= {b} THEN 2 WHEN {c} >= {a} THEN 1 END"
_PLAN = f"""
p AS (SELECT *, {_TIER('variants_limit', 25, 50)} AS vt, {_TIER('checks_limit', 500, 1000)} AS ct FROM users),
q AS (SELECT *, CASE WHEN vt IS NULL THEN 0 ELSE least(vt, coalesce(ct, vt)) END AS o FROM p),
r AS (SELECT *, ['free', 'standart', 'pro'][o + 1] AS the_plan, [NULL, 25, 50][o + 1] AS base FROM q)"""


@query("num_07_plan", U.rstrip() + "," + _PLAN + " SELECT telegram_id, the_plan AS plan, CASE WHEN variants_limit > base THEN the_plan || '+' || (variants_limit - base) ELSE the_plan END AS plan_name FROM r")
def num_07(spark, d):
    v, c = F.col("variants_limit"), F.col("checks_limit")
    return view(spark, d, "users").select("telegram_id", A.plan_of(v, c).alias("plan"), A.plan_name(v, c).alias("plan_name"))


_REMAIN = lambda a, b: f"CASE WHEN {a} IS NULL THEN NULL WHEN period_start IS NULL OR {T} - period_start >= INTERVAL 30 DAY THEN {a} ELSE greatest(0, {a} - {b}) END"


@query("num_08_remaining", U + f"SELECT telegram_id, {_REMAIN('variants_limit', 'variants_used')} AS variants_remaining, {_REMAIN('checks_limit', 'checks_used')} AS checks_remaining FROM users")
def num_08(spark, d):
    left = lambda k: A.remaining(F.col(f"{k}_limit"), F.col(f"{k}_used"), NOW).alias(f"{k}_remaining")
    return view(spark, d, "users").select("telegram_id", left("variants"), left("checks"))


_DAYS = f"CASE WHEN access_until IS NULL THEN 0 ELSE greatest(0, floor((epoch_us(access_until) - epoch_us({T})) / 86400000000.0))::INT END"


@query(
    "num_09_summary",
    U.rstrip() + "," + _PLAN + f""" SELECT telegram_id, CASE WHEN variants_limit > base THEN the_plan || '+' || (variants_limit - base) ELSE the_plan END AS plan_name,
  {_REMAIN('variants_limit', 'variants_used')} AS variants_remaining, {_REMAIN('checks_limit', 'checks_used')} AS checks_remaining, {_DAYS} AS days_left,
  CASE WHEN uses_left IS NULL THEN 'unlimited' ELSE CAST(uses_left AS VARCHAR) END AS uses_note FROM r""",
)
def num_09(spark, d):
    return A.account_summary(view(spark, d, "users"), NOW)


_CLOCKS = [f"{h}:{m:02d}" for h in (0, 7, 12, 23, 24) for m in (0, 5, 59, 60)] + ["9 am", "12 am", "12pm", "1:30 PM", "13 pm", "0 am", "14.30", "7", "abc", "", " 8:15 "]


@query(
    "dat_01_clock",
    "WITH c AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _CLOCKS) + r"""]) AS clock),
e AS (SELECT clock, regexp_extract(lower(trim(clock)), '^([0-9]{1,2})(?:[:.]([0-9]{2}))?\s*(am|pm)?$', ['h', 'm', 'p']) AS g, regexp_matches(lower(trim(clock)), '^([0-9]{1,2})(?:[:.]([0-9]{2}))?\s*(am|pm)?$') AS ok FROM c),
f AS (SELECT clock, ok AND NOT (g.m = '' AND g.p = '') AS ok, TRY_CAST(g.h AS INT) AS h, coalesce(TRY_CAST(g.m AS INT), 0) AS m, g.p AS p FROM e),
k AS (SELECT *, CASE WHEN p = '' THEN h WHEN h < 1 OR h > 12 THEN NULL WHEN p = 'am' THEN h % 12 ELSE h % 12 + 12 END AS full_h FROM f)
SELECT clock, CASE WHEN ok AND full_h <= 23 AND m <= 59 THEN lpad(CAST(full_h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END AS parsed FROM k""",
)
def dat_01(spark, d):
    return spark.createDataFrame([(c,) for c in _CLOCKS], "clock string").select("clock", A.parse_clock(F.col("clock")).alias("parsed"))


_MINUTES = ["45", " 90 ", "0", "-5", "12.5", "abc", "", "1000000", "180"]


@query("dat_02_duration", "SELECT t AS text, CASE WHEN regexp_matches(trim(t), '^[0-9]{1,6}$') AND TRY_CAST(trim(t) AS INT) > 0 THEN TRY_CAST(trim(t) AS INT) END AS minutes FROM (SELECT unnest([" + ", ".join(f"'{m}'" for m in _MINUTES) + "]) AS t)")
def dat_02(spark, d):
    return spark.createDataFrame([(m,) for m in _MINUTES], "text string").select("text", A.parse_minutes(F.col("text")).alias("minutes"))


@query("dat_03_combine", f"SELECT clock, CAST(date_trunc('day', {T} + INTERVAL 5 HOUR) + CAST(clock || ':00' AS INTERVAL) - INTERVAL 5 HOUR AS VARCHAR) AS at_utc FROM (SELECT unnest(['00:00', '04:59', '08:30', '23:59']) AS clock)")
def dat_03(spark, d):
    clocks = spark.createDataFrame([(c,) for c in ("00:00", "04:59", "08:30", "23:59")], "clock string")
    return clocks.select("clock", F.date_format(A.combine_today(F.col("clock"), NOW), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


@query(
    "dat_04_plan_jobs",
    with_views("projects") + f"""SELECT project_id, kind, CAST(run_at AS VARCHAR) AS run_at FROM (
  SELECT project_id, 'warn' AS kind, exam_end_time - INTERVAL 10 MINUTE AS run_at FROM projects UNION ALL SELECT project_id, 'end', exam_end_time FROM projects) j WHERE run_at > {T}""",
)
def dat_04(spark, d):
    return A.plan_jobs(view(spark, d, "projects"), NOW).withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"))


@query("dat_05_expiry", with_views("variants") + f"SELECT variant_id, created_at + INTERVAL 48 HOUR <= {T} AS expired FROM variants")
def dat_05(spark, d):
    return view(spark, d, "variants").select("variant_id", A.session_expired(F.col("created_at"), NOW).alias("expired"))


@query("dat_06_days_left", U + f"SELECT telegram_id, {_DAYS} AS days_left FROM users WHERE access_until IS NOT NULL")
def dat_06(spark, d):
    return view(spark, d, "users").where("access_until IS NOT NULL").select("telegram_id", A.days_left(F.col("access_until"), NOW).alias("days_left"))


@query("dat_07_anchors", with_views("usage") + f"SELECT count(*) FILTER (created_at >= date_trunc('day', {T})) AS today, count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS week, count(*) FILTER (created_at >= {T} - INTERVAL 30 DAY) AS month FROM usage")
def dat_07(spark, d):
    a = A.anchors(NOW)
    return view(spark, d, "usage").agg(*[F.count_if(F.col("created_at") >= a[k]).alias(n) for k, n in (("day", "today"), ("week", "week"), ("month", "month"))])


@query("tri_01_trial", U + f"SELECT telegram_id, CAST({T} + INTERVAL 30 DAY AS VARCHAR) AS access_until, 1 AS uses_left, 2 AS checks_limit FROM users WHERE created_at >= {T} - INTERVAL 1 DAY")
def tri_01(spark, d):
    new = view(spark, d, "users").where(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-1), A.instant(NOW)))
    return A.with_trial(new, NOW).select("telegram_id", F.date_format("access_until", "yyyy-MM-dd HH:mm:ss").alias("access_until"), "uses_left", "checks_limit")


@query("tri_02_note", U + "SELECT telegram_id, uses_left IS NULL AS unlimited, CASE WHEN uses_left IS NULL THEN 'unlimited' ELSE CAST(uses_left AS VARCHAR) END AS note FROM users")
def tri_02(spark, d):
    return view(spark, d, "users").select("telegram_id", A.is_unlimited(F.col("uses_left")).alias("unlimited"), A.remaining_note(F.col("uses_left")).alias("note"))


@query("tri_04_get_or_create", U + "SELECT DISTINCT coalesce(user_id, -1) + 1400 AS telegram_id, FALSE AS is_blocked FROM events WHERE user_id + 1400 NOT IN (SELECT telegram_id FROM users)")
def tri_04(spark, d):
    from quillgrade.operators.mutations import placeholders

    asked = table(spark, d, "events").select((F.coalesce("user_id", F.lit(-1)) + 1400).alias("telegram_id"))
    return placeholders(view(spark, d, "users"), asked).select("telegram_id", "is_blocked")


@query("tri_05_user_card", U.rstrip() + "," + _PLAN + f" SELECT telegram_id, full_name, CASE WHEN variants_limit > base THEN the_plan || '+' || (variants_limit - base) ELSE the_plan END AS plan_name, is_admin OR (NOT is_blocked AND {_IN_TIME} AND {_USES}) AS allowed FROM r WHERE telegram_id = 17")
def tri_05(spark, d):
    found = A.find(view(spark, d, "users"), "17")
    return found.select("telegram_id", "full_name", A.plan_name(F.col("variants_limit"), F.col("checks_limit")).alias("plan_name"), A.has_access(NOW).alias("allowed"))


@query("srt_01_page", U + "SELECT telegram_id, full_name, (SELECT count(*) FROM users) AS total FROM users ORDER BY created_at DESC, telegram_id LIMIT 20 OFFSET 40")
def srt_01(spark, d):
    users = view(spark, d, "users")
    page = users.orderBy(F.desc("created_at"), "telegram_id").offset(40).limit(20)
    return page.crossJoin(users.agg(F.count("*").alias("total"))).select("telegram_id", "full_name", "total")
