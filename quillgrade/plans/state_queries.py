"""Queries of stateful operators and mutations: STF, WIN-11, SRT-05, TRI-03, MUT."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrade.operators import access as A
from quillgrade.operators import mutations as M
from quillgrade.operators import state as S
from quillgrade.plans.registry import query
from quillgrade.plans.views import NOW, NOW_S, table, view, with_views

HOUR = 3600 * S.MICROS
T = f"TIMESTAMP '{NOW}'"
_SEQ = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events{where})"

_THROTTLE = "WITH RECURSIVE " + _SEQ.format(where="") + f""",
f(user_id, i, event_id, last, ok) AS (SELECT user_id, i, event_id, t, TRUE FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.event_id, CASE WHEN e.t - f.last >= {12 * HOUR} THEN e.t ELSE f.last END, e.t - f.last >= {12 * HOUR} FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id FROM f WHERE ok"""


@query("stf_01_throttle", _THROTTLE)
def stf_01(spark, d):
    return S.throttle(table(spark, d, "events"), "user_id", 12 * HOUR)


@query("stf_01_throttle_stream", _THROTTLE)
def stf_01_stream(spark, d):
    from quillgrade.sources import files
    from quillgrade.streaming import throttle as X

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path.replace("events.parquet", "event[s].parquet"))
    return X.run_available(X.throttle_stream(events, "user_id", 12 * HOUR), files.work_dir(spark, "throttled"))


_QUOTA = f"""
f(user_id, i, start, n, blocked, resets) AS (
  SELECT user_id, i, t, CASE WHEN lim > 0 THEN 1 ELSE 0 END, CASE WHEN lim > 0 THEN 0 ELSE 1 END, 1 FROM (SELECT *, 2 + user_id % 3 - 1 AS lim FROM e) WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, CASE WHEN e.t - f.start >= {168 * HOUR} THEN e.t ELSE f.start END,
    CASE WHEN e.t - f.start >= {168 * HOUR} THEN 1 WHEN f.n < 1 + e.user_id % 3 THEN f.n + 1 ELSE f.n END,
    f.blocked + CASE WHEN e.t - f.start >= {168 * HOUR} OR f.n < 1 + e.user_id % 3 THEN 0 ELSE 1 END, f.resets + CASE WHEN e.t - f.start >= {168 * HOUR} THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(n, i) AS used, max(blocked) AS blocked, max(resets) AS resets FROM f GROUP BY user_id"""


@query("stf_02_quota", "WITH RECURSIVE " + _SEQ.format(where=" WHERE event_type = 'purchase'") + "," + _QUOTA)
def stf_02(spark, d):
    buys = table(spark, d, "events").where("event_type = 'purchase'")
    return S.quota(buys, "user_id", 1 + F.col("user_id") % 3, 168 * HOUR)


@query("stf_03_session_ttl", with_views("variants") + f"SELECT project_id, count(*) FILTER (created_at + INTERVAL 48 HOUR > {T}) AS active, count(*) FILTER (created_at + INTERVAL 48 HOUR <= {T}) AS cancelled FROM variants GROUP BY project_id")
def stf_03(spark, d):
    gone = A.session_expired(F.col("created_at"), NOW)
    return view(spark, d, "variants").groupBy("project_id").agg(F.count_if(~gone).alias("active"), F.count_if(gone).alias("cancelled"))


@query("stf_04_timers", with_views("projects") + f"SELECT kind, count(*) AS jobs FROM (SELECT 'warn' AS kind, exam_end_time - INTERVAL 10 MINUTE AS run_at, exam_end_time FROM projects UNION ALL SELECT 'end', exam_end_time, exam_end_time FROM projects) j WHERE run_at > {T} AND exam_end_time > {T} GROUP BY kind")
def stf_04(spark, d):
    jobs = A.plan_jobs(view(spark, d, "projects"), NOW).dropDuplicates(["project_id", "kind"])
    return jobs.groupBy("kind").agg(F.count("*").alias("jobs"))


@query("stf_05_first_charge", "SELECT user_id AS telegram_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stf_05(spark, d):
    return M.first_charges(table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("telegram_id"), "event_id"), "event_id")


@query("stf_06_has_quota", with_views("users") + f"SELECT telegram_id, checks_limit IS NULL OR period_start IS NULL OR epoch_us({T}) - epoch_us(period_start) >= {30 * 24 * HOUR} OR checks_used < checks_limit AS allowed FROM users")
def stf_06(spark, d):
    now = F.lit(NOW_S * S.MICROS)
    return view(spark, d, "users").select("telegram_id", S.has_quota(F.col("checks_limit"), F.col("checks_used"), S.micros(F.col("period_start")), now, 30 * 24 * HOUR).alias("allowed"))


@query("stf_07_runs", with_views("runs") + "SELECT session_id, string_agg(CAST(score AS VARCHAR), ',' ORDER BY idx) AS scores FROM runs GROUP BY session_id")
def stf_07(spark, d):
    return S.run_results(view(spark, d, "runs"), "session_id")


@query("stf_08_outcomes", "SELECT count(*) FILTER (event_type <> 'error') AS sent, count(*) FILTER (event_type = 'error') AS failed FROM events")
def stf_08(spark, d):
    return S.outcomes(table(spark, d, "events"), F.col("event_type") != "error")


_FIRST = "SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) x WHERE rn = 1"


@query("win_11_session_charge", f"SELECT user_id, CAST(day AS VARCHAR) AS day, event_id FROM ({_FIRST}) y")
def win_11(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    e = e.withColumn("session", F.concat_ws("|", "user_id", "day"))
    return M.charge_sessions(e, "session", "event_id").select("user_id", "day", "event_id")


@query("srt_05_least_used", "SELECT user_id, row_number() OVER (ORDER BY n, md5('s|' || user_id)) AS place FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) x ORDER BY place LIMIT 25")
def srt_05(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    top = n.orderBy("n", F.md5(F.concat(F.lit("s|"), F.col("user_id").cast("string")))).limit(25)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct("n", F.md5(F.concat(F.lit("s|"), F.col("user_id").cast("string"))).alias("k"), "user_id"))).alias("o"))
    return ordered.select(F.posexplode("o").alias("at", "x")).select("x.user_id", (F.col("at") + 1).cast("long").alias("place"))


_CHARGES = "c AS (SELECT user_id AS telegram_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)"
_UC = with_views("users").rstrip() + "," + _CHARGES
_TAKEN = "CASE WHEN uses_left IS NOT NULL THEN greatest(0, uses_left - coalesce(n, 0)) END AS uses_left, CASE WHEN uses_left IS NULL THEN 0 ELSE least(uses_left, coalesce(n, 0)) END::BIGINT AS granted"


def _charges(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("telegram_id"), "event_id", "ts")


@query("mut_01_decrement", _UC + f" SELECT telegram_id, {_TAKEN} FROM users LEFT JOIN c USING (telegram_id)")
def mut_01(spark, d):
    return M.decrement_uses(view(spark, d, "users"), _charges(spark, d))


@query("mut_02_session_charge", with_views("users").rstrip() + f", c AS (SELECT user_id AS telegram_id, count(*) AS n FROM ({_FIRST}) y GROUP BY user_id) SELECT telegram_id, {_TAKEN} FROM users LEFT JOIN c USING (telegram_id)")
def mut_02(spark, d):
    charged = win_11(spark, d).select(F.col("user_id").alias("telegram_id"), "event_id")
    return M.decrement_uses(view(spark, d, "users"), charged)


@query("tri_03_charge_notice", _UC + f", f AS (SELECT user_id AS telegram_id, min(event_id) AS first_event FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT telegram_id, {_TAKEN}, first_event FROM users LEFT JOIN c USING (telegram_id) LEFT JOIN f USING (telegram_id)")
def tri_03(spark, d):
    c = _charges(spark, d)
    return M.decrement_uses(view(spark, d, "users"), c).join(M.first_charges(c.select("telegram_id", F.col("event_id").alias("first_event")), "first_event"), "telegram_id", "left")


_LOG = "SELECT user_id AS telegram_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'grant' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'limit' WHEN 'error' THEN 'block' ELSE CASE WHEN event_id % 2 = 0 THEN 'unblock' ELSE 'reset' END END AS command, CAST(event_id % 30 AS INT) AS amount FROM events"


@query(
    "mut_03_commands",
    with_views("users", recursive=True).rstrip() + f""", l AS (SELECT *, row_number() OVER (PARTITION BY telegram_id ORDER BY seq) AS i FROM ({_LOG}) x),
f(telegram_id, i, uses_left, variants_limit, variants_used, is_blocked) AS (SELECT telegram_id, 0::BIGINT, uses_left, variants_limit, variants_used, is_blocked FROM users UNION ALL
  SELECT f.telegram_id, f.i + 1, CASE WHEN command = 'grant' THEN amount ELSE f.uses_left END, CASE WHEN command = 'limit' THEN amount WHEN command = 'add' THEN f.variants_limit + amount ELSE f.variants_limit END,
    CASE WHEN command = 'reset' THEN 0 ELSE f.variants_used END, CASE WHEN command = 'block' THEN TRUE WHEN command = 'unblock' THEN FALSE ELSE f.is_blocked END FROM f JOIN l ON l.telegram_id = f.telegram_id AND l.i = f.i + 1)
SELECT telegram_id, arg_max(coalesce(uses_left, -99), i) AS uses_left, arg_max(coalesce(variants_limit, -99), i) AS variants_limit, arg_max(variants_used, i) AS variants_used, arg_max(is_blocked, i) AS is_blocked, max(i)::INT AS audit_rows FROM f GROUP BY telegram_id""",
)
def mut_03(spark, d):
    log = spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    out = M.apply_commands(view(spark, d, "users"), log)
    return out.withColumn("uses_left", F.coalesce("uses_left", F.lit(-99))).withColumn("variants_limit", F.coalesce("variants_limit", F.lit(-99)))


@query("mut_04_upsert", with_views("users").rstrip() + ", s AS (SELECT user_id + 1400 AS telegram_id, arg_max('nick' || (event_id % 40), event_id) AS nu FROM events GROUP BY ALL) SELECT telegram_id, coalesce(nu, username) AS username, coalesce(is_admin, FALSE) OR telegram_id IN (3, 1405) AS is_admin FROM users FULL JOIN s USING (telegram_id)")
def mut_04(spark, d):
    seen = table(spark, d, "events").select((F.col("user_id") + 1400).alias("telegram_id"), "event_id", F.concat(F.lit("nick"), (F.col("event_id") % 40).cast("string")).alias("username"))
    return M.upsert_users(view(spark, d, "users"), seen, [3, 1405])


@query("mut_05_daily_reset", with_views("users") + "SELECT telegram_id, CASE WHEN CAST(period_start AS DATE) < DATE '2024-01-16' THEN 0 ELSE variants_used END AS variants_used, CASE WHEN CAST(period_start AS DATE) < DATE '2024-01-16' THEN '2024-01-16' ELSE CAST(CAST(period_start AS DATE) AS VARCHAR) END AS reset_on FROM users")
def mut_05(spark, d):
    return M.reset_daily(view(spark, d, "users"), "2024-01-16")


_VP = "(SELECT DISTINCT project_id FROM variants)"


@query("mut_06_soft_delete", with_views("questions", "variants") + f"SELECT project_id, count(*) FILTER (is_deleted OR (question_number = 2 AND project_id NOT IN {_VP})) AS deleted FROM questions GROUP BY project_id")
def mut_06(spark, d):
    q = view(spark, d, "questions")
    out = M.soft_delete(q, q.where("question_number = 2").select("project_id", "question_id"), view(spark, d, "variants"))
    return out.groupBy("project_id").agg(F.count_if("is_deleted").alias("deleted"))


@query("mut_07_hard_delete", with_views("questions") + "SELECT project_id, count(*) AS n FROM questions WHERE question_id NOT IN (SELECT question_id FROM questions WHERE part_id % 6 = 0) GROUP BY project_id")
def mut_07(spark, d):
    q = view(spark, d, "questions")
    return M.hard_delete(q, q.where("part_id % 6 = 0"), "question_id").groupBy("project_id").agg(F.count("*").alias("n"))


@query("mut_08_cascade", with_views("projects", "questions", "variants") + "SELECT (SELECT count(*) FROM projects WHERE owner % 10 <> 0) AS projects, (SELECT count(*) FROM questions JOIN projects USING (project_id) WHERE owner % 10 <> 0) AS questions, (SELECT count(*) FROM variants JOIN projects USING (project_id) WHERE owner % 10 <> 0) AS variants, (SELECT count(*) FROM variants JOIN projects USING (project_id) WHERE owner % 10 <> 0) AS submissions")
def mut_08(spark, d):
    p, q, v = view(spark, d, "projects"), view(spark, d, "questions"), view(spark, d, "variants")
    kept = M.cascade(p, q, v, v.select("variant_id"), p.where("owner % 10 = 0").select("project_id"))
    counts = [x.agg(F.count("*").alias(n)) for x, n in zip(kept, ("projects", "questions", "variants", "submissions"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query("mut_09_ban", with_views("users") + "SELECT telegram_id, is_blocked OR telegram_id % 31 = 0 AS is_blocked, CASE WHEN telegram_id % 29 = 0 THEN 'pro' ELSE plan END AS plan FROM users")
def mut_09(spark, d):
    key = F.col("telegram_id")
    return view(spark, d, "users").select(key, (F.col("is_blocked") | (key % 31 == 0)).alias("is_blocked"), F.when(key % 29 == 0, "pro").otherwise(F.col("plan")).alias("plan"))


@query("mut_10_append", "SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM labels) AS rows, (SELECT count(*) FROM labels) AS appended")
def mut_10(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("usage").alias("kind"))
    more = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("decision").alias("kind"))
    return log.unionByName(more).agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "decision").alias("appended"))
