"""Access predicates, plans, quotas, account notes and clock arithmetic.

A null limit means unlimited. The three notions of an active user differ on purpose
and keep separate names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers with their variant and check quotas.
TIERS = [("standart", 25, 500), ("pro", 50, 1000)]
TRIAL_DAYS, TRIAL_USES, TRIAL_CHECKS = 30, 1, 2
SESSION_HOURS = 48
PERIOD_DAYS = 30
UTC_OFFSET_HOURS = 5


def instant(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def unexpired(now: str) -> Column:
    return F.col("access_until").isNull() | (F.col("access_until") > instant(now))


def uses_remain() -> Column:
    return F.col("uses_left").isNull() | (F.col("uses_left") > 0)


def has_access(now: str) -> Column:
    return F.col("is_admin") | (~F.col("is_blocked") & unexpired(now) & uses_remain())


def can_check(now: str) -> Column:
    return F.col("is_admin") | (~F.col("is_blocked") & unexpired(now))


def counted_with_access(now: str) -> Column:
    """As the statistics count it: no bypass for admins."""
    return ~F.col("is_blocked") & unexpired(now) & uses_remain()


def recipients(users: DataFrame, now: str, active_only: bool) -> DataFrame:
    return (users.where(~F.col("is_blocked") & unexpired(now)) if active_only else users).select("telegram_id")


def gate(action: Column, has_session: Column, now: str) -> Column:
    """Whether an action is denied: checks need only access in time, an active session lets a multi action pass."""
    return F.when(action == "check", ~can_check(now)).when((action == "multi") & has_session, False).when(action.isin("upload", "multi"), ~has_access(now)).otherwise(False)


def search(users: DataFrame, text: str) -> DataFrame:
    """Partial, case-blind match in user name or full name; wildcards in the text work as such."""
    own = text.strip().lstrip("@")
    if not own:
        return users.limit(0)
    like = f"%{own}%"
    return users.where(F.col("username").ilike(like) | F.col("full_name").ilike(like))


def find(users: DataFrame, ident: str) -> DataFrame:
    """By number, or by user name without regard to case."""
    own = ident.strip().lstrip("@")
    if own.lstrip("-").isdigit():
        return users.where(F.col("telegram_id") == int(own))
    return users.where(F.lower("username") == own.lower())


def tier(limit: Column, place: int) -> Column:
    """Ordinal of the highest tier whose quota the limit reaches; null below all."""
    out = F.lit(None).cast("int")
    for i, t in enumerate(TIERS):
        out = F.when(limit >= t[place], F.lit(i + 1)).otherwise(out)
    return out


def plan_of(variants: Column, checks: Column) -> Column:
    """The lower of both limits' tiers; without a tier of their own, checks follow the variants."""
    own = tier(variants, 1)
    ordinal = F.when(own.isNull(), F.lit(0)).otherwise(F.least(own, F.coalesce(tier(checks, 2), own)))
    return F.element_at(F.array(F.lit("free"), *[F.lit(t[0]) for t in TIERS]), ordinal + 1)


def plan_name(variants: Column, checks: Column) -> Column:
    plan = plan_of(variants, checks)
    base = F.lit(None).cast("int")
    for name, quota, _ in TIERS:
        base = F.when(plan == name, F.lit(quota)).otherwise(base)
    return F.when(variants > base, F.concat(plan, F.lit("+"), (variants - base).cast("string"))).otherwise(plan)


def period_over(now: str, days: int = PERIOD_DAYS) -> Column:
    return F.col("period_start").isNull() | (F.timestamp_diff("DAY", F.col("period_start"), instant(now)) >= days)


def remaining(limit: Column, used: Column, now: str, days: int = PERIOD_DAYS) -> Column:
    """What a quota still allows; an expired window reads as full, a null limit stays null."""
    return F.when(limit.isNull(), None).when(period_over(now, days), limit).otherwise(F.greatest(F.lit(0), limit - used))


def is_unlimited(uses: Column) -> Column:
    return uses.isNull()


def remaining_note(uses: Column) -> Column:
    return F.when(is_unlimited(uses), F.lit("unlimited")).otherwise(uses.cast("string"))


def days_left(until: Column, now: str) -> Column:
    """Whole days, never below 0; null where there is no end."""
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", instant(now), until) / 86400)).cast("int")


def with_trial(users: DataFrame, now: str) -> DataFrame:
    """Trial defaults of a new user."""
    return users.withColumns({"access_until": F.timestamp_add("DAY", F.lit(TRIAL_DAYS), instant(now)), "uses_left": F.lit(TRIAL_USES), "checks_limit": F.lit(TRIAL_CHECKS)})


def account_summary(users: DataFrame, now: str) -> DataFrame:
    return users.select(
        "telegram_id",
        plan_name(F.col("variants_limit"), F.col("checks_limit")).alias("plan_name"),
        remaining(F.col("variants_limit"), F.col("variants_used"), now).alias("variants_remaining"),
        remaining(F.col("checks_limit"), F.col("checks_used"), now).alias("checks_remaining"),
        days_left(F.col("access_until"), now).alias("days_left"),
        remaining_note(F.col("uses_left")).alias("uses_note"),
    )


def session_expired(created: Column, now: str) -> Column:
    return F.timestamp_add("HOUR", F.lit(SESSION_HOURS), created) <= instant(now)


def anchors(now: str) -> dict[str, Column]:
    """Starts of today, of the last seven and of the last thirty days."""
    return {"day": F.date_trunc("DAY", instant(now)).cast("timestamp_ntz"), "week": F.timestamp_add("DAY", F.lit(-7), instant(now)), "month": F.timestamp_add("DAY", F.lit(-30), instant(now))}


def parse_clock(text: Column) -> Column:
    """'14:30', '14.30', '9 am', '9:05 pm' as HH:MM; null where it is no time of day."""
    s = F.lower(F.trim(text))
    pattern = r"^([0-9]{1,2})(?:[:.]([0-9]{2}))?\s*(am|pm)?$"
    hour, minute, half = F.regexp_extract(s, pattern, 1).try_cast("int"), F.coalesce(F.regexp_extract(s, pattern, 2).try_cast("int"), F.lit(0)), F.regexp_extract(s, pattern, 3)
    bare = (half == "") & (F.regexp_extract(s, pattern, 2) == "")
    full = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).when(half == "am", hour % 12).otherwise(hour % 12 + 12)
    good = s.rlike(pattern) & ~bare & (full <= 23) & (minute <= 59)
    return F.when(good, F.concat(F.lpad(full.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def parse_minutes(text: Column) -> Column:
    """A positive number of minutes, or null."""
    n = F.when(F.trim(text).rlike(r"^[0-9]{1,6}$"), F.trim(text).try_cast("int"))
    return F.when(n > 0, n)


def combine_today(clock: Column, now: str, hours: int = UTC_OFFSET_HOURS) -> Column:
    """A wall clock of today, in the fixed offset, as UTC."""
    day = F.date_trunc("DAY", F.timestamp_add("HOUR", F.lit(hours), instant(now))).cast("timestamp_ntz")
    minutes = F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int") - hours * 60
    return F.timestamp_add("MINUTE", minutes, day)


def plan_jobs(exams: DataFrame, now: str, warn_minutes: int = 10) -> DataFrame:
    """A warning before and a notice at each exam's end, as far as these lie ahead."""
    end = F.col("exam_end_time")
    warn = F.timestamp_add("MINUTE", F.lit(-warn_minutes), end)
    jobs = F.array(F.struct(F.lit("warn").alias("kind"), warn.alias("run_at")), F.struct(F.lit("end").alias("kind"), end.alias("run_at")))
    ahead = F.filter(jobs, lambda j: j["run_at"] > instant(now))
    return exams.select("project_id", F.explode(F.when(end > instant(now), ahead)).alias("job")).select("project_id", "job.kind", "job.run_at")
