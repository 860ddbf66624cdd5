"""Changes to snapshots: pure functions of a snapshot and an ordered command log.

Nothing is updated in place; each function returns the next version of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placeholders(users: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows for ids that have no user yet."""
    return asked.select("telegram_id").distinct().join(users, "telegram_id", "left_anti").select("telegram_id", F.lit(False).alias("is_blocked"), F.lit(None).cast("string").alias("username"))


def decrement_uses(users: DataFrame, charges: DataFrame) -> DataFrame:
    """Takes each user's charges off, never below 0; null stays null. ``granted`` counts the charges that found a use."""
    n = charges.groupBy("telegram_id").agg(F.count("*").alias("n"))
    rows = users.join(n, "telegram_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("telegram_id", F.when(F.col("uses_left").isNotNull(), F.greatest(F.lit(0), F.col("uses_left") - F.col("n"))).alias("uses_left"), F.when(F.col("uses_left").isNull(), 0).otherwise(F.least("uses_left", "n")).cast("long").alias("granted"))


def charge_sessions(events: DataFrame, session: str, order: str) -> DataFrame:
    """The first event of each session is the one that is charged."""
    w = Window.partitionBy(session).orderBy(order)
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first_charges(charges: DataFrame, order: str) -> DataFrame:
    """The first charge ever of each user."""
    return charges.groupBy("telegram_id").agg(F.min(order).alias(order))


def apply_commands(users: DataFrame, commands: DataFrame) -> DataFrame:
    """Folds admin commands, in order, over each user's row; every command leaves an audit row.

    Commands: grant (sets uses), add (adds to a limit, null stays unlimited), limit
    (sets a limit), block, unblock, reset (zeroes what was used).
    """
    log = commands.groupBy("telegram_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command", "amount"))).alias("log"))
    start = F.struct(F.col("uses_left").cast("int").alias("uses"), F.col("variants_limit").cast("int").alias("lim"), F.col("variants_used").cast("int").alias("used"), F.col("is_blocked").alias("blocked"))

    def step(s, c):
        kind, n = c["command"], c["amount"].cast("int")
        return F.struct(
            F.when(kind == "grant", n).otherwise(s["uses"]).alias("uses"),
            F.when(kind == "limit", n).when(kind == "add", s["lim"] + n).otherwise(s["lim"]).alias("lim"),
            F.when(kind == "reset", F.lit(0)).otherwise(s["used"]).alias("used"),
            F.when(kind == "block", True).when(kind == "unblock", False).otherwise(s["blocked"]).alias("blocked"),
        )

    rows = users.join(log, "telegram_id", "left")
    folded = rows.withColumn("after", F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, step)))
    return folded.select("telegram_id", F.col("after.uses").alias("uses_left"), F.col("after.lim").alias("variants_limit"), F.col("after.used").alias("variants_used"), F.col("after.blocked").alias("is_blocked"), F.coalesce(F.size("log"), F.lit(0)).alias("audit_rows"))


def upsert_users(users: DataFrame, seen: DataFrame, admins: list[int]) -> DataFrame:
    """Latest known identity of each user: new ones are added, changed names refreshed, listed admins promoted."""
    latest = seen.groupBy("telegram_id").agg(F.max_by("username", "event_id").alias("new_username"))
    both = users.select("telegram_id", "username", "is_admin").join(latest, "telegram_id", "full_outer")
    return both.select("telegram_id", F.coalesce("new_username", "username").alias("username"), (F.coalesce("is_admin", F.lit(False)) | F.col("telegram_id").isin(admins)).alias("is_admin"))


def reset_daily(users: DataFrame, today: str) -> DataFrame:
    """Zeroes the use of users whose last reset lies before today; those never reset stay."""
    due = F.to_date("period_start") < F.lit(today).cast("date")
    return users.select("telegram_id", F.when(due, 0).otherwise(F.col("variants_used")).alias("variants_used"), F.when(due, F.lit(today)).otherwise(F.to_date("period_start").cast("string")).alias("reset_on"))


def soft_delete(questions: DataFrame, wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """Marks wanted questions as deleted, in projects that have no variants yet."""
    free = wanted.join(variants.select("project_id").distinct(), "project_id", "left_anti").select("question_id", F.lit(True).alias("hit"))
    return questions.join(free, "question_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("hit", F.lit(False))).drop("hit")


def hard_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def cascade(projects: DataFrame, questions: DataFrame, variants: DataFrame, submissions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Deletes projects with their questions, variants and the variants' submissions."""
    p, q, v = (x.join(gone, "project_id", "left_anti") for x in (projects, questions, variants))
    return p, q, v, submissions.join(v.select("variant_id"), "variant_id", "left_semi")
