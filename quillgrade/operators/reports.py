"""Statistics, usage cost, group results, rankings and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Model prices in US cents per million tokens, and local currency per USD.
CENTS_IN, CENTS_OUT, RATE = 30, 250, 12_000.0
GRADES = (5, 4, 3, 2)
REUSE_SHOWN = 20
WARNINGS_SHOWN = 12


def thinking(prompt: Column, output: Column, said: Column, total: Column) -> Column:
    """Thinking tokens as reported, else what the total has beyond prompt and output, if anything."""
    rest = total - prompt - output
    return F.coalesce(said, F.when(rest > 0, rest), F.lit(0)).cast("long")


def cost(prompt: Column, billed: Column, rate: float = 1.0) -> Column:
    """In USD times ``rate``; whole cents per million tokens are summed first, so that equal counts give equal doubles."""
    return (prompt * CENTS_IN + billed * CENTS_OUT).cast("double") * rate / 1e8


def usage_summary(usage: DataFrame, since: str, by: str | None = None, rate: float = RATE) -> DataFrame:
    """Calls, tokens and cost since an instant; thinking is billed as output, no rows give zeros."""
    rows = usage.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    billed = F.col("output_tokens") + thinking(F.col("prompt_tokens"), F.col("output_tokens"), F.col("thinking_tokens"), F.col("total_tokens"))
    groups = rows.groupBy(by) if by else rows.groupBy()
    out = groups.agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum(billed), F.lit(0)).alias("billed_output"))
    own = F.col("prompt"), F.col("billed_output")
    return out.withColumn("usd", cost(*own)).withColumn("local_cost", cost(*own, rate))


def grade_for(percent: Column) -> Column:
    return F.when(percent >= 86, 5).when(percent >= 71, 4).when(percent >= 56, 3).otherwise(2)


def percent_half_even(score: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(F.lit(100.0) * score / total, 0)).otherwise(0.0)


def group_result(runs: DataFrame, session: str = "session_id") -> DataFrame:
    """Mean score and percent of each session, with a full histogram of grades."""
    percent = F.lit(100.0) * F.col("score") / F.col("total")
    grade = grade_for(percent_half_even(F.col("score"), F.col("total")))
    counts = [F.count_if(grade == g).alias(f"grade_{g}") for g in GRADES]
    return runs.groupBy(session).agg(F.count("*").alias("sheets"), F.round(F.avg("score"), 4).alias("mean_score"), F.bround(F.avg(percent), 0).alias("mean_percent"), *counts)


def ranked(runs: DataFrame, session: str = "session_id") -> DataFrame:
    """Strict ranks: higher scores first, equal scores by arrival."""
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("score"), "idx")))


def row_label() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("(Variant "), F.col("variant").cast("string"), F.lit(")")), F.concat(F.lit("(Sheet "), F.col("idx").cast("string"), F.lit(")")))


def tsv(runs: DataFrame, session: str = "session_id") -> DataFrame:
    """A line for each run, label, score and grade, in rank order."""
    grade = grade_for(percent_half_even(F.col("score"), F.col("total")))
    lines = ranked(runs, session).select(session, "rank", F.concat_ws("\t", row_label(), F.concat_ws("/", "score", "total"), grade).alias("line"))
    return lines.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("report"))


def answer_key_lines(keys: DataFrame, by: str) -> DataFrame:
    """'N. answer' in numeric order of positions; alternatives joined, a dash where there is none."""
    told = F.when(F.size("accepted") > 0, F.array_join("accepted", " / ")).otherwise(F.lit("-"))
    line = F.concat(F.col("position").cast("string"), F.lit(". "), told)
    return keys.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("p"), line.alias("line")))), lambda x: x["line"]), "\n").alias("key_text"))


def pack_columns(widths: Column, room: int, gap: int = 0) -> Column:
    """The block of each column when they are set side by side as long as they fit."""
    kind = "struct<block:int,used:int,out:array<int>>"
    start = F.struct(F.lit(1).alias("block"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s, w):
        fits = (s["used"] == 0) | (s["used"] + gap + w <= room)
        block = F.when(fits, s["block"]).otherwise(s["block"] + 1)
        used = F.when(s["used"] == 0, w).when(fits, s["used"] + gap + w).otherwise(w)
        return F.struct(block.cast("int").alias("block"), used.cast("int").alias("used"), F.concat(s["out"], F.array(block.cast("int"))).alias("out"))

    return F.aggregate(widths, start, step, lambda s: s["out"])


def layout_columns(texts: Column, room: int) -> Column:
    """How many options share a row: all, else two, else one; the widest decides."""
    n, widest = F.size(texts), F.array_max(F.transform(texts, lambda t: F.length(t)))
    return F.when(n == 0, 0).when(widest * n <= room, n).when((n >= 2) & (widest * 2 <= room), 2).otherwise(1)


def reuse_stats(used: DataFrame, unit: str) -> DataFrame:
    """Highest use of a unit, how many are used more than once, and the first of these."""
    counts = used.groupBy(unit).agg(F.count("*").alias("n"))
    return counts.agg(
        F.max("n").alias("max_usage"),
        F.count_if(F.col("n") > 1).alias("reused"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col(unit)))), 1, REUSE_SHOWN), ",").alias("first_reused"),
    )


def predicted_reuse(variants: Column, per_variant: Column, pool: Column) -> Column:
    return F.when(pool > 0, F.ceil(variants * per_variant / pool)).otherwise(0).cast("long")


def white_ratio(histogram: Column) -> Column:
    """Share of the eight lightest of 256 bins."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(F.slice(histogram, 249, 8), F.lit(0).cast("long"), lambda a, x: a + x) / total).otherwise(0.0)
