"""Grading: option letters, answer matching, the two scoring flows, overrides, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrade.operators.reports import grade_for, percent_half_even

#: Cyrillic letters that look like Latin option letters.
CYRILLIC, LATIN = "АВСДЕ", "ABCDE"
NUMBER = r"^[+-]?[0-9]+([.,][0-9]+)?$"
ASK_FROM = 0.40


def canonical_letter(text: Column) -> Column:
    return F.translate(F.upper(F.trim(text)), CYRILLIC, LATIN)


def is_option_letter(text: Column) -> Column:
    return canonical_letter(text).rlike(r"^[A-EБГ]$")


def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(x.split()).casefold())


def casefold_exact(text: Column) -> Column:
    """White space collapsed and full case folding, in Arrow batches; for scripts where lower case isn't enough."""
    return F.pandas_udf(_casefold, "string")(text)


def normalise(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def as_number(text: Column) -> Column:
    own = F.trim(text)
    return F.when(own.rlike(NUMBER), F.replace(own, F.lit(","), F.lit(".")).try_cast("decimal(38,18)"))


def matches(student: Column, accepted: Column) -> Column:
    """Equal as text, as option letter or as decimal number to any accepted answer."""
    s = normalise(student)

    def one(a):
        b = normalise(a)
        letters = (F.length(s) == 1) & (F.length(b) == 1) & (canonical_letter(s) == canonical_letter(b))
        return (s == b) | letters | F.coalesce(as_number(s) == as_number(b), F.lit(False))

    return F.coalesce((s != "") & F.exists(accepted, one), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def worth_asking(student: Column, accepted: Column) -> Column:
    """Of a wrong written answer: a number against a number always, else a close enough text."""
    s = normalise(student)
    numbers = as_number(s).isNotNull() & F.exists(accepted, lambda a: as_number(a).isNotNull())
    best = F.array_max(F.transform(accepted, lambda a: similarity(s, normalise(a))))
    return F.coalesce((s != "") & (numbers | (best >= ASK_FROM)), F.lit(False))


def accepted_list(value: Column) -> Column:
    """A scalar or null as a list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def graded(keys: DataFrame, answers: DataFrame) -> DataFrame:
    """A row each key position: the answer if there is one, whether it is right, and whether it was skipped."""
    rows = keys.join(answers, ["sheet_id", "position"], "left")
    skipped = F.col("student_answer").isNull() | (F.trim("student_answer") == "")
    right = ~skipped & matches(F.col("student_answer"), F.col("accepted"))
    return rows.withColumn("is_skipped", skipped).withColumn("is_correct", F.coalesce(right, F.lit(False)))


def score_sheet(rows: DataFrame) -> DataFrame:
    """Saved tests. The total runs to the last keyed position, holes counting; the raw percent is graded: total, correct, wrong, skipped, percent and grade over positions up to the last keyed one."""
    last = rows.groupBy("sheet_id").agg(F.max(F.when(F.col("accepted").isNotNull(), F.col("position"))).alias("last")).where("last IS NOT NULL")
    inside = rows.join(last, "sheet_id").where("position <= last")
    own = inside.groupBy("sheet_id").agg(F.max("last").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if("is_skipped").alias("blank"), F.count("*").alias("n"))
    skipped = F.col("blank") + F.col("total") - F.col("n")
    out = own.select("sheet_id", "total", "correct", (F.col("total") - F.col("correct") - skipped).alias("wrong"), skipped.alias("skipped"))
    return out.withColumn("percent", F.lit(100.0) * F.col("correct") / F.col("total")).withColumn("grade", grade_for(F.col("percent")))


def score_manual(rows: DataFrame) -> DataFrame:
    """Checks by hand: every key entry counts, unclear ones are listed apart and aren't wrong; the rounded percent is graded."""
    counted = rows.where(F.col("accepted").isNotNull())
    unclear = F.coalesce("is_unclear", F.lit(False))
    numbers = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("position")))), ",")
    right = F.col("is_correct") & ~unclear
    own = counted.groupBy("sheet_id").agg(F.count("*").alias("total"), F.count_if(right).alias("score"), numbers(~right & ~unclear).alias("wrong"), numbers(unclear).alias("unclear"))
    return own.withColumn("percent", percent_half_even(F.col("score"), F.col("total"))).withColumn("grade", grade_for(F.col("percent")))


def resolve_key(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """Checks entered answers against the questions: no such question, or a letter the question doesn't have; open questions take any text."""
    rows = parsed.join(labels, ["project_id", "question_number"], "left")
    bad = ~F.forall("accepted", lambda a: F.array_contains(F.transform("letters", lambda x: canonical_letter(x)), canonical_letter(a)))
    return rows.withColumn("reason", F.when(F.col("letters").isNull(), "no_question").when((F.size("letters") > 0) & bad, "bad_letter"))


def override(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """A teacher's ok makes the answer the first accepted one, a no empties it; then everything is graded again."""
    both = rows.drop("is_correct", "is_skipped").join(decisions, ["sheet_id", "position"], "left")
    answer = F.when(F.col("ok"), F.element_at("accepted", 1)).when(~F.col("ok"), None).otherwise(F.col("student_answer"))
    return both.withColumn("student_answer", F.when(F.col("ok").isNull(), F.col("student_answer")).otherwise(answer)).drop("ok")


def report_lines(rows: DataFrame) -> DataFrame:
    """A line a position: mark, number, answer, and the key where the answer is wrong."""
    mark = F.when(F.col("is_correct"), "+").when(F.col("is_skipped"), "o").otherwise("-")
    tail = F.when(F.col("is_correct") | F.col("accepted").isNull(), F.lit("")).otherwise(F.concat(F.lit(" ["), F.array_join("accepted", "/"), F.lit("]")))
    line = F.concat(mark, F.lit(" "), F.col("position").cast("string"), F.lit(": "), F.coalesce(F.trim("student_answer"), F.lit("")), tail)
    own = rows.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return own.select("sheet_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))
