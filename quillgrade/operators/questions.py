"""Question tables: validation, fallbacks, live views, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGES = 20


def filled(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def filled_options(options: Column) -> Column:
    return F.filter(F.coalesce(options, F.array().cast("array<struct<letter:string,text:string>>")), lambda o: filled(o["text"]))


def is_open_ended(options: Column) -> Column:
    return F.size(filled_options(options)) == 0


def live(questions: DataFrame) -> DataFrame:
    """The one view that every read of questions goes through."""
    return questions.where(~F.col("is_deleted"))


def options_of(options: Column, *legacy: Column) -> Column:
    """The options array, or what older rows hold in a column for each letter."""
    old = F.array(*[F.struct(F.lit(letter).alias("letter"), c.alias("text")) for letter, c in zip("ABCDE", legacy)])
    return F.when(F.size(F.coalesce(options, F.array().cast("array<struct<letter:string,text:string>>"))) > 0, filled_options(options)).otherwise(filled_options(old))


def accepted_of(answers: Column, single: Column) -> Column:
    """The accepted answers as an array, whichever generation of columns holds them."""
    return F.when(F.size(answers) > 0, answers).when(filled(single), F.array(single)).otherwise(F.array().cast("array<string>"))


def option_text(options: Column, letter: Column) -> Column:
    return F.element_at(F.transform(F.filter(options, lambda o: o["letter"] == letter), lambda o: o["text"]), 1)


def reject_reason(text: Column, options: Column, correct: Column) -> Column:
    """Why a question can't be used, or null; the first reason counts."""
    n = F.size(filled_options(options))
    blank_correct = F.exists(F.coalesce(options, F.array().cast("array<struct<letter:string,text:string>>")), lambda o: (o["letter"] == correct) & ~filled(o["text"]))
    return F.when(~filled(text), "empty_text").when(n == 1, "single_option").when((n > 0) & F.coalesce(blank_correct, F.lit(False)), "blank_correct_option")


def validate(questions: DataFrame) -> DataFrame:
    """Adds the reject reason and keeps only filled options, in their order."""
    reason = reject_reason(F.col("question_text"), F.col("options"), F.col("correct_answer"))
    return questions.withColumn("reason", reason).withColumn("options", filled_options(F.col("options")))


def first_pages(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    return pages.where(F.col("page_number") <= most)


def page_text(blocks: DataFrame) -> DataFrame:
    """Each page's text, blocks in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def split_columns(pages: DataFrame) -> DataFrame:
    """Renumbers pages in reading order, left half before right where a page has a split."""
    halves = pages.withColumn("half", F.explode(F.when(F.col("split_frac").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    w = Window.partitionBy("doc_id").orderBy("page_number", "half")
    return halves.withColumn("new_page", F.row_number().over(w))


def blank_page(text_len: Column, white: Column, has_figure: Column) -> Column:
    """Pages that aren't worth a paid look."""
    return ~has_figure & ((text_len < 100) | (white > 0.90))


def sniff(head: Column, path: Column) -> Column:
    """File kind by its first bytes, else by its extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_head = F.when(F.substring(head, 1, 4) == F.lit(b"%PDF"), "pdf").when(F.substring(head, 1, 2) == F.lit(b"PK"), "docx").when(F.substring(head, 1, 3) == F.lit(b"\xff\xd8\xff"), "image")
    return F.coalesce(by_head, F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin("jpg", "jpeg", "png"), "image").otherwise("unknown"))


def to_persist(questions: DataFrame) -> DataFrame:
    """What is stored of each question, with its project's final status and count."""
    own = questions.withColumn("options", filled_options(F.col("options")))
    n = own.groupBy("project_id").agg(F.count("*").alias("total_questions")).withColumn("status", F.lit("completed"))
    return own.join(n, "project_id")


def accept_recovered(found: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Recovered questions that were asked for, aren't known yet, have a text, and have no single option; the first of each number."""
    own = ["doc_id", "question_number"]
    good = found.where(filled(F.col("question_text")) & (F.col("n_options") != 1)).join(wanted, own, "left_semi").join(known, own, "left_anti")
    w = Window.partitionBy(*own).orderBy("pos")
    return good.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def replace_unique(questions: DataFrame, again: DataFrame) -> DataFrame:
    """Takes re-extracted texts over where the number is unique in its document."""
    n = Window.partitionBy("doc_id", "question_number")
    rows = questions.withColumn("n", F.count("*").over(n)).join(again.select("doc_id", "question_number", F.col("question_text").alias("newer")), ["doc_id", "question_number"], "left")
    return rows.withColumn("question_text", F.when(F.col("n") == 1, F.coalesce("newer", "question_text")).otherwise(F.col("question_text"))).drop("n", "newer")
