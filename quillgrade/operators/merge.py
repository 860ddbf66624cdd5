"""Sequence operators over extracted pages: sections, gaps, fragments, merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESTART_UPTO, RESTART_DROP = 3, 5
INTERLEAVED_FROM = 3
CONFIDENT_FROM = 4
CHUNK = 8
WINDOW_PAGES = 2


def sections(items: DataFrame) -> DataFrame:
    """Numbered items with their section: a new one starts where the number falls and a title stands, or falls far back to the start."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    rows = items.where("question_number <> 0").withColumn("before", F.lag("question_number").over(order))
    fell = F.col("question_number") < F.col("before")
    restart = fell & (F.col("section_title").isNotNull() | ((F.col("question_number") <= RESTART_UPTO) & (F.col("before") - F.col("question_number") >= RESTART_DROP)))
    rows = rows.withColumn("restart", F.coalesce(restart, F.lit(False))).withColumn("inversion", F.coalesce(fell & ~F.col("restart"), F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.lit(1) + F.sum(F.col("restart").cast("int")).over(upto)).drop("before")


def interleaved_pages(rows: DataFrame) -> DataFrame:
    """Pages on which the numbers fall back too often to be in reading order."""
    return rows.groupBy("doc_id", "page_number").agg(F.count_if("inversion").alias("inversions")).where(F.col("inversions") >= INTERLEAVED_FROM)


def section_summary(rows: DataFrame) -> DataFrame:
    """Count, highest number, first title and missing numbers of each section."""
    order = F.struct("page_number", "pos")
    own = rows.groupBy("doc_id", "section").agg(
        F.count("*").alias("n"), F.max("question_number").alias("highest"), F.min_by("section_title", F.when(F.col("section_title").isNotNull(), order)).alias("title"), F.collect_set("question_number").alias("present")
    )
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("highest")), "present"))
    return own.select("doc_id", "section", "n", "highest", "title", F.array_join(gaps, ",").alias("gaps"))


def confident(summary: DataFrame) -> DataFrame:
    """Whether a document's sections can be trusted: several, and none of them small."""
    return summary.groupBy("doc_id").agg(((F.count("*") > 1) & (F.min("n") >= CONFIDENT_FROM)).alias("confident"))


def gap_numbers(rows: DataFrame, by: list[str]) -> DataFrame:
    own = rows.groupBy(*by).agg(F.max("question_number").alias("highest"), F.collect_set("question_number").alias("present"))
    return own.select(*by, F.explode(F.array_except(F.sequence(F.lit(1), "highest"), "present")).alias("missing"))


def chunked(rows: DataFrame, by: list[str], order: str, size: int = CHUNK) -> DataFrame:
    """Numbers the runs of ``size`` rows in each group."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(at / size).cast("int"))


def gap_windows(rows: DataFrame) -> DataFrame:
    """For each missing number the pages of the nearest numbers below and above, two pages at most."""
    pages = rows.groupBy("doc_id", "question_number").agg(F.min("page_number").alias("page"))
    span = rows.groupBy("doc_id").agg(F.explode(F.sequence(F.lit(1), F.max("question_number"))).alias("question_number"))
    every = span.join(pages, ["doc_id", "question_number"], "left")
    w = Window.partitionBy("doc_id").orderBy("question_number")
    below = F.last("page", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("page", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = every.withColumn("below", below).withColumn("above", above).where("page IS NULL")
    low = F.coalesce("below", "above")
    high = F.greatest(low, F.least(F.coalesce("above", "below"), low + WINDOW_PAGES - 1))
    return out.select("doc_id", F.col("question_number").alias("missing"), low.alias("first_page"), high.alias("last_page"))


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """One question for each key: the first occurrence, its blank options and its missing image filled from later ones."""
    order = F.struct("page_number", "pos")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    options = [F.coalesce(F.min_by(c, F.when(~blank(c), order)), F.min_by(c, order)).alias(c) for c in ("option_a", "option_b")]
    return rows.where("question_number <> 0").groupBy(*by).agg(
        F.min_by("question_text", order).alias("question_text"), *options, F.bool_or("has_image").alias("has_image"),
        F.min_by("page_number", F.when(F.col("has_image"), order)).alias("image_page"), F.count("*").alias("occurrences"),
    ).withColumn("is_open_ended", blank("option_a") & blank("option_b"))


def stitched(rows: DataFrame) -> DataFrame:
    """Appends fragments that open a page to the last numbered question of the page before; orphans go.

    Fills the target's blank options first; the text follows where options were filled or the target has fewer than four.
    """
    schema = "doc_id long, page_number int, pos int, question_number int, question_text string, options array<string>"

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_number", "pos"], kind="stable").reset_index(drop=True)
        last: dict[int, int] = {}
        gone = []
        opened: set[int] = set()
        rows_ = pdf.to_dict("records")
        for i, r in enumerate(rows_):
            if r["question_number"]:
                last[r["page_number"]] = i
                opened.add(r["page_number"])
                continue
            gone.append(i)
            target = last.get(r["page_number"] - 1)
            if r["page_number"] in opened or target is None:
                continue
            t = rows_[target]
            own, new = list(t["options"]), list(r["options"])
            had = sum(bool(o) for o in own)
            filled = [n if not (i < len(own) and own[i]) else own[i] for i, n in enumerate(new)] + own[len(new) :]
            took = sum(bool(o) for o in filled) > had
            t["options"] = filled
            if r["question_text"] and (took or had < 4):
                t["question_text"] = f"{t['question_text']} {r['question_text']}"
        kept = [r for i, r in enumerate(rows_) if i not in set(gone)]
        return pd.DataFrame(kept, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("doc_id").applyInPandas(stitch, schema)


def flagged_chunks(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """Flagged numbers whose page is known, in chunks for another extraction."""
    return chunked(flags.join(pages, ["doc_id", "question_number"]), ["doc_id", "page"], "question_number")


def continuation(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a continued page whose number isn't known yet; unnumbered ones always stay."""
    own = ["doc_id", "question_number"]
    return rows.where("question_number <> 0").join(known.select(*own), own, "left_anti").unionByName(rows.where("question_number = 0 OR question_number IS NULL"))


def runs(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Stretches of consecutive flagged rows: first and last place, and length."""
    w = Window.partitionBy(*by).orderBy(order)
    placed = rows.withColumn("i", F.row_number().over(w)).where(F.col(flag))
    island = placed.withColumn("island", F.col("i") - F.row_number().over(w))
    return island.groupBy(*by, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).drop("island")


def final_order(rows: DataFrame) -> DataFrame:
    """Place of each question of a document: by section, then number."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "question_number", "page_number", "pos")))
