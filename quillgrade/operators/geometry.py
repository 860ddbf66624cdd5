"""Layout geometry as relations over page words and rectangles.

Every range join carries the page as an equi-join prefix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
NUMBER = r"^([0-9]{1,3})[.)]$"
MARKER = r"^([A-E])\)$"
PAGE_BOTTOM = 800.0
BELOW = 1.5
CLUSTER_GAP = 20.0
GARBAGE_MARKERS = 3


def number_places(words: DataFrame) -> DataFrame:
    """Where each question number stands on its page: the topmost occurrence."""
    n = F.regexp_extract("text", NUMBER, 1)
    rows = words.withColumn("number", n.try_cast("int")).where("number IS NOT NULL")
    return rows.groupBy(*PAGE, "number").agg(F.min("y0").alias("y"), F.min_by("x0", F.struct("y0", "x0")).alias("x"))


def bands(places: DataFrame, tolerance: float = 5.0, bottom: float = PAGE_BOTTOM) -> DataFrame:
    """From a number down to the next one that lies clearly below, or the page's end."""
    w = Window.partitionBy(*PAGE).orderBy("y").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = F.array_sort(F.collect_list("y").over(w))
    next_y = F.get(F.filter(later, lambda y: y > F.col("y") + tolerance), F.lit(0))
    return places.withColumn("y_end", F.coalesce(next_y, F.lit(bottom)))


def first_places(words: DataFrame, margin: float) -> DataFrame:
    """The first page and height at which a number stands near the left margin."""
    n = F.regexp_extract("text", NUMBER, 1).try_cast("int")
    rows = words.withColumn("number", n).where(F.col("number").isNotNull() & (F.col("x0") <= margin))
    return rows.groupBy("doc_id", "number").agg(F.min(F.struct("page", "y0")).alias("at")).select("doc_id", "number", "at.page", F.col("at.y0").alias("y"))


def area(prefix: str = "") -> Column:
    c = lambda k: F.col(prefix + k)
    return (c("x1") - c("x0")) * (c("y1") - c("y0"))


def figures_in_bands(band: DataFrame, rects: DataFrame) -> DataFrame:
    """The figure of each question: the largest whose centre lies in the band, else the nearest within half a band below."""
    middle = (F.col("y0") + F.col("y1")) / 2
    both = band.join(rects, PAGE).withColumn("mid", middle).withColumn("height", F.col("y_end") - F.col("y"))
    inside = (F.col("mid") >= F.col("y")) & (F.col("mid") <= F.col("y_end"))
    below = (F.col("mid") > F.col("y_end")) & (F.col("mid") <= F.col("y") + BELOW * F.col("height"))
    best = both.where(inside | below).groupBy(*PAGE, "number").agg(
        F.max_by("rect_id", F.when(inside, F.struct(area().alias("a"), (-F.col("rect_id")).alias("r")))).alias("own"),
        F.min_by("rect_id", F.when(below, F.struct((F.col("mid") - F.col("y_end")).alias("g"), F.col("rect_id").alias("r")))).alias("near"),
    )
    return best.select(*PAGE, "number", F.coalesce("own", "near").alias("rect_id"), F.col("own").isNull().alias("from_below"))


def words_in(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a rectangle and a word whose centre lies in it."""
    w = words.select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("wx"), ((F.col("y0") + F.col("y1")) / 2).alias("wy"), "text")
    return rects.join(w, PAGE).where("wx >= x0 AND wx <= x1 AND wy >= y0 AND wy <= y1")


def garbage(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Crops that hold option markers or question numbers instead of a figure."""
    own = words_in(rects, words).groupBy("rect_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("text").rlike(MARKER) | F.col("text").rlike(NUMBER)).alias("n_markers"))
    return own.withColumn("is_garbage", F.col("n_markers") >= GARBAGE_MARKERS)


def next_word(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """For each marker the nearest word to its right on the same line."""
    marks = words.where(F.col("text").rlike(MARKER)).select(*PAGE, F.col("x1").alias("mx"), F.col("y0").alias("my"), F.col("text").alias("marker"))
    other = words.where(~F.col("text").rlike(MARKER))
    both = marks.join(other, PAGE).where((F.abs(F.col("y0") - F.col("my")) <= tolerance) & (F.col("x0") >= F.col("mx")))
    return both.groupBy(*PAGE, "marker", "mx", "my").agg(F.min_by("text", F.struct("x0", "y0", "text")).alias("follows"))


def stroke_union(rects: DataFrame, by: list[str], least: float = 40.0) -> DataFrame:
    """The box around a question's strokes, where it is large enough."""
    box = rects.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("strokes"))
    return box.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def zipped(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of the i-th rows of two ordered lists, only where both are equally long. Columns: by, pos, and l or r."""
    w, n = Window.partitionBy(*by).orderBy("pos"), Window.partitionBy(*by)
    a = left.withColumn("i", F.row_number().over(w)).withColumn("n_left", F.count("*").over(n)).drop("pos")
    b = right.withColumn("i", F.row_number().over(w)).withColumn("n_right", F.count("*").over(n)).drop("pos")
    return a.join(b, [*by, "i"]).where("n_left = n_right").drop("n_left", "n_right")


def clusters(rects: DataFrame, gap: float = CLUSTER_GAP) -> DataFrame:
    """Boxes of rectangles that come within the gap of the box grown so far, page by page."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [list(b) for b in pdf.sort_values(["y0", "x0", "rect_id"], kind="stable")[["x0", "y0", "x1", "y1"]].to_numpy()]
        counts = [1] * len(boxes)
        moved = True
        while moved:
            moved = False
            kept: list[list[float]] = []
            sizes: list[int] = []
            for b, n in zip(boxes, counts):
                for i, k in enumerate(kept):
                    if b[0] <= k[2] + gap and b[2] >= k[0] - gap and b[1] <= k[3] + gap and b[3] >= k[1] - gap:
                        kept[i] = [min(k[0], b[0]), min(k[1], b[1]), max(k[2], b[2]), max(k[3], b[3])]
                        sizes[i] += n
                        moved = True
                        break
                else:
                    kept.append(b)
                    sizes.append(n)
            boxes, counts = kept, sizes
        out = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1"])
        out["n"], out["doc_id"], out["page"] = counts, pdf["doc_id"].iloc[0], pdf["page"].iloc[0]
        return out[["doc_id", "page", "x0", "y0", "x1", "y1", "n"]]

    return rects.groupBy(*PAGE).applyInPandas(grow, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, n int")


def candidates(rects: DataFrame, page_area: float) -> DataFrame:
    """Bitmaps of some size that don't fill the page, and stroke clusters of some size."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bitmaps = rects.where((F.col("kind") == "bitmap") & (w >= 50) & (h >= 50) & (w * h <= 0.6 * page_area))
    strokes = clusters(rects.where("kind = 'stroke'")).where((w > 40) & (h > 40))
    return bitmaps.select(*PAGE, "x0", "y0", "x1", "y1", F.lit("bitmap").alias("kind")).unionByName(strokes.select(*PAGE, "x0", "y0", "x1", "y1", F.lit("stroke").alias("kind")))


def expanded(rects: DataFrame, words: DataFrame, reach: float = 15.0) -> DataFrame:
    """Figures grown by the labels around them, above the first option marker below their top; markers and numbers don't count."""
    w = words.select(*PAGE, F.col("x0").alias("a"), F.col("y0").alias("b"), F.col("x1").alias("c"), F.col("y1").alias("e"), "text")
    both = rects.join(w, PAGE, "left")
    mark = F.col("text").rlike(MARKER)
    stop = both.groupBy("rect_id").agg(F.min(F.when(mark & (F.col("b") >= F.col("y0")), F.col("b"))).alias("stop"))
    both = both.join(stop, "rect_id")
    label = ~mark & ~F.col("text").rlike(NUMBER) & (F.col("a") >= F.col("x0")) & (F.col("c") <= F.col("x1"))
    label = label & (F.col("b") >= F.col("y0") - reach) & (F.col("e") <= F.coalesce("stop", F.lit(1e9))) & (F.col("e") <= F.col("y1") + reach)
    grown = both.groupBy(*PAGE, "rect_id").agg(
        F.least(F.min("y0"), F.min(F.when(label, F.col("b")))).alias("y0"), F.greatest(F.max("y1"), F.max(F.when(label, F.col("e")))).alias("y1"), F.count_if(label).alias("labels")
    )
    return grown


def stem_region(band: DataFrame, words: DataFrame, least: float = 15.0) -> DataFrame:
    """Between the first line of a stem and its first option marker, where that leaves room."""
    w = words.select(*PAGE, F.col("y0").alias("b"), F.col("y1").alias("e"), "text")
    both = band.join(w, PAGE).where("b >= y AND b < y_end")
    top, bottom = F.min("e") + 2, F.min(F.when(F.col("text").rlike(MARKER), F.col("b")))
    own = both.groupBy(*PAGE, "number").agg(top.alias("top"), bottom.alias("bottom"))
    return own.where(F.col("bottom") - F.col("top") >= least)


def ladder(*steps: tuple[Column, Column]) -> Column:
    """The first candidate that passes its own test."""
    return F.coalesce(*[F.when(good, value) for good, value in steps])


def page_infos(pages: DataFrame, known: DataFrame) -> DataFrame:
    """What is known of each page's source; unknown pages count as full of text with a figure."""
    rows = pages.join(known, ["doc_id", "source_page"], "left")
    return rows.select("doc_id", "page_number", F.coalesce("text_len", F.lit(999)).alias("text_len"), F.coalesce("has_visual", F.lit(True)).alias("has_visual"))


def recover_labels(options: DataFrame, markers: DataFrame, by: list[str]) -> DataFrame:
    """Printed labels instead of read ones, position by position, where counts agree and the labels are distinct; else a doubt flag."""
    pairs = zipped(options, markers, by)
    distinct = pairs.groupBy(*by).agg((F.count_distinct("label") == F.count("*")).alias("sound"))
    own = options.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    good = pairs.join(distinct.where("sound"), by).select(*by, "i", "label")
    return own.join(good, [*by, "i"], "left").select(*by, "i", F.coalesce("label", "letter").alias("letter"), F.col("label").isNull().alias("label_doubt"))
