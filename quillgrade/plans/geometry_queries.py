"""Queries of the geometry family: JOI-11..14, WIN-08/09, AGG-17, DED-10, GEO, JSN-09."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrade.operators import geometry as G
from quillgrade.plans.registry import query
from quillgrade.plans.views import table, view, with_views

W = with_views("words").rstrip()
WR = with_views("words", "rects").rstrip()
_N = "TRY_CAST(regexp_extract(text, '^([0-9]{1,3})[.)]$', 1) AS INT)"
_ISM = "regexp_matches(text, '^([A-E])\\)$')"
_ISN = "regexp_matches(text, '^([0-9]{1,3})[.)]$')"
_PL = f", p AS (SELECT doc_id, page, {_N} AS number, min(y0) AS y FROM words WHERE {_N} IS NOT NULL GROUP BY ALL)"
_BA = _PL + ", b AS (SELECT p.doc_id, p.page, p.number, p.y, coalesce((SELECT min(q.y) FROM p q WHERE q.doc_id = p.doc_id AND q.page = p.page AND q.y > p.y + 5), 800.0) AS y_end FROM p)"


def _bands(spark, d):
    return G.bands(G.number_places(view(spark, d, "words")).drop("x"))


@query("win_08_bands", W + _BA + " SELECT * FROM b")
def win_08(spark, d):
    return _bands(spark, d)


@query("win_09_first_places", W + f" SELECT doc_id, number, m.page AS page, m.y0 AS y FROM (SELECT doc_id, {_N} AS number, min({{'page': page, 'y0': y0}}) AS m FROM words WHERE {_N} IS NOT NULL AND x0 <= 120 GROUP BY ALL) z")
def win_09(spark, d):
    return G.first_places(view(spark, d, "words"), 120.0)


@query(
    "joi_11_figures",
    WR + _BA + """, j AS (SELECT b.*, r.rect_id, (r.y0 + r.y1) / 2 AS mid, (r.x1 - r.x0) * (r.y1 - r.y0) AS a FROM b JOIN rects r USING (doc_id, page)),
k AS (SELECT *, mid >= y AND mid <= y_end AS inside, mid > y_end AND mid <= y + 1.5 * (y_end - y) AS below FROM j),
o AS (SELECT doc_id, page, number, first(rect_id ORDER BY a DESC, rect_id) FILTER (inside) AS own, first(rect_id ORDER BY mid - y_end, rect_id) FILTER (below) AS near FROM k WHERE inside OR below GROUP BY ALL)
SELECT doc_id, page, number, coalesce(own, near) AS rect_id, own IS NULL AS from_below FROM o""",
)
def joi_11(spark, d):
    return G.figures_in_bands(_bands(spark, d), view(spark, d, "rects"))


@query("joi_12_garbage", WR + f" SELECT rect_id, count(*) AS n_words, count(*) FILTER ({_ISM} OR {_ISN}) AS n_markers, count(*) FILTER ({_ISM} OR {_ISN}) >= 3 AS is_garbage FROM rects r JOIN (SELECT doc_id, page, (x0 + x1) / 2 AS wx, (y0 + y1) / 2 AS wy, text FROM words) w USING (doc_id, page) WHERE wx BETWEEN r.x0 AND r.x1 AND wy BETWEEN r.y0 AND r.y1 GROUP BY rect_id")
def joi_12(spark, d):
    return G.garbage(view(spark, d, "rects"), view(spark, d, "words"))


@query("joi_13_next_word", W + f" SELECT m.doc_id, m.page, m.text AS marker, m.x1 AS mx, m.y0 AS my, first(w.text ORDER BY w.x0, w.y0, w.text) AS follows FROM (SELECT * FROM words WHERE {_ISM}) m JOIN (SELECT * FROM words WHERE NOT {_ISM}) w ON w.doc_id = m.doc_id AND w.page = m.page AND abs(w.y0 - m.y0) <= 3 AND w.x0 >= m.x1 GROUP BY ALL")
def joi_13(spark, d):
    return G.next_word(view(spark, d, "words"))


_L = "l AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderkey % 7 AS l FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderkey % 5 AS r FROM orders WHERE o_orderstatus = 'O')"


@query("joi_14_zip", f"WITH {_L}, a AS (SELECT k, l, row_number() OVER (PARTITION BY k ORDER BY pos) AS i, count(*) OVER (PARTITION BY k) AS n FROM l), b AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY pos) AS i, count(*) OVER (PARTITION BY k) AS n FROM r) SELECT a.k, a.i, l, r FROM a JOIN b ON a.k = b.k AND a.i = b.i AND a.n = b.n")
def joi_14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), "o_orderstatus")
    left = o.where("o_orderstatus = 'F'").select("k", "pos", (F.col("pos") % 7).alias("l"))
    return G.zipped(left, o.where("o_orderstatus = 'O'").select("k", "pos", (F.col("pos") % 5).alias("r")), ["k"])


@query("agg_17_stroke_union", with_views("rects") + "SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS strokes FROM rects WHERE kind = 'stroke' GROUP BY doc_id, page HAVING max(x1) - min(x0) >= 40 AND max(y1) - min(y0) >= 40")
def agg_17(spark, d):
    return G.stroke_union(view(spark, d, "rects").where("kind = 'stroke'"), ["doc_id", "page"])


@query("ded_10_clusters")
def ded_10(spark, d):
    return G.clusters(view(spark, d, "rects"))


@query("geo_01_bitmaps", with_views("rects") + "SELECT doc_id, page, x0, y0, x1, y1 FROM rects WHERE kind = 'bitmap' AND x1 - x0 >= 50 AND y1 - y0 >= 50 AND (x1 - x0) * (y1 - y0) <= 0.6 * 480000")
def geo_01(spark, d):
    return G.candidates(view(spark, d, "rects"), 480000.0).where("kind = 'bitmap'").drop("kind")


@query(
    "geo_02_expand",
    WR + f""", u AS (SELECT DISTINCT * FROM rects), s AS (SELECT u.rect_id, min(w.y0) FILTER ({_ISM} AND w.y0 >= u.y0) AS stop FROM u LEFT JOIN words w USING (doc_id, page) GROUP BY u.rect_id),
j AS (SELECT u.doc_id, u.page, u.rect_id, u.y0, u.y1, w.y0 AS b, w.y1 AS e, coalesce(NOT {_ISM} AND NOT {_ISN} AND w.x0 >= u.x0 AND w.x1 <= u.x1 AND w.y0 >= u.y0 - 15 AND w.y1 <= coalesce(stop, 1e9) AND w.y1 <= u.y1 + 15, FALSE) AS label
  FROM u JOIN s USING (rect_id) LEFT JOIN words w USING (doc_id, page))
SELECT doc_id, page, rect_id, least(min(y0), min(b) FILTER (label)) AS y0, greatest(max(y1), max(e) FILTER (label)) AS y1, count(*) FILTER (label) AS labels FROM j GROUP BY ALL""",
)
def geo_02(spark, d):
    return G.expanded(view(spark, d, "rects").distinct(), view(spark, d, "words"))


_REGION = _BA + f", g AS (SELECT b.doc_id, b.page, number, min(w.y1) + 2 AS top, min(w.y0) FILTER ({_ISM}) AS bottom FROM b JOIN words w USING (doc_id, page) WHERE w.y0 >= b.y AND w.y0 < b.y_end GROUP BY ALL)"


@query("geo_03_region", W + _REGION + " SELECT * FROM g WHERE bottom - top >= 15")
def geo_03(spark, d):
    return G.stem_region(_bands(spark, d), view(spark, d, "words"))


@query("geo_04_ladder", W + _REGION + " SELECT b.doc_id, b.page, b.number, CASE WHEN number % 3 = 0 THEN 'raster' WHEN number % 3 = 1 AND y > 100 THEN 'strokes' WHEN g.bottom - g.top >= 15 THEN 'region' END AS strategy FROM b LEFT JOIN g USING (doc_id, page, number)")
def geo_04(spark, d):
    band = _bands(spark, d)
    rows = band.join(G.stem_region(band, view(spark, d, "words")), ["doc_id", "page", "number"], "left")
    steps = G.ladder((F.col("number") % 3 == 0, F.lit("raster")), ((F.col("number") % 3 == 1) & (F.col("y") > 100), F.lit("strokes")), (F.col("top").isNotNull(), F.lit("region")))
    return rows.select("doc_id", "page", "number", steps.alias("strategy"))


@query("geo_05_page_infos", with_views("page_items").rstrip() + ", k AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS source_page, length(text) AS text_len, turn % 2 = 0 AS has_visual FROM conversations WHERE role = 'user') SELECT p.doc_id, page_number, coalesce(text_len, 999) AS text_len, coalesce(has_visual, TRUE) AS has_visual FROM (SELECT DISTINCT doc_id, page_number FROM page_items) p LEFT JOIN k ON k.doc_id = p.doc_id AND k.source_page = p.page_number")
def geo_05(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    known = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("source_page"), F.length("text").alias("text_len"), (F.col("turn") % 2 == 0).alias("has_visual"))
    pages = view(spark, d, "page_items").select("doc_id", "page_number", F.col("page_number").alias("source_page")).distinct()
    return G.page_infos(pages, known)


@query("geo_06_stale_crops", "SELECT event_id FROM events WHERE event_type = 'click' AND epoch_us(TIMESTAMP '2024-01-16 12:00:00') - epoch_us(ts) > 3600999999")
def geo_06(spark, d):
    from quillgrade.sources import files

    f = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_type") == "click", "debug_").otherwise("crop_"), F.col("event_id").cast("string")).alias("name"), F.col("ts").alias("modified"))
    return files.stale(f, "2024-01-16 12:00:00").select("event_id")


@query(
    "jsn_09_label_recovery",
    with_views("questions").rstrip() + """, q AS (SELECT question_id, part_id, option_b IS NOT NULL AS full_set FROM questions WHERE option_a IS NOT NULL),
o AS (SELECT question_id, part_id, unnest(CASE WHEN full_set THEN [1, 2, 3, 4] ELSE [1] END) AS i FROM q),
m AS (SELECT question_id, unnest(CASE WHEN part_id % 4 = 0 THEN [1, 2] ELSE [1, 2, 3, 4] END) AS i, part_id FROM q),
l AS (SELECT question_id, i, CASE WHEN part_id % 5 = 0 THEN 'A' ELSE substr('ABDE', i, 1) END AS label FROM m),
c AS (SELECT question_id, (SELECT count(*) FROM o WHERE o.question_id = q.question_id) = (SELECT count(*) FROM l WHERE l.question_id = q.question_id) AND (SELECT count(DISTINCT label) = count(*) FROM l WHERE l.question_id = q.question_id) AS sound FROM q)
SELECT o.question_id, o.i, coalesce(CASE WHEN sound THEN label END, substr('ABCD', o.i, 1)) AS letter, NOT sound AS label_doubt FROM o JOIN c USING (question_id) LEFT JOIN l ON l.question_id = o.question_id AND l.i = o.i""",
)
def jsn_09(spark, d):
    q = view(spark, d, "questions").where("option_a IS NOT NULL")
    four = F.sequence(F.lit(1), F.lit(4))
    options = q.select("question_id", F.explode(F.when(F.col("option_b").isNotNull(), four).otherwise(F.array(F.lit(1)))).alias("pos")).withColumn("letter", F.substring(F.lit("ABCD"), F.col("pos"), F.lit(1)))
    marks = q.select("question_id", "part_id", F.explode(F.when(F.col("part_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(four)).alias("pos"))
    marks = marks.select("question_id", "pos", F.when(F.col("part_id") % 5 == 0, "A").otherwise(F.substring(F.lit("ABDE"), F.col("pos"), F.lit(1))).alias("label"))
    return G.recover_labels(options, marks, ["question_id"])
