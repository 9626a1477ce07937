"""Runs, lines, blocks, document text and wrapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import metrics
from pageloom.functions import text as tx
from pageloom.operators import bullets, doctext, layout, regions
from pageloom.plans.stage import staged
from pageloom.schemas import PAGE
from pageloom.sources import corpus, items, sinks
from workloads import views as v
from workloads.registry import query
from workloads.sql_views import FAMILY, glyph_wrap_sql, wrap_sql

RECT = ["x", "y", "w", "h"]


def style_cols():
    return [F.col("style.font_name").alias("font_name"), F.col("style.font_size_pt").alias("size"),
            F.col("style.bold").alias("bold"), F.col("style.italic").alias("italic")]


# --- sources -----------------------------------------------------------------

@query("scan_corpus", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_corpus(spark, sf):
    return corpus.scan_corpus(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("scan_filter", "SELECT doc_id, lang FROM documents WHERE n_chars > 100 AND lang = 'en'")
def scan_filter(spark, sf):
    """A filter and two columns, which reach the Parquet scan."""
    return corpus.scan_corpus(spark, sf, "documents").where("n_chars > 100 AND lang = 'en'").select("doc_id", "lang")


@query("page_geometry", """
SELECT doc_id, page_index, 612.0::DOUBLE AS width_pt, 792.0::DOUBLE AS height_pt,
       CAST((doc_id % 4) * 90 AS INTEGER) AS rotation, (doc_id % 3) * 4.0::DOUBLE AS box_x, (doc_id % 3) * 8.0::DOUBLE AS box_y
FROM v_page""")
def page_geometry(spark, sf):
    return v.pages(spark, sf).select(*PAGE, "width_pt", "height_pt", "rotation",
                                     F.col("box.x").alias("box_x"), F.col("box.y").alias("box_y"))


@query("media_type", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' END AS media_type
FROM documents""")
def media_type(spark, sf):
    head = F.element_at(F.array(*[F.lit(h) for h in ("89504E470D", "FFD8FFE0", "255044462D312E37", "47494638")]),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return v.table(spark, sf, "documents").select("doc_id", corpus.media_type(content).alias("media_type"))


@query("text_runs", """
SELECT doc_id, page_index, run_ord, text, x, y, w, h, font_name, size, bold, italic FROM v_run""")
def text_runs(spark, sf):
    return v.runs(spark, sf).select(*PAGE, "run_ord", "text", *RECT, *style_cols())


@query("item_runs", """
SELECT doc_id, page_index, run_ord, text, x, y, 1.5 * w AS w, 20.0::DOUBLE AS h, 2.0::DOUBLE AS size,
       regexp_matches(font_name, '(?i)bold|black|heavy|semibold|[6-9]00') AS bold
FROM v_run WHERE run_ord % 10 < 8""")
def item_runs(spark, sf):
    k = F.col("run_ord") % 10
    made = v.runs(spark, sf).select(
        *PAGE, F.col("run_ord").alias("item_ord"), F.when(k == 9, "  ").otherwise(F.col("text")).alias("text"),
        F.array(F.lit(1.5), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.col("x"), F.col("y")).alias("matrix"),
        F.when(k == 8, 0.0).otherwise(F.col("w") * 2.25).alias("width"), F.lit(40.0).alias("height"),
        F.col("style.font_name").alias("font_name"))
    made = made.withColumn("width", F.col("width") / 1.5).withColumn("height", F.col("height") / 2)
    return items.runs_from_items(made).select(*PAGE, "run_ord", "text", *RECT, F.col("style.font_size_pt").alias("size"),
                                              F.col("style.bold").alias("bold"))


# --- lines -------------------------------------------------------------------

@query("baseline_rows", "SELECT doc_id, page_index, run_ord, CAST(row_id AS BIGINT) AS row_id FROM v_row")
def baseline_rows(spark, sf):
    return layout.assign_rows(v.runs(spark, sf)).select(*PAGE, "run_ord", "row_id")


@query("baseline_rows_exact", "SELECT doc_id, page_index, run_ord, CAST(row_id AS BIGINT) AS row_id FROM v_row")
def baseline_rows_exact(spark, sf):
    return layout.assign_rows(v.runs(spark, sf), "exact").select(*PAGE, "run_ord", "row_id")


@query("column_segments", """
SELECT doc_id, page_index, run_ord, CAST(seg AS BIGINT) AS seg, CAST(seg_ord AS INTEGER) AS seg_ord, coalesce(spaced, false) AS space FROM v_placed""")
def column_segments(spark, sf):
    return layout.assign_lines(v.runs(spark, sf)).select(*PAGE, "run_ord", "seg", "seg_ord", "space")


@query("text_lines", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, text, x, y, w, h, round(baseline_y, 6) AS baseline_y,
       font_name, size, bold, italic, n_runs FROM v_line""")
def text_lines(spark, sf):
    return v.lines(spark, sf).select(*PAGE, "line_ord", "text", *RECT, F.round("baseline_y", 6).alias("baseline_y"),
                                     *style_cols(), "n_runs")


@query("reading_order", """
SELECT doc_id, page_index, first_run_ord, CAST(line_ord AS INTEGER) AS line_ord FROM v_line""")
def reading_order(spark, sf):
    return v.lines(spark, sf).select(*PAGE, "first_run_ord", "line_ord")


@query("line_segments", """
SELECT doc_id, page_index, run_ord, CAST(end_char - length(text) AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char
FROM (SELECT *, sum(length(text) + CASE WHEN spaced THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, page_index, row_id, seg ORDER BY seg_ord ROWS UNBOUNDED PRECEDING) AS end_char FROM v_placed)""")
def line_segments(spark, sf):
    return layout.line_segments(v.runs(spark, sf)).select(*PAGE, "run_ord", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


@query("page_text", "SELECT p.doc_id, p.page_index, coalesce(t.text, '') AS text, coalesce(t.n_lines, 0) AS n_lines "
                    "FROM v_page p LEFT JOIN v_page_text t USING (doc_id, page_index)")
def page_text(spark, sf):
    return doctext.page_text(v.lines(spark, sf), v.page_counts(spark, sf))


DOC_SQL = """
SELECT doc_id, n_pages, n_lines, length(whole) AS char_count,
       CASE WHEN length(whole) <= {0} THEN whole
            ELSE rtrim(left(whole, {0} - 23), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '[…document truncated…]' END AS "full"
FROM v_doc_text"""


@query("document_text", DOC_SQL.format(50000))
def document_text(spark, sf):
    return doctext.document_text(doctext.page_text(v.lines(spark, sf)))


@query("document_text_capped", DOC_SQL.format(600))
def document_text_capped(spark, sf):
    return doctext.document_text(doctext.page_text(v.lines(spark, sf)), max_chars=600, pages_per_part=2)


# --- paragraph blocks -----------------------------------------------------------

@query("block_lines_window", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, CAST(block_ord AS BIGINT) AS block_ord FROM v_window_line""")
def block_lines_window(spark, sf):
    return layout.assign_blocks(v.lines(spark, sf), mode="window").select(*PAGE, "line_ord", "block_ord")


@query("text_blocks", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, text, x, y, w, h, round(top_baseline_y, 6) AS top_baseline_y,
       round(line_height_pt, 6) AS line_height_pt, n_lines, font_name, size, bold, italic FROM v_block""")
def text_blocks(spark, sf):
    return v.blocks(spark, sf).select(*PAGE, "block_ord", "text", *RECT, F.round("top_baseline_y", 6).alias("top_baseline_y"),
                                      F.round("line_height_pt", 6).alias("line_height_pt"), "n_lines", *style_cols())


@query("spacing_median", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, round(earlier, 6) AS expected_gap
FROM (SELECT *, quantile_cont(g, 0.5) OVER (PARTITION BY doc_id, page_index, block_ord ORDER BY line_ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM (SELECT *, lag(baseline_y) OVER (PARTITION BY doc_id, page_index, block_ord ORDER BY line_ord) - baseline_y AS g FROM v_block_line))""")
def spacing_median(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy(*PAGE, "block_ord").orderBy("line_ord")
    gaps = v.block_lines(spark, sf, ["baseline_y"]).withColumn("g", F.lag("baseline_y").over(w) - F.col("baseline_y"))
    return gaps.select(*PAGE, "line_ord", F.round(F.expr("percentile(g, 0.5)").over(
        w.rowsBetween(W.unboundedPreceding, -1)), 6).alias("expected_gap"))


@query("block_lines_exact", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, CAST(block_ord AS BIGINT) AS block_ord FROM v_block_line""")
def block_lines_exact(spark, sf):
    return layout.assign_blocks(v.lines(spark, sf), mode="exact", keep=[])


GUIDES_SQL = """
SELECT doc_id, page_index, edge, unnest(list_reduce(list([pos] ORDER BY guide_ord),
  lambda a, b: CASE WHEN len(list_filter(a, lambda p: abs(p - b[1]) <= 1)) = 0 THEN list_concat(a, b) ELSE a END)) AS pos
FROM (
  SELECT doc_id, page_index, 'mid' AS edge, 306.0::DOUBLE AS pos, 0 AS guide_ord FROM v_page
  UNION ALL SELECT p.doc_id, p.page_index, 'min', coalesce(min(x), 0), 1 FROM v_page p LEFT JOIN v_block USING (doc_id, page_index) GROUP BY ALL
  UNION ALL SELECT p.doc_id, p.page_index, 'max', coalesce(max(x + w), 612), 2 FROM v_page p LEFT JOIN v_block USING (doc_id, page_index) GROUP BY ALL
  UNION ALL SELECT doc_id, page_index, 'min', x, block_ord * 3 FROM v_block
  UNION ALL SELECT doc_id, page_index, 'mid', x + w / 2, block_ord * 3 + 1 FROM v_block
  UNION ALL SELECT doc_id, page_index, 'max', x + w, block_ord * 3 + 2 FROM v_block)
GROUP BY doc_id, page_index, edge"""


def _block_rects(spark, sf):
    """The blocks' rectangles, staged: their texts and styles set no guide and are not written."""
    return staged(v.blocks(spark, sf).select(*PAGE, "block_ord", *RECT))


@query("page_guides", GUIDES_SQL)
def page_guides(spark, sf):
    return layout.page_guides(_block_rects(spark, sf), v.plain_pages(spark, sf)).select(*PAGE, "edge", "pos")


@query("page_guides_down", """
SELECT doc_id, page_index, edge, unnest(list_reduce(list([pos] ORDER BY guide_ord),
  lambda a, b: CASE WHEN len(list_filter(a, lambda p: abs(p - b[1]) <= 1)) = 0 THEN list_concat(a, b) ELSE a END)) AS pos
FROM (
  SELECT doc_id, page_index, 'mid' AS edge, 396.0::DOUBLE AS pos, 0 AS guide_ord FROM v_page
  UNION ALL SELECT doc_id, page_index, 'min', 792.0::DOUBLE - y - h, block_ord * 3 FROM v_block
  UNION ALL SELECT doc_id, page_index, 'mid', 792.0::DOUBLE - y - h + h / 2, block_ord * 3 + 1 FROM v_block
  UNION ALL SELECT doc_id, page_index, 'max', 792.0::DOUBLE - y - h + h, block_ord * 3 + 2 FROM v_block)
GROUP BY doc_id, page_index, edge""")
def page_guides_down(spark, sf):
    return layout.page_guides(_block_rects(spark, sf), v.plain_pages(spark, sf), axis="y").select(*PAGE, "edge", "pos")


@query("line_covers", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, round(x - p, 6) AS cover_x, round(y - q, 6) AS cover_y,
       round(w + 2 * p, 6) AS cover_w, round(h + 2 * q, 6) AS cover_h
FROM (SELECT *, greatest(0.75, 0.08 * size) AS p, greatest(1, 0.14 * size) AS q FROM v_line)""")
def line_covers(spark, sf):
    return layout.line_cover_rects(v.lines(spark, sf)).select(
        *PAGE, "line_ord", *[F.round(f"cover_{c}", 6).alias(f"cover_{c}") for c in RECT])


@query("block_covers", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, round(min(x - p), 6) AS cover_x, round(min(y - q), 6) AS cover_y,
       round(max(x + w + p) - min(x - p), 6) AS cover_w, round(max(y + h + q) - min(y - q), 6) AS cover_h
FROM (SELECT *, greatest(0.75, 0.08 * size) AS p, greatest(1, 0.14 * size) AS q FROM v_block_line) GROUP BY ALL""")
def block_covers(spark, sf):
    return layout.block_cover_rects(v.block_lines(spark, sf)).select(
        *PAGE, "block_ord", *[F.round(f"cover_{c}", 6).alias(f"cover_{c}") for c in RECT])


@query("block_line_height", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord,
       round(least(12 * 1.5, greatest(12 * 1.0, line_height_pt * (12 / greatest(1, size)))), 6) AS line_height,
       round(12 * 1.2::DOUBLE, 6) AS free_height FROM v_block""")
def block_line_height(spark, sf):
    size = F.lit(12.0)
    return v.blocks(spark, sf).select(
        *PAGE, "block_ord", F.round(tx.line_height(F.col("line_height_pt"), F.col("style.font_size_pt"), size), 6).alias("line_height"),
        F.round(tx.free_line_height(size), 6).alias("free_height"))


@query("hit_test", """
SELECT p.doc_id, p.page_index, p.point_id, q.run_ord, q.text
FROM (SELECT doc_id, page_index, run_ord AS point_id, x + w AS px, y AS py FROM v_run) p
JOIN v_run q ON p.doc_id = q.doc_id AND p.page_index = q.page_index AND p.px BETWEEN q.x AND q.x + q.w AND p.py BETWEEN q.y AND q.y + q.h
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page_index, p.point_id ORDER BY q.w * q.h, q.run_ord DESC) = 1""")
def hit_test(spark, sf):
    r = v.runs(spark, sf)
    points = r.select(*PAGE, F.col("run_ord").alias("point_id"), (F.col("x") + F.col("w")).alias("px"), F.col("y").alias("py"))
    return layout.hit_test(points, r).select(*PAGE, "point_id", "run_ord", "text")


@query("hit_test_misses", """
SELECT p.doc_id, p.page_index, p.point_id, q.run_ord
FROM (SELECT doc_id, page_index, run_ord AS point_id, CASE WHEN run_ord % 2 = 0 THEN x ELSE -50.0 END AS px, y + 1 AS py FROM v_run) p
LEFT JOIN v_run q ON p.doc_id = q.doc_id AND p.page_index = q.page_index AND p.px BETWEEN q.x AND q.x + q.w AND p.py BETWEEN q.y AND q.y + q.h
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page_index, p.point_id ORDER BY q.w * q.h, q.run_ord DESC) = 1""")
def hit_test_misses(spark, sf):
    """A point for every run; every other one lies left of the page, where no run is."""
    r = v.runs(spark, sf)
    points = r.select(*PAGE, F.col("run_ord").alias("point_id"), F.when(F.col("run_ord") % 2 == 0, F.col("x")).otherwise(-50.0).alias("px"), (F.col("y") + 1).alias("py"))
    return layout.hit_test(points, r).select(*PAGE, "point_id", "run_ord")


# --- regions and bullets ------------------------------------------------------------

@query("text_backed_regions", """
SELECT g.doc_id, g.page_index, g.region_id, count(t.text) > 0 AS has_text, coalesce(sum(length(t.text)), 0) > 160 AS paragraph,
       CAST(coalesce(sum(length(t.text)), 0) AS BIGINT) AS n_chars
FROM v_region g LEFT JOIN v_run t ON g.doc_id = t.doc_id AND g.page_index = t.page_index AND t.w * t.h > 0
 AND greatest(0, least(g.x + g.w, t.x + t.w) - greatest(g.x, t.x)) * greatest(0, least(g.y + g.h, t.y + t.h) - greatest(g.y, t.y)) / (t.w * t.h) >= 0.6
GROUP BY ALL""")
def text_backed_regions(spark, sf):
    return regions.text_backed_regions(v.regions(spark, sf), v.runs(spark, sf)).select(
        *PAGE, "region_id", "has_text", "paragraph", F.col("n_chars").cast("long"))


@query("marker_candidates", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, region_id, round(distance, 6) AS distance FROM v_candidate""")
def marker_candidates(spark, sf):
    return bullets.marker_candidates(v.block_lines(spark, sf), v.regions(spark, sf)).select(
        *PAGE, "line_ord", "region_id", F.round("distance", 6).alias("distance"))


def _markers(spark, sf):
    lines = staged(v.block_lines(spark, sf))
    return lines, staged(bullets.bullet_markers(lines, v.regions(spark, sf)))


@query("bullet_markers", "SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, region_id FROM v_marker")
def bullet_markers(spark, sf):
    return _markers(spark, sf)[1].select(*PAGE, "line_ord", "region_id")


@query("bullet_item_lines", """
SELECT doc_id, page_index, CAST(line_ord AS INTEGER) AS line_ord, item_ord FROM v_item_line""")
def bullet_item_lines(spark, sf):
    return bullets.bullet_items(*_markers(spark, sf)).select(*PAGE, "line_ord", "item_ord")


@query("bullet_items", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, item_ord, text, text_x, n_lines, round(baseline_y, 6) AS baseline_y FROM v_item""")
def bullet_items(spark, sf):
    return bullets.item_rollup(bullets.bullet_items(*_markers(spark, sf))).select(
        *PAGE, "block_ord", "item_ord", "text", "text_x", "n_lines", F.round("baseline_y", 6).alias("baseline_y"))


def _lists(spark, sf):
    lines, marks = _markers(spark, sf)
    return bullets.bullet_lists(lines, layout.blocks(lines), marks)


LIST_COLS = ["bullet_x", "text_x", "bullet_size_pt", "line_height_pt", "item_spacing_pt",
             *[f"{p}_{c}" for p in ("list", "cover") for c in RECT]]


@query("bullet_lists", "SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, n_items, n_lines, editor_text, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in LIST_COLS) + " FROM v_list")
def bullet_lists(spark, sf):
    return _lists(spark, sf).select(*PAGE, "block_ord", "n_items", "n_lines", "editor_text",
                                    *[F.round(c, 6).alias(c) for c in LIST_COLS])


@query("list_covers", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, round(cover_x - 0.8, 6) AS pad_x, round(cover_y - 0.8, 6) AS pad_y,
       round(cover_w + 1.6, 6) AS pad_w, round(cover_h + 1.6, 6) AS pad_h FROM v_list""")
def list_covers(spark, sf):
    return bullets.list_cover_rects(_lists(spark, sf)).select(
        *PAGE, "block_ord", *[F.round(f"pad_{c}", 6).alias(f"pad_{c}") for c in RECT])


@query("list_headings", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, string_agg(text, chr(10) ORDER BY line_ord) AS text, count(*) AS n_lines
FROM v_item_line JOIN v_list USING (doc_id, page_index, block_ord) WHERE item_ord = 0 GROUP BY ALL""".replace("text, chr", "v_item_line.text, chr"))
def list_headings(spark, sf):
    lines, marks = _markers(spark, sf)
    lists = staged(bullets.bullet_lists(lines, layout.blocks(lines), marks))
    return bullets.heading_blocks(lines, marks, lists).select(*PAGE, "block_ord", "text", "n_lines")


@query("owned_blocks", """
SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, l.n_items IS NOT NULL AS owned
FROM v_block LEFT JOIN (SELECT doc_id, page_index, block_ord, n_items FROM v_list) l USING (doc_id, page_index, block_ord)""")
def owned_blocks(spark, sf):
    lines, marks = _markers(spark, sf)
    rows = staged(layout.blocks(lines))
    lists = staged(bullets.bullet_lists(lines, rows, marks))
    part = lambda owned: bullets.owned_blocks(rows, lists, owned).select(*PAGE, "block_ord", F.lit(owned).alias("owned"))
    return part(True).unionByName(part(False))


@query("next_block_below", """
SELECT l.doc_id, l.page_index, CAST(l.block_ord AS BIGINT) AS block_ord, CAST(n.block_ord AS BIGINT) AS next_block_ord,
       round(greatest(0, l.cover_y + l.cover_h - coalesce(n.y + n.h, 0)), 6) AS available_height_pt
FROM v_list l LEFT JOIN v_block n ON n.doc_id = l.doc_id AND n.page_index = l.page_index AND n.block_ord <> l.block_ord
 AND n.y + n.h <= l.cover_y + 0.5
 AND greatest(0, least(l.list_x + l.list_w, n.x + n.w) - greatest(l.list_x, n.x)) >= greatest(2, 0.2 * least(l.list_w, n.w))
QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.page_index, l.block_ord ORDER BY n.y + n.h DESC NULLS LAST, n.block_ord) = 1""")
def next_block_below(spark, sf):
    lines, marks = _markers(spark, sf)
    rows = staged(layout.blocks(lines))
    lists = staged(bullets.bullet_lists(lines, rows, marks))
    return layout.next_block_below(lists, rows).select(
        *PAGE, "block_ord", "next_block_ord", F.round("available_height_pt", 6).alias("available_height_pt"))


# --- fonts and predicates on runs -------------------------------------------------

@query("font_classes", """
SELECT doc_id, page_index, run_ord, {0} AS family,
       regexp_matches(font_name, '(?i)bold|black|heavy|semibold|[6-9]00') AS name_bold, regexp_matches(font_name, '(?i)italic|oblique') AS name_italic
FROM v_run""".replace("{0}", "CASE font_name WHEN 'ABCDEE+Cambria' THEN 'serif' WHEN 'CourierNew' THEN 'mono' "
                             "WHEN 'TimesNewRomanPS-ItalicMT' THEN 'serif' ELSE 'sans' END"))
def font_classes(spark, sf):
    name = F.col("style.font_name")
    return v.runs(spark, sf).select(*PAGE, "run_ord", tx.font_family(name).alias("family"),
                                    tx.font_bold(name).alias("name_bold"), tx.font_italic(name).alias("name_italic"))


@query("standard_fonts", """
SELECT doc_id, page_index, run_ord, CASE font_name
   WHEN 'CourierNew' THEN CASE WHEN bold THEN 'Courier-Bold' ELSE 'Courier' END
   WHEN 'ABCDEE+Cambria' THEN CASE WHEN bold THEN 'Times-Bold' ELSE 'Times-Roman' END
   WHEN 'TimesNewRomanPS-ItalicMT' THEN CASE WHEN bold THEN 'Times-BoldItalic' ELSE 'Times-Italic' END
   ELSE CASE WHEN bold THEN 'Helvetica-Bold' ELSE 'Helvetica' END END AS standard_font,
 CASE WHEN font_name IN ('Unknown-700', 'ABCDEE+Cambria') THEN
   'Font ''' || font_name || ''' substituted with Helvetica; widths/kerning may differ.' END AS warning
FROM v_run""")
def standard_fonts(spark, sf):
    styled = v.runs(spark, sf).select(*PAGE, "run_ord", "style.font_name", "style.bold", "style.italic")
    return sinks.map_fonts(styled).select(*PAGE, "run_ord", "standard_font", "warning")


@query("run_predicates", """
SELECT doc_id, page_index, run_ord, doc_id % 2 = 1 AS indic, regexp_matches(t, '^[0-9.,/-]{1,6}$') AS standalone_number
FROM (SELECT *, CASE WHEN run_ord % 9 = 4 THEN CAST(run_ord * 7 AS VARCHAR) ELSE text END AS t FROM v_run)""")
def run_predicates(spark, sf):
    odd = F.when(F.col("doc_id") % 2 == 1, F.lit("अ")).otherwise("")
    t = F.when(F.col("run_ord") % 9 == 4, (F.col("run_ord") * 7).cast("string")).otherwise(F.col("text"))
    return v.runs(spark, sf).select(*PAGE, "run_ord", tx.is_indic(F.concat("text", odd)).alias("indic"),
                                    tx.is_standalone_number(F.concat(F.lit(" "), t)).alias("standalone_number"))


# --- wrapping ------------------------------------------------------------------------

WRAP_SQL = wrap_sql("SELECT doc_id, text FROM documents", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, i) - 1 AS INTEGER) AS chunk_ord, chunk FROM v_wrapped""")


@query("wrap_chunks", WRAP_SQL)
def wrap_chunks(spark, sf):
    return doctext.wrap_chunks(v.table(spark, sf, "documents"), 220.0)


@query("wrap_metric", glyph_wrap_sql("SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, '' AS flags, CAST(doc_id % 12 AS INTEGER) AS k0, 0 AS k1 FROM documents", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, i) - 1 AS INTEGER) AS chunk_ord, chunk FROM v_wrapped""", 22_000))
def wrap_metric(spark, sf):
    """Each document in one of the twelve faces, at size 10 in 220 points."""
    font = F.get(F.array(*(F.lit(name) for name in metrics.FACES)), (F.col("doc_id") % 12).cast("int"))
    return doctext.wrap_chunks(v.table(spark, sf, "documents"), 220.0, measure=metrics.FontWidth(font, 10.0))
