"""Geometry, colours, paint logs, image boxes and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import colors, geometry as g
from pageloom.operators import compare, edits, paint, pixels, regions
from pageloom.plans.stage import staged
from pageloom.schemas import PAGE
from workloads import views as v
from workloads.registry import query

RECT = ["x", "y", "w", "h"]


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


# --- geometry ------------------------------------------------------------------

@query("affine_points", """
SELECT doc_id, page_index, run_ord,
       2 * (x + y * 0.5::DOUBLE) + 3 AS tx, 2 * y + CAST(page_index AS DOUBLE) AS ty
FROM v_run""")
def affine_points(spark, sf):
    num = lambda *vs: F.array(*[c.cast("double") if hasattr(c, "cast") else F.lit(float(c)) for c in vs])
    m = g.affine_mul(num(2, 0, 0, 2, 3, F.col("page_index")), num(1, 0, 0.5, 1, 0, 0))
    p = v.runs(spark, sf).withColumn("_p", g.affine_apply(m, F.col("x"), F.col("y")))
    return p.select(*PAGE, "run_ord", F.col("_p.x").alias("tx"), F.col("_p.y").alias("ty"))


@query("rotated_boxes", """
SELECT doc_id, page_index, run_ord, CASE WHEN doc_id % 2 = 0 THEN x ELSE y - h END AS bx, CASE WHEN doc_id % 2 = 0 THEN y ELSE x END AS "by",
       CASE WHEN doc_id % 2 = 0 THEN w ELSE h END AS bw, CASE WHEN doc_id % 2 = 0 THEN h ELSE w END AS bh
FROM v_run""")
def rotated_boxes(spark, sf):
    turn = F.col("doc_id") % 2 == 1
    m = F.when(turn, F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.col("y"), F.col("x"))).otherwise(
        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("x"), F.col("y")))
    b = v.runs(spark, sf).withColumn("_m", m).withColumn("_b", g.transformed_bbox(F.col("_m"), F.col("w"), F.col("h")))
    return b.select(*PAGE, "run_ord", *[F.col(f"_b.{c}").alias(f"b{c}") for c in RECT])


@query("viewport_points", """
SELECT doc_id, page_index, run_ord,
       off + CASE doc_id % 4 WHEN 0 THEN vx WHEN 1 THEN vy WHEN 2 THEN 612 - vx ELSE 612 - vy END AS page_x,
       2 * off + CASE doc_id % 4 WHEN 0 THEN 792 - vy WHEN 1 THEN vx WHEN 2 THEN vy ELSE 792 - vx END AS page_y
FROM (SELECT *, x / 2 AS vx, y / 2 AS vy, (doc_id % 3) * 4.0::DOUBLE AS off FROM v_run)""")
def viewport_points(spark, sf):
    p = v.pages(spark, sf)
    pts = v.runs(spark, sf).select(*PAGE, "run_ord", "x", "y").join(p, PAGE)
    at = g.viewport_to_page(F.col("x"), F.col("y"), F.col("rotation"), F.col("width_pt"), F.col("height_pt"),
                            F.col("box.x"), F.col("box.y"), 2.0)
    return pts.withColumn("_p", at).select(*PAGE, "run_ord", F.col("_p.x").alias("page_x"), F.col("_p.y").alias("page_y"))


@query("viewport_round_trip", "SELECT doc_id, page_index, run_ord, true AS same FROM v_run")
def viewport_round_trip(spark, sf):
    p = v.pages(spark, sf)
    pts = v.runs(spark, sf).select(*PAGE, "run_ord", "x", "y").join(p, PAGE)
    geo = (F.col("rotation"), F.col("width_pt"), F.col("height_pt"), F.col("box.x"), F.col("box.y"), 1.5)
    pts = pts.withColumn("_v", g.page_to_viewport(F.col("x"), F.col("y"), *geo))
    pts = pts.withColumn("_p", g.viewport_to_page(F.col("_v.x"), F.col("_v.y"), *geo))
    same = (F.abs(F.col("_p.x") - F.col("x")) < 1e-8) & (F.abs(F.col("_p.y") - F.col("y")) < 1e-8)
    return pts.select(*PAGE, "run_ord", same.alias("same"))


@query("device_scale", """
SELECT doc_id, page_index, run_ord, x * (1 + doc_id % 3) AS dx, y * (1 + doc_id % 3) AS dy, x / (1 + doc_id % 3) AS sx, y / (1 + doc_id % 3) AS sy
FROM v_run""")
def device_scale(spark, sf):
    dpr = (F.col("doc_id") % 3 + 1).cast("double")
    r = (v.runs(spark, sf).withColumn("_d", g.scale_point(F.col("x"), F.col("y"), dpr))
         .withColumn("_s", g.scale_point(F.col("x"), F.col("y"), dpr, inverse=True)))
    return r.select(*PAGE, "run_ord", F.col("_d.x").alias("dx"), F.col("_d.y").alias("dy"),
                    F.col("_s.x").alias("sx"), F.col("_s.y").alias("sy"))


@query("corner_rects", """
SELECT doc_id, page_index, run_ord, x AS rx, y AS ry, w AS rw, h AS rh FROM v_run""")
def corner_rects(spark, sf):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in RECT)
    flip = F.col("run_ord") % 2 == 1
    a = F.when(flip, pt(x + w, y)).otherwise(pt(x, y))
    b = F.when(flip, pt(x, y + h)).otherwise(pt(x + w, y + h))
    r = v.runs(spark, sf).withColumn("_r", g.rect_norm(a, b))
    return r.select(*PAGE, "run_ord", *[F.col(f"_r.{c}").alias(f"r{c}") for c in RECT])


@query("rect_overlaps", """
SELECT doc_id, page_index, run_ord, ox * oy AS area, round(ox * oy / (w * h), 6) AS inside, ox AS shared, round(ox / greatest(1, least(w, w2)), 6) AS shared_ratio
FROM (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) AS ox, greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS oy
      FROM (SELECT *, x + 7 AS x2, y - 4 AS y2, w / 2 AS w2, h + 1 AS h2 FROM v_run))""")
def rect_overlaps(spark, sf):
    a = g.Rect.of()
    b = g.Rect(F.col("x") + 7, F.col("y") - 4, F.col("w") / 2, F.col("h") + 1)
    return v.runs(spark, sf).select(
        *PAGE, "run_ord", g.intersection_area(a, b).alias("area"), F.round(g.fraction_inside(a, b), 6).alias("inside"),
        g.horizontal_overlap(a, b).alias("shared"), F.round(g.horizontal_overlap_ratio(a, b), 6).alias("shared_ratio"))


@query("rect_tolerance", """
SELECT doc_id, page_index, run_ord, run_ord % 4 < 2 AS same, run_ord % 4 < 1 AS same_strict, run_ord % 4 < 2 AS holds FROM v_run""")
def rect_tolerance(spark, sf):
    k = F.col("run_ord") % 4
    step = F.when(k == 0, 0.0).when(k == 1, 0.0078125).when(k == 2, 0.03125).otherwise(1.0)
    a = g.Rect.of()
    b = g.Rect(F.col("x") - step, F.col("y"), F.col("w"), F.col("h"))
    return v.runs(spark, sf).select(
        *PAGE, "run_ord", g.rect_same(a, b).alias("same"), g.rect_same(a, b, 0.0078125, strict=True).alias("same_strict"),
        g.rect_contains(a, b).alias("holds"))


# --- colours -----------------------------------------------------------------------

@query("color_spaces", """
SELECT image_id, px, py, round(r / s3, 6) AS rgb_r, round(g / s3, 6) AS rgb_g, round(g / s1, 6) AS gray,
       round(1 - least(1, r / s3 + b / s3), 6) AS ink_r, abs(r / s3 - g / s3) <= 0.03 AS close
FROM (SELECT *, CASE WHEN greatest(r, g, b) > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS s3,
        CASE WHEN g > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS s1 FROM v_pixel)""")
def color_spaces(spark, sf):
    num = lambda *cs: F.array(*[F.col(c).cast("double") for c in cs])
    p = v.pixels(spark, sf)
    p = (p.withColumn("_rgb", colors.to_rgb(F.lit("rgb"), num("r", "g", "b")))
          .withColumn("_gray", colors.to_rgb(F.lit("gray"), num("g")))
          .withColumn("_ink", colors.to_rgb(F.lit("cmyk"), num("r", "g", "g", "b"))))
    close = colors.color_close(F.struct(F.col("_rgb.r").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")),
                               F.struct(F.col("_rgb.g").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))
    return p.select("image_id", "px", "py", F.round("_rgb.r", 6).alias("rgb_r"), F.round("_rgb.g", 6).alias("rgb_g"),
                    F.round("_gray.r", 6).alias("gray"), F.round("_ink.r", 6).alias("ink_r"), close.alias("close"))


@query("cover_color", """
SELECT doc_id, page_index, id, log_pos,
       CASE WHEN log_pos % 5 = 0 THEN 0.5::DOUBLE WHEN sample_background AND page_index < 2 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS fill_r
FROM v_edit WHERE kind = 'cover'""")
def cover_color(spark, sf):
    covers = v.edits(spark, sf).where("kind = 'cover'").withColumn(
        "color", F.when(F.col("log_pos") % 5 == 0, colors.rgb(0.5, 0.5, 0.5)))
    back = covers.select(*PAGE).distinct().where("page_index < 2").select(
        *PAGE, *[F.lit(0.25).alias(c) for c in ("r", "g", "b")])
    return edits.with_background(covers, back).select(*PAGE, "id", "log_pos", F.col("fill.r").alias("fill_r"))


# --- paint logs -----------------------------------------------------------------------

@query("graphics_state", """
SELECT doc_id, page_index, CAST(o AS BIGINT) AS op_ord,
       CASE WHEN o BETWEEN 1 AND 3 OR o BETWEEN 6 AND 7 THEN 100.0::DOUBLE WHEN o BETWEEN 4 AND 5 THEN 50.0::DOUBLE ELSE 1.0::DOUBLE END AS scale_x,
       CASE WHEN o BETWEEN 1 AND 3 OR o BETWEEN 6 AND 7 THEN page_index + 20.0::DOUBLE WHEN o BETWEEN 4 AND 5 THEN page_index + 45.0::DOUBLE ELSE 0.0::DOUBLE END AS move_x,
       CASE WHEN o >= 10 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS line_width,
       CASE WHEN o >= 11 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS stroke_g,
       CASE WHEN o >= 26 THEN 0.5::DOUBLE WHEN o >= 12 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS fill_g
FROM v_page, (SELECT unnest(range(29)) AS o)""")
def graphics_state(spark, sf):
    return paint.graphics_state(v.paint_ops(spark, sf)).select(
        *PAGE, "op_ord", F.col("ctm")[0].alias("scale_x"), F.col("ctm")[4].alias("move_x"), "line_width",
        F.round("stroke.g", 6).alias("stroke_g"), F.round("fill.g", 6).alias("fill_g"))


IMAGES = """
SELECT doc_id, page_index, 2097152::BIGINT AS region_id, page_index + 20.0::DOUBLE AS x, doc_id % 100 + 30.0::DOUBLE AS y, 100.0::DOUBLE AS w, 50.0::DOUBLE AS h FROM v_page
UNION ALL SELECT doc_id, page_index, 5242880, page_index + 45.0::DOUBLE, doc_id % 100 + 42.5::DOUBLE, 50.0::DOUBLE, 25.0::DOUBLE FROM v_page
UNION ALL SELECT doc_id, page_index, 9437184, 400.0::DOUBLE, doc_id % 50 + 10.0::DOUBLE, 12.0::DOUBLE, 8.0::DOUBLE FROM v_page
UNION ALL SELECT doc_id, page_index, 9437185, 450.0::DOUBLE, doc_id % 50 + 10.0::DOUBLE, 12.0::DOUBLE, 8.0::DOUBLE FROM v_page"""


@query("painted_images", IMAGES + """
UNION ALL SELECT doc_id, page_index, 7340032, page_index + 20.0::DOUBLE, doc_id % 100 + 30.0::DOUBLE, 100.0::DOUBLE, 50.0::DOUBLE FROM v_page""")
def painted_images(spark, sf):
    return paint.painted_images(v.paint_ops(spark, sf))


@query("image_regions", IMAGES)
def image_regions(spark, sf):
    return paint.image_regions(v.paint_ops(spark, sf))


CANDIDATES = """
SELECT *, doc_id % 80 AS k, doc_id % 90 AS m FROM v_page"""
RULE_ROWS = """
SELECT doc_id, page_index, 14 AS op_ord, 'horizontal' AS orientation, 72.0::DOUBLE AS x1, 100.0::DOUBLE AS y1, k + 222.0::DOUBLE AS x2, 100.0::DOUBLE AS y2, 1.25::DOUBLE AS thickness_pt, 0.4::DOUBLE AS color_g FROM ({c})
UNION ALL SELECT doc_id, page_index, 16, 'horizontal', k + 223.0::DOUBLE, 100.0::DOUBLE, k + 313.0::DOUBLE, 100.0::DOUBLE, 1.0::DOUBLE, 0.4::DOUBLE FROM ({c})
UNION ALL SELECT doc_id, page_index, 20, 'horizontal', 300.0::DOUBLE, 300.5::DOUBLE, 350.0::DOUBLE, 300.5::DOUBLE, 1.0::DOUBLE, 0.4::DOUBLE FROM ({c})
UNION ALL SELECT doc_id, page_index, 22, 'vertical', 500.0::DOUBLE, 200.0::DOUBLE, 500.0::DOUBLE, m + 240.0::DOUBLE, 1.25::DOUBLE, 0.4::DOUBLE FROM ({c})
UNION ALL SELECT doc_id, page_index, 28, 'horizontal', 100.0::DOUBLE, 501.0::DOUBLE, 220.0::DOUBLE, 501.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE FROM ({c})""".replace("{c}", CANDIDATES)
FRAME_ROW = """
UNION ALL SELECT doc_id, page_index, 18, 'horizontal', 0.0::DOUBLE, 1.0::DOUBLE, 640.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 0.4::DOUBLE FROM v_page"""
RULE = ["orientation", "x1", "y1", "x2", "y2", "thickness_pt"]


@query("rule_paints", """
SELECT doc_id, page_index, CAST(o AS BIGINT) AS op_ord, CASE WHEN o IN (14, 22) THEN 'segment' ELSE 'rectangle' END AS shape,
       CASE WHEN o IN (14, 22) THEN 'stroke' ELSE 'fill' END AS mode
FROM v_page, (SELECT unnest([14, 16, 18, 20, 22, 28]) AS o)""")
def rule_paints(spark, sf):
    return paint.rule_paints(v.paint_ops(spark, sf)).select(*PAGE, "op_ord", "shape", "mode")


def _candidates(spark, sf):
    return paint.rule_candidates(paint.rule_paints(v.paint_ops(spark, sf)))


@query("rule_candidates", f"SELECT * REPLACE (CAST(op_ord AS BIGINT) AS op_ord) FROM ({RULE_ROWS}{FRAME_ROW})")
def rule_candidates(spark, sf):
    return _candidates(spark, sf).select(*PAGE, "op_ord", *RULE, F.round("color.g", 6).alias("color_g"))


def _framed(spark, sf):
    return paint.drop_page_frame(_candidates(spark, sf), v.plain_pages(spark, sf))


@query("rules_without_frame", f"SELECT doc_id, page_index, CAST(op_ord AS BIGINT) AS op_ord, orientation FROM ({RULE_ROWS})")
def rules_without_frame(spark, sf):
    return _framed(spark, sf).select(*PAGE, "op_ord", "orientation")


MERGED = f"""
SELECT doc_id, page_index, CAST(CASE WHEN op_ord = 16 THEN 14 ELSE op_ord END AS BIGINT) AS rule_ord, orientation, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
       max(thickness_pt) AS thickness_pt FROM ({RULE_ROWS}) GROUP BY ALL"""


@query("merged_rules", MERGED)
def merged_rules(spark, sf):
    return paint.merge_rules(_framed(spark, sf), "window").select(*PAGE, "rule_ord", *RULE)


@query("merged_rules_exact", MERGED)
def merged_rules_exact(spark, sf):
    return paint.merge_rules(_framed(spark, sf), "exact").select(*PAGE, "rule_ord", *RULE)


LONG = f"SELECT * FROM ({MERGED}) WHERE greatest(x2 - x1, y2 - y1) >= 72"


@query("long_rules", LONG)
def long_rules(spark, sf):
    return paint.long_rules(paint.merge_rules(_framed(spark, sf))).select(*PAGE, "rule_ord", *RULE)


FINAL = f"SELECT * FROM ({LONG}) WHERE NOT (rule_ord = 14 AND doc_id % 3 = 0)"


@query("divider_rules", FINAL)
def divider_rules(spark, sf):
    return _rules(spark, sf).select(*PAGE, "rule_ord", *RULE)


def _rules(spark, sf):
    return paint.rules(v.paint_ops(spark, sf), v.plain_pages(spark, sf), v.underline_hints(spark, sf))


@query("not_underlines", f"SELECT doc_id, page_index, rule_ord FROM ({LONG}) WHERE NOT (rule_ord = 14 AND doc_id % 3 = 0)")
def not_underlines(spark, sf):
    merged = paint.long_rules(paint.merge_rules(_framed(spark, sf)))
    return paint.drop_underlines(merged, v.underline_hints(spark, sf)).select(*PAGE, "rule_ord")


@query("rule_covers", f"""
SELECT doc_id, page_index, rule_ord, x1 - r AS x, y1 - r AS y, x2 - x1 + 2 * r AS w, y2 - y1 + 2 * r AS h
FROM (SELECT *, thickness_pt / 2 + 1.5 AS r FROM ({FINAL}))""")
def rule_covers(spark, sf):
    return paint.rule_rects(_rules(spark, sf), paint.COVER_PADDING).select(*PAGE, "rule_ord", *RECT)


@query("current_rules", f"""
SELECT doc_id, page_index, rule_ord, CASE WHEN doc_id % 4 = 1 THEN 'c' || rule_ord END AS cover_id,
       CASE WHEN doc_id % 4 = 1 THEN 'l' || rule_ord END AS line_id
FROM ({FINAL}) WHERE doc_id % 4 <> 2""")
def current_rules(spark, sf):
    rules = staged(_rules(spark, sf))
    kind = F.col("doc_id") % 4
    made = paint.rule_rects(rules, paint.COVER_PADDING)
    z = F.col("rule_ord") * 10
    covers = made.where(kind.isin(1, 2)).select(
        *PAGE, F.concat(F.lit("c"), F.col("rule_ord").cast("string")).alias("id"), F.lit("cover").alias("kind"), *RECT,
        z.alias("z"), F.lit(True).alias("sample_background"), F.col("rule_ord").alias("log_pos"))
    lines = made.where(kind == 1).select(
        *PAGE, F.concat(F.lit("l"), F.col("rule_ord").cast("string")).alias("id"), F.lit("line").alias("kind"), *RECT,
        (z + 1).alias("z"), F.lit(False).alias("sample_background"), F.col("rule_ord").alias("log_pos"))
    return paint.current_rules(rules, covers.unionByName(lines)).select(*PAGE, "rule_ord", "cover_id", "line_id")


# --- image boxes ---------------------------------------------------------------------

@query("dedupe_regions", """
SELECT doc_id, page_index, region_id, x, y, w, h FROM v_region""")
def dedupe_regions(spark, sf):
    r = staged(v.regions(spark, sf))
    near = r.withColumn("x", F.col("x") + 0.0078125).withColumn("region_id", F.col("region_id") + (1 << 40))
    again = r.withColumn("region_id", F.col("region_id") + (1 << 41))
    return regions.dedupe_regions(r.unionByName(near).unionByName(again)).select(*PAGE, "region_id", *RECT)


@query("uncovered_regions", """
SELECT doc_id, page_index, region_id FROM v_region WHERE NOT (region_id % 2 = 0 AND doc_id % 3 < 2)""")
def uncovered_regions(spark, sf):
    r = staged(v.regions(spark, sf))
    name = F.element_at(F.array(F.lit("image-cover-"), F.lit("image-delete-cover-"), F.lit("cover-")), (F.col("doc_id") % 3 + 1).cast("int"))
    edit = r.where("region_id % 2 = 0").select(
        *PAGE, F.concat(name, F.col("region_id").cast("string")).alias("id"), F.lit("cover").alias("kind"),
        (F.col("x") + 0.0078125).alias("x"), "y", "w", "h")
    return regions.uncovered_regions(r, edit).select(*PAGE, "region_id")


@query("outside_bands", """
SELECT region_id, b AS band, CAST(greatest(0, floor(bx)) AS BIGINT) AS x1, CAST(greatest(0, floor(yy)) AS BIGINT) AS y1,
       CAST(least(48, ceil(bx + bw)) AS BIGINT) AS x2, CAST(least(48, ceil(yy + bh)) AS BIGINT) AS y2
FROM (SELECT region_id, b, CASE b WHEN 3 THEN "left" + width ELSE "left" - 5 END AS bx,
        CASE b WHEN 0 THEN top - 5 WHEN 1 THEN top + height ELSE top END AS yy,
        CASE WHEN b < 2 THEN width + 10 ELSE 5 END AS bw, CASE WHEN b < 2 THEN 5 ELSE height END AS bh
      FROM v_box, (SELECT CAST(unnest(range(4)) AS INTEGER) AS b))
WHERE least(48, ceil(bx + bw)) > greatest(0, floor(bx)) AND least(48, ceil(yy + bh)) > greatest(0, floor(yy))""")
def outside_bands(spark, sf):
    return pixels.outside_bands(v.image_boxes(spark, sf)).select("region_id", "band", "x1", "y1", "x2", "y2")


@query("crop_windows", """
SELECT region_id, CAST(floor(greatest(0, "left") * 2) AS BIGINT) AS win_left, CAST(ceil(least(48, "left" + width) * 2) - floor(greatest(0, "left") * 2) AS BIGINT) AS win_w,
       CAST(floor((48 - least(48, top + height)) * 3) AS BIGINT) AS win_top, CAST(ceil((48 - greatest(0, top)) * 3) - floor((48 - least(48, top + height)) * 3) AS BIGINT) AS win_h,
       width * 1.0 AS fit_w, width / 2 * 1.0 AS fit_h
FROM v_box""".replace("width * 1.0 AS fit_w, width / 2 * 1.0 AS fit_h",
                      "CASE WHEN 2 >= width / height THEN width ELSE height * 2 END AS fit_w, CASE WHEN 2 >= width / height THEN width / 2 ELSE height END AS fit_h"))
def crop_windows(spark, sf):
    b = v.image_boxes(spark, sf)
    num = lambda x: F.lit(float(x))
    crops = b.select("region_id", num(0).alias("image_x"), num(0).alias("image_y"), num(48).alias("image_w"), num(48).alias("image_h"),
                     F.col("left").alias("crop_x"), F.col("top").alias("crop_y"), F.col("width").alias("crop_w"), F.col("height").alias("crop_h"),
                     F.lit(96).cast("long").alias("pixel_w"), F.lit(144).cast("long").alias("pixel_h"))
    ok, _ = pixels.crop_windows(crops)
    fit = pixels.fit_rect(F.col("crop_x"), F.col("crop_y"), F.col("crop_w"), F.col("crop_h"), F.lit(96.0), F.lit(48.0))
    return ok.withColumn("_f", fit).select(
        "region_id", F.col("left").alias("win_left"), F.col("width").alias("win_w"), F.col("top").alias("win_top"),
        F.col("height").alias("win_h"), F.col("_f.w").alias("fit_w"), F.col("_f.h").alias("fit_h"))


@query("rejected_crops", "SELECT region_id FROM v_box WHERE region_id % 4 = 3")
def rejected_crops(spark, sf):
    b = v.image_boxes(spark, sf)
    num = lambda x: F.lit(float(x))
    off = F.when(F.col("region_id") % 4 == 3, 100.0).otherwise(0.0)
    crops = b.select("region_id", num(0).alias("image_x"), num(0).alias("image_y"), num(48).alias("image_w"), num(48).alias("image_h"),
                     (F.col("left") + off).alias("crop_x"), F.col("top").alias("crop_y"), F.col("width").alias("crop_w"), F.col("height").alias("crop_h"),
                     F.lit(96).cast("long").alias("pixel_w"), F.lit(144).cast("long").alias("pixel_h"))
    return pixels.crop_windows(crops)[1].select("region_id")


# --- pixels -----------------------------------------------------------------------------

@query("color_count", "SELECT image_id, count(DISTINCT bucket) AS color_count FROM v_seen GROUP BY image_id")
def color_count(spark, sf):
    return pixels.color_count(v.pixels(spark, sf))


@query("edge_ratio", """
SELECT image_id, edge_count, edge_pairs, round(edge_count / edge_pairs, 6) AS edge_ratio FROM v_edge""")
def edge_ratio(spark, sf):
    return pixels.edge_ratio(v.pixels(spark, sf), chunk=512).withColumn("edge_ratio", F.round("edge_ratio", 6))


RICH = """
SELECT image_id, color_count, round(dominant_fraction, 6) AS dominant_fraction, round(edge_ratio, 6) AS edge_ratio, rich,
  NOT rich AND color_count >= 24 AND dominant_fraction >= 0.55 AND dominant_fraction < 0.95 AND edge_ratio >= 0.025 AS raster_text_pattern
FROM (SELECT *, color_count >= 64 AND dominant_fraction < 0.6 AS rich
 FROM (SELECT image_id, count(*) AS color_count, max(n) / sum(n) AS dominant_fraction FROM (SELECT image_id, bucket, count(*) AS n FROM v_seen GROUP BY ALL) GROUP BY image_id)
 JOIN (SELECT image_id, edge_count / edge_pairs AS edge_ratio FROM v_edge) USING (image_id))"""


@query("image_richness", RICH)
def image_richness(spark, sf):
    return pixels.image_richness(v.pixels(spark, sf)).select(
        "image_id", "color_count", *rounded("dominant_fraction", "edge_ratio"), "rich", "raster_text_pattern")


REGION_PIXELS = """
SELECT region_id, i, j, p.r, p.g, p.b, p.a, area
FROM (SELECT region_id, image_id, i, j, area, CAST(floor(x1 + (i + 0.5::DOUBLE) * (x2 - x1) / 48) AS INTEGER) AS sx, CAST(floor(y1 + (j + 0.5::DOUBLE) * (y2 - y1) / 48) AS INTEGER) AS sy
      FROM (SELECT *, greatest(0, floor("left")) AS x1, greatest(0, floor(top)) AS y1, least(48, ceil("left" + width)) AS x2, least(48, ceil(top + height)) AS y2,
              least(1, width * height / (48 * 48)) AS area FROM v_box),
        (SELECT unnest(range(48)) AS i), (SELECT unnest(range(48)) AS j) WHERE x2 > x1 AND y2 > y1) q
JOIN v_pixel p ON p.image_id = q.image_id AND p.px = q.sx AND p.py = q.sy"""


@query("region_richness", f"""
SELECT region_id, count(*) AS color_count, round(max(n) / sum(n), 6) AS dominant_fraction, round(any_value(area), 6) AS area_fraction
FROM (SELECT region_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bucket, count(*) AS n, any_value(area) AS area
      FROM ({REGION_PIXELS}) WHERE a <> 0 GROUP BY ALL) GROUP BY region_id""")
def region_richness(spark, sf):
    return pixels.region_richness(v.image_boxes(spark, sf), v.pixels(spark, sf)).select(
        "region_id", "color_count", *rounded("dominant_fraction", "area_fraction"))


@query("raster_text_regions", f"""
SELECT image_id, raster_text_pattern AND (image_id % 10) / 100.0::DOUBLE >= 0.04 AS raster_text,
       NOT ((NOT rich AND (image_id % 2 = 0 OR (raster_text_pattern AND (image_id % 10) / 100.0::DOUBLE >= 0.04))) OR image_id % 7 = 0) AS keep
FROM ({RICH})""")
def raster_text_regions(spark, sf):
    r = pixels.image_richness(v.pixels(spark, sf)).withColumn("raster_text", pixels.is_raster_text(
        F.col("raster_text_pattern"), (F.col("image_id") % 10) / 100.0))
    return r.select("image_id", "raster_text", pixels.keep_region(
        F.col("rich"), F.col("image_id") % 2 == 0, F.col("image_id") % 7 == 0, F.col("raster_text")).alias("keep"))


DOMINANT = """
SELECT {key}, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM (
 SELECT {key}, sum(r) / count(*) / 255 AS r, sum(g) / count(*) / 255 AS g, sum(b) / count(*) / 255 AS b, count(*) AS n, max(pos) AS last_pos
 FROM ({rows}) GROUP BY {key}, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3)
) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, last_pos) = 1"""


@query("dominant_color", DOMINANT.format(key="image_id", rows="SELECT *, py * 48 + px AS pos FROM v_pixel WHERE a >= 128"))
def dominant_color(spark, sf):
    return pixels.dominant_color(v.pixels(spark, sf), ["image_id"]).select("image_id", *rounded("r", "g", "b"))


@query("outside_background", "SELECT b.region_id, coalesce(d.r, 1) AS r, coalesce(d.g, 1) AS g, coalesce(d.b, 1) AS b FROM v_box b LEFT JOIN ("
       + DOMINANT.format(key="region_id", rows="""
SELECT q.region_id, p.r, p.g, p.b, q.band * 10000 + p.py * 48 + p.px AS pos FROM (
 SELECT region_id, image_id, b AS band, greatest(0, floor(bx)) AS x1, greatest(0, floor(yy)) AS y1, least(48, ceil(bx + bw)) AS x2, least(48, ceil(yy + bh)) AS y2
 FROM (SELECT region_id, image_id, b, CASE b WHEN 3 THEN "left" + width ELSE "left" - 5 END AS bx,
        CASE b WHEN 0 THEN top - 5 WHEN 1 THEN top + height ELSE top END AS yy,
        CASE WHEN b < 2 THEN width + 10 ELSE 5 END AS bw, CASE WHEN b < 2 THEN 5 ELSE height END AS bh
      FROM v_box, (SELECT unnest(range(4)) AS b))) q
JOIN v_pixel p ON p.image_id = q.image_id AND p.px >= x1 AND p.px < x2 AND p.py >= y1 AND p.py < y2 WHERE p.a >= 128""") + ") d USING (region_id)")
def outside_background(spark, sf):
    return pixels.outside_background(v.image_boxes(spark, sf), v.pixels(spark, sf)).select("region_id", *rounded("r", "g", "b"))


# --- comparison ------------------------------------------------------------------------------

@query("pixel_diff", """
SELECT image_id, count(*) AS n_rows, CAST(sum(CASE WHEN (px + py) % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatched,
       CAST(sum(CASE WHEN image_id % 4 = 3 AND px = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched,
       CASE WHEN image_id % 4 = 3 THEN 1.0::DOUBLE ELSE round(sum(CASE WHEN (px + py) % 5 = 0 THEN 1 ELSE 0 END) / count(*), 6) END AS ratio
FROM v_pixel GROUP BY image_id""".replace("(px + py) % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mism",
                                         "(px + py) % 5 = 0 AND NOT (image_id % 4 = 3 AND px = 0) THEN 1 ELSE 0 END) AS BIGINT) AS n_mism"))
def pixel_diff(spark, sf):
    want = v.pixels(spark, sf)
    shift = F.when((F.col("px") + F.col("py")) % 5 == 0, 40).otherwise(10)
    have = want.withColumn("r", F.col("r") + shift).where("NOT (image_id % 4 = 3 AND px = 0)")
    return compare.diff_ratio(want, have, ["image_id"], ["py", "px"], ["r", "g", "b", "a"]).withColumn("ratio", F.round("ratio", 6)).drop("absent")


@query("scenario_pass", """
SELECT image_id % 4 AS scenario, count(DISTINCT image_id) AS n_groups,
       CASE WHEN image_id % 4 = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, image_id % 4 < 3 AS pass
FROM v_pixel GROUP BY ALL""")
def scenario_pass(spark, sf):
    want = v.pixels(spark, sf)
    have = want.withColumn("r", F.col("r") + 10).where("NOT (image_id % 4 = 3 AND px = 0)")
    ratios = compare.diff_ratio(want, have, ["image_id"], ["py", "px"], ["r", "g", "b", "a"])
    return compare.scenario_result(ratios.withColumn("scenario", F.col("image_id") % 4), ["scenario"])


@query("scenario_missing", """
SELECT image_id % 4 AS scenario, count(DISTINCT image_id) AS n_groups,
       CASE WHEN bool_or(image_id % 8 = 5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, NOT bool_or(image_id % 8 = 5) AS pass
FROM v_pixel GROUP BY ALL""")
def scenario_missing(spark, sf):
    """Images 5, 13, ... are missing on one side and not scored; differences of the others are not scored either."""
    want = v.pixels(spark, sf)
    have = want.withColumn("r", F.when(F.col("image_id") % 2 == 1, 255 - F.col("r")).otherwise(F.col("r"))).where("image_id % 8 != 5")
    ratios = compare.diff_ratio(want, have, ["image_id"], ["py", "px"], ["r", "g", "b", "a"])
    return compare.scenario_result(ratios.withColumn("scenario", F.col("image_id") % 4), ["scenario"], scored=F.col("image_id") % 2 == 0)


PERCEPTUAL = """
SELECT * FROM (WITH drawn AS (
  SELECT image_id, px, py, r, g, b, a, image_id % 3 < 2 AS d,
         (px - 24) + (py - 24) * ((image_id % 7 - 3) / 4.0) AS pos FROM v_pixel),
s AS (SELECT 0 AS side, image_id, px, py, CASE WHEN d THEN t ELSE r END AS r, CASE WHEN d THEN t ELSE g END AS g, CASE WHEN d THEN t ELSE b END AS b, a
      FROM (SELECT *, floor(255 * least(1.0, greatest(0.0, pos))) AS t FROM drawn)
      UNION ALL
      SELECT 1, image_id, px, py, CASE WHEN d THEN t ELSE r END + CASE WHEN image_id % 3 = 2 AND (px + py) % 5 = 0 THEN 70 ELSE 0 END,
             CASE WHEN d THEN t ELSE g END, CASE WHEN d THEN t ELSE b END, a
      FROM (SELECT *, floor(255 * least(1.0, greatest(0.0, pos + CASE WHEN image_id % 3 = 0 THEN 0.375 ELSE 1.5 END))) AS t FROM drawn)),
w AS (SELECT side, image_id, px, py, [r, g, b, a]::DOUBLE[] AS c, 255 + (r - 255) * (a / 255::DOUBLE) AS r, 255 + (g - 255) * (a / 255::DOUBLE) AS g,
             255 + (b - 255) * (a / 255::DOUBLE) AS b FROM s),
y AS (SELECT *, r * 0.29889531::DOUBLE + g * 0.58662247::DOUBLE + b * 0.11448223::DOUBLE AS y, r * 0.59597799::DOUBLE - g * 0.27417610::DOUBLE - b * 0.32180189::DOUBLE AS i,
             r * 0.21147017::DOUBLE - g * 0.52261711::DOUBLE + b * 0.31114694::DOUBLE AS q FROM w),
around AS (
  SELECT o.side, o.image_id, o.px, o.py, n.px AS nx, n.py AS ny, n.c = o.c AS same, CASE WHEN n.c = o.c THEN 0 ELSE o.y - n.y END AS delta,
         (n.px - o.px + 1) * 3 + (n.py - o.py + 1) AS k
  FROM y o JOIN (SELECT * FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0) ON true
  JOIN y n ON n.side = o.side AND n.image_id = o.image_id AND n.px = o.px + dx AND n.py = o.py + dy),
told AS (
  SELECT side, image_id, px, py, CASE WHEN count(*) < 8 THEN 1 ELSE 0 END AS edge, count_if(same) + edge > 2 AS flat, count_if(delta = 0) + edge <= 2 AS few,
         arg_min({'x': nx, 'y': ny}, {'d': delta, 'k': k}) FILTER (delta < 0) AS low, arg_min({'x': nx, 'y': ny}, {'d': -delta, 'k': k}) FILTER (delta > 0) AS high
  FROM around GROUP BY ALL),
areas AS (SELECT image_id, px, py, bool_and(flat) AS flat FROM told GROUP BY ALL),
smooth AS (
  SELECT t.image_id, t.px, t.py, bool_or(few AND low IS NOT NULL AND high IS NOT NULL AND (l.flat OR h.flat)) AS smooth
  FROM told t LEFT JOIN areas l ON l.image_id = t.image_id AND l.px = t.low.x AND l.py = t.low.y
  LEFT JOIN areas h ON h.image_id = t.image_id AND h.px = t.high.x AND h.py = t.high.y GROUP BY ALL),
marked AS (
  SELECT e.image_id, 0.5053::DOUBLE * (e.y - a.y) * (e.y - a.y) + 0.299::DOUBLE * (e.i - a.i) * (e.i - a.i) + 0.1957::DOUBLE * (e.q - a.q) * (e.q - a.q) > 35215::DOUBLE * 0.1::DOUBLE * 0.1::DOUBLE AS far, smooth
  FROM y e JOIN y a ON e.side = 0 AND a.side = 1 AND e.image_id = a.image_id AND e.px = a.px AND e.py = a.py
  JOIN smooth m ON m.image_id = e.image_id AND m.px = e.px AND m.py = e.py)
SELECT image_id, count(*) AS n_rows, CAST(count_if(far AND NOT smooth) AS BIGINT) AS n_mismatched, CAST(count_if(far) AS BIGINT) AS n_far,
       round(count_if(far AND NOT smooth) / count(*), 6) AS ratio FROM marked GROUP BY image_id)"""


@query("image_diff", PERCEPTUAL)
def image_diff(spark, sf):
    """Pixels that differ to the eye; ``n_far`` counts those that only smooth an edge as well."""
    want, have = v.edge_pictures(spark, sf)
    strict = compare.image_mismatch(want, have, ["image_id"], smoothing=False).select("image_id", F.col("n_mismatched").alias("n_far"))
    return compare.image_mismatch(want, have, ["image_id"]).select(
        "image_id", "n_rows", "n_mismatched", F.round("ratio", 6).alias("ratio")).join(strict, "image_id")


@query("image_scenarios", f"""
SELECT image_id % 3 AS scenario, count(*) AS n_groups, max(ratio) AS ratio, max(ratio) <= 0.001 AS pass FROM ({PERCEPTUAL}) GROUP BY ALL""")
def image_scenarios(spark, sf):
    ratios = compare.image_mismatch(*v.edge_pictures(spark, sf), ["image_id"]).withColumn("ratio", F.round("ratio", 6))
    return compare.scenario_result(ratios.withColumn("scenario", F.col("image_id") % 3), ["scenario"])


@query("nearest_edges", """
SELECT r.doc_id, r.page_index, r.run_ord, 'min' AS edge, b.block_ord, b.x - r.x AS delta
FROM v_run r JOIN (SELECT doc_id, page_index, CAST(block_ord AS BIGINT) AS block_ord, x FROM v_block) b
  ON r.doc_id = b.doc_id AND r.page_index = b.page_index AND abs(b.x - r.x) <= 6
QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.page_index, r.run_ord ORDER BY abs(b.x - r.x), b.block_ord) = 1""")
def nearest_edges(spark, sf):
    left = v.runs(spark, sf).select(*PAGE, F.lit("min").alias("edge"), "run_ord", "x")
    right = v.blocks(spark, sf).select(*PAGE, F.lit("min").alias("edge"), "block_ord", F.col("x").alias("pos"))
    return compare.nearest_within(left, right, [*PAGE, "edge"], "run_ord", "x", "pos", "block_ord", 6.0).select(
        *PAGE, "run_ord", "edge", "block_ord", "delta")
