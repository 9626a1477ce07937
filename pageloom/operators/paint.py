"""Paint logs: graphics state, painted image regions, and divider rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.colors import to_rgb
from pageloom.functions.geometry import Rect, affine_apply, affine_mul, transformed_bbox
from pageloom.operators.regions import dedupe_regions
from pageloom.plans.folds import fold_columns
from pageloom.plans.grid import grid_pairs
from pageloom.plans.stage import staged
from pageloom.schemas import PAGE

# Thresholds in points.
MIN_LENGTH, MAX_THICKNESS, OFF_AXIS, MERGE, FRAME_MARGIN = 72.0, 3.0, 1.5, 2.0, 4.0
MIN_IMAGE_SIDE = 0.1

UNIT_IMAGES = ("paintImageXObject", "paintInlineImageXObject", "paintImageMaskXObject")
STROKES, FILLS = ("stroke", "closeStroke"), ("fill", "eoFill")
BOTH = ("fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke")
COLOR_OPS = {f"set{kind}{name}": (kind, space) for kind in ("Stroke", "Fill")
             for name, space in (("RGBColor", "rgb"), ("Gray", "gray"), ("CMYKColor", "cmyk"))}

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class _Graphics:
    """Current matrix, line width and colour settings with the save stack."""

    def __init__(self):
        self.now = (IDENTITY, 1.0, None, None)
        self.saved: list[tuple] = []

    def apply(self, op: str, args) -> tuple:
        matrix, width, stroke, fill = self.now
        nested = op == "paintFormXObjectBegin"
        if op == "save" or nested:
            self.saved.append(self.now)
        elif op in ("restore", "paintFormXObjectEnd") and self.saved:
            self.now = self.saved.pop()
        if (op == "transform" or nested) and args is not None and len(args) == 6:
            a, b, c, d, e, f = matrix
            p, q, r, s, t, u = args
            self.now = ((a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s,
                         a * t + c * u + e, b * t + d * u + f), width, stroke, fill)
        elif op == "setLineWidth" and args:
            self.now = (matrix, abs(args[0]), stroke, fill)
        elif op in COLOR_OPS:
            kind, space = COLOR_OPS[op]
            if args is not None and len(args) >= {"rgb": 3, "gray": 1, "cmyk": 4}[space]:
                color = {"space": space, "comps": list(args)}
                self.now = (matrix, width, color, fill) if kind == "Stroke" else (matrix, width, stroke, color)
        return self.now


_PAINT = T.StructType([T.StructField("space", T.StringType()), T.StructField("comps", T.ArrayType(T.DoubleType()))])
_STATE = T.StructType([
    T.StructField("ctm", T.ArrayType(T.DoubleType())), T.StructField("line_width", T.DoubleType()),
    T.StructField("_stroke", _PAINT), T.StructField("_fill", _PAINT)])


def graphics_state(paint_ops: DataFrame) -> DataFrame:
    """Adds the graphics state in force after each op: ``ctm``, ``line_width``, ``stroke``, ``fill``."""
    state = fold_columns(paint_ops, PAGE, ["op_ord"], ["op", "args"], _Graphics,
                         lambda g, row: g.apply(*row), _STATE)
    black = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b")])
    color = lambda c: F.coalesce(to_rgb(F.col(f"{c}.space"), F.col(f"{c}.comps")), black)
    return (state.withColumn("stroke", color("_stroke")).withColumn("fill", color("_fill"))
                 .drop("_stroke", "_fill"))


# --- image regions -----------------------------------------------------------

def _placements() -> Column:
    """array<array<double>>: the matrices an image op paints the unit square with, before the CTM."""
    a, n = F.col("args"), F.size("args")
    at = lambda i: F.element_at(a, i)
    pairs = lambda first: F.when(n > first, F.sequence(F.lit(first + 1), n - (n - first) % 2, F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    safe = lambda first: F.filter(pairs(first), lambda i: i + 1 <= n)
    repeat = F.transform(safe(2), lambda i: F.array(at(1), F.lit(0.0), F.lit(0.0), at(2), at(i), at(i + 1)))
    mask = F.transform(safe(4), lambda i: F.array(at(1), at(3), at(2), at(4), at(i), at(i + 1)))
    groups = F.transform(F.when(n >= 6, F.sequence(F.lit(0), F.floor(n / 6).cast("int") - 1)).otherwise(
        F.array().cast("array<int>")), lambda k: F.slice(a, k * 6 + 1, F.lit(6)))
    unit = F.array(F.array(*[F.lit(v) for v in IDENTITY]))
    op = F.col("op")
    return (F.when(op.isin(*UNIT_IMAGES), unit)
            .when(op == "paintImageXObjectRepeat", repeat)
            .when(op == "paintImageMaskXObjectRepeat", mask)
            .when(op.isin("paintInlineImageXObjectGroup", "paintImageMaskXObjectGroup"), groups))


def painted_images(paint_ops: DataFrame) -> DataFrame:
    """Every painted image as a page-space rectangle, before removing repeats."""
    placed = (graphics_state(paint_ops).withColumn("_p", _placements()).where(F.col("_p").isNotNull())
              .select(*PAGE, "op_ord", "ctm", F.posexplode_outer("_p").alias("_k", "_m")).where(F.col("_m").isNotNull()))
    boxed = placed.withColumn("_b", transformed_bbox(affine_mul(F.col("ctm"), F.col("_m"))))
    return (boxed.select(*PAGE, (F.col("op_ord") * (1 << 20) + F.col("_k")).alias("region_id"), "_b.*")
                 .where((F.col("w") > MIN_IMAGE_SIDE) & (F.col("h") > MIN_IMAGE_SIDE)))


def image_regions(paint_ops: DataFrame) -> DataFrame:
    """Painted image rectangles of each page, first of near-equal ones kept."""
    return dedupe_regions(painted_images(paint_ops))


# --- rules -------------------------------------------------------------------

def rule_paints(paint_ops: DataFrame) -> DataFrame:
    """Painted paths: ``shape`` rectangle or segment, page-space points, mode, state.

    A path is the op right before its paint once unrelated ops are set aside; a
    path that was painted or ended already is not painted again.
    """
    related = (*STROKES, *FILLS, *BOTH, "constructPath", "endPath")
    state = graphics_state(paint_ops).where(F.col("op").isin(*related))
    w = W.partitionBy(*PAGE).orderBy("op_ord")
    prev = lambda c: F.lag(c).over(w)
    here = (state.withColumn("_pop", prev("op")).withColumn("_path", prev("path"))
                 .withColumn("_args", prev("args")).withColumn("_m", prev("ctm")))
    painted = here.where((F.col("_pop") == "constructPath") & F.col("op").isin(*STROKES, *FILLS, *BOTH))
    path, args, m = F.col("_path"), F.col("_args"), F.col("_m")
    rectangle = (F.size(path) == 1) & (F.get(path, F.lit(0)) == "rectangle") & (F.size(args) >= 4)
    moves_only = F.forall(path, lambda p: p.isin("moveTo", "lineTo"))
    line_at = F.array_position(path, F.lit("lineTo")).cast("int")
    one_line = F.size(F.filter(path, lambda p: p == "lineTo")) == 1
    segment = moves_only & one_line & (line_at > 1) & (F.size(args) >= F.size(path) * 2)
    at = lambda k: F.get(args, k)
    pt = lambda x, y: affine_apply(m, x, y)
    x, y, rw, rh = (at(F.lit(k)) for k in range(4))
    corners = F.array(pt(x, y), pt(x + rw, y), pt(x + rw, y + rh), pt(x, y + rh))
    ends = F.array(pt(at(line_at * 2 - 4), at(line_at * 2 - 3)), pt(at(line_at * 2 - 2), at(line_at * 2 - 1)))
    shaped = (painted.withColumn("shape", F.when(rectangle, "rectangle").when(segment, "segment"))
                     .withColumn("points", F.when(rectangle, corners).when(segment, ends))
                     .where(F.col("shape").isNotNull()))
    mode = (F.when(F.col("op").isin(*STROKES), "stroke").when(F.col("op").isin(*FILLS), "fill")
            .when(F.col("shape") == "rectangle", "fill").otherwise("stroke"))
    return (shaped.withColumn("mode", mode)
                  .select(*PAGE, "op_ord", "shape", "points", "mode", "ctm", "line_width", "stroke", "fill"))


def rule_candidates(paints: DataFrame) -> DataFrame:
    """Thin axis-aligned paths as centre lines with thickness and colour."""
    xs, ys = F.col("points.x"), F.col("points.y")
    left, right, low, high = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    filled = (F.col("shape") == "rectangle") & (F.col("mode") == "fill") & (right > left) & (high > low)
    stroked = (F.col("shape") == "segment") & (F.col("mode") == "stroke")
    width, height = right - left, high - low
    flat = width >= height
    x1, y1, x2, y2 = xs[0], ys[0], xs[1], ys[1]
    seg_flat = F.abs(x2 - x1) >= F.abs(y2 - y1)
    m = F.col("ctm")
    scale = F.when(seg_flat, F.hypot(m[2], m[3])).otherwise(F.hypot(m[0], m[1]))
    flatness = F.when(filled, flat).otherwise(seg_flat)
    off_axis = F.when(filled, F.lit(0.0)).when(seg_flat, F.abs(y2 - y1)).otherwise(F.abs(x2 - x1))
    thick = F.when(filled, F.least(width, height)).otherwise(
        F.greatest(F.lit(0.25), F.col("line_width") * scale))
    mid_y = F.when(filled, (low + high) / 2).otherwise((y1 + y2) / 2)
    mid_x = F.when(filled, (left + right) / 2).otherwise((x1 + x2) / 2)
    return (paints.where(filled | stroked)
            .withColumn("orientation", F.when(flatness, "horizontal").otherwise("vertical"))
            .withColumn("x1", F.when(flatness, left).otherwise(mid_x))
            .withColumn("x2", F.when(flatness, right).otherwise(mid_x))
            .withColumn("y1", F.when(flatness, mid_y).otherwise(low))
            .withColumn("y2", F.when(flatness, mid_y).otherwise(high))
            .withColumn("thickness_pt", thick).withColumn("_off", off_axis)
            .withColumn("color", F.when(filled, F.col("fill")).otherwise(F.col("stroke")))
            .where((F.col("_off") <= OFF_AXIS) & (F.col("thickness_pt") <= MAX_THICKNESS))
            .select(*PAGE, "op_ord", "orientation", "x1", "y1", "x2", "y2", "thickness_pt", "color"))


def drop_page_frame(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Remove rules along the page edge that span at least 90 % of it."""
    p = pages.select(*PAGE, F.col("box.x").alias("_px"), F.col("box.y").alias("_py"),
                     F.col("width_pt").alias("_pw"), F.col("height_pt").alias("_ph"))
    edge = lambda v, lo, size: F.least(F.abs(v - lo), F.abs(v - (lo + size)))
    flat = F.col("orientation") == "horizontal"
    frame = F.when(flat, (F.col("x2") - F.col("x1") >= F.col("_pw") * 0.9)
                   & (edge(F.col("y1"), F.col("_py"), F.col("_ph")) <= FRAME_MARGIN)).otherwise(
        (F.col("y2") - F.col("y1") >= F.col("_ph") * 0.9)
        & (edge(F.col("x1"), F.col("_px"), F.col("_pw")) <= FRAME_MARGIN))
    return rules.join(p, PAGE, "left").where(~F.coalesce(frame, F.lit(False))).drop("_px", "_py", "_pw", "_ph")


def _along(df: DataFrame) -> DataFrame:
    flat = F.col("orientation") == "horizontal"
    return (df.withColumn("_s", F.when(flat, F.col("x1")).otherwise(F.col("y1")))
              .withColumn("_e", F.when(flat, F.col("x2")).otherwise(F.col("y2")))
              .withColumn("_p", F.when(flat, F.col("y1")).otherwise(F.col("x1"))))


def _from_along(df: DataFrame) -> DataFrame:
    flat = F.col("orientation") == "horizontal"
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    return (df.withColumn("x1", pick("_s", "_p")).withColumn("y1", pick("_p", "_s"))
              .withColumn("x2", pick("_e", "_p")).withColumn("y2", pick("_p", "_e"))
              .select(*PAGE, "rule_ord", "orientation", "x1", "y1", "x2", "y2", "thickness_pt", "color"))


def merge_rules(candidates: DataFrame, mode: str = "exact") -> DataFrame:
    """Join collinear touching rules of one colour.

    ``window`` clusters by colour (equal to two decimals) and perpendicular
    position, then merges intervals with a running maximum; the merged position
    is the mean. ``exact`` follows paint order: a rule joins the first merged rule
    it touches and the position is averaged pairwise. They agree when colours are
    equal and separate rules lie more than 2 pt apart.
    """
    df = _along(candidates)
    if mode == "exact":
        return _merge_exact(df)
    if mode != "window":
        raise ValueError(f"unknown mode {mode!r}")
    shade = F.concat_ws(",", *[F.round(F.col(f"color.{c}"), 2).cast("string") for c in ("r", "g", "b")])
    df = df.withColumn("_shade", shade)
    key = [*PAGE, "orientation", "_shade"]
    by_p = W.partitionBy(*key).orderBy("_p")
    far = F.coalesce(F.col("_p") - F.lag("_p").over(by_p) > MERGE, F.lit(True)).cast("int")
    df = df.withColumn("_f", far).withColumn("_lane", F.sum("_f").over(by_p))
    by_s = W.partitionBy(*key, "_lane").orderBy("_s", "_e", "op_ord")
    reach = F.max("_e").over(by_s.rowsBetween(W.unboundedPreceding, -1))
    gap = F.coalesce(F.col("_s") > reach + MERGE, F.lit(True)).cast("int")
    df = df.withColumn("_g", gap).withColumn("_run", F.sum("_g").over(by_s))
    merged = df.groupBy(*key, "_lane", "_run").agg(
        F.min("op_ord").alias("rule_ord"), F.min("_s").alias("_s"), F.max("_e").alias("_e"),
        F.avg("_p").alias("_p"), F.max("thickness_pt").alias("thickness_pt"),
        F.min_by("color", "op_ord").alias("color"))
    return _from_along(merged)


class _Merging:
    """Merged rules of one page so far, in order of first appearance."""

    def __init__(self):
        self.rules: list[list] = []

    def add(self, row: tuple) -> tuple:
        order, side, start, end, pos, color = row
        shade = (color["r"], color["g"], color["b"])
        for rule in self.rules:
            if (rule[1] == side and all(abs(p - q) <= 0.03 for p, q in zip(rule[5], shade))
                    and abs(rule[4] - pos) <= MERGE and start <= rule[3] + MERGE and end >= rule[2] - MERGE):
                rule[2], rule[3], rule[4] = min(rule[2], start), max(rule[3], end), (rule[4] + pos) / 2
                return rule[0], rule[4]
        self.rules.append([order, side, start, end, pos, shade])
        return order, pos


def _merge_exact(df: DataFrame) -> DataFrame:
    folded = fold_columns(
        df, PAGE, ["op_ord"], ["op_ord", "orientation", "_s", "_e", "_p", "color"], _Merging,
        lambda state, row: state.add(row),
        T.StructType([T.StructField("rule_ord", T.LongType()), T.StructField("_pos", T.DoubleType())]))
    merged = folded.groupBy(*PAGE, "rule_ord", "orientation").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max_by("_pos", "op_ord").alias("_p"),
        F.max("thickness_pt").alias("thickness_pt"), F.min_by("color", "op_ord").alias("color"))
    return _from_along(merged)


def long_rules(rules: DataFrame) -> DataFrame:
    """Rules of at least 72 pt; apply after merging."""
    return rules.where(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= MIN_LENGTH)


def drop_underlines(rules: DataFrame, hints: DataFrame) -> DataFrame:
    """Remove horizontal rules that sit under a text item ``(x, baseline_y, width, height)``."""
    tol = F.greatest(F.lit(10.0), (F.col("x2") - F.col("x1")) * 0.08)
    flat = (rules.where("orientation = 'horizontal'").select(*PAGE, "rule_ord", "x1", "x2", F.col("y1").alias("_ry"))
                 .withColumn("_tol", tol))
    text = hints.where("width > 0").select(
        *PAGE, F.col("x").alias("_hx"), F.col("baseline_y").alias("_hb"), F.col("width").alias("_hw"),
        F.greatest(F.lit(6.0), F.col("height") * 0.4).alias("_hgap"))
    zero = F.lit(0.0)
    near = grid_pairs(
        flat, text, PAGE,
        Rect(F.col("x1") - F.col("_tol"), F.col("_ry"), F.col("_tol") * 2, zero),
        Rect(F.col("_hx"), F.col("_hb") - F.col("_hgap"), zero, F.col("_hgap") + 1),
        (F.abs(F.col("x2") - (F.col("_hx") + F.col("_hw"))) <= F.col("_tol"))
        & (F.col("_hb") - F.col("_ry") >= -1) & (F.col("_hb") - F.col("_ry") <= F.col("_hgap"))
        & (F.abs(F.col("x1") - F.col("_hx")) <= F.col("_tol")))
    return rules.join(near.select(*PAGE, "rule_ord").distinct(), [*PAGE, "rule_ord"], "left_anti")


def rules(paint_ops: DataFrame, pages: DataFrame, hints: DataFrame, mode: str = "exact") -> DataFrame:
    """Divider rules of each page, from paint log to final list."""
    candidates = drop_page_frame(rule_candidates(rule_paints(paint_ops)), pages)
    # The hints are met and the rest is told from them: three readers.
    return drop_underlines(staged(long_rules(merge_rules(candidates, mode))), hints)


def rule_rects(rule_rows: DataFrame, padding: float = 0.0) -> DataFrame:
    """Bounding rectangle of each rule, widened by half its thickness and ``padding``."""
    radius = F.col("thickness_pt") / 2 + padding
    return (rule_rows.withColumn("x", F.least("x1", "x2") - radius).withColumn("y", F.least("y1", "y2") - radius)
                     .withColumn("w", F.abs(F.col("x2") - F.col("x1")) + radius * 2)
                     .withColumn("h", F.abs(F.col("y2") - F.col("y1")) + radius * 2))


COVER_PADDING = 1.5


def current_rules(rule_rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rules with their replacement line: untouched, moved, or dropped when deleted.

    A sampled cover with the rule's padded rectangle marks it as edited; the line
    edit at the next z is its replacement, and a cover without one deletes it.
    """
    source = rule_rects(rule_rows, COVER_PADDING)
    covers = edits.where("kind = 'cover' AND sample_background").select(
        *PAGE, F.col("id").alias("cover_id"), F.col("z").alias("_cz"), "log_pos",
        *[F.col(c).alias(f"c_{c}") for c in ("x", "y", "w", "h")])
    r, c = Rect.of(), Rect.of("c_")
    near = F.lit(True)
    for p, q in zip(r, c):
        near = near & (F.abs(p - q) < 0.01)
    zero = F.lit(0.0)
    hit = grid_pairs(source.select(*PAGE, "rule_ord", "x", "y", "w", "h"), covers, PAGE,
                     Rect(r.x, r.y, zero, zero),
                     Rect(c.x - 0.02, c.y - 0.02, F.lit(0.04), F.lit(0.04)), near, large="right")
    first = hit.groupBy(*PAGE, "rule_ord").agg(F.min_by(F.struct("cover_id", "_cz"), "log_pos").alias("_c"))
    lines = edits.where("kind = 'line'").groupBy(*PAGE, F.col("z").alias("_lz")).agg(F.min_by("id", "log_pos").alias("line_id"))
    marked = (rule_rows.join(first, [*PAGE, "rule_ord"], "left").withColumn("_lz", F.col("_c._cz") + 1)
                       .join(lines, [*PAGE, "_lz"], "left"))
    return (marked.where(F.col("_c").isNull() | F.col("line_id").isNotNull())
                  .withColumn("cover_id", F.col("_c.cover_id")).drop("_c", "_lz"))
