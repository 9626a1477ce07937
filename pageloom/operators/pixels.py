"""Pixel statistics over ``(image_id, px, py, r, g, b, a)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions.colors import color_bucket, luminance, rgb, WHITE

SAMPLE = 48  # fixed value: side of the square sample richness works on
EDGE_STEP = 32


def _bucket() -> Column:
    return color_bucket(F.col("r"), F.col("g"), F.col("b"))


def color_count(pixels: DataFrame) -> DataFrame:
    """Distinct five-bit colours per image; fully transparent pixels are ignored."""
    return (pixels.where("a <> 0").groupBy("image_id")
                  .agg(F.count_distinct(_bucket()).alias("color_count")))


def edge_ratio(pixels: DataFrame, keys: list[str] | None = None, chunk: int = 4096) -> DataFrame:
    """Share of neighbour pairs whose luminance differs by at least 32.

    Neighbours are the pixel before and the one 48 before, counted over the
    visible pixels in row order. The position of a pixel is its rank in its image
    row plus the visible pixels of earlier rows, so no window spans an image;
    neighbours are then read inside chunks that overlap by one sample row.
    """
    keys = keys or ["image_id"]
    seen = pixels.where("a <> 0").select(*keys, "px", "py", luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"))
    per_row = seen.groupBy(*keys, "py").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("py").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_row.select(*keys, "py", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*keys, "py").orderBy("px")) - 1
    indexed = (seen.withColumn("_rank", rank).join(offsets, [*keys, "py"])
                   .withColumn("idx", F.col("_rank") + F.col("_before")))
    home = F.floor(F.col("idx") / chunk)
    halo = F.when(F.col("idx") % chunk >= chunk - SAMPLE, F.array(home, home + 1)).otherwise(F.array(home))
    spread = indexed.withColumn("_home", home).withColumn("_chunk", F.explode(halo))
    w = W.partitionBy(*keys, "_chunk").orderBy("idx")
    left, above = F.lag("lum", 1).over(w), F.lag("lum", SAMPLE).over(w)
    pairs = (spread.withColumn("_left", left).withColumn("_above", above)
                   .where(F.col("_chunk") == F.col("_home")))
    has_left = (F.col("idx") % SAMPLE > 0).cast("long")
    has_above = (F.col("idx") >= SAMPLE).cast("long")
    step = lambda c: (F.abs(F.col("lum") - F.col(c)) >= EDGE_STEP)
    edges = ((has_left == 1) & step("_left")).cast("long") + ((has_above == 1) & step("_above")).cast("long")
    return pairs.groupBy(*keys).agg(F.sum(edges).alias("edge_count"), F.sum(has_left + has_above).alias("edge_pairs")).select(
        *keys, "edge_count", "edge_pairs",
        F.when(F.col("edge_pairs") > 0, F.col("edge_count") / F.col("edge_pairs")).otherwise(0.0).alias("edge_ratio"))


def image_richness(pixels: DataFrame, min_colors: int = 64, keys: list[str] | None = None) -> DataFrame:
    """Colour count, dominant share, edge ratio and the ``rich`` / ``raster_text_pattern`` flags.

    Colours are counted per bucket first, so a hot image is merged map-side.
    """
    if not 1 <= min_colors < float("inf"):
        raise ValueError("min_colors must be a positive finite number")
    keys = keys or ["image_id"]
    # Transparent pixels share one bucket that counts nothing but keeps the image present.
    bucket = F.when(F.col("a") != 0, _bucket()).otherwise(-1)
    buckets = pixels.groupBy(*keys, bucket.alias("_bucket")).agg(F.count_if(F.col("a") != 0).alias("_n"))
    colors = buckets.groupBy(*keys).agg(
        F.count_if(F.col("_n") > 0).alias("color_count"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    stats = (colors.join(edge_ratio(pixels, keys).select(*keys, "edge_ratio"), keys, "left")
                   .select(*keys, "color_count",
                           F.when(F.col("_all") > 0, F.col("_top") / F.col("_all")).otherwise(0.0).alias("dominant_fraction"),
                           F.coalesce("edge_ratio", F.lit(0.0)).alias("edge_ratio")))
    rich = (F.col("color_count") >= min_colors) & (F.col("dominant_fraction") < 0.6)
    return stats.withColumn("rich", rich).withColumn("raster_text_pattern", raster_text_pattern(
        F.col("rich"), F.col("color_count"), F.col("dominant_fraction"), F.col("edge_ratio")))


def raster_text_pattern(rich: Column, colors: Column, dominant: Column, edges: Column) -> Column:
    return ~rich & (colors >= 24) & (dominant >= 0.55) & (dominant < 0.95) & (edges >= 0.025)


def is_raster_text(pattern: Column, area_fraction: Column, min_area: float = 0.04) -> Column:
    if not 0 <= min_area <= 1:
        raise ValueError("min_area must be between 0 and 1")
    return pattern & (area_fraction >= min_area)


def keep_region(rich: Column, has_text: Column, paragraph: Column, raster_text: Column) -> Column:
    """Whether an image region is shown as an image; missing richness counts as rich."""
    is_rich = F.coalesce(rich, F.lit(True))
    return ~((~is_rich & (has_text | F.coalesce(raster_text, F.lit(False)))) | paragraph)


def _window(box, width: Column, height: Column) -> list[Column]:
    x, y, w, h = box
    return [F.greatest(F.lit(0), F.floor(x)), F.greatest(F.lit(0), F.floor(y)),
            F.least(width, F.ceil(x + w)), F.least(height, F.ceil(y + h))]


def region_windows(regions: DataFrame) -> DataFrame:
    """Clip ``(left, top, width, height)`` to the image ``(image_w, image_h)``; empty ones drop out."""
    x1, y1, x2, y2 = _window([F.col(c) for c in ("left", "top", "width", "height")], F.col("image_w"), F.col("image_h"))
    share = F.least(F.lit(1.0), F.col("width") * F.col("height") / (F.col("image_w") * F.col("image_h")))
    return (regions.withColumn("x1", x1).withColumn("y1", y1).withColumn("x2", x2).withColumn("y2", y2)
                   .withColumn("area_fraction", share).where("x2 > x1 AND y2 > y1"))


def region_richness(regions: DataFrame, pixels: DataFrame) -> DataFrame:
    """Richness of each region, sampled to 48 x 48 by nearest pixel.

    Every region has exactly 48 x 48 sample cells, each naming one source pixel, so
    the work per region is fixed and the join is on the pixel itself.
    """
    cell = F.explode(F.sequence(F.lit(0), F.lit(SAMPLE - 1)))
    grid = (region_windows(regions).select("region_id", "image_id", "x1", "y1", "x2", "y2", "area_fraction")
            .withColumn("_i", cell).withColumn("_j", cell))
    pick = lambda lo, hi, k: F.floor(F.col(lo) + (F.col(k) + 0.5) * (F.col(hi) - F.col(lo)) / SAMPLE)
    cells = grid.withColumn("_sx", pick("x1", "x2", "_i")).withColumn("_sy", pick("y1", "y2", "_j"))
    source = pixels.select("image_id", F.col("px").cast("long").alias("_sx"), F.col("py").cast("long").alias("_sy"), "r", "g", "b", "a")
    # The regions' size tells nothing of their cells': neither side may be taken for small and sent to every task.
    sampled = cells.join(source.hint("merge"), ["image_id", "_sx", "_sy"]).select(
        "region_id", F.col("_i").alias("px"), F.col("_j").alias("py"), "r", "g", "b", "a")
    share = region_windows(regions).select("region_id", "area_fraction")
    return image_richness(sampled, keys=["region_id"]).join(share, "region_id")


def dominant_color(pixels: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Mean of the fullest five-bit bucket among pixels with alpha of at least 128.

    Among equally full buckets the one that filled up first wins, which is the one
    whose last pixel comes first in ``order``. Groups without such pixels are white.
    """
    solid = F.col("a") >= 128
    position = F.when(solid, F.struct(*(order or ["py", "px"])))
    buckets = pixels.groupBy(*keys, _bucket().alias("_bucket")).agg(
        F.count_if(solid).alias("_n"), *[F.sum(F.when(solid, F.col(c))).alias(f"_{c}") for c in ("r", "g", "b")],
        F.max(position).alias("_last"))
    # Fullest bucket first; among equals the one whose last pixel comes first.
    best = buckets.groupBy(*keys).agg(
        F.min_by(F.struct("_n", "_r", "_g", "_b"), F.struct(-F.col("_n"), F.col("_last"))).alias("_w"))
    share = lambda c: F.when(F.col("_w._n") > 0, F.col(f"_w._{c}") / F.col("_w._n") / 255).otherwise(1.0).alias(c)
    return best.select(*keys, share("r"), share("g"), share("b"))


def outside_bands(regions: DataFrame, margin: float = 5.0) -> DataFrame:
    """Up to four clipped bands just outside each region: top, bottom, left, right."""
    m = max(1.0, float(margin))
    x, y, w, h = (F.col(c) for c in ("left", "top", "width", "height"))
    band = lambda k, bx, by, bw, bh: F.struct(
        F.lit(k).alias("band"), bx.alias("bx"), by.alias("by"), bw.alias("bw"), bh.alias("bh"))
    wide, m_ = w + m * 2, F.lit(m)
    bands = F.array(band(0, x - m, y - m, wide, m_), band(1, x - m, y + h, wide, m_),
                    band(2, x - m, y, m_, h), band(3, x + w, y, m_, h))
    opened = regions.withColumn("_b", F.explode(bands)).select("region_id", "image_id", "image_w", "image_h", "_b.*")
    x1, y1, x2, y2 = _window([F.col(c) for c in ("bx", "by", "bw", "bh")], F.col("image_w"), F.col("image_h"))
    return (opened.select("region_id", "image_id", "band", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
                  .where("x2 > x1 AND y2 > y1"))


def outside_background(regions: DataFrame, pixels: DataFrame, margin: float = 5.0) -> DataFrame:
    """Dominant colour of the bands around each region; white when there are none.

    Bands expand to image rows, and a row meets its pixels by ``(image, row,
    column tile)``, so the join is an equi-join spread over the image.
    """
    tile = 64
    bands = outside_bands(regions, margin)
    rows = (bands.withColumn("py", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
                 .withColumn("_t", F.explode(F.sequence(F.floor(F.col("x1") / tile), F.floor((F.col("x2") - 1) / tile)))))
    source = pixels.select("image_id", F.col("py").cast("long").alias("py"), F.col("px").cast("long").alias("px"),
                           "r", "g", "b", "a").withColumn("_t", F.floor(F.col("px") / tile))
    hit = rows.join(source, ["image_id", "py", "_t"]).where("px >= x1 AND px < x2")
    found = dominant_color(hit, ["region_id"], ["band", "py", "px"])
    white = rgb(*WHITE)
    return (regions.select("region_id").join(found, "region_id", "left")
                   .select("region_id", *[F.coalesce(c, white[c]).alias(c) for c in ("r", "g", "b")]))


def crop_windows(crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page-space crop rectangles to pixel windows of their image, and the rejected rows.

    Needs ``image_x..image_h``, ``crop_x..crop_h`` and ``pixel_w``, ``pixel_h``.
    """
    i = {c: F.col(f"image_{c}") for c in "xywh"}
    c_ = {c: F.col(f"crop_{c}") for c in "xywh"}
    pw, ph = F.col("pixel_w"), F.col("pixel_h")
    lo_x, hi_x = F.greatest(i["x"], c_["x"]), F.least(i["x"] + i["w"], c_["x"] + c_["w"])
    lo_y, hi_y = F.greatest(i["y"], c_["y"]), F.least(i["y"] + i["h"], c_["y"] + c_["h"])
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = F.lit(True)
    for v in (*i.values(), *c_.values(), pw, ph):
        ok = ok & F.coalesce(finite(v.cast("double")), F.lit(False))
    ok = ok & (i["w"] > 0) & (i["h"] > 0) & (c_["w"] > 0) & (c_["h"] > 0) & (pw > 0) & (ph > 0)
    ok = F.coalesce(ok & (hi_x > lo_x) & (hi_y > lo_y), F.lit(False))
    top = i["y"] + i["h"]
    left = F.floor((lo_x - i["x"]) / i["w"] * pw)
    right = F.ceil((hi_x - i["x"]) / i["w"] * pw)
    upper = F.floor((top - hi_y) / i["h"] * ph)
    lower = F.ceil((top - lo_y) / i["h"] * ph)
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    windows = crops.where(ok).select(
        "*",
        F.greatest(zero, F.least(pw - 1, left)).alias("left"), F.greatest(zero, F.least(ph - 1, upper)).alias("top"),
        F.greatest(one, F.least(pw, right) - F.greatest(zero, left)).alias("width"),
        F.greatest(one, F.least(ph, lower) - F.greatest(zero, upper)).alias("height"))
    return windows, crops.where(~ok)


def fit_rect(x: Column, y: Column, w: Column, h: Column, pixel_w: Column, pixel_h: Column) -> Column:
    """Largest centred rectangle of the image's aspect ratio inside a target rectangle."""
    ratio = pixel_w / pixel_h
    wide = ratio >= w / h
    fw, fh = F.when(wide, w).otherwise(h * ratio), F.when(wide, w / ratio).otherwise(h)
    return F.struct((x + (w - fw) / 2).alias("x"), (y + (h - fh) / 2).alias("y"), fw.alias("w"), fh.alias("h"))
