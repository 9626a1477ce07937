"""Image regions: text behind them, duplicates, and regions already covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text as tx
from pageloom.functions.geometry import Rect, fraction_inside, rect_same
from pageloom.plans.folds import fold_columns
from pageloom.plans.grid import grid_pairs, meet, with_cell_mates
from pageloom.schemas import PAGE

EPS = 0.01
COVER_ID = "^image-(cover|delete-cover|crop-cover)-"  # fixed value


def text_backed_regions(regions: DataFrame, runs: DataFrame, paragraph_text: float = 160,
                        inside: float = 0.6) -> DataFrame:
    """Adds ``has_text`` and ``paragraph`` from the runs lying mostly inside each region."""
    if not 0 <= paragraph_text < float("inf"):
        raise ValueError("paragraph_text must be a non-negative finite number")
    if not 0 <= inside <= 1:
        raise ValueError("inside must be between 0 and 1")
    slim = (runs.select(*PAGE, tx.utrim(F.col("text")).alias("_t"),
                        *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "w", "h")])
                .where((F.col("_t") != "") & (F.col("t_w") * F.col("t_h") > 0)).withColumn("_t", F.length("_t")))
    region, run = Rect.of(), Rect.of("t_")
    # A run that lies inside for more than half has its centre inside: one copy, and no size to ask for.
    zero, by_centre = F.lit(0.0), inside > 0.51
    spot = Rect(run.x + run.w / 2, run.y + run.h / 2, zero, zero) if by_centre else run
    near = with_cell_mates(slim, regions.select(*PAGE, "region_id", "x", "y", "w", "h").where(F.col("region_id").isNotNull()), PAGE, spot, region,
                           large="right" if by_centre else "both")
    pairs = (near.withColumn("_mate", F.explode("_mates")).select("*", "_mate.*")
                 .where(meet(spot, region) & (fraction_inside(run, region) >= inside)))
    # Regions and what they hold meet in a window, which leaves rows that lie together by page where they are.
    keys = [*PAGE, "region_id"]
    chars = pairs.groupBy(*keys).agg(F.sum("_t").alias("_chars"))
    row = F.struct(*(F.col(c) for c in regions.columns))
    both = (regions.select(*keys, row.alias("_row"), F.lit(None).cast("long").alias("_chars"))
                   .unionByName(chars.select(*keys, F.lit(None).cast(regions.select(row).schema[0].dataType).alias("_row"), "_chars")))
    held = both.withColumn("_chars", F.max("_chars").over(W.partitionBy(*keys))).where(F.col("_row").isNotNull()).select("_row.*", "_chars")
    count = F.coalesce("_chars", F.lit(0))
    return (held.withColumn("has_text", F.col("_chars").isNotNull())
                .withColumn("paragraph", count > paragraph_text)
                .withColumn("n_chars", count).drop("_chars"))


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """Drop regions equal within 0.01 to an earlier kept one of the same page.

    Exact copies are merged map-side first. The rest are compared only inside
    stretches of left edges, then of lower edges, that chain within the tolerance.
    """
    unique = regions.groupBy(*PAGE, "x", "y", "w", "h").agg(F.min("region_id").alias("region_id"))
    by_x = W.partitionBy(*PAGE).orderBy("x")
    apart = F.coalesce(F.col("x") - F.lag("x").over(by_x) > EPS, F.lit(True)).cast("int")
    chained = unique.withColumn("_a", apart).withColumn("_gx", F.sum("_a").over(by_x))
    by_y = W.partitionBy(*PAGE, "_gx").orderBy("y")
    apart = F.coalesce(F.col("y") - F.lag("y").over(by_y) > EPS, F.lit(True)).cast("int")
    chained = chained.withColumn("_a", apart).withColumn("_gy", F.sum("_a").over(by_y)).drop("_a")

    def keep(kept: dict, row: tuple) -> tuple:
        # A kept rectangle within the tolerance is in the unit cell of v - EPS or of v + EPS.
        near = [()]
        for v in row:
            near = [n + (c,) for n in near for c in {(v - EPS) // 1, (v + EPS) // 1}]
        for cell in near:
            for other in kept.get(cell, ()):
                if all(abs(p - q) <= EPS for p, q in zip(row, other)):
                    return (False,)
        kept.setdefault(tuple(v // 1 for v in row), []).append(row)
        return (True,)

    folded = fold_columns(chained, [*PAGE, "_gx", "_gy"], ["region_id"], ["x", "y", "w", "h"], dict, keep,
                          T.StructType([T.StructField("_keep", T.BooleanType())]))
    return folded.where("_keep").select(*PAGE, "region_id", "x", "y", "w", "h")


def uncovered_regions(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions without an image cover edit of the same rectangle (within 0.01)."""
    covers = (edits.where((F.col("kind") == "cover") & F.col("id").rlike(COVER_ID))
                   .select(*PAGE, *[F.col(c).alias(f"c_{c}") for c in ("x", "y", "w", "h")]).distinct())
    region, cover = Rect.of(), Rect.of("c_")
    zero = F.lit(0.0)
    pairs = grid_pairs(
        regions.select(*PAGE, "region_id", "x", "y", "w", "h"), covers, PAGE,
        Rect(region.x, region.y, zero, zero),
        Rect(cover.x - EPS * 2, cover.y - EPS * 2, F.lit(EPS * 4), F.lit(EPS * 4)),
        rect_same(region, cover, EPS), large="right")
    return regions.join(pairs.select(*PAGE, "region_id").distinct(), [*PAGE, "region_id"], "left_anti")
