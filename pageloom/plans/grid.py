"""Spatial joins as equi-joins on a page grid of three levels.

A rectangle lives on the finest level on which it touches at most ``MOST`` cells: the fine grid, a grid of cells
16 times as wide and high, or the page as a whole. So a page-wide or infinite rectangle is copied no more often than
a small one. Two rectangles meet on the coarser of their levels: each also probes the levels above its own that the
other side uses, and a probe meets only what lives there. Which levels a side uses is asked before the join, by an
aggregate over its edges: where all rectangles are small, nothing is probed. A crowded page is spread over its cells and never forms all pairs; each touching
pair is kept in exactly one cell, the one holding the lower-left corner of the intersection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions.geometry import Rect
from pageloom.plans.sizing import expanded_partitions

CELL = (128.0, 64.0)
#: Width of a level's cells in cells of the fine grid; the level after the last is the page.
SCALES = (1, 16)
PAGE_LEVEL = len(SCALES)
#: Cells that a rectangle touches at most on its own level.
MOST = 16
#: Coordinates from here on have no cell: such rectangles live on the page level.
FAR = 2.0 ** 50


def _level(rect: Rect, cell: tuple[float, float]) -> Column:
    """The level a rectangle lives on; null for one without a place: a null or NaN edge, or a negative size."""
    edges = (rect.x, rect.y, rect.right, rect.top)
    real, near = F.lit(True), F.lit(True)
    for e in edges:
        real, near = real & e.isNotNull() & ~F.isnan(e), near & (F.abs(e) < FAR)
    real = real & (rect.right >= rect.x) & (rect.top >= rect.y)
    out = F.when(~F.coalesce(real, F.lit(False)), F.lit(None).cast("int"))
    for k, scale in enumerate(SCALES):
        cells = F.lit(1.0)
        for lo, hi, size in ((rect.x, rect.right, cell[0] * scale), (rect.y, rect.top, cell[1] * scale)):
            cells = cells * (F.floor(hi / size).cast("double") - F.floor(lo / size).cast("double") + 1)
        out = out.when(near & (cells <= MOST), F.lit(k))
    return out.otherwise(F.lit(PAGE_LEVEL))


def coarse_levels(df: DataFrame, rect: Rect, cell=CELL) -> list[int]:
    """The levels above the fine grid on which rectangles live: one pass over their edges."""
    found = df.select(_level(rect, cell).alias("k")).agg(F.collect_set(F.when(F.col("k") > 0, F.col("k")))).first()[0]
    return sorted(found)


def on_grid(df: DataFrame, rect: Rect, probed: list[int] = (), tag: int = 0, meets_probes: bool = False, cell=CELL) -> DataFrame:
    """Copies of each row for its cells, in ``_code, _cx, _cy``; the code is twice the level, plus a tag.

    Tag 0 joins what lives in a cell. ``probed`` are coarser levels, on which a row has copies with ``tag``; with
    ``meets_probes`` what lives on such a level has copies with tag 1 too. A rectangle without a place has one copy
    without a code. (Outer explodes: a filter on the code would be pushed down and repeat the edges' expressions.)
    """
    def codes(k: int) -> Column:
        own = [2 * k, 2 * k + 1] if meets_probes and k else [2 * k]
        return F.array(*(F.lit(c) for c in own + [2 * j + tag for j in probed if j > k]))

    lives = F.col("_lives")
    chosen = F.when(lives == 0, codes(0))
    for k in range(1, PAGE_LEVEL + 1):
        chosen = chosen.when(lives == k, codes(k))

    def cells(lo: Column, hi: Column, size: float) -> Column:
        low = high = F.when(F.col("_code").isNotNull(), F.lit(0).cast("long"))
        for k, scale in reversed(list(enumerate(SCALES))):
            here = F.col("_code") < 2 * (k + 1)
            low, high = F.when(here, F.floor(lo / (size * scale))).otherwise(low), F.when(here, F.floor(hi / (size * scale))).otherwise(high)
        return F.explode_outer(F.sequence(low, high))

    out = df.withColumn("_lives", _level(rect, cell))
    return (out.withColumn("_code", F.explode_outer(chosen)).withColumn("_cx", cells(rect.x, rect.right, cell[0]))
               .withColumn("_cy", cells(rect.y, rect.top, cell[1])).drop("_lives"))


def _touching(left: Rect, right: Rect) -> Column:
    return (left.x <= right.right) & (right.x <= left.right) & (left.y <= right.top) & (right.y <= left.top)


def _home(left: Rect, right: Rect, cell: tuple[float, float]) -> Column:
    """Whether the copies in ``_code, _cx, _cy`` are those that keep the pair."""
    home = F.col("_code") >= 2 * PAGE_LEVEL
    for k, scale in enumerate(SCALES):
        home = home | (F.col("_code").between(2 * k, 2 * k + 1)
                       & (F.floor(F.greatest(left.x, right.x) / (cell[0] * scale)) == F.col("_cx"))
                       & (F.floor(F.greatest(left.y, right.y) / (cell[1] * scale)) == F.col("_cy")))
    return home


def with_cell_mates(rows: DataFrame, others: DataFrame, keys: list[str], rect: Rect, others_rect: Rect,
                    large: str = "both", cell=CELL) -> DataFrame:
    """``rows`` in the cells of ``grid_pairs``, each copy with all ``others`` of its cell: an array of structs, ``_mates``.

    For sides that lie together by ``keys`` or the first of them already, in equal numbers of partitions: a union and a
    window leave such rows where they are, while a join on cells moves both sides. Rows that lie elsewhere are moved once,
    by cell. The mates of a cell are held in memory and come with each of its rows, so ``others`` should be the side of
    fewer or smaller rows. They touch the row or not; ``meet`` tells, in one cell for each pair. A row with a null key or
    without a place has one copy and no mates. ``large`` is as in ``grid_pairs``, ``rows`` being on the left.
    """
    if large not in ("left", "right", "both"):
        raise ValueError("large is left, right or both")
    of_rows = coarse_levels(rows, rect, cell) if large in ("left", "both") else []
    of_others = coarse_levels(others, others_rect, cell) if large in ("right", "both") else []
    place = [*keys, "_code", "_cx", "_cy"]
    placed = F.col("_code").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    mine = on_grid(rows, rect, of_others, 1, False, cell)
    mate = F.struct(*(F.col(c) for c in others.columns if c not in keys))
    # Not a filter on the keys: that would make another scan of a table that both sides read.
    theirs = on_grid(others, others_rect, of_rows, 0, bool(of_others), cell).select(*place, F.when(placed, mate).alias("_mate"))
    both = mine.withColumn("_mate", F.lit(None).cast(theirs.schema["_mate"].dataType)).withColumn("_mine", F.lit(True)).unionByName(
        theirs, allowMissingColumns=True)
    return both.withColumn("_mates", F.collect_list("_mate").over(W.partitionBy(*place))).where("_mine").drop("_mate", "_mine")


def meet(rect: Rect, other: Rect, cell=CELL) -> Column:
    """Whether a row and a mate touch, true in one cell for each pair."""
    return _touching(rect, other) & _home(rect, other, cell)


def grid_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_rect: Rect, right_rect: Rect,
               condition: Column | None = None, cell=CELL, large: str = "both") -> DataFrame:
    """Pairs of touching rectangles with equal ``keys``; other columns must not clash.

    A rectangle with a null or NaN edge or a negative size touches nothing; one of infinite size touches what it
    holds. ``large`` names the sides (``left``, ``right``, ``both``) that may hold a rectangle of more than ``MOST``
    cells, and which are asked for the levels they use (a job); the other side must have a known bound. The right side's key
    columns are renamed internally and dropped.
    """
    if large not in ("left", "right", "both"):
        raise ValueError("large is left, right or both")
    renamed = {k: f"_r_{k}" for k in keys}
    large_left, large_right = large in ("left", "both"), large in ("right", "both")
    of_left = coarse_levels(left, left_rect, cell) if large_left else []
    of_right = coarse_levels(right, right_rect, cell) if large_right else []
    rdf = on_grid(right, right_rect, of_left, 0, bool(of_right), cell)
    for k, r in {**renamed, **{c: f"_r{c}" for c in ("_code", "_cx", "_cy")}}.items():
        rdf = rdf.withColumnRenamed(k, r)
    ldf = on_grid(left, left_rect, of_right, 1, False, cell)
    parts = expanded_partitions(left, right)
    if parts > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # Large inputs: partitions of one size, so that the join's sorts stay in memory.
        ldf = ldf.repartition(parts, *keys, "_code", "_cx", "_cy")
        rdf = rdf.repartition(parts, *renamed.values(), "_r_code", "_r_cx", "_r_cy")
    on = F.lit(True)
    for c in ("_code", "_cx", "_cy"):
        on = on & (F.col(c) == F.col(f"_r{c}"))
    for k, r in renamed.items():
        on = on & (F.col(k) == F.col(r))
    on = on & _touching(left_rect, right_rect) & _home(left_rect, right_rect, cell)
    if condition is not None:
        on = on & condition
    return ldf.join(rdf, on).drop("_code", "_cx", "_cy", "_r_code", "_r_cx", "_r_cy", *renamed.values())
