"""Expected against actual: keyed mismatch ratios and nearest positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.plans.sizing import expanded_partitions


def diff_ratio(expected: DataFrame, actual: DataFrame, group: list[str], keys: list[str],
               values: list[str], threshold: float = 0.1, scale: float = 255.0) -> DataFrame:
    """Share of rows that differ, per group.

    Rows are matched on ``group + keys`` and differ when a value differs by more
    than ``threshold * scale``. A group whose two sides have different extents
    (a missing partner on either side) scores 1; one that a side lacks altogether is ``absent``.
    """
    side = lambda df, p: df.select(*group, *keys, *[F.col(v).alias(f"{p}{v}") for v in values], F.lit(1).alias(f"{p}here"))
    both = side(expected, "_e_").join(side(actual, "_a_"), [*group, *keys], "full")
    off = F.lit(False)
    for v in values:
        off = off | (F.abs(F.col(f"_e_{v}") - F.col(f"_a_{v}")) > threshold * scale)
    lone = F.col("_e_here").isNull() | F.col("_a_here").isNull()
    counted = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(off).alias("n_mismatched"), F.count_if(lone).alias("n_unmatched"),
        (F.count("_e_here") == 0).alias("n_absent_expected"), (F.count("_a_here") == 0).alias("n_absent_actual"))
    counted = counted.withColumn("absent", F.col("n_absent_expected") | F.col("n_absent_actual")).drop("n_absent_expected", "n_absent_actual")
    return counted.withColumn("ratio", F.when(F.col("n_unmatched") > 0, 1.0).otherwise(
        F.col("n_mismatched") / F.col("n_rows")))


# --- perceptual difference of images -----------------------------------------------

# Brightness and the two colour differences from red, green and blue; their shares of the squared
# distance; the largest squared distance there is.
LUMA = (0.29889531, 0.58662247, 0.11448223)
IN_PHASE = (0.59597799, -0.27417610, -0.32180189)
QUADRATURE = (0.21147017, -0.52261711, 0.31114694)
SHARES = (0.5053, 0.299, 0.1957)
LARGEST = 35215.0
#: Edge of a tile, and how far the test of a pixel looks: its neighbours, and theirs.
TILE, HALO = 64, 2


def _weighted(rgb: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    return rgb[..., 0] * weights[0] + rgb[..., 1] * weights[1] + rgb[..., 2] * weights[2]


def _on_white(rgba: np.ndarray) -> np.ndarray:
    """Colours as seen over white."""
    rgb, alpha = rgba[..., :3], rgba[..., 3:]
    return np.where(alpha < 255, 255 + (rgb - 255) * (alpha / 255), rgb)


class _Picture:
    """One side of a tile with its halo: colours, presence, and what the eight neighbours say of each pixel.

    The arrays have one more ring than the halo, so that every pixel has eight places around it.
    """

    AROUND = [(dy, dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]

    def __init__(self, rgba: np.ndarray, here: np.ndarray):
        self.rgba, self.here, self.seen = rgba, here, _on_white(rgba)
        self.luma = _weighted(self.seen, LUMA)
        side = lambda a, dy, dx: np.roll(a, (-dy, -dx), (0, 1))
        # A pixel at the picture's edge counts as having one equal neighbour.
        inner = side(here, -1, 0) & side(here, 1, 0) & side(here, 0, -1) & side(here, 0, 1)
        edge = (~inner).astype(np.int8)
        alike, equal = edge.copy(), edge.copy()
        low, high = np.zeros(here.shape), np.zeros(here.shape)
        self.low_at, self.high_at = (np.full(here.shape, -1, np.int8) for _ in range(2))
        for k, (dy, dx) in enumerate(self.AROUND):
            there = side(here, dy, dx)
            same = (side(rgba, dy, dx) == rgba).all(-1) & there
            delta = np.where(same | ~there, 0.0, self.luma - side(self.luma, dy, dx))
            alike += same
            equal += there & (delta == 0)
            darker, lighter = there & (delta < low), there & (delta > high)
            low, high = np.where(darker, delta, low), np.where(lighter, delta, high)
            self.low_at[darker], self.high_at[lighter] = k, k
        self.flat = alike > 2          # three or more neighbours of the very same colour
        self.between = (equal <= 2) & (self.low_at >= 0) & (self.high_at >= 0)

    def smoothed(self, other: "_Picture") -> np.ndarray:
        """Pixels between a lighter and a darker neighbour, one of which lies in a flat area of both pictures."""
        both = self.flat & other.flat
        out = np.zeros(self.here.shape, bool)
        for k, (dy, dx) in enumerate(self.AROUND):
            out |= ((self.low_at == k) | (self.high_at == k)) & np.roll(both, (-dy, -dx), (0, 1))
        return out & self.between


def _tile_counts(x: np.ndarray, y: np.ndarray, rgba: np.ndarray, actual: np.ndarray, size: int, threshold: float, smoothing: bool) -> tuple[int, ...]:
    """Rows, mismatches, unmatched, expected and actual pixels of a tile; ``x`` and ``y`` run from ``-HALO`` to ``size + HALO``."""
    ring = HALO + 1
    sides = []
    for which in (False, True):
        at = actual == which
        here, colours = np.zeros((size + 2 * ring,) * 2, bool), np.zeros((size + 2 * ring,) * 2 + (4,))
        here[y[at] + ring, x[at] + ring] = True
        colours[y[at] + ring, x[at] + ring] = rgba[at]
        sides.append(_Picture(colours, here))
    want, have = sides
    core = np.zeros(want.here.shape, bool)
    core[ring:-ring, ring:-ring] = True
    both = want.here & have.here & core
    change = [(_weighted(want.seen, w) - _weighted(have.seen, w)) for w in (LUMA, IN_PHASE, QUADRATURE)]
    distance = SHARES[0] * change[0] * change[0] + SHARES[1] * change[1] * change[1] + SHARES[2] * change[2] * change[2]
    off = both & (distance > LARGEST * threshold * threshold)
    if smoothing and off.any():
        off &= ~(want.smoothed(have) | have.smoothed(want))
    there, lone = (want.here | have.here) & core, (want.here ^ have.here) & core
    return tuple(int(m.sum()) for m in (there, off, lone, want.here & core, have.here & core))


def image_mismatch(expected: DataFrame, actual: DataFrame, group: list[str], x: str = "px", y: str = "py",
                   channels: tuple[str, ...] = ("r", "g", "b", "a"), threshold: float = 0.1, tile: int = TILE,
                   smoothing: bool = True) -> DataFrame:
    """``diff_ratio`` for pictures: share of pixels whose colour differs to the eye, per group.

    Colours (0 to 255) are laid over white and compared by brightness and hue; a pixel that only smooths an edge of
    either picture doesn't count, unless ``smoothing`` is off. Pictures of different extents score 1. Pixels are dealt to tiles of ``tile`` x
    ``tile`` with a rim of neighbours, in one shuffle: a picture of any size takes many tasks. A null channel counts
    as 255. Rows without a coordinate are left out; of pixels with one place, one counts.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold lies between 0 and 1")
    names = ["_c0", "_c1", "_c2", "_c3"]

    def side(df: DataFrame, is_actual: bool) -> DataFrame:
        colours = [F.coalesce(F.col(c), F.lit(255)).cast("double").alias(n) for c, n in zip(channels, names)]
        return df.select(*group, F.col(x).cast("int").alias("_x"), F.col(y).cast("int").alias("_y"), *colours, F.lit(is_actual).alias("_actual"))

    reach = lambda c: F.sequence(F.floor((F.col(c) - HALO) / tile), F.floor((F.col(c) + HALO) / tile))
    dealt = side(expected, False).unionByName(side(actual, True)).where("_x IS NOT NULL AND _y IS NOT NULL")
    dealt = dealt.withColumn("_tx", F.explode(reach("_x"))).withColumn("_ty", F.explode(reach("_y")))
    counts = ("n_rows", "n_mismatched", "n_unmatched", "n_expected", "n_actual")
    schema = T.StructType([dealt.schema[g] for g in group] + [T.StructField(c, T.LongType()) for c in counts])
    whole = tuple(group)

    def run(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        x0, y0 = int(rows.column("_tx")[0].as_py()) * tile, int(rows.column("_ty")[0].as_py()) * tile
        got = _tile_counts(column("_x") - x0, column("_y") - y0, np.stack([column(n) for n in names], -1), column("_actual").astype(bool), tile, threshold, smoothing)
        return pa.table({**{g: rows.column(g).combine_chunks()[:1] for g in whole}, **{c: pa.array([n], pa.int64()) for c, n in zip(counts, got)}})

    # A tile's rows are bounded by its area.
    tiles = dealt.groupBy(*group, "_tx", "_ty").applyInArrow(run, schema)
    summed = tiles.groupBy(*group).agg(*(F.sum(c).alias(c) for c in counts)).where("n_rows > 0")
    ratio = F.when(F.col("n_unmatched") > 0, 1.0).otherwise(F.col("n_mismatched") / F.col("n_rows"))
    return summed.select(*group, *counts[:3], ((F.col("n_expected") == 0) | (F.col("n_actual") == 0)).alias("absent"), ratio.alias("ratio"))


def scenario_result(ratios: DataFrame, scenario: list[str], tolerance: float = 0.001,
                    scored: Column | None = None) -> DataFrame:
    """Worst scored ratio of each scenario and whether it stays within the tolerance.

    With a page missing on one side (``absent``) the whole scenario fails with 1, whether
    that page is scored or not.
    """
    counts = F.when(scored, F.col("ratio")).otherwise(0.0) if scored is not None else F.col("ratio")
    counts = F.when(F.col("absent"), 1.0).otherwise(counts)
    worst = ratios.groupBy(*scenario).agg(F.max(counts).alias("ratio"), F.count(F.lit(1)).alias("n_groups"))
    return worst.withColumn("pass", F.col("ratio") <= tolerance)


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_pos: str,
                   right_pos: str, right_ord: str, threshold: float) -> DataFrame:
    """Nearest right position of each left row within ``threshold``, first on ties.

    Left rows without one are absent. The result has ``delta`` (right minus left).
    Equal right positions are merged first. Positions are cut into buckets one
    threshold wide and right rows are also put in both neighbours, so each left row
    only looks at the right row before and after it in its own bucket: no pairs
    are formed, and a busy key is spread over its buckets.
    """
    keep = [c for c in right.columns if c not in on]
    unique = right.groupBy(*on, F.col(right_pos).alias("_pos")).agg(
        F.min_by(F.struct(*keep), right_ord).alias("_right"))
    bucket = lambda c: F.floor(F.col(c) / threshold)
    spread = unique.withColumn("_b", F.explode(F.array(*[bucket("_pos") + d for d in (-1, 0, 1)])))
    rows = left.select(*on, F.col(left_pos).alias("_pos"), bucket(left_pos).alias("_b"), F.struct(left_id, left_pos).alias("_left"))
    # As many partitions as the rows need: a union forgets those of its sides, and two sorts follow.
    both = rows.unionByName(spread, allowMissingColumns=True).repartition(expanded_partitions(left, right), *on, "_b")
    # At one position the right row sorts first in both directions.
    left_last = F.col("_left").isNotNull()
    up = W.partitionBy(*on, "_b").orderBy(F.col("_pos"), left_last)
    down = W.partitionBy(*on, "_b").orderBy(F.col("_pos").desc(), left_last)
    seen = F.last("_right", ignorenulls=True)
    near = both.withColumn("_lo", seen.over(up)).withColumn("_hi", seen.over(down)).where(left_last)
    gap = lambda c: F.abs(F.col(c)[right_pos] - F.col("_pos"))
    rank = lambda c: F.when(gap(c) <= threshold, F.struct(gap(c).alias("d"), F.col(c)[right_ord].alias("o"), F.col(c).alias("r")))
    picked = near.withColumn("_n", F.array_min(F.filter(F.array(rank("_lo"), rank("_hi")), lambda r: r.isNotNull())))
    return (picked.where(F.col("_n").isNotNull())
                  .select(*on, f"_left.{left_id}", f"_left.{left_pos}", "_n.r.*",
                          (F.col("_n.r")[right_pos] - F.col("_pos")).alias("delta")))
