"""Rectangle, affine and viewport column functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    """Four columns of one rectangle: bottom-left corner, width, height."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", x="x", y="y", w="w", h="h") -> "Rect":
        return cls(*(F.col(prefix + c) for c in (x, y, w, h)))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def top(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, ("x", "y", "w", "h"))]

    def padded(self, dx: Column, dy: Column) -> "Rect":
        return Rect(self.x - dx, self.y - dy, self.w + dx * 2, self.h + dy * 2)


def affine_mul(a: Column, b: Column) -> Column:
    """Apply ``b`` inside the transform ``a``; both are array<double> of six."""
    def cell(row: int, col: int) -> Column:
        value = a[row] * b[2 * col] + a[row + 2] * b[2 * col + 1]
        return value + a[row + 4] if col == 2 else value
    return F.array(*[cell(r, c) for c in range(3) for r in range(2)])


def affine_apply(m: Column, x, y) -> Column:
    return F.struct(
        (m[0] * x + m[2] * y + m[4]).alias("x"),
        (m[1] * x + m[3] * y + m[5]).alias("y"),
    )


def bbox(points: Column) -> Column:
    """Bounding rectangle struct of an array<struct<x,y>>."""
    xs, ys = points["x"], points["y"]
    x0, y0 = F.array_min(xs), F.array_min(ys)
    return F.struct(
        x0.alias("x"), y0.alias("y"),
        (F.array_max(xs) - x0).alias("w"), (F.array_max(ys) - y0).alias("h"),
    )


def transformed_bbox(m: Column, w=1.0, h=1.0) -> Column:
    """Bounding rectangle of the (0,0)-(w,h) box under ``m``."""
    w, h, zero = (F.lit(v) if not isinstance(v, Column) else v for v in (w, h, 0.0))
    return bbox(F.array(*[affine_apply(m, x, y) for x in (zero, w) for y in (zero, h)]))


def positive_finite(c: Column) -> Column:
    return F.coalesce((c > 0) & (c < float("inf")) & ~F.isnan(c), F.lit(False))


def scale_point(x: Column, y: Column, scale: Column, inverse: bool = False) -> Column:
    """Device-pixel scaling; a scale that is not positive and finite is an error."""
    ok = positive_finite(scale)
    checked = F.when(ok, scale).otherwise(
        F.raise_error(F.lit("scale must be a positive finite number")).cast("double"))
    return F.struct(
        (x / checked if inverse else x * checked).alias("x"),
        (y / checked if inverse else y * checked).alias("y"),
    )


def viewport_to_page(x: Column, y: Column, rotation: Column, width: Column, height: Column,
                     box_x: Column, box_y: Column, scale) -> Column:
    """Viewport pixel to unrotated page point for the four right-angle rotations."""
    vx, vy = x / scale, y / scale
    px = (F.when(rotation == 0, vx).when(rotation == 90, vy)
          .when(rotation == 180, width - vx).when(rotation == 270, width - vy))
    py = (F.when(rotation == 0, height - vy).when(rotation == 90, vx)
          .when(rotation == 180, vy).when(rotation == 270, height - vx))
    return F.struct((box_x + px).alias("x"), (box_y + py).alias("y"))


def page_to_viewport(x: Column, y: Column, rotation: Column, width: Column, height: Column,
                     box_x: Column, box_y: Column, scale) -> Column:
    """Inverse of :func:`viewport_to_page`."""
    px, py = x - box_x, y - box_y
    vx = (F.when(rotation == 0, px).when(rotation == 90, py)
          .when(rotation == 180, width - px).when(rotation == 270, height - py))
    vy = (F.when(rotation == 0, height - py).when(rotation == 90, px)
          .when(rotation == 180, py).when(rotation == 270, width - px))
    return F.struct((vx * scale).alias("x"), (vy * scale).alias("y"))


def rect_norm(a: Column, b: Column) -> Column:
    """Rectangle struct from two opposite corner structs, in any order."""
    return F.struct(
        F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"),
        F.abs(a["x"] - b["x"]).alias("w"), F.abs(a["y"] - b["y"]).alias("h"),
    )


def _extent(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def horizontal_overlap(a: Rect, b: Rect) -> Column:
    return _extent(a.x, a.right, b.x, b.right)


def horizontal_overlap_ratio(a: Rect, b: Rect) -> Column:
    return horizontal_overlap(a, b) / F.greatest(F.lit(1.0), F.least(a.w, b.w))


def intersection_area(a: Rect, b: Rect) -> Column:
    return horizontal_overlap(a, b) * _extent(a.y, a.top, b.y, b.top)


def fraction_inside(inner: Rect, outer: Rect) -> Column:
    """Share of ``inner``'s area inside ``outer``; null for an empty rectangle."""
    return F.when(inner.area > 0, intersection_area(outer, inner) / inner.area)


def rect_same(a: Rect, b: Rect, eps: float = 0.01, strict: bool = False) -> Column:
    """Equal within ``eps`` on all four columns; ``strict`` excludes ``eps`` itself."""
    out = F.lit(True)
    for p, q in zip(a, b):
        gap = F.abs(p - q)
        out = out & ((gap < eps) if strict else (gap <= eps))
    return out


def rect_contains(outer: Rect, inner: Rect, eps: float = 0.01) -> Column:
    return ((outer.x <= inner.x + eps) & (outer.y <= inner.y + eps)
            & (outer.right >= inner.right - eps) & (outer.top >= inner.top - eps))


def union_aggs(rect: Rect | None = None, prefix: str = "") -> list[Column]:
    """Aggregates giving the bounding rectangle of a group."""
    r = rect or Rect.of()
    return [
        F.min(r.x).alias(prefix + "x"), F.min(r.y).alias(prefix + "y"),
        (F.max(r.right) - F.min(r.x)).alias(prefix + "w"),
        (F.max(r.top) - F.min(r.y)).alias(prefix + "h"),
    ]
