"""Colour normalisation, comparison and five-bit quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r, g, b) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(float(c)) for c in (r, g, b)]
    return F.struct(*[c.alias(n) for c, n in zip(cols, ("r", "g", "b"))])


WHITE = (1.0, 1.0, 1.0)


def _unit(comps: Column, count: int) -> Column:
    """First ``count`` components as 0..1; 0..255 input is recognised by any value above 1."""
    used = F.slice(comps, F.lit(1), F.lit(count))
    scale = F.when(F.exists(used, lambda v: v > 1), 255.0).otherwise(1.0)
    return F.transform(used, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / scale)))


def to_rgb(space: Column, comps: Column) -> Column:
    """Colour struct of ``rgb``, ``gray`` or ``cmyk`` components; null when too few or when a used one is not a finite number."""
    c3, c1, c4 = _unit(comps, 3), _unit(comps, 1), _unit(comps, 4)
    ink = lambda i: 1 - F.least(F.lit(1.0), c4[i] + c4[3])
    used = F.slice(comps, F.lit(1), F.when(space == "rgb", 3).when(space == "gray", 1).otherwise(4))
    odd = F.exists(used, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n = F.when(odd, 0).otherwise(F.size(comps))
    return (F.when((space == "rgb") & (n >= 3), rgb(F.get(c3, F.lit(0)), F.get(c3, F.lit(1)), F.get(c3, F.lit(2))))
            .when((space == "gray") & (n >= 1), rgb(F.get(c1, F.lit(0)), F.get(c1, F.lit(0)), F.get(c1, F.lit(0))))
            .when((space == "cmyk") & (n >= 4), rgb(ink(0), ink(1), ink(2))))


def color_close(a: Column, b: Column, tolerance: float = 0.03) -> Column:
    return ((F.abs(a["r"] - b["r"]) <= tolerance) & (F.abs(a["g"] - b["g"]) <= tolerance)
            & (F.abs(a["b"] - b["b"]) <= tolerance))


def cover_color(explicit: Column, sampled: Column, use_sample: Column) -> Column:
    """Explicit colour, else the sampled one when asked for, else white."""
    return F.coalesce(explicit, F.when(use_sample, sampled), rgb(*WHITE))


def color_bucket(r: Column, g: Column, b: Column) -> Column:
    """Colour reduced to five bits per channel, as one number."""
    five = lambda c: F.shiftright(c, 3)
    return F.shiftleft(five(r), 10).bitwiseOR(F.shiftleft(five(g), 5)).bitwiseOR(five(b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722
