"""Advance widths of the standard fonts, and the width of a text in a font.

Widths are whole thousandths of the font size, so sums are exact in any order. Kerning is left out. A character
that a font's table lacks counts with the fallback width.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.text import STANDARD_FONTS

#: Width of a character without a metric, in thousandths of the size.
FALLBACK = 550

# Advance widths of the characters from space to tilde, then of the characters of TYPOGRAPHIC.
TYPOGRAPHIC = "‘’“”–—•…€"
HELVETICA = """
278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278
556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778
667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556
556 556 333 500 278 556 500 722 500 500 500 334 260 334 584
222 222 333 333 556 1000 350 1000 556"""
HELVETICA_BOLD = """
278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278
556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778
667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611
611 611 389 556 333 611 556 778 556 556 500 389 280 389 584
278 278 500 500 556 1000 350 1000 556"""
TIMES_ROMAN = """
250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278
500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444
921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722
556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500
333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500
500 500 333 389 278 500 500 722 500 500 444 480 200 480 541
333 333 444 444 500 1000 350 1000 500"""
TIMES_BOLD = """
250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278
500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500
930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778
611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500
333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500
556 556 444 389 333 556 500 722 500 500 444 394 220 394 520
333 333 500 500 500 1000 350 1000 500"""
TIMES_ITALIC = """
250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278
500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500
920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722
611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500
333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500
500 500 389 389 278 500 444 667 444 444 389 400 275 400 541
333 333 556 556 500 889 350 889 500"""
TIMES_BOLD_ITALIC = """
250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278
500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500
832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722
611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500
333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500
500 500 389 389 278 556 444 667 500 444 389 348 220 348 570
333 333 500 500 500 1000 350 1000 500"""
COURIER = "600 " * (95 + len(TYPOGRAPHIC))
#: Slanted faces of Helvetica and Courier have the upright widths.
FACES = {
    "Times-Roman": TIMES_ROMAN, "Times-Bold": TIMES_BOLD, "Times-Italic": TIMES_ITALIC, "Times-BoldItalic": TIMES_BOLD_ITALIC,
    "Helvetica": HELVETICA, "Helvetica-Bold": HELVETICA_BOLD, "Helvetica-Oblique": HELVETICA, "Helvetica-BoldOblique": HELVETICA_BOLD,
    "Courier": COURIER, "Courier-Bold": COURIER, "Courier-Oblique": COURIER, "Courier-BoldOblique": COURIER,
}
DOTLESS_I = 278  # an accented i is as wide as one without its dot, where the pitch isn't fixed

#: Characters below this have their place in a width array.
DIRECT = 0x180


def widths(font: str, fallback: int = FALLBACK) -> dict[str, int]:
    """Width of each character that ``font`` has a metric for, accented Latin letters included.

    An accented letter is as wide as its base letter; tabs and no-break spaces are as wide as a space.
    """
    listed = [int(w) for w in FACES[font].split()]
    out = {chr(32 + i): w for i, w in enumerate(listed[:95])}
    out.update(zip(TYPOGRAPHIC, listed[95:]))
    out.update(dict.fromkeys("\t\x0b\f ", listed[0]))
    for code in range(0xC0, DIRECT):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            out[chr(code)] = DOTLESS_I if parts[0] == "i" and "Courier" not in font else out[parts[0]]
    return out


@dataclass(frozen=True)
class FontWidth:
    """Measure with a font's advance widths.

    ``font`` is the name of a standard font or a column of such names (another name: every character
    has the fallback width); ``size_pt`` is a number or a column.
    """

    font: str | Column
    size_pt: float | Column
    fallback: int = FALLBACK

    def table(self) -> Column:
        """The widths of the characters below ``DIRECT``, by code point."""
        def row(name: str) -> Column:
            known = widths(name, self.fallback)
            return F.array(*(F.lit(known.get(chr(c), self.fallback)) for c in range(DIRECT)))
        return self._chosen(row)

    def others(self) -> Column:
        """The widths of ``TYPOGRAPHIC``, in its order."""
        return self._chosen(lambda name: F.array(*(F.lit(widths(name)[c]) for c in TYPOGRAPHIC)))

    def _chosen(self, row) -> Column:
        if isinstance(self.font, str):
            return row(self.font)
        alike: dict[str, list[str]] = {}
        for name, listed in FACES.items():
            alike.setdefault(listed, []).append(name)
        out = None
        for names in alike.values():
            out = (F if out is None else out).when(self.font.isin(*names), row(names[0]))
        return out

    def limit(self, max_width: float | Column) -> Column:
        """The most thousandths of the size that stay within ``max_width``."""
        size, most = (x if isinstance(x, Column) else F.lit(float(x)) for x in (self.size_pt, max_width))
        near = F.floor(most * 1000 / size)
        width = lambda n: n * size / 1000
        return let(near, lambda n: n + (width(n + 1) <= most).cast("long") - (width(n) > most).cast("long"))

    def usable(self, max_width: float | Column) -> Column:
        """Whether size and ``max_width`` are finite numbers above 0."""
        fine = F.lit(True)
        for x in (self.size_pt, max_width):
            x = x if isinstance(x, Column) else F.lit(float(x))
            fine = fine & F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))
        return fine

    def units(self, text: Column, table: Column, others: Column) -> Column:
        """Thousandths of the size that ``text`` takes; the arrays are bound outside loops, with ``let``."""
        def char(c: Column) -> Column:
            code = F.ascii(c)
            spot = F.instr(F.lit(TYPOGRAPHIC), c)
            width = F.when(code < DIRECT, F.get(table, code)).when(spot > 0, F.get(others, spot - 1))
            return F.coalesce(width, F.lit(self.fallback)).cast("long")
        # An empty pattern cuts between characters, at a third of a regular expression's cost; an empty text would be one piece.
        none = F.lit(0).cast("long")
        return F.when(text == "", none).otherwise(F.aggregate(F.split(text, ""), none, lambda acc, c: acc + char(c)))

    def __call__(self, text: Column) -> Column:
        """The width of ``text`` in points."""
        size = self.size_pt if isinstance(self.size_pt, Column) else F.lit(float(self.size_pt))
        return let(self.table(), lambda t: let(self.others(), lambda o: self.units(text, t, o))) * size / 1000


@dataclass(frozen=True)
class StyledWidth:
    """Measure each character in the face of its style: a family (``serif``, ``sans``, ``mono``) and a size."""

    family: str
    size_pt: float
    fallback: int = FALLBACK

    def faces(self) -> list[tuple[bool, bool, FontWidth]]:
        return [(bold, italic, FontWidth(name, self.size_pt, self.fallback)) for family, bold, italic, name in STANDARD_FONTS if family == self.family]

    def limit(self, max_width: float | Column) -> Column:
        return FontWidth("Courier", self.size_pt).limit(max_width)

    def bound(self, body) -> Column:
        """``body(units)``, where ``units(text, at, ranges)`` measures a text from offset ``at`` on, by the styles' ranges."""
        kinds = self.faces()
        tables = F.array(*(F.struct(face.table().alias("t"), face.others().alias("o")) for _, _, face in kinds))

        def inner(held: Column) -> Column:
            def units(text: Column, at: Column, ranges: Column) -> Column:
                end = at + F.length(text)

                def part(r: Column) -> Column:
                    lo, hi = F.greatest(r["start"], at), F.least(r["stop"], end)
                    kind = F.coalesce(r["bold"], F.lit(False)).cast("int") + 2 * F.coalesce(r["italic"], F.lit(False)).cast("int")
                    own = F.get(held, F.get(F.array(*(F.lit(place[k]) for k in range(4))), kind))
                    return kinds[0][2].units(F.substring(text, lo - at + 1, hi - lo), own["t"], own["o"])

                inside = F.filter(ranges, lambda r: (r["start"] < end) & (r["stop"] > at))
                return F.aggregate(inside, F.lit(0).cast("long"), lambda acc, r: acc + part(r))

            return body(units)

        place = {bold + 2 * italic: k for k, (bold, italic, _) in enumerate(kinds)}
        return let(tables, inner)
