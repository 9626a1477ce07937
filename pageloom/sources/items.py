"""Text-run sources: extracted text items, or plain document text set on pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions.geometry import affine_apply, bbox
from pageloom.plans.sizing import expansion_partitions


def style_struct(font_name: Column, size: Column, bold: Column, italic: Column) -> Column:
    black = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b")])
    return F.struct(font_name.alias("font_name"), size.cast("double").alias("font_size_pt"),
                    bold.alias("bold"), italic.alias("italic"), black.alias("color"))


def runs_from_items(items: DataFrame) -> DataFrame:
    """Runs from ``(doc_id, page_index, item_ord, text, matrix, width, height, font_name)``.

    ``matrix`` places the item in page space. Blank text, zero width and a
    degenerate matrix are dropped. Item sizes are in device units, so they are
    divided by the matrix scale before the matrix is applied.
    """
    m = F.col("matrix")
    hscale, vscale = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    keep = items.where((tx.utrim(F.col("text")) != "") & (F.col("width") != 0) & (hscale != 0) & (vscale != 0))
    w, h = F.col("width") / hscale, F.col("height") / vscale
    zero = F.lit(0.0)
    box = bbox(F.array(*[affine_apply(m, x, y) for x in (zero, w) for y in (zero, h)]))
    name = F.col("font_name")
    return (keep.withColumn("_box", box)
                .select("doc_id", "page_index", F.col("item_ord").alias("run_ord"), "text", "_box.*",
                        style_struct(name, vscale, tx.font_bold(name), tx.font_italic(name)).alias("style")))


def runs_from_text(documents: DataFrame, words_per_row: int = 12, rows_per_page: int = 48,
                   top: float = 760.0, left: float = 40.0, leading: float = 14.0, size: float = 10.0,
                   glyph: float = 5.0,
                   gap: Callable[[Column], Column] = lambda i: F.lit(3.0),
                   shift: Callable[[Column], Column] = lambda i: F.lit(0.0),
                   lift: Callable[[Column], Column] = lambda i: F.lit(0.0),
                   drop: Callable[[Column], Column] = lambda r: F.lit(0.0),
                   font_name: Column | None = None,
                   bold: Callable[[Column], Column] = lambda r: F.lit(False),
                   row_starts: bool = False) -> DataFrame:
    """Set the words of each document on fixed pages, one run per word.

    ``gap(i)`` is the space after word ``i``, ``shift(i)`` and ``lift(i)`` move it,
    ``drop(r)`` lowers page row ``r``. With ``row_starts`` only the first run of
    each row is made. Documents are hash-partitioned on
    ``doc_id`` while still compact; the words are expanded after that, so later
    per-page windows find their rows in place.
    """
    name = font_name if font_name is not None else F.lit("Helvetica")
    docs = (documents.select("doc_id", "text").withColumn("_font", name)
                     .withColumn("_heavy", tx.font_bold(F.col("_font"))).withColumn("_slanted", tx.font_italic(F.col("_font")))
                     .repartition(expansion_partitions(documents), "doc_id"))
    # Words are cut once, by a split: a character class of this size costs ten times as much, a slice per row the whole array.
    runs = (docs.select("doc_id", "_font", "_heavy", "_slanted", F.posexplode(tx.words(F.col("text"))).alias("_i", "_word"))
                .withColumn("_row", F.floor(F.col("_i") / words_per_row).cast("int")).withColumn("_j", F.col("_i") % words_per_row))
    if row_starts:
        # Nothing stands before them in their row: the other words need not be placed.
        runs = runs.where("_j = 0")
    index = lambda j: F.col("_row").cast("long") * words_per_row + j
    # The window's key starts with doc_id, so the rows stay where they are.
    before = W.partitionBy("doc_id", "_row").orderBy("_j").rowsBetween(W.unboundedPreceding, -1)
    advance = F.sum(F.length("_word") * glyph + gap(index(F.col("_j")))).over(before)
    runs = runs.withColumn("_x", F.coalesce(advance, F.lit(0.0)) + left)
    i, r = index(F.col("_j")), F.col("_row") % rows_per_page
    runs = runs.withColumn("_r", r).withColumn("run_ord", i)
    y = F.lit(top) - F.col("_r") * leading - drop(F.col("_r")) + lift(F.col("run_ord"))
    return runs.select(
        "doc_id", F.floor(F.col("_row") / rows_per_page).cast("int").alias("page_index"), "run_ord",
        F.col("_word").alias("text"),
        (F.col("_x") + shift(F.col("run_ord"))).alias("x"), y.alias("y"),
        (F.length("_word") * glyph).alias("w"), F.lit(size).alias("h"),
        style_struct(F.col("_font"), F.lit(size), bold(F.col("_r")) | F.col("_heavy"), F.col("_slanted")).alias("style"))
