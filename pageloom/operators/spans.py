"""Styled spans as tables: normalising, per-line bullets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import text as tx


def normalize_span_rows(spans: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Merge adjacent span rows of equal style; newlines unified, empty spans dropped."""
    clean = spans.withColumn("text", tx.unix_newlines(F.col("text"))).where("text <> ''")
    w = W.partitionBy(*keys).orderBy(order)
    changed = ~(F.col("bold").eqNullSafe(F.lag("bold").over(w)) & F.col("italic").eqNullSafe(F.lag("italic").over(w)))
    grouped = clean.withColumn("_c", changed.cast("int")).withColumn("span_ord", F.sum("_c").over(w))
    return grouped.groupBy(*keys, "span_ord").agg(
        F.expr(f"listagg(text, '') WITHIN GROUP (ORDER BY {order})").alias("text"),
        F.first("bold").alias("bold"), F.first("italic").alias("italic"))


def bullet_spans(docs: DataFrame) -> DataFrame:
    """Split ``(doc_id, text, spans)`` into marker-free bullet items with their spans.

    Works inside the row: lines are located by their offsets in the text, the
    marker and outer blanks are skipped, and the spans are cut to what is left.
    """
    text = tx.unix_newlines(F.col("text"))
    staged = docs.select("doc_id", text.alias("text"),
                         tx.effective_spans(text, F.lit(False), F.lit(False), F.col("spans")).alias("spans"))
    staged = staged.withColumn("_styles", tx.style_ranges(F.col("spans"))).withColumn("_lines", F.split("text", "\n"))
    staged = staged.withColumn("_from", tx.running_starts(F.transform("_lines", lambda s: F.length(s) + 1)))
    rows = staged.select("doc_id", "_styles", F.posexplode(F.arrays_zip("_lines", "_from")).alias("line_ord", "_l"))
    body = F.regexp_replace("_l._lines", f"^{tx.WS}*•{tx.WS}?", "")
    rows = rows.withColumn("_body", body).withColumn("item", tx.utrim(F.col("_body"))).where("item <> ''")
    skipped = F.length("_l._lines") - F.length(F.ltrim(F.col("_body"), F.lit(tx.WS_CHARS)))
    return rows.select("doc_id", "line_ord", "item",
                       tx.style_piece(F.col("item"), F.col("_l._from") + skipped, F.col("_styles")).alias("spans"))
