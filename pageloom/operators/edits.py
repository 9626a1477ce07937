"""Edit logs: replay, undo history, page order, integrity and grouping."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.geometry import union_aggs
from pageloom.functions.text import free_line_height, unix_newlines
from pageloom.plans.folds import fold_groups
from pageloom.schemas import EDIT, EDIT_KINDS, PAGE

HISTORY_LIMIT = 100


# --- replay without undo ------------------------------------------------------

def replay_edits(events: DataFrame) -> DataFrame:
    """Final edits of each document's log of add / update / remove / replace / reset.

    No fold: an added edit survives when it comes after the last reset of its
    document and the last removal of its id, and takes the last later update of
    its id. All three are map-side combined maxima, so a busy document or id is
    merged before it is shuffled. ``(add_seq, add_ord)`` is the list order. Any other
    action (undo, redo) stops the job: it needs :func:`replay_history`.
    """
    other = events.where("action IS NULL OR action NOT IN ('add', 'update', 'remove', 'replace', 'reset')")
    refused = F.raise_error(F.concat(F.lit("replay_edits has no action "), F.coalesce("action", F.lit("null"))))
    other = other.where(refused.cast("string").isNotNull())
    resets = events.where("action = 'reset'").groupBy("doc_id").agg(F.max("seq").alias("_reset"))
    gone = (events.where("action IN ('remove', 'replace')")
                  .select("doc_id", "seq", F.explode("ids").alias("_id"))
                  .groupBy("doc_id", "_id").agg(F.max("seq").alias("_gone")))
    updates = (events.where("action = 'update'").select("doc_id", "seq", F.get("edits", F.lit(0)).alias("_e"))
                     .groupBy("doc_id", F.col("_e.id").alias("_id"))
                     .agg(F.max_by("_e", "seq").alias("_up"), F.max("seq").alias("_up_seq")))
    fates = gone.join(updates, ["doc_id", "_id"], "full")
    added = (events.where("action IN ('add', 'replace')")
                   .select("doc_id", F.col("seq").alias("add_seq"), "action", F.posexplode("edits").alias("add_ord", "_edit"))
                   .withColumn("_id", F.col("_edit.id")))
    live = (added.join(fates, ["doc_id", "_id"], "left").join(resets, "doc_id", "left")
            .where((F.col("_reset").isNull() | (F.col("add_seq") > F.col("_reset")))
                   & (F.col("_gone").isNull() | (F.col("add_seq") > F.col("_gone"))
                      | ((F.col("add_seq") == F.col("_gone")) & (F.col("action") == "replace")))))
    now = F.when(F.col("_up_seq") > F.col("add_seq"), F.col("_up")).otherwise(F.col("_edit"))
    final = live.withColumn("_now", now).select("doc_id", "add_seq", "add_ord", "_now.*")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in final.schema if f.name not in ("doc_id", "add_seq")]
    return final.unionByName(other.select("doc_id", F.col("seq").alias("add_seq"), *none))


def replace_edits(edits: DataFrame, ids: DataFrame, new: DataFrame) -> DataFrame:
    """Edits minus ``ids(doc_id, id)`` plus the new rows."""
    return edits.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti").unionByName(new)


# --- replay with undo and redo ------------------------------------------------

class EditHistory:
    """Undo history of one document.

    Versions share their edits, and at most 100 past versions are kept. An action
    that changes nothing is not recorded; any recorded change clears the redo side.
    """

    def __init__(self, limit: int = HISTORY_LIMIT):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.past: deque = deque()
        self.present: tuple = ()
        self.future: list = []

    def apply(self, action: str, ids, edits) -> None:
        if action == "reset":
            self.clear()
        elif action == "undo":
            if self.past:
                self.future.append(self.present)
                self.present = self.past.pop()
        elif action == "redo":
            if self.future:
                self.past.append(self.present)
                self.present = self.future.pop()
        else:
            changed = self._changed(action, ids or (), edits or ())
            if changed is not None:
                self.past.append(self.present)
                while len(self.past) > self.limit:
                    self.past.popleft()
                self.present, self.future = changed, []

    def _changed(self, action: str, ids, edits) -> tuple | None:
        now = self.present
        if action == "add":
            return (*now, *edits) if edits else None
        if action == "update":
            new = edits[0] if edits else None
            if new is None or all(e["id"] != new["id"] for e in now):
                return None
            return tuple(new if e["id"] == new["id"] else e for e in now)
        if action == "remove":
            kept = tuple(e for e in now if e["id"] not in ids)
            return kept if len(kept) != len(now) else None
        if action == "replace":
            if not ids and not edits:
                return None
            dropped = set(ids)
            return (*(e for e in now if e["id"] not in dropped), *edits)
        raise ValueError(f"unknown action {action!r}")


def after_last_reset(events: DataFrame) -> DataFrame:
    """Events that can still matter: those from the last reset of their document on.

    A reset empties the state and the history, so earlier events are dropped
    before the shuffle to the ordered pass.
    """
    resets = events.where("action = 'reset'").groupBy("doc_id").agg(F.max("seq").alias("_reset"))
    return (events.join(resets, "doc_id", "left")
                  .where(F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))).drop("_reset"))


def replay_history(events: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Final edits of each document with undo and redo honoured.

    Also gives the depth of both sides. The log streams through in sequence, so a
    long log costs time but only the live versions are held.
    """
    result = T.StructType([
        T.StructField("past_len", T.IntegerType()), T.StructField("future_len", T.IntegerType()),
        T.StructField("edits", T.ArrayType(EDIT))])
    return fold_groups(
        after_last_reset(events), ["doc_id"], ["seq"], ["seq", "action", "ids", "edits"],
        lambda: EditHistory(limit), lambda h, row: h.apply(row[1], row[2], row[3]),
        lambda h: [(len(h.past), len(h.future), list(h.present))], result)


# --- reading an edit table ------------------------------------------------------

def paint_order(edits: DataFrame, position: str = "log_pos") -> DataFrame:
    """Adds ``paint_ord``: z order within the page, log order on ties.

    The position is the number of edits at lower z plus the rank among equal z, so
    a page is ranked in one part per z and only its counts come together.
    """
    level = [*PAGE, "z"]
    counts = edits.groupBy(*level).agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(W.partitionBy(*PAGE).orderBy("z").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*level, F.coalesce(below, F.lit(0)).alias("_below"))
    rank = F.row_number().over(W.partitionBy(*level).orderBy(position))
    return (edits.withColumn("_rank", rank).join(starts, level)
                 .withColumn("paint_ord", F.col("_below") + F.col("_rank")).drop("_rank", "_below"))


def validate_edits(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Pass edits through; an edit whose page is missing is an error at run time."""
    known = pages.select(*PAGE).distinct().withColumn("_known", F.lit(True))
    joined = edits.join(known, PAGE, "left")
    ok = F.when(F.col("_known") & (F.col("page_index") >= 0), F.col("page_index")).otherwise(
        F.raise_error(F.format_string("edit on unknown page %d", F.col("page_index"))).cast("int"))
    return joined.withColumn("page_index", ok).drop("_known")


def invalid_edits(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits whose page has no geometry row."""
    return edits.join(pages.select(*PAGE).distinct(), PAGE, "left_anti")


def known_kind(kind: Column) -> Column:
    """The kind itself; anything outside the closed set is an error."""
    return F.when(kind.isin(*EDIT_KINDS), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown edit kind: "), F.coalesce(kind, F.lit("null")))).cast("string"))


def split_by_kind(edits: DataFrame, handlers: dict | None = None) -> dict[str, DataFrame]:
    """One DataFrame per kind, each passed through its handler.

    ``handlers`` must name every kind exactly once when given.
    """
    if handlers is not None and set(handlers) != set(EDIT_KINDS):
        raise ValueError(f"handlers must cover exactly {EDIT_KINDS}")
    checked = edits.withColumn("kind", known_kind(F.col("kind")))
    parts = {k: checked.where(F.col("kind") == k) for k in EDIT_KINDS}
    return parts if handlers is None else {k: handlers[k](df) for k, df in parts.items()}


def next_z(edits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return edits.groupBy(*(keys or ["doc_id"])).agg((F.coalesce(F.max("z"), F.lit(0)) + 1).alias("next_z"))


def edit_groups(edits: DataFrame, anchors: DataFrame) -> DataFrame:
    """Text edits at consecutive z after each anchor cover.

    ``anchors`` is ``(doc_id, page_index, anchor_id, anchor_z, n_covers)``. The texts
    start at ``anchor_z + n_covers`` and end at the first missing z, so they are the
    island of consecutive z values holding that start, from it onwards.
    """
    texts = edits.where((F.col("kind") == "text") & ~F.coalesce(F.col("origin") == "free", F.lit(False)))
    last = texts.groupBy(*PAGE, "z").agg(F.max_by("id", "log_pos").alias("id"))
    w = W.partitionBy(*PAGE).orderBy("z")
    islands = last.withColumn("_island", F.col("z") - F.row_number().over(w))
    starts = (anchors.withColumn("z", F.col("anchor_z") + F.col("n_covers"))
                     .join(islands.select(*PAGE, "z", "_island"), [*PAGE, "z"])
                     .select(*PAGE, "anchor_id", F.col("z").alias("_from"), "_island"))
    return (starts.join(islands, [*PAGE, "_island"]).where(F.col("z") >= F.col("_from"))
                  .select(*PAGE, "anchor_id", "z", "id"))


def text_boxes(edits: DataFrame) -> DataFrame:
    """Free-text boxes: their first style, source text and rectangles."""
    free = (edits.where("kind = 'text' AND origin = 'free'")
                 .withColumn("box", F.coalesce("box_id", "id")))
    order = F.struct("z", "log_pos")
    first = lambda c: F.min_by(c, order)
    boxes = free.groupBy(*PAGE, "box").agg(
        F.count(F.lit(1)).alias("n_lines"),
        first("box_text").alias("_text"),
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY z, log_pos)").alias("_joined"),
        first("box_height").alias("_height"), first("font_size_pt").alias("_size"),
        first("x").alias("_fx"), first("y").alias("_fy"), first("w").alias("_fw"),
        F.max(F.col("y") + F.col("h")).alias("_top"), *union_aggs(prefix="_u"))
    tall = F.coalesce("_height", "_uh")
    open_height = F.coalesce(F.col("_height"), free_line_height(F.col("_size")))
    return boxes.select(
        *PAGE, "box", "n_lines", F.coalesce("_text", "_joined").alias("source_text"),
        F.col("_ux").alias("x"), (F.col("_top") - tall).alias("y"), F.col("_uw").alias("w"), tall.alias("h"),
        F.col("_fx").alias("open_x"), (F.col("_fy") - open_height).alias("open_y"),
        F.col("_fw").alias("open_w"), open_height.alias("open_h"))


def changed_only(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``after`` that differ from ``before``.

    Text is compared after newline normalisation, height within 0.5; any move counts.
    Both sides carry ``text, style, spans, width, height``; ``after`` also ``dx, dy``.
    """
    old = before.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in ("text", "style", "spans", "width", "height")])
    same = (unix_newlines(F.col("text")).eqNullSafe(unix_newlines(F.col("_b_text")))
            & F.col("style").eqNullSafe(F.col("_b_style")) & F.col("spans").eqNullSafe(F.col("_b_spans"))
            & (F.col("width") == F.col("_b_width")) & (F.abs(F.col("height") - F.col("_b_height")) <= 0.5)
            & (F.col("dx") == 0) & (F.col("dy") == 0))
    return (after.join(old, keys, "left").where(~F.coalesce(same, F.lit(False)))
                 .drop(*[f"_b_{c}" for c in ("text", "style", "spans", "width", "height")]))


def with_background(covers: DataFrame, backgrounds: DataFrame | None) -> DataFrame:
    """Covers with their final ``fill``: explicit, sampled from the page's background, or white."""
    from pageloom.functions.colors import cover_color
    null_color = F.lit(None).cast("struct<r:double,g:double,b:double>")
    if backgrounds is None:
        return covers.withColumn("fill", cover_color(F.col("color"), null_color, F.col("sample_background")))
    sampled = backgrounds.select(*PAGE, F.struct("r", "g", "b").alias("_bg"))
    return (covers.join(sampled, PAGE, "left")
                  .withColumn("fill", cover_color(F.col("color"), F.col("_bg"), F.col("sample_background"))).drop("_bg"))
