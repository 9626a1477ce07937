"""Text runs to lines, lines to paragraph blocks, and questions about both."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text as tx
from pageloom.functions.geometry import Rect, horizontal_overlap, union_aggs
from pageloom.plans.folds import NUMBER, fold_columns, sorted_by_key
from pageloom.plans.grid import FAR, with_cell_mates
from pageloom.plans.rows import Packing, line_pass
from pageloom.schemas import PAGE, RECT

LINE = [*PAGE, "row_id", "seg"]


def _size(prefix: str = "") -> Column:
    return F.col(f"{prefix}style.font_size_pt")


# --- rows and lines -------------------------------------------------------

class _Rows:
    """Open baselines of one page: running sum and count per row."""

    def __init__(self):
        self.rows: list[list] = []

    def place(self, y: float, size: float) -> int:
        tolerance = max(1.5, size * 0.18)
        best, best_gap = None, None
        for i, (total, count) in enumerate(self.rows):
            gap = abs(total / count - y)
            if best is None or gap < best_gap:
                best, best_gap = i, gap
        if best is not None and best_gap <= tolerance:
            self.rows[best][0] += y
            self.rows[best][1] += 1
            return best
        self.rows.append([y, 1])
        return len(self.rows) - 1


class _RecentRows(_Rows):
    """Rows whose baseline is out of every later run's reach are forgotten.

    Runs arrive by falling y, so a row more than the page's largest tolerance
    above the current run can never be chosen again.
    """

    def __init__(self):
        super().__init__()
        self.dropped = 0

    def place_run(self, y: float, size: float, page_size: float) -> int:
        reach = max(1.5, page_size * 0.18)
        while self.rows and self.rows[0][0] / self.rows[0][1] - y > reach:
            self.rows.pop(0)
            self.dropped += 1
        return self.dropped + self.place(y, size)


def assign_rows(runs: DataFrame, mode: str = "window") -> DataFrame:
    """Baseline clustering: adds ``row_id``.

    ``window`` starts a row where the drop to the previous run exceeds the
    tolerance. ``exact`` joins the nearest row by its running mean baseline.
    Both agree when rows lie more than two tolerances apart.
    """
    order = [F.col("y").desc(), F.col("x"), F.col("run_ord")]
    if mode == "window":
        w = W.partitionBy(*PAGE).orderBy(*order)
        drop = F.lag("y").over(w) - F.col("y")
        opens = drop.isNull() | (drop > F.greatest(F.lit(1.5), _size() * 0.18))
        return (runs.withColumn("_opens", opens.cast("int"))
                    .withColumn("row_id", F.sum("_opens").over(w) - 1).drop("_opens"))
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    sized = (runs.withColumn("_fs", _size())
                 .withColumn("_pfs", F.max(_size()).over(W.partitionBy(*PAGE))))
    placed = fold_columns(
        sized, PAGE, order, ["y", "_fs", "_pfs"], _RecentRows,
        lambda rows, r: (rows.place_run(*r),),
        T.StructType([T.StructField("row_id", T.LongType())]))
    return placed.drop("_fs", "_pfs")


def assign_lines(runs: DataFrame, mode: str = "window") -> DataFrame:
    """Runs with ``row_id``, column segment ``seg``, and their piece of the line text.

    Adds ``seg_ord`` (place in the line), ``part`` (trimmed text) and ``space``
    (whether a space goes before it). Everything after the page shuffle is a
    sort inside the same partitions.
    """
    rows = assign_rows(runs, mode)
    w = W.partitionBy(*PAGE, "row_id").orderBy("x", F.col("y").desc(), "run_ord")
    prev = lambda c: F.lag(c).over(w)
    rows = (rows.withColumn("part", tx.utrim(F.col("text")))
                .withColumn("_num", tx.is_standalone_number(F.col("part")))
                .withColumn("_gap", F.col("x") - prev(F.col("x") + F.col("w")))
                .withColumn("_psize", prev(_size()))
                .withColumn("_pnum", prev("_num"))
                .withColumn("_ppart", prev("part")))
    column_gap = F.greatest(F.lit(18.0), F.greatest(F.col("_psize"), _size()) * 1.75)
    numbers = (F.col("_pnum") & F.col("_num") & (F.col("_gap") > F.greatest(F.lit(3.0), _size() * 0.4)))
    cut = F.coalesce((F.col("_gap") > column_gap) | numbers, F.lit(False))
    wide = F.col("_gap") > F.greatest(F.lit(0.75), F.least(F.col("_psize"), _size()) * 0.08)
    space = ~cut & wide & ~tx.starts_closing(F.col("part")) & ~tx.ends_opening(F.col("_ppart"))
    return (rows.withColumn("_cut", cut.cast("int"))
                .withColumn("space", F.coalesce(space, F.lit(False)))
                .withColumn("seg", F.sum("_cut").over(w))
                .withColumn("seg_ord", F.row_number().over(w))
                .drop("_gap", "_psize", "_pnum", "_num", "_ppart", "_cut"))


def lines(runs: DataFrame, mode: str = "window", segments: bool = False) -> DataFrame:
    """One row per text line, in ``line_ord`` reading order within its page.

    With ``segments`` the line also carries the character span and rectangle of
    each run, for mapping text matches back to geometry.
    """
    if mode == "window" and not segments:
        return reading_order(_summed_lines(runs))
    placed = assign_lines(runs, mode)
    piece = F.when(F.col("space"), F.concat(F.lit(" "), F.col("part"))).otherwise(F.col("part"))
    placed = placed.withColumn("_piece", piece)
    aggs = [
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY seg_ord)").alias("text"),
        *union_aggs(),
        F.avg("y").alias("baseline_y"),
        F.max_by("style", F.struct(F.length("part"), -F.col("seg_ord"))).alias("style"),
        F.count(F.lit(1)).alias("n_runs"),
        F.min("run_ord").alias("first_run_ord"),
    ]
    if segments:
        w = W.partitionBy(*LINE).orderBy("seg_ord")
        end = F.sum(F.length("_piece")).over(w)
        placed = (placed.withColumn("_end", end)
                        .withColumn("_start", F.col("_end") - F.length("part")))
        aggs.append(F.array_sort(F.collect_list(F.struct(
            F.col("_start").cast("int").alias("start"), F.col("_end").cast("int").alias("end"), "x", "y", "w", "h",
        ))).alias("segments"))
    grouped = placed.groupBy(*LINE).agg(*aggs)
    return reading_order(grouped)


def _summed_lines(runs: DataFrame) -> DataFrame:
    """The lines of ``assign_lines``, cut and added up in one pass over the runs, sorted once."""
    slim = runs.select(*PAGE, "run_ord", "text", *(F.col(c).cast("double").alias(c) for c in RECT), "style")
    ordered = sorted_by_key(slim, PAGE, [F.col("y").desc(), F.col("x"), F.col("run_ord")])
    pack = Packing()
    for c in ("run_ord", NUMBER):
        pack.add(F.col(c), T.LongType())
    for c in (*(F.col(c) for c in RECT), _size().cast("double")):
        pack.add(c, T.DoubleType())
    style = pack.add(F.col("style"), slim.schema["style"].dataType)
    long, double, string = T.LongType(), T.DoubleType(), T.StringType()
    added = [("row_id", long), ("seg", long), ("text", string), *((c, double) for c in (*RECT, "baseline_y")),
             ("style", slim.schema["style"].dataType), ("n_runs", long), ("first_run_ord", long)]
    schema = T.StructType([*(slim.schema[k] for k in PAGE), *(T.StructField(c, kind) for c, kind in added)])
    found = line_pass(PAGE, style, tx.WS_CHARS, tx.NUMBER_END, tx.CLOSING, tx.OPENING, schema.names)
    return ordered.select(*PAGE, "text", *pack.columns()).mapInArrow(found, schema)


def reading_order(line_rows: DataFrame) -> DataFrame:
    """Adds ``line_ord``: top to bottom, then left to right within the page."""
    w = W.partitionBy(*PAGE).orderBy(F.col("baseline_y").desc(), "x", "row_id", "seg")
    return line_rows.withColumn("line_ord", F.row_number().over(w))


def line_segments(runs: DataFrame, mode: str = "window") -> DataFrame:
    """Character offsets of each run inside its line's text: ``[start_char, end_char)``."""
    w = W.partitionBy(*LINE).orderBy("seg_ord")
    placed = assign_lines(runs, mode)
    width = F.length("part") + F.col("space").cast("int")
    return (placed.withColumn("end_char", F.sum(width).over(w))
                  .withColumn("start_char", F.col("end_char") - F.length("part")))


# --- paragraph blocks -----------------------------------------------------

def _spacing_breaks(gap: float, expected: float) -> bool:
    return abs(gap - expected) > max(2.0, expected * 0.35)


class RunningMedian:
    """The median of what has been added: the smaller half in one heap, the larger in another."""

    def __init__(self):
        self.low: list[float] = []   # negated, so that the largest of the half is first
        self.high: list[float] = []

    def add(self, value: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (-self.low[0] + self.high[0]) / 2


class _Blocks:
    """Open paragraphs of one page, newest last, with their spacing so far."""

    def __init__(self):
        self.open: list[dict] = []
        self.count = 0

    def add(self, row: tuple) -> int:
        line = dict(zip(("baseline", "x", "w", "size", "style", "long", "number", "page_size"), row))
        reach = line["page_size"] * 1.85
        self.open = [b for b in self.open if b["last"]["baseline"] - line["baseline"] <= reach]
        best = None
        for block in self.open:
            if self._joins(block, line):
                away = abs(block["last"]["x"] - line["x"])
                if best is None or away < best[0]:
                    best = (away, block)
        if best is None:
            self.count += 1
            self.open.append({"id": self.count, "last": line, "usual": RunningMedian()})
            return self.count
        block = best[1]
        block["usual"].add(block["last"]["baseline"] - line["baseline"])
        block["last"] = line
        return block["id"]

    @staticmethod
    def _joins(block: dict, line: dict) -> bool:
        last = block["last"]
        gap, size = last["baseline"] - line["baseline"], max(last["size"], line["size"])
        if last["number"] or line["number"] or not 0.5 < gap <= size * 1.85:
            return False
        if abs(last["size"] - line["size"]) > max(1.5, size * 0.22) or last["style"] != line["style"]:
            return False
        if not (last["long"] or line["long"]):
            return False
        overlap = min(last["x"] + last["w"], line["x"] + line["w"]) - max(last["x"], line["x"])
        ratio = max(0.0, overlap) / max(1.0, min(last["w"], line["w"]))
        if abs(last["x"] - line["x"]) > max(9.0, size) and ratio < 0.7:
            return False
        usual = block["usual"].value()
        return usual is None or not _spacing_breaks(gap, usual)


def _style_key() -> Column:
    return F.concat_ws("|", tx.font_family(F.col("style.font_name")),
                       F.col("style.bold").cast("string"), F.col("style.italic").cast("string"))


def _paragraph_like() -> Column:
    return (F.length("text") >= 24) | (F.col("n_runs") >= 3)


def assign_blocks(line_rows: DataFrame, mode: str = "exact", keep: list[str] | None = None) -> DataFrame:
    """Adds ``block_ord``, the paragraph each line belongs to, numbered per page.

    ``exact`` tests a line against every open paragraph and takes the nearest by
    left edge. ``window`` splits the page into left-edge columns and compares each
    line with the one above it; it is meant for one-column pages. ``keep`` names the
    columns wanted beside the page, ``line_ord`` and ``block_ord``: no others go through the pass.
    """
    wanted = line_rows.columns if keep is None else list(dict.fromkeys([*PAGE, "line_ord", *keep]))
    if mode == "window":
        return _assign_blocks_window(line_rows).select(*wanted, "block_ord")
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    prepared = (line_rows
                .withColumn("_size", _size()).withColumn("_style", _style_key())
                .withColumn("_long", _paragraph_like())
                .withColumn("_number", tx.is_standalone_number(F.col("text")))
                .withColumn("_psize", F.max(_size()).over(W.partitionBy(*PAGE))))
    inputs = ["baseline_y", "x", "w", "_size", "_style", "_long", "_number", "_psize"]
    prepared = prepared.select(*dict.fromkeys([*wanted, *inputs]))
    folded = fold_columns(prepared, PAGE, ["line_ord"], inputs, _Blocks,
                          lambda state, row: (state.add(row),),
                          T.StructType([T.StructField("block_ord", T.LongType())]))
    return folded.select(*wanted, "block_ord")


def _assign_blocks_window(line_rows: DataFrame) -> DataFrame:
    by_x = W.partitionBy(*PAGE).orderBy("x", "line_ord")
    step = F.col("x") - F.lag("x").over(by_x)
    island = (line_rows
              .withColumn("_new", F.coalesce(step > F.greatest(F.lit(9.0), _size()), F.lit(True)).cast("int"))
              .withColumn("_col", F.sum("_new").over(by_x)))
    down = W.partitionBy(*PAGE, "_col").orderBy(F.col("baseline_y").desc(), "x", "line_ord")
    prev = lambda c: F.lag(c).over(down)
    gap = prev("baseline_y") - F.col("baseline_y")
    size = F.greatest(prev(_size()), _size())
    joins = (~prev(tx.is_standalone_number(F.col("text"))) & ~tx.is_standalone_number(F.col("text"))
             & (gap > 0.5) & (gap <= size * 1.85)
             & (F.abs(prev(_size()) - _size()) <= F.greatest(F.lit(1.5), size * 0.22))
             & (prev(_style_key()) == _style_key())
             & (prev(_paragraph_like()) | _paragraph_like()))
    chained = (island.withColumn("_gap", gap)
                     .withColumn("_brk", (~F.coalesce(joins, F.lit(False))).cast("int"))
                     .withColumn("_chain", F.sum("_brk").over(down)))
    within = W.partitionBy(*PAGE, "_col", "_chain").orderBy(F.col("baseline_y").desc(), "x", "line_ord")
    earlier = F.expr("percentile(CASE WHEN _brk = 0 THEN _gap END, 0.5)").over(
        within.rowsBetween(W.unboundedPreceding, -1))
    uneven = F.abs(F.col("_gap") - earlier) > F.greatest(F.lit(2.0), earlier * 0.35)
    split = (chained.withColumn("_cut", ((F.col("_brk") == 1) | F.coalesce(uneven, F.lit(False))).cast("int"))
                    .withColumn("_blk", F.sum("_cut").over(down)))
    first = F.min("line_ord").over(W.partitionBy(*PAGE, "_col", "_blk"))
    return (split.withColumn("block_ord", first.cast("long"))
                 .drop("_new", "_col", "_gap", "_brk", "_chain", "_cut", "_blk"))


def blocks(line_rows: DataFrame) -> DataFrame:
    """Roll lines with ``block_ord`` up to paragraphs."""
    keys = [*PAGE, "block_ord"]
    above = F.lag("baseline_y").over(W.partitionBy(*keys).orderBy("line_ord"))
    gap = above - F.col("baseline_y")
    rolled = line_rows.withColumn("_gap", gap).groupBy(*keys).agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY line_ord)").alias("text"),
        *union_aggs(),
        F.max("baseline_y").alias("top_baseline_y"),
        F.median("_gap").alias("_median"),
        F.min_by("style", "line_ord").alias("style"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    usual = F.nullif(F.col("_median"), F.lit(0.0))
    return (rolled.withColumn("line_height_pt", F.coalesce(usual, _size() * 1.2)).drop("_median"))


# --- questions over runs and blocks ----------------------------------------

def hit_test(points: DataFrame, runs: DataFrame) -> DataFrame:
    """For each ``(point_id, px, py)``: the smallest run holding it, the later on ties.

    A point inside no run, or without finite coordinates, has nulls. ``point_id`` is unique within its page.
    """
    zero, slim = F.lit(0.0), runs.select(*PAGE, "run_ord", "text", "x", "y", "w", "h")
    placed = points.select(*PAGE, "point_id", "px", "py")
    near = with_cell_mates(placed, slim, PAGE, Rect(F.col("px"), F.col("py"), zero, zero), Rect.of(), large="right")

    # A point has one copy on each level, in one cell, where it meets each run of the level that holds it.
    def held(r: Column) -> Column:
        return ((r["x"] <= F.col("px")) & (F.col("px") <= r["x"] + r["w"]) & (r["y"] <= F.col("py")) & (F.col("py") <= r["y"] + r["h"])
                & r["run_ord"].isNotNull())

    ranked = F.transform(F.filter("_mates", held), lambda r: F.struct((r["w"] * r["h"]).alias("area"), (-r["run_ord"]).alias("later"), r.alias("run")))
    found = near.select(*PAGE, "point_id", F.array_min(ranked).alias("best"))
    best = F.min_by("best.run", F.when(F.col("best").isNotNull(), F.struct("best.area", "best.later"))).alias("hit")
    return found.groupBy(*PAGE, "point_id").agg(best).select(*PAGE, "point_id", "hit.*")


class _Sweep:
    """Blocks of one strip, lowest first; a list asks for the highest one so far that shares its column."""

    def __init__(self):
        self.passed: list[tuple[int, float, float, float]] = []

    def meet(self, row: tuple) -> tuple:
        is_list, block, x, w, top = row
        if not is_list:
            self.passed.append((block, x, w, top))
            return None, None
        for other, ox, ow, otop in reversed(self.passed):
            shared = min(x + w, ox + ow) - max(x, ox)
            if other != block and shared >= max(2.0, min(w, ow) * 0.2):
                return other, otop
        return None, None


def next_block_below(lists: DataFrame, block_rows: DataFrame, column_width: float = 128.0) -> DataFrame:
    """Highest other block under each list in the same column, and the free height to it.

    ``lists`` has the cover rectangle as ``cover_*`` and the text rectangle as
    ``list_*``. A list with nothing below it reaches to the page bottom. Blocks and lists are sorted by
    height in each strip of the page and passed once from the bottom up: a list meets the blocks right below
    it, until one shares its column. Rectangles without finite edges share no column.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / column_width), F.floor(hi / column_width)))
    lrect, brect = Rect.of("list_"), Rect.of()
    finite = lambda r: (F.abs(r.x) < FAR) & (F.abs(r.right) < FAR) & ~F.isnan(r.x) & ~F.isnan(r.right) & (r.w >= 0)
    rows = lambda df, r, at, is_list: df.where(finite(r)).select(
        *PAGE, F.col("block_ord").alias("_block"), r.x.alias("_x"), r.w.alias("_w"), at.alias("_at"),
        F.lit(is_list).alias("_list"), span(r.x, r.right).alias("_c"))
    both = rows(block_rows, brect, brect.top, False).unionByName(rows(lists, lrect, F.col("cover_y") + 0.5, True))
    order = ["_at", "_list", F.col("_block").desc()]
    swept = fold_columns(both, [*PAGE, "_c"], order, ["_list", "_block", "_x", "_w", "_at"], _Sweep, lambda state, row: state.meet(row),
                         T.StructType([T.StructField("_next", T.LongType()), T.StructField("_top", T.DoubleType())]))
    below = (swept.where("_list AND _next IS NOT NULL").groupBy(*PAGE, F.col("_block").alias("block_ord"))
                  .agg(F.max_by(F.struct("_next", "_top"), F.struct(F.col("_top"), -F.col("_next"))).alias("_n")))
    joined = lists.join(below, [*PAGE, "block_ord"], "left")
    room = F.col("cover_y") + F.col("cover_h") - F.coalesce(F.col("_n._top"), F.lit(0.0))
    return (joined.withColumn("next_block_ord", F.col("_n._next"))
                  .withColumn("available_height_pt", F.greatest(F.lit(0.0), room)).drop("_n"))


def line_cover_rects(line_rows: DataFrame) -> DataFrame:
    """Redaction rectangle of every line: the line box padded by its font size."""
    box = Rect.of().padded(F.greatest(F.lit(0.75), _size() * 0.08), F.greatest(F.lit(1.0), _size() * 0.14))
    return line_rows.select(*[c for c in line_rows.columns if c not in ("x", "y", "w", "h")],
                            *box.columns("cover_"))


def block_cover_rects(line_rows: DataFrame) -> DataFrame:
    """Redaction rectangle of every block: the union of its lines' rectangles."""
    return line_cover_rects(line_rows).groupBy(*PAGE, "block_ord").agg(
        *union_aggs(Rect.of("cover_"), "cover_"))


def page_guides(block_rows: DataFrame, pages: DataFrame, within: float = 1.0, axis: str = "x") -> DataFrame:
    """Alignment positions of a page along ``axis``, one per edge kind and ``within`` points.

    Guides come in a fixed order; an earlier guide suppresses later ones close to it. Along
    ``x``: page centre, content edges, then each block's left, centre, right. Along ``y``,
    measured down from the page's top: page centre, then each block's top, middle, bottom.
    """
    if axis not in ("x", "y"):
        raise ValueError(f"unknown axis {axis!r}")
    content = block_rows.groupBy(*PAGE).agg(
        F.min("x").alias("content_left"), F.max(F.col("x") + F.col("w")).alias("content_right"))
    base = pages.select(*PAGE, "width_pt", "height_pt").join(content, PAGE, "left")
    guide = lambda pos, edge, label, k: F.struct(
        F.lit(k).cast("long").alias("guide_ord"), pos.alias("pos"), F.lit(edge).alias("edge"), F.lit(label).alias("label"))
    across = axis == "x"
    page_level = base.select(*PAGE, F.explode(F.array(
        guide(F.col("width_pt") / 2, "mid", "page center", 0),
        guide(F.coalesce("content_left", F.lit(0.0)), "min", "left column", 1),
        guide(F.coalesce("content_right", F.col("width_pt")), "max", "right margin", 2)) if across else F.array(
        guide(F.col("height_pt") / 2, "mid", "page center", 0))).alias("g"))
    order, top = F.col("block_ord") * 3, F.col("height_pt") - F.col("y") - F.col("h")
    edges = ((F.col("x"), "min", "left column"), (F.col("x") + F.col("w") / 2, "mid", "block center"),
             (F.col("x") + F.col("w"), "max", "right edge")) if across else (
        (top, "min", "top edge"), (top + F.col("h") / 2, "mid", "block middle"), (top + F.col("h"), "max", "bottom edge"))
    placed = block_rows if across else block_rows.join(pages.select(*PAGE, "height_pt"), PAGE)
    block_level = placed.select(*PAGE, F.explode(F.array(*[
        F.struct((order + k).alias("guide_ord"), pos.alias("pos"), F.lit(edge).alias("edge"), F.lit(label).alias("label"))
        for k, (pos, edge, label) in enumerate(edges)])).alias("g"))
    every = page_level.unionByName(block_level).select(*PAGE, "g.*")
    # Equal positions collapse map-side before the ordered pass sees them.
    unique = every.groupBy(*PAGE, "edge", "pos").agg(
        F.min(F.struct("guide_ord", "label")).alias("g")).select(*PAGE, "edge", "pos", "g.*")
    by_pos = W.partitionBy(*PAGE, "edge").orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(by_pos) > within, F.lit(True))
    clustered = (unique.withColumn("_a", apart.cast("int")).withColumn("_cluster", F.sum("_a").over(by_pos)).drop("_a"))

    def keep(kept: list, row: tuple) -> tuple:
        fresh = all(abs(p - row[0]) > within for p in kept)
        if fresh:
            kept.append(row[0])
        return (fresh,)

    folded = fold_columns(clustered, [*PAGE, "edge", "_cluster"], ["guide_ord"], ["pos"], list, keep,
                          T.StructType([T.StructField("_keep", T.BooleanType())]))
    return folded.where("_keep").drop("_keep", "_cluster")
