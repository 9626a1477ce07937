"""Page text, page-marked document text, and width-bounded wrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions.binding import let
from pageloom.functions.metrics import FontWidth, StyledWidth
from pageloom.plans.sizing import expanded_partitions
from pageloom.schemas import PAGE

# The cap, the truncation marker and the fallback glyph width.
MAX_CHARS = 50_000
TRUNCATED = "\n[…document truncated…]"
GLYPH_EM = 0.55


def page_text(line_rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines of each page in reading order; with ``pages``, empty pages are kept."""
    text = line_rows.groupBy(*PAGE).agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY line_ord)").alias("text"),
        F.count(F.lit(1)).alias("n_lines"))
    if pages is None:
        return text
    return (pages.select(*PAGE).join(text, PAGE, "left")
                 .select(*PAGE, F.coalesce("text", F.lit("")).alias("text"),
                         F.coalesce("n_lines", F.lit(0)).alias("n_lines")))


def document_text(pages: DataFrame, max_chars: int = MAX_CHARS, pages_per_part: int = 1024) -> DataFrame:
    """One row per document: ``char_count`` of the marked text and its capped ``full`` text.

    Pages are first joined in parts of ``pages_per_part``, each clipped to the
    cap, then the parts are joined. The clip loses nothing: text past the cap of
    a part is past the cap of the document. So a document of any length moves at
    most the cap per part, and its pages are spread over its parts.
    """
    if not isinstance(max_chars, int) or max_chars < len(TRUNCATED):
        raise ValueError(f"max_chars must be an integer of at least {len(TRUNCATED)}")
    clean = tx.utrim(F.col("text"))
    marker = F.concat(F.lit("[Page "), (F.col("page_index") + 1).cast("string"), F.lit("]"))
    section = F.when(clean != "", F.concat(marker, F.lit("\n"), clean)).otherwise(marker)
    sections = (pages.withColumn("_section", section)
                     .withColumn("_len", F.length("_section").cast("long"))
                     .withColumn("_section", F.left("_section", F.lit(max_chars + 1)))
                     .withColumn("_part", F.floor(F.col("page_index") / pages_per_part)))
    parts = sections.groupBy("doc_id", "_part").agg(
        F.expr("listagg(_section, '\\n\\n') WITHIN GROUP (ORDER BY page_index)").alias("_text"),
        F.sum("_len").alias("_len"), F.count(F.lit(1)).alias("_pages"),
        F.sum("n_lines").alias("_lines") if "n_lines" in pages.columns else F.lit(None).cast("long").alias("_lines"))
    parts = parts.withColumn("_text", F.left("_text", F.lit(max_chars + 1)))
    docs = parts.groupBy("doc_id").agg(
        F.expr("listagg(_text, '\\n\\n') WITHIN GROUP (ORDER BY _part)").alias("_text"),
        F.sum("_len").alias("_len"), F.sum("_pages").alias("n_pages"), F.sum("_lines").alias("n_lines"))
    count = F.col("_len") + (F.col("n_pages") - 1) * 2
    cut = F.concat(tx.utrim_end(F.left("_text", F.lit(max_chars - len(TRUNCATED)))), F.lit(TRUNCATED))
    return docs.select(
        "doc_id", "n_pages", "n_lines", count.alias("char_count"),
        F.when(count <= max_chars, F.col("_text")).otherwise(cut).alias("full"))


# --- wrapping ----------------------------------------------------------------

class CharWidth:
    """Measure with one width for every character.

    Wrapping with it runs as one regular expression per line; any other measure
    is a function from a text column to its width.
    """

    def __init__(self, unit: float):
        self.unit = unit

    def __call__(self, text: Column) -> Column:
        return F.length(text) * F.lit(self.unit)

    def fit(self, max_width: float) -> int:
        """Most characters that stay within the width, and at least one."""
        n = int(max_width / self.unit)
        n += (n + 1) * self.unit <= max_width
        n -= n * self.unit > max_width
        return max(1, n)


def em_width(size_pt: float) -> CharWidth:
    """Measure a string by its length at the fallback glyph width."""
    return CharWidth(size_pt * GLYPH_EM)


def _split_word(word: Column, max_width: float, measure: tx.Measure) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, ch: Column) -> Column:
        longer = F.concat(acc["cur"], ch)
        over = (acc["cur"] != "") & (measure(longer) > max_width)
        return F.struct(F.when(over, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
                        F.when(over, ch).otherwise(longer).alias("cur"))

    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), start, add)


def _wrap_line(line: Column, max_width: float, measure: tx.Measure) -> Column:
    if isinstance(measure, CharWidth):
        # The longest stretch ending between a word and a blank, or a cut inside a long word.
        n, ws, word = measure.fit(max_width), tx.WS, tx.NOT_WS
        stretch = f"(?s).{{1,{n}}}(?:(?<={ws})(?={word})|(?<={word})(?={ws})|\\z)|.{{1,{n}}}"
        pieces = F.regexp_extract_all(line, F.lit(stretch), F.lit(0))
        return F.when(line == "", F.array(F.lit(""))).otherwise(pieces)
    tokens = F.regexp_extract_all(line, F.lit(f"{tx.WS}+|{tx.NOT_WS}+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, token: Column) -> Column:
        longer = F.concat(acc["cur"], token)
        flushed = F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
        pieces = _split_word(token, max_width, measure)
        return (F.when(measure(longer) <= max_width, F.struct(acc["done"].alias("done"), longer.alias("cur")))
                .when(measure(token) <= max_width, F.struct(flushed.alias("done"), token.alias("cur")))
                .otherwise(F.struct(F.concat(flushed, pieces["done"]).alias("done"), pieces["cur"].alias("cur"))))

    wrapped = F.aggregate(tokens, start, add, lambda acc: F.array_append(acc["done"], acc["cur"]))
    return F.when(line == "", F.array(F.lit(""))).otherwise(wrapped)


#: Line starts that are held apart before they join the others, so that a long line's are not copied for each.
RECENT = 256


def _glyph_pieces(line: Column, limit: Column, units) -> Column:
    """array<struct<c,w,must,i>>: words and stretches of white space, over-long ones as single characters.

    ``units(text, at)`` is the width of a text that starts at character ``at`` of the line. ``must``
    marks where a piece can't stay on a line with what stands before it.
    """
    tokens = F.regexp_extract_all(line, F.lit(f"{tx.WS}+|{tx.NOT_WS}+"), F.lit(0))

    def measured(toks: Column) -> Column:
        starts = tx.running_starts(F.transform(toks, lambda t: F.length(t)))
        return let(starts, lambda at: F.transform(toks, lambda t, k: F.struct(
            t.alias("c"), F.get(at, k).alias("at"), units(t, F.get(at, k)).alias("w"))))

    def pieces(p: Column) -> Column:
        piece = lambda c, w, must: F.struct(c.alias("c"), w.alias("w"), must.alias("must"))
        letters = F.regexp_extract_all(p["c"], F.lit("(?s)."), F.lit(0))
        return F.when(p["w"] <= limit, F.array(piece(p["c"], p["w"], F.lit(False)))).otherwise(
            F.transform(letters, lambda c, i: piece(c, units(c, p["at"] + i), i == 0)))

    return let(let(tokens, measured), lambda m: F.flatten(F.transform(m, pieces)))


def _glyph_breaks(pieces: Column, limit: Column) -> Column:
    """The pieces (from 0) that open a line: the widths' running sums, searched by halving once per line.

    Before a piece that must open a line lies a gap that no line can hold.
    """
    added = lambda p: p["w"] + F.when(p["must"], limit + 1).otherwise(F.lit(0).cast("long"))
    ends = let(tx.running_starts(F.transform(pieces, added), 64, "long"),
               lambda x: F.transform(x, lambda v, i: v + added(F.get(pieces, i))))
    n = F.size(pieces)
    strides = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))

    def found(end: Column, steps: Column) -> Column:
        # What opens the line after next doesn't fit beside the first of this one: two lines take more than the limit.
        most = F.least(n, (F.element_at(end, -1) * 2 / F.greatest(limit, F.lit(1).cast("long"))).cast("int") + 2)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("recent"))

        def line(acc: Column, _: Column) -> Column:
            reach = F.get(end, acc["at"]) - F.get(pieces, acc["at"])["w"] + limit
            stop = let(reach, lambda r: F.aggregate(steps, acc["at"] + 1, lambda e, b: F.when(F.get(end, e + b - 1) <= r, e + b).otherwise(e)))
            full = F.size(acc["recent"]) >= RECENT
            return F.when(acc["at"] >= n, acc).otherwise(F.struct(
                stop.alias("at"), F.when(full, F.array_append(acc["done"], acc["recent"])).otherwise(acc["done"]).alias("done"),
                F.when(full, F.array(acc["at"])).otherwise(F.array_append(acc["recent"], acc["at"])).alias("recent")))

        return F.aggregate(F.sequence(F.lit(1), most), start, line, lambda acc: F.flatten(F.array_append(acc["done"], acc["recent"])))

    return let(ends, lambda end: let(strides, lambda steps: found(end, steps)))


def _wrap_glyphs(line: Column, limit: Column, units) -> Column:
    """Greedy wrap by added-up widths, in time that grows with the line."""
    def cut(pieces: Column) -> Column:
        def joined(starts: Column, texts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(texts))
            return F.transform(starts, lambda s, k: F.array_join(F.slice(texts, s + 1, end(k) - s), ""))
        return let(_glyph_breaks(pieces, limit), lambda starts: let(pieces["c"], lambda texts: joined(starts, texts)))

    return F.when(line == "", F.array(F.lit(""))).otherwise(let(_glyph_pieces(line, limit, units), cut))


def _with_glyphs(measure: FontWidth, max_width: float | Column, body) -> Column:
    """``body(limit, units)`` with the font's arrays and the limit bound once."""
    return let(measure.table(), lambda t: let(measure.others(), lambda o: let(measure.limit(max_width), lambda n: body(
        n, lambda text, at: measure.units(text, t, o)))))


def _checked(max_width: float | Column) -> None:
    if not isinstance(max_width, Column) and not 0 < max_width < float("inf"):
        raise ValueError("max_width must be a positive finite number")


def wrap_lines(text: Column, max_width: float | Column, measure: tx.Measure) -> Column:
    """Greedy wrap to array<string>: white space kept, long words split, blank lines kept.

    With a ``FontWidth``, font, size and ``max_width`` may be columns; a width or size that is null
    or not above 0 gives null.
    """
    _checked(max_width)
    logical = F.split(tx.unix_newlines(text), "\n")
    if isinstance(measure, FontWidth):
        wrapped = _with_glyphs(measure, max_width, lambda n, units: F.flatten(F.transform(logical, lambda s: _wrap_glyphs(s, n, units))))
        wrapped = F.when(measure.usable(max_width), wrapped)
    else:
        wrapped = F.flatten(F.transform(logical, lambda s: _wrap_line(s, max_width, measure)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(wrapped)


def wrap_chunks(docs: DataFrame, max_width: float | Column, size_pt: float = 10.0,
                measure: tx.Measure | None = None) -> DataFrame:
    """Documents to chunks no wider than ``max_width``, one pass per row.

    Measuring each character takes long: for a font, documents are dealt out first, as a file may be few splits.
    """
    lines = wrap_lines(F.col("text"), max_width, measure or em_width(size_pt))
    if isinstance(measure, FontWidth):
        docs = docs.repartition(expanded_partitions(docs))
    return docs.select("doc_id", F.posexplode(lines).alias("chunk_ord", "chunk"))


def wrap_spans(docs: DataFrame, max_width: float, size_pt: float = 10.0,
               measure: tx.Measure | StyledWidth | None = None) -> DataFrame:
    """Wrap ``(doc_id, spans)`` and carry each line's own styled spans.

    The text is wrapped as a whole, then every line takes its character range of
    the spans; the line break itself is a one-character gap in the source. A
    ``StyledWidth`` measures every character in the face of its own span.
    """
    _checked(max_width)
    staged = docs.select("doc_id", tx.normalize_spans(F.col("spans")).alias("_norm"))
    staged = staged.select("doc_id", tx.style_ranges(F.col("_norm")).alias("_styles"),
                           tx.spans_text(F.col("_norm")).alias("_text")).where(F.col("_text") != "")
    logical = staged.withColumn("_lines", F.split("_text", "\n"))
    starts = tx.running_starts(F.transform("_lines", lambda s: F.length(s) + 1))
    rows = logical.withColumn("_starts", starts).select(
        "doc_id", "_styles", F.posexplode(F.arrays_zip("_lines", "_starts")).alias("line_ord", "_z"))
    line, first = F.col("_z._lines"), F.col("_z._starts")
    if isinstance(measure, StyledWidth):
        wrapped = measure.bound(lambda units: let(measure.limit(max_width), lambda n: _wrap_glyphs(
            line, n, lambda text, at: units(text, first + at, F.col("_styles")))))
    elif isinstance(measure, FontWidth):
        wrapped = _with_glyphs(measure, max_width, lambda n, units: _wrap_glyphs(line, n, units))
    else:
        wrapped = _wrap_line(line, max_width, measure or em_width(size_pt))
    rows = rows.withColumn("_wrapped", wrapped)
    rows = rows.withColumn("_at", tx.running_starts(F.transform("_wrapped", lambda s: F.length(s))))
    out = rows.select("doc_id", "_styles", "line_ord", F.col("_z._starts").alias("_start"),
                      F.posexplode(F.arrays_zip("_wrapped", "_at")).alias("wrap_ord", "_p"))
    return out.select("doc_id", "line_ord", "wrap_ord", F.col("_p._wrapped").alias("text"),
                      tx.style_piece(F.col("_p._wrapped"), F.col("_start") + F.col("_p._at"), F.col("_styles")).alias("spans"))


# --- the largest size that fits ---------------------------------------------------

# The least sizes, the halvings of the range, the slack of the height.
SMALLEST_SIZE, DEFAULT_LEAST, HALVINGS, SLACK = 0.1, 4.0, 18, 0.001


def _line_count(measured: Column, limit: Column) -> Column:
    """Lines of a logical line at ``limit``, from its measured words (``w``, widths of its characters ``g``)."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("n"), F.lit(True).alias("blank"))
    state = lambda used, n: F.struct(used.alias("used"), n.alias("n"), F.lit(False).alias("blank"))

    def letters(acc: Column, p: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("used"), F.when(acc["blank"], acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.lit(True).alias("blank"))
        return F.aggregate(p["g"], first, lambda a, w: F.when(~a["blank"] & (a["used"] + w > limit), state(w, a["n"] + 1)).otherwise(
            state(a["used"] + w, a["n"])))

    def step(acc: Column, p: Column) -> Column:
        return (F.when(acc["used"] + p["w"] <= limit, state(acc["used"] + p["w"], acc["n"]))
                .when(p["w"] <= limit, state(p["w"], F.when(acc["blank"], acc["n"]).otherwise(acc["n"] + 1)))
                .otherwise(letters(acc, p)))

    return F.aggregate(measured, start, step, lambda acc: acc["n"])


def fit_text(boxes: DataFrame, font: str | Column, line_height=tx.free_line_height, max_size: str | Column = "max_size_pt",
             min_size: float | Column = DEFAULT_LEAST) -> DataFrame:
    """Adds ``size_pt, line_height_pt, lines, used_height_pt``: the largest size at which ``text`` stays in ``width`` x ``height``.

    The largest size is tried first, then the range to the least is halved a set number of times; if no size fits, the
    least one is taken. Words are measured once, in thousandths of the size: a trial only counts lines.
    ``line_height`` maps a size column to the height of a line. Rows with a null or a width or height not
    above 0 get nulls.
    """
    number = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))
    text, width, height = F.coalesce(F.col("text"), F.lit("")), F.col("width"), F.col("height")
    largest = F.greatest(F.lit(SMALLEST_SIZE), number(max_size).cast("double"))
    least = F.least(largest, F.greatest(F.lit(SMALLEST_SIZE), number(min_size).cast("double")))
    face = FontWidth(font, 1.0)
    good = width.isNotNull() & height.isNotNull() & (width > 0) & (height > 0) & (width < float("inf")) & (height < float("inf")) & ~F.isnan(width) & ~F.isnan(height)

    def words(t: Column, o: Column) -> Column:
        def line(s: Column) -> Column:
            tokens = F.regexp_extract_all(s, F.lit(f"{tx.WS}+|{tx.NOT_WS}+"), F.lit(0))
            glyphs = lambda p: F.transform(F.regexp_extract_all(p, F.lit("(?s)."), F.lit(0)), lambda c: face.units(c, t, o))
            return F.transform(F.transform(tokens, glyphs), lambda g: F.struct(F.aggregate(g, F.lit(0).cast("long"), lambda a, w: a + w).alias("w"), g.alias("g")))
        return F.transform(F.split(tx.unix_newlines(text), "\n"), line)

    measured = let(face.table(), lambda t: let(face.others(), lambda o: words(t, o)))

    def used(size: Column, lines: Column) -> Column:
        limit = FontWidth("Courier", size).limit(width)
        rows = let(limit, lambda n: F.aggregate(lines, F.lit(0), lambda acc, s: acc + _line_count(s, n)))
        return F.when(text == "", F.lit(0.0)).otherwise(size + (rows - 1) * line_height(size))

    def search(lines: Column) -> Column:
        start = F.struct(least.alias("low"), largest.alias("high"), least.alias("best"))

        def halve(acc: Column, _: Column) -> Column:
            return let((acc["low"] + acc["high"]) / 2, lambda mid: F.when(
                used(mid, lines) <= height + SLACK, F.struct(mid.alias("low"), acc["high"].alias("high"), mid.alias("best"))).otherwise(
                F.struct(acc["low"].alias("low"), mid.alias("high"), acc["best"].alias("best"))))

        return F.when(used(largest, lines) <= height + SLACK, largest).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: acc["best"]))

    sized = boxes.withColumn("size_pt", F.when(good, let(measured, search)))
    wrapped = wrap_lines(text, width, FontWidth(font, F.col("size_pt")))
    out = sized.withColumn("line_height_pt", line_height(F.col("size_pt"))).withColumn("lines", F.when(good, wrapped))
    tall = F.when(F.size("lines") == 0, F.lit(0.0)).otherwise(F.col("size_pt") + (F.size("lines") - 1) * F.col("line_height_pt"))
    return out.withColumn("used_height_pt", F.when(F.col("lines").isNotNull(), tall))
