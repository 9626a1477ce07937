"""Text, font-name and rich-text column functions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let

# The Unicode white space that counts as blank.
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_WS = WS.replace("[", "[^", 1)
WS_CHARS = ("\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")

# Patterns over font names.
SANS_FIRST = r"(?i)sans[-_\s]*serif"
SERIF = (r"(?i)times|georgia|serif|cambria|garamond|minion|book[-_\s]*antiqua|palatino|"
         r"baskerville|bodoni|constantia|merriweather")
MONO = r"(?i)courier|mono|consolas"
BOLD_NAME = r"(?i)bold|black|heavy|semibold|[6-9]00"
ITALIC_NAME = r"(?i)italic|oblique"
KNOWN_FONT = r"(?i)times|georgia|serif|courier|mono|consolas|helvetica|arial|sans|inter|roboto"

# The twelve standard fonts.
STANDARD_FONTS = [
    ("serif", False, False, "Times-Roman"), ("serif", True, False, "Times-Bold"),
    ("serif", False, True, "Times-Italic"), ("serif", True, True, "Times-BoldItalic"),
    ("sans", False, False, "Helvetica"), ("sans", True, False, "Helvetica-Bold"),
    ("sans", False, True, "Helvetica-Oblique"), ("sans", True, True, "Helvetica-BoldOblique"),
    ("mono", False, False, "Courier"), ("mono", True, False, "Courier-Bold"),
    ("mono", False, True, "Courier-Oblique"), ("mono", True, True, "Courier-BoldOblique"),
]

# What binds to a neighbour. Java's $ also stands before a last \u0085, Arrow's does not.
NUMBER = r"^[0-9.,/-]{1,6}$"
NUMBER_END = "^[0-9.,/-]{1,6}\u0085?$"
CLOSING = r"^[,.;:!?%)}\]]"
OPENING = r"[(\[{/]$"


def words(text: Column) -> Column:
    """The words between white space, in order."""
    return F.array_remove(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " "), "")


def utrim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def utrim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return utrim(F.regexp_replace(c, f"{WS}+", " "))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def font_family(name: Column) -> Column:
    return (F.when(name.rlike(SANS_FIRST), "sans").when(name.rlike(SERIF), "serif")
            .when(name.rlike(MONO), "mono").otherwise("sans"))


def font_bold(name: Column) -> Column:
    return name.rlike(BOLD_NAME)


def font_italic(name: Column) -> Column:
    return name.rlike(ITALIC_NAME)


def is_indic(text: Column) -> Column:
    """Contains a Devanagari or Tamil character."""
    return text.rlike(r"[\u0900-\u097f\u0b80-\u0bff]")


def is_standalone_number(text: Column) -> Column:
    return utrim(text).rlike(NUMBER)


def starts_closing(text: Column) -> Column:
    """Begins with punctuation that binds to the word before it."""
    return text.rlike(CLOSING)


def ends_opening(text: Column) -> Column:
    return F.right(text, F.lit(1)).isin("(", "[", "{", "/")


def line_height(block_height: Column, block_size: Column, size: Column) -> Column:
    """Detected line height rescaled to ``size``, kept within 1.0 to 1.5 times it."""
    detected = block_height * (size / F.greatest(F.lit(1.0), block_size))
    return F.least(size * 1.5, F.greatest(size * 1.0, detected))


def free_line_height(size: Column) -> Column:
    return size * 1.2


# --- bullet editor text ---------------------------------------------------

def format_bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("• "), utrim(s))), "\n")


def parse_bullets(text: Column) -> Column:
    lines = F.split(unix_newlines(text), "\n")
    stripped = F.transform(lines, lambda s: utrim(F.regexp_replace(s, f"^{WS}*•{WS}?", "")))
    return F.filter(stripped, lambda s: s != "")


# --- styled spans: array<struct<text,bold,italic>> ------------------------

_SPANS = "array<struct<text:string,bold:boolean,italic:boolean>>"


def _span(text: Column, bold: Column, italic: Column) -> Column:
    return F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"))


def normalize_spans(spans: Column) -> Column:
    """Unix newlines, no empty spans, equal-style neighbours merged.

    Works by breaking the array where the style changes and joining each
    stretch, so no accumulator is copied per span.
    """
    clean = F.filter(F.transform(spans, lambda s: _span(unix_newlines(s["text"]), s["bold"], s["italic"])),
                     lambda s: s["text"] != "")

    def starts_of(a: Column) -> Column:
        def opens(i: Column) -> Column:
            here, before = F.element_at(a, i), F.element_at(a, F.greatest(i - 1, F.lit(1)))
            return ((i == 1) | ~here["bold"].eqNullSafe(before["bold"]) | ~here["italic"].eqNullSafe(before["italic"]))
        return F.filter(F.sequence(F.lit(1), F.size(a)), opens)

    def stretch(a: Column, starts: Column):
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(a) + 1)
        return lambda s, k: let(F.slice(a, s, end(k) - s), lambda part: _span(
            F.array_join(part["text"], ""), part[0]["bold"], part[0]["italic"]))

    merge = lambda a: F.when(F.size(a) > 0, let(starts_of(a), lambda starts: F.transform(starts, stretch(a, starts)))).otherwise(
        F.array().cast(_SPANS))
    return let(clean, merge)


def spans_text(spans: Column) -> Column:
    return F.array_join(spans["text"], "")


def effective_spans(text: Column, bold: Column, italic: Column, spans: Column) -> Column:
    """Normalised spans when they spell ``text``; otherwise one span in the base style."""
    def choose(norm: Column) -> Column:
        usable = (F.size(norm) > 0) & (spans_text(norm) == text)
        return (F.when(usable, norm).when(text != "", F.array(_span(text, bold, italic)))
                .otherwise(F.array().cast(_SPANS)))
    return let(normalize_spans(F.coalesce(spans, F.array().cast(_SPANS))), choose)


def finalize_spans(spans: Column, base_bold: Column, base_italic: Column) -> Column:
    """struct<text,bold,italic,spans>: uniform spans collapse into the base style."""
    def collapse(norm: Column) -> Column:
        # Neighbours differ after normalising, so uniform means a single span.
        uniform = F.size(norm) == 1
        first = F.get(norm, F.lit(0))
        return F.struct(
            spans_text(norm).alias("text"),
            F.when(uniform, first["bold"]).otherwise(base_bold).alias("bold"),
            F.when(uniform, first["italic"]).otherwise(base_italic).alias("italic"),
            F.when(F.size(norm) > 1, norm).alias("spans"))
    return let(normalize_spans(spans), collapse)


def running_starts(lengths: Column, block: int = 128, kind: str = "int") -> Column:
    """Start offset of each piece, given the lengths of consecutive pieces (of type ``kind``).

    Blocks of pieces are summed first, so that no accumulator is copied once per piece of a long array.
    """
    start = F.struct(F.lit(0).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("starts"))

    def within(part: Column) -> Column:
        return F.aggregate(part, start, lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")))

    def whole(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(block))
        parts = F.transform(firsts, lambda i: within(F.slice(all_, i, F.lit(block))))
        return let(parts, lambda p: let(within(p["at"])["starts"], lambda base: F.flatten(
            F.transform(p, lambda x, k: F.transform(x["starts"], lambda s: s + F.get(base, k))))))

    return let(lengths, lambda all_: F.when(F.size(all_) > block, whole(all_)).otherwise(within(all_)["starts"]))


def style_ranges(spans: Column) -> Column:
    """array<struct<start,stop,bold,italic>>: where each style applies, without the text."""
    def ranges(s: Column) -> Column:
        lengths = F.transform(s, lambda p: F.length(p["text"]))
        return let(running_starts(lengths), lambda starts: F.transform(s, lambda p, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(p["text"])).alias("stop"),
            p["bold"].alias("bold"), p["italic"].alias("italic"))))
    return let(spans, ranges)


def style_piece(text: Column, at: Column, ranges: Column) -> Column:
    """Spans of a piece of text that starts at offset ``at`` of the styled text."""
    end = at + F.length(text)
    inside = F.filter(ranges, lambda r: (r["start"] < end) & (r["stop"] > at))

    def cut(r: Column) -> Column:
        lo, hi = F.greatest(r["start"], at), F.least(r["stop"], end)
        return _span(F.substring(text, lo - at + 1, hi - lo), r["bold"], r["italic"])

    return normalize_spans(F.transform(inside, cut))


def slice_spans(spans: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a span array, styles kept."""
    part = F.substring(spans_text(spans), start + 1, end - start)
    return style_piece(part, start, style_ranges(spans))


def escape_html(text: Column) -> Column:
    # The HTML escapes, ampersand first.
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("'", "&#39;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def spans_to_html(text: Column, bold: Column, italic: Column, spans: Column) -> Column:
    eff = effective_spans(text, bold, italic, spans)
    html = F.array_join(F.transform(eff, lambda s: F.concat(
        F.lit('<span style="font-weight:'), F.when(s["bold"], "bold").otherwise("normal"),
        F.lit(";font-style:"), F.when(s["italic"], "italic").otherwise("normal"),
        F.lit('">'), escape_html(s["text"]), F.lit("</span>"))), "")
    return F.when(spans.isNull(), escape_html(unix_newlines(text))).otherwise(html)


# --- speech, answers and links ------------------------------------------

NOT_IN_DOCUMENT = "[[NOT_IN_DOCUMENT]]"  # fixed value
SPEECH_CHARS = 2500
SNIPPET_CHARS = 200


def strip_page_markers(text: Column) -> Column:
    return utrim(F.regexp_replace(F.regexp_replace(text, r"(?i)\[Page[^\]]*\]", ""), f"{WS}{{2,}}", " "))


def clip_for_speech(text: Column, chars: int = SPEECH_CHARS) -> Column:
    return F.left(text, F.lit(chars))


def base_mime(raw: Column) -> Column:
    base = utrim(F.substring_index(raw, ";", 1))
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("audio/webm"))


def error_class(name: Column, message: Column) -> Column:
    return (F.when(name.isin("NotAllowedError", "SecurityError"), "permission")
            .when(message.rlike("(?i)permission|denied|not allowed"), "permission")
            .when(message.rlike("(?i)empty (recording|transcript)|didn.t catch"), "empty")
            .otherwise("other"))


def readable_error(message: Column, causes: Column) -> Column:
    """First cause of an aggregate error, else its own message."""
    return F.coalesce(F.get(causes, F.lit(0)), message)


def decode_base64(text: Column) -> Column:
    return F.unbase64(text)


def endpoint_path(url: Column, mount: str) -> Column:
    """URL path after the last ``/mount/``."""
    return F.regexp_replace(F.parse_url(url, F.lit("PATH")), f"^.*/{mount}/", "")


def join_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))


def _percent_encode(text: Column) -> Column:
    """Component encoding: spaces as %20 and ``! ' ( ) ~`` left alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, raw in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def snippet(text: Column) -> Column:
    return F.left(collapse_ws(text), F.lit(SNIPPET_CHARS))


def meaning_url(text: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="),
                    _percent_encode(F.concat(F.lit("meaning of "), snippet(text))))


def maps_url(text: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), _percent_encode(snippet(text)))


def date_search_url(title: Column, raw: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="),
                    F.url_encode(collapse_ws(F.concat_ws(" ", title, raw))))


def calendar_url(title: Column, dates: Column, details: Column) -> Column:
    """Pre-filled calendar event; an empty title is an error."""
    clean, more = collapse_ws(title), collapse_ws(F.coalesce(details, F.lit("")))
    checked = F.when(clean != "", clean).otherwise(
        F.raise_error(F.lit("calendar event title cannot be empty")).cast("string"))
    return F.concat(
        F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), F.url_encode(checked),
        F.lit("&dates="), F.url_encode(dates),
        F.when(more != "", F.concat(F.lit("&details="), F.url_encode(more))).otherwise(""))


Measure = Callable[[Column], Column]
