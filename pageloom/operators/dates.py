"""Dates and clock times inside text lines, with their place on the page.

Everything happens inside the line's own row with array functions: matches,
priority, overlap, nearest-date binding and geometry. The only row expansion is
the final explode, and there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.functions.dates import hour_24, month_number, safe_date, widen_year
from pageloom.functions.text import WS

# The recognised date and time formats.
_MONTH = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
          "Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
_NAMED = rf"([0-3]?\d){WS}+({_MONTH})(?:{WS}*,?{WS}*(\d{{4}}))?"
_NUMERIC = r"([0-3]?\d)[/.]([01]?\d)[/.](\d{2}|\d{4})"
_TO = rf"{WS}*(?:-|–|—|to){WS}*"
_CLOCK = rf"(?:([01]?\d|2[0-3]):([0-5]\d)|([1-9]|1[0-2]){WS}*(am|pm))"

_ANY_CASE = "(?i)"
NAMED_RANGE = rf"{_ANY_CASE}\b{_NAMED}{_TO}{_NAMED}\b"
NUMERIC_RANGE = rf"\b{_NUMERIC}{_TO}{_NUMERIC}\b"
NAMED_DATE = rf"{_ANY_CASE}\b{_NAMED}\b"
NUMERIC_DATE = rf"\b{_NUMERIC}\b"
CLOCK_TIME = rf"{_ANY_CASE}\b{_CLOCK}\b"


_MARK, _NOT_MARK = "\ue000", "\ue001"  # private-use characters, neither blank nor word


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<raw,start>> with exact character offsets.

    The text between matches is what the same pattern leaves when its matches are
    replaced by a mark, so the offsets are those of the regex engine itself.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    marked = F.regexp_replace(F.translate(text, _MARK, _NOT_MARK), pattern, _MARK)
    between = F.split(marked, _MARK, -1)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda acc, s: acc + F.length(s))
    return F.transform(found, lambda raw, i: F.struct(
        raw.alias("raw"), (total(between, i + 1) + total(found, i)).alias("start")))


def _staged(items: Column, *stages) -> Column:
    """Apply struct-building lambdas one after another.

    Each stage reads plain fields of the one before, so no expression is
    evaluated more than once per match.
    """
    def build(stage):
        return lambda m: F.struct(m["raw"].alias("raw"), m["start"].alias("start"),
                                  *[c.alias(n) for n, c in stage(m).items()])
    for stage in stages:
        items = F.transform(items, build(stage))
    return items


def _none() -> Column:
    return F.lit(None).cast("string")


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _groups(pattern: str, count: int):
    return lambda m: {f"g{k}": F.regexp_extract(m["raw"], pattern, k) for k in range(1, count + 1)}


def _as_detection(m: Column, end=None, alt_start=None, alt_end=None) -> dict:
    return {"stop": m["start"] + F.length(m["raw"]), "start_iso": m["s"], "end_iso": _none() if end is None else end,
            "all_day": F.lit(True), "alt_start_iso": _none() if alt_start is None else alt_start,
            "alt_end_iso": _none() if alt_end is None else alt_end}


def _named_ranges(text: Column, as_of_year: Column) -> Column:
    blank = lambda a, b: F.when(a != "", a).otherwise(b)
    return _staged(
        _matches(text, NAMED_RANGE), _groups(NAMED_RANGE, 6),
        lambda m: {"y1": blank(m["g3"], m["g6"]), "y2": blank(m["g6"], m["g3"]), "open": m["g6"] == "",
                   "m1": month_number(m["g2"]), "m2": month_number(m["g5"]), "d1": _int(m["g1"]), "d2": _int(m["g4"])},
        lambda m: {**{k: m[k] for k in ("open", "m1", "m2", "d1", "d2")},
                   "y1": widen_year(m["y1"], as_of_year), "y2": widen_year(m["y2"], as_of_year)},
        lambda m: {"open": m["open"], "s": safe_date(m["y1"], m["m1"], m["d1"]),
                   "e": safe_date(m["y2"], m["m2"], m["d2"]), "later": safe_date(m["y2"] + 1, m["m2"], m["d2"])},
        lambda m: {"s": m["s"], "e": F.when((m["e"] < m["s"]) & m["open"], m["later"]).otherwise(m["e"])},
        lambda m: {"s": F.when(m["e"].isNotNull(), m["s"]), "e": m["e"]},
        lambda m: _as_detection(m, end=m["e"]))


def _numeric_ranges(text: Column, as_of_year: Column) -> Column:
    small = lambda a, b: (a <= 12) & (b <= 12)
    return _staged(
        _matches(text, NUMERIC_RANGE), _groups(NUMERIC_RANGE, 6),
        lambda m: {"y1": widen_year(m["g3"], as_of_year), "y2": widen_year(m["g6"], as_of_year),
                   "d1": _int(m["g1"]), "m1": _int(m["g2"]), "d2": _int(m["g4"]), "m2": _int(m["g5"])},
        lambda m: {"s": safe_date(m["y1"], m["m1"], m["d1"]), "e": safe_date(m["y2"], m["m2"], m["d2"]),
                   "as": F.when(small(m["d1"], m["m1"]), safe_date(m["y1"], m["d1"], m["m1"])),
                   "ae": F.when(small(m["d2"], m["m2"]), safe_date(m["y2"], m["d2"], m["m2"]))},
        lambda m: {"s": F.when(m["e"].isNotNull(), m["s"]), "e": m["e"], "as": m["as"],
                   "ae": F.when(m["as"].isNotNull(), m["ae"])},
        lambda m: _as_detection(m, m["e"], m["as"], m["ae"]))


def _named_dates(text: Column, as_of_year: Column) -> Column:
    return _staged(
        _matches(text, NAMED_DATE), _groups(NAMED_DATE, 3),
        lambda m: {"y": widen_year(m["g3"], as_of_year), "m": month_number(m["g2"]), "d": _int(m["g1"])},
        lambda m: {"s": safe_date(m["y"], m["m"], m["d"])},
        lambda m: _as_detection(m))


def _numeric_dates(text: Column, as_of_year: Column) -> Column:
    return _staged(
        _matches(text, NUMERIC_DATE), _groups(NUMERIC_DATE, 3),
        lambda m: {"y": widen_year(m["g3"], as_of_year), "d": _int(m["g1"]), "m": _int(m["g2"])},
        lambda m: {"dm": safe_date(m["y"], m["m"], m["d"]),
                   "md": F.when((m["d"] <= 12) & (m["m"] <= 12), safe_date(m["y"], m["d"], m["m"]))},
        lambda m: {"s": F.coalesce(m["dm"], m["md"]), "alt": F.when(m["dm"] != m["md"], m["md"])},
        lambda m: _as_detection(m, alt_start=m["alt"]))


def _dated(detections: Column) -> Column:
    return F.filter(detections, lambda d: d["start_iso"].isNotNull())


def _apart(accepted: Column, candidates: Column) -> Column:
    return F.filter(candidates, lambda c: ~F.exists(
        accepted, lambda a: (c["start"] < a["stop"]) & (c["stop"] > a["start"])))


def _times(text: Column, accepted: Column, as_of: Column) -> Column:
    nearest = lambda m: F.array_min(F.transform(accepted, lambda a, i: F.struct(
        F.abs((a["start"] + a["stop"]) / 2 - m["start"]).alias("d"), i.alias("i"), a["start_iso"].alias("iso"))))
    found = _staged(
        _matches(text, CLOCK_TIME), _groups(CLOCK_TIME, 4),
        lambda m: {"h": F.coalesce(_int(m["g1"]), _int(m["g3"])), "n": F.coalesce(_int(m["g2"]), F.lit(0)),
                   "half": m["g4"], "near": nearest(m)["iso"]},
        lambda m: {"s": F.concat(F.coalesce(m["near"], F.date_format(as_of, "yyyy-MM-dd")),
                                 F.format_string("T%02d:%02d:00Z", hour_24(m["h"], m["half"]), m["n"]))},
        lambda m: {**_as_detection(m), "all_day": F.lit(False)})
    return _apart(accepted, found)


def span_rect(segments: Column, line_rect: Column, start: Column, stop: Column) -> Column:
    """Rectangle of the characters ``[start, stop)``, interpolated inside each run."""
    hit = F.filter(segments, lambda s: F.greatest(start, s["start"]) < F.least(stop, s["end"]))
    def cut(s: Column) -> Column:
        length = F.greatest(F.lit(1), s["end"] - s["start"])
        lo = (F.greatest(start, s["start"]) - s["start"]) / length
        hi = (F.least(stop, s["end"]) - s["start"]) / length
        x = s["x"] + s["w"] * lo
        return F.struct(x.alias("x"), s["y"].alias("y"), (x + s["w"] * (hi - lo)).alias("r"), (s["y"] + s["h"]).alias("t"))
    def union(cuts: Column) -> Column:
        x, y = F.array_min(cuts["x"]), F.array_min(cuts["y"])
        box = F.struct(x.alias("x"), y.alias("y"), (F.array_max(cuts["r"]) - x).alias("w"), (F.array_max(cuts["t"]) - y).alias("h"))
        return F.when(F.size(cuts) > 0, box).otherwise(line_rect)

    return let(F.transform(hit, cut), union)


def date_spans(line_rows: DataFrame, as_of) -> DataFrame:
    """Date and time matches of lines built with ``segments``, one row each.

    ``as_of`` (date or column) supplies the missing year and the day of a clock
    time on a line without dates. Dates are accepted in the order named range,
    numeric range, named date, numeric date; times bind to the nearest date.
    """
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    day = day.cast("date")
    year = F.year(day)
    text = F.col("text")
    df = line_rows.where(text.rlike(r"\d")).withColumn("_acc", _dated(_named_ranges(text, year)))
    for detect in (_numeric_ranges, _named_dates, _numeric_dates):
        df = df.withColumn("_m", _dated(detect(text, year)))
        df = df.withColumn("_acc", F.concat("_acc", _apart(F.col("_acc"), F.col("_m")))).drop("_m")
    df = df.withColumn("_acc", F.concat("_acc", _times(text, F.col("_acc"), day)))
    # An outer explode keeps the optimiser from repeating the whole detection as a filter.
    df = df.withColumn("_d", F.explode_outer("_acc")).where(F.col("_d").isNotNull())
    rect = span_rect(F.col("segments"), F.struct("x", "y", "w", "h"), F.col("_d.start"), F.col("_d.stop"))
    keep = [c for c in line_rows.columns if c not in ("text", "segments", "x", "y", "w", "h", "style")]
    return (df.withColumn("_r", rect)
              .select(*keep, F.col("text").alias("context"), "_d.*", "_r.*"))
