"""Calendar column functions: validation, links, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import text as tx


def _days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (F.when(month == 2, F.when(leap, 29).otherwise(28))
            .when(month.isin(4, 6, 9, 11), 30).otherwise(31))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """ISO date string, or null when the three numbers are no calendar date.

    Years below 100 are rejected: two-digit years must be widened first.
    """
    valid = ((year >= 100) & month.between(1, 12) & (day >= 1) & (day <= _days_in_month(year, month)))
    return F.when(valid, F.format_string("%04d-%02d-%02d", year, month, day))


def widen_year(text: Column, default: Column) -> Column:
    """Year digits to a number: blank gives the default, two digits pivot at 70."""
    number = F.when(text != "", text).cast("int")
    return (F.when(F.coalesce(text, F.lit("")) == "", default)
            .when(F.length(text) == 2, F.when(number >= 70, number + 1900).otherwise(number + 2000))
            .otherwise(number))


def month_number(name: Column) -> Column:
    """Month number of an English month name, short or long."""
    months = "janfebmaraprmayjunjulaugsepoctnovdec"
    return F.floor(F.instr(F.lit(months), F.left(F.lower(name), F.lit(3))) / 3).cast("int") + 1


def hour_24(hour: Column, meridiem: Column) -> Column:
    half = F.lower(meridiem)
    return (F.when((half == "am") & (hour == 12), 0)
            .when((half == "pm") & (hour != 12), hour + 12).otherwise(hour))


def event_title(context: Column, raw: Column) -> Column:
    """Text around the first occurrence of the match, or ``Travel: match`` if none is left."""
    at = F.instr(context, raw)
    rest = F.when(at > 0, F.concat(F.substring(context, F.lit(1), at - 1), F.lit(" "),
                                   F.substring(context, at + F.length(raw), F.length(context)))).otherwise(context)
    edge = tx.WS[:-1] + r":;,–—-]+"
    near = tx.utrim(F.regexp_replace(F.regexp_replace(rest, f"{tx.WS}+", " "), f"^{edge}|{edge}$", ""))
    return F.when(near != "", F.left(near, F.lit(80))).otherwise(F.concat(F.lit("Travel: "), raw))


def choose_interpretation(mode: Column, day_month: Column, month_day: Column) -> Column:
    return F.when(mode == "month-day", F.coalesce(month_day, day_month)).otherwise(day_month)


def _checked_date(iso: Column) -> Column:
    day = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))
    return F.coalesce(day, F.raise_error(F.concat(F.lit("invalid ISO date: "), iso)).cast("date"))


def _checked_instant(iso: Column) -> Column:
    zoned = F.when(iso.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.coalesce(F.try_to_timestamp(zoned),
                      F.raise_error(F.concat(F.lit("invalid ISO date/time: "), iso)).cast("timestamp"))


def calendar_range(start_iso: Column, end_iso: Column, all_day: Column) -> Column:
    """``start/end`` for a calendar link: exclusive all-day end, or UTC instants with a 1 h default."""
    last = F.date_add(_checked_date(F.coalesce(end_iso, start_iso)), 1)
    days = F.concat(F.date_format(_checked_date(start_iso), "yyyyMMdd"), F.lit("/"),
                    F.date_format(last, "yyyyMMdd"))
    begin = _checked_instant(start_iso)
    finish = F.when(end_iso.isNotNull(), _checked_instant(end_iso)).otherwise(begin + F.expr("INTERVAL 1 HOUR"))
    stamp = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return F.when(all_day, days).otherwise(F.concat(stamp(begin), F.lit("/"), stamp(finish)))
