"""Moments and windows of time, and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for days, as days from now.
DAYS = {"today": 0, "heute": 0, "yesterday": -1, "gestern": -1, "tomorrow": 1, "morgen": 1}
#: Hours of the units of relative moments.
HOURS = {"h": 1, "d": 24, "w": 7 * 24, "m": 30 * 24}
#: The forms of absolute moments, by what they match and how Spark reads them.
FORMS = ((r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"), (r"\d{8}", "yyyyMMdd"))


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def moment(value: Column, now: Column, zone: str = "UTC", end_of_day: bool = False) -> Column:
    """Epoch seconds of words for days, relative moments ("-7d", "+ 2 w", "-3h") and ISO dates and times in ``zone``; null for null and blanks.

    Each kind has one expression and the first that gives a value counts. All but hours and times
    stand for the first (or, with ``end_of_day``, the last) second of their day. ``now`` is in epoch
    seconds. Anything else is an error when it is evaluated.
    """
    word = F.lower(F.trim(value))
    here = F.from_utc_timestamp(F.timestamp_seconds(now), zone)
    day = F.try_element_at(_table(DAYS), word)
    step = F.concat(F.regexp_extract(word, r"^([+-])\s*\d+\s*[dwmh]$", 1), F.regexp_extract(word, r"^[+-]\s*(\d+)\s*[dwmh]$", 1)).try_cast("long")
    unit = F.regexp_extract(word, r"^[+-]\s*\d+\s*([dwmh])$", 1)
    hours = step * F.try_element_at(_table(HOURS), unit)
    # Days are steps of the local clock, hours are not.
    local = F.coalesce(F.date_add(here, day), F.date_add(here, (hours / 24).cast("int")), *(F.when(word.rlike(f"^{p}$"), F.to_date(F.try_to_timestamp(word, F.lit(f)))) for p, f in FORMS))
    begin = F.unix_timestamp(F.to_utc_timestamp((F.date_add(local, 1) if end_of_day else local).cast("timestamp"), zone))
    bound = begin - 1 if end_of_day else begin
    iso = F.when(F.length(word) > 10, word)
    told = F.unix_timestamp(F.when(iso.rlike(r"(z|[+-]\d\d:?\d\d)$"), F.upper(iso).try_cast("timestamp")))
    naive = F.unix_timestamp(F.to_utc_timestamp(F.upper(iso).try_cast("timestamp_ntz").cast("timestamp"), zone))
    got = F.coalesce(F.when(unit == "h", now + hours * 3600), bound, told, naive)
    wrong = F.raise_error(F.concat(F.lit("not a date: "), value, F.lit("; use YYYY-MM-DD, -7d, -2w or today")))
    return F.when(F.coalesce(word, F.lit("")) != "", F.coalesce(got, wrong.cast("long")))


def format_date(epoch: Column, zone: str = "UTC") -> Column:
    """dd.mm.yyyy in a time zone; unbekannt for null and 0."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)
    return F.when(epoch.isNull() | (epoch == 0), F.lit("unbekannt")).otherwise(F.date_format(local, "dd.MM.yyyy"))


def window_start(epoch: Column, unit: str, zone: str) -> Column:
    """Epoch seconds of the local midnight (day) or first of the month (month) before a moment."""
    return F.unix_timestamp(F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)), zone))


def window_end(epoch: Column, unit: str, zone: str) -> Column:
    """Epoch seconds of the next local midnight or first of a month; days of 23 or 25 hours included."""
    local = F.date_trunc(unit, F.from_utc_timestamp(F.timestamp_seconds(epoch), zone))
    nxt = local + (F.expr("INTERVAL 1 DAY") if unit == "day" else F.expr("INTERVAL 1 MONTH"))
    return F.unix_timestamp(F.to_utc_timestamp(nxt, zone))


def backoff(attempts: Column, base: float, at_least: Column | float = 0.0, most: float = 3600.0) -> Column:
    """Seconds until the next attempt: doubled each time, at least what the host asks, at most an hour."""
    least = F.lit(float(at_least)) if isinstance(at_least, (int, float)) else at_least
    return F.least(F.greatest(F.lit(float(base)) * F.pow(F.lit(2.0), attempts), least), F.lit(float(most)))


def outbox_backoff(attempts: Column) -> Column:
    """Seconds until the producer tries again: a minute doubled each time, at most six hours."""
    return F.least(F.lit(21600.0), F.lit(60.0) * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date; null if neither."""
    at = F.try_to_timestamp(F.regexp_replace(header, r"^\w+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("double")).when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(at) - now).cast("double")))
