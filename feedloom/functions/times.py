"""Timestamps: raw ISO strings are kept next to parsed values, because some
orders are lexicographic on the raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import latin_digits

ISO_SHAPE = r"^\d{4}(-\d{2}){0,2}([T ].*)?$"


def parse_ts(raw: Column) -> Column:
    """ISO-8601 or null.  The guard rejects ``12:30``, which a bare cast would
    read as a time today."""
    return F.when(raw.rlike(ISO_SHAPE), raw.try_cast("timestamp"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def age_hours(ts: Column, now: Column) -> Column:
    return F.round((millis(now) - millis(ts)) / F.lit(3_600_000.0), 2)


def _formatted(raw: Column, pattern: str, zone: str | None) -> Column:
    ts = parse_ts(raw)
    shown = F.from_utc_timestamp(ts, zone) if zone else ts
    return F.coalesce(F.date_format(shown, pattern), latin_digits(raw), F.lit(""))


def format_datetime(raw: Column, zone: str | None = None) -> Column:
    """``Apr 28, 14:30``; unparseable text is shown as it is, null as empty."""
    return _formatted(raw, "MMM d, HH:mm", zone)


def format_date(raw: Column, zone: str | None = None) -> Column:
    return _formatted(raw, "MMM d, yyyy", zone)
