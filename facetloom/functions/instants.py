"""Instants as wall-clock time in UTC (``timestamp_ntz``): no expression here reads the session's time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
DATE_UNITS = {"week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def _epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def utc_of(c: Column, dtype: str, zone: str) -> Column:
    """Timestamps are instants; wall-clock times and dates (midnight) are read in ``zone``, of two in an overlap the earlier."""
    if dtype == "timestamp":
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch())
    wall = c.cast("timestamp_ntz")
    return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def instant_of(utc: Column) -> Column:
    """The ``timestamp`` of a time in UTC."""
    days = F.datediff(utc.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(utc) * 3600 + F.minute(utc) * 60
    micros = (F.date_part(F.lit("SECONDS"), utc) * 1_000_000).cast("long")
    return F.timestamp_micros(seconds * 1_000_000 + micros)


def local_date(utc: Column, zone: str) -> Column:
    return (utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)).cast("date")


def period_of(utc: Column, zone: str, unit: str) -> Column:
    """The first day of the calendar period in ``zone``."""
    day = local_date(utc, zone)
    return day if unit == "day" else F.trunc(day, DATE_UNITS[unit])


def utc_literal(t: datetime) -> Column:
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
