"""Calendar periods and relative presets in a time zone (driver side)."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

GRANULARITIES = ["day", "week", "month", "quarter", "year"]
PRESETS = ["today", "yesterday", "last7Days", "last30Days", "thisWeek", "lastWeek", "thisMonth", "lastMonth", "thisQuarter", "lastQuarter", "thisYear", "lastYear", "yearToDate"]
YEAR_DAYS = 365.2425
MEAN_DAYS = {"day": 1.0, "week": 7.0, "month": YEAR_DAYS / 12, "quarter": YEAR_DAYS / 4, "year": YEAR_DAYS}


def period_start(day: date, unit: str) -> date:
    if unit == "week":
        return day - timedelta(days=day.weekday())
    if unit == "day":
        return day
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return date(day.year, (day.month - 1) // months * months + 1, 1)


def next_period(start: date, unit: str) -> date:
    if unit in ("day", "week"):
        return start + timedelta(days=7 if unit == "week" else 1)
    at = start.year * 12 + start.month - 1 + {"month": 1, "quarter": 3, "year": 12}[unit]
    return date(at // 12, at % 12 + 1, 1)


def to_instant(local: date | datetime, zone: str) -> datetime:
    """The UTC instant of a wall-clock time; of two in an overlap the earlier."""
    if not isinstance(local, datetime):
        local = datetime(local.year, local.month, local.day)
    return local.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)


def resolve(preset: str, now: datetime, zone: str) -> tuple[datetime, datetime]:
    """The half-open interval of instants that ``preset`` means at ``now``."""
    today = now.astimezone(ZoneInfo(zone)).date()
    day = timedelta(days=1)
    if preset in ("today", "yesterday"):
        first = today - day * (preset == "yesterday")
        span = first, first + day
    elif preset in ("last7Days", "last30Days"):
        span = today - day * (int(preset[4:-4]) - 1), today + day
    elif preset == "yearToDate":
        span = period_start(today, "year"), today + day
    elif preset in PRESETS:
        unit = preset[4:].lower()
        start = period_start(today, unit)
        span = (start, next_period(start, unit)) if preset.startswith("this") else (period_start(start - day, unit), start)
    else:
        raise ValueError(f"unknown preset {preset}")
    return to_instant(span[0], zone), to_instant(span[1], zone)


def auto_granularity(low: date | None, high: date | None, most: int = 30) -> str:
    """The finest unit that cuts low..high into at most ``most`` periods."""
    if low is None or high is None:
        return "month"
    days = (high - low).days + 1
    return next((u for u in GRANULARITIES if days / MEAN_DAYS[u] <= most), "year")
