"""Dates: relative filters, buckets and phrases. ``now`` is always a parameter."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of a unit, and of "recent".
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
RECENT_DAYS = 14


def changed_since(text: str, now: datetime) -> datetime:
    """An ISO date or time, or ``<n>d/w/m/y`` before ``now``; naive values are UTC."""
    if m := re.fullmatch(r"(\d+)([dwmy])", text.strip()):
        return now - timedelta(days=int(m[1]) * UNIT_DAYS[m[2]])
    got = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return got.astimezone(timezone.utc).replace(tzinfo=None) if got.tzinfo else got


def since(ts: Column, text: str, now: datetime) -> Column:
    return ts >= F.lit(changed_since(text, now))


def recent(ts: Column, now: datetime, days: int = RECENT_DAYS) -> Column:
    return F.coalesce(ts >= F.lit(now - timedelta(days=days)), F.lit(False))


def in_window(text: Column, low: str | None, high: str | None) -> Column:
    """Inclusive; a date that can't be read passes."""
    ts = F.try_to_timestamp(text)
    inside = F.lit(True)
    if low:
        inside = inside & (ts >= F.lit(low).cast("timestamp"))
    if high:
        inside = inside & (ts <= F.lit(high).cast("timestamp"))
    return F.coalesce(inside, F.lit(True))


def week_key(ts: Column) -> Column:
    """Year and week of the year with Monday first and week 00 before the first Monday."""
    d = F.to_date(ts)
    week = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def relative(ts: Column, now: datetime) -> Column:
    days = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400)
    say = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    part = lambda k: F.floor(days / k)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, say(days, "day")).when(days < 30, say(part(7), "week")).when(days < 365, say(part(30), "month")).otherwise(say(part(365), "year"))
