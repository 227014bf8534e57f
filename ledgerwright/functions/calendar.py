"""Calendar periods as integers, in column expressions and on the driver.

A period's ordinal is a gap-free integer, so neighbours differ by one at any grain
and a missing period is a hole in the numbers. Weeks begin on Monday.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")
#: Periods in a season, by grain; 0: none.
SEASON = {"day": 7, "week": 52, "month": 12, "quarter": 4, "year": 0}
_EPOCH = date(1970, 1, 1)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def ordinal(day: Column, grain: str) -> Column:
    """The period ordinal of a date column (bigint)."""
    if grain == "day":
        out = F.unix_date(day)
    elif grain == "week":
        out = F.floor((F.unix_date(day) + 3) / 7)
    elif grain == "month":
        out = F.year(day) * 12 + F.month(day) - 1
    elif grain == "quarter":
        out = F.year(day) * 4 + F.quarter(day) - 1
    elif grain == "year":
        out = F.year(day)
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return out.cast("bigint")


def period_start(number: Column, grain: str) -> Column:
    """The first date of the period with this ordinal."""
    n = number.cast("int")
    if grain == "day":
        return F.date_from_unix_date(n)
    if grain == "week":
        return F.date_from_unix_date(n * 7 - 3)
    if grain == "month":
        return F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)) + 1, F.lit(1))
    if grain == "quarter":
        return F.make_date(F.floor(n / 4).cast("int"), F.pmod(n, F.lit(4)) * 3 + 1, F.lit(1))
    return F.make_date(n, F.lit(1), F.lit(1))


def period_key(number: Column, grain: str) -> Column:
    """The period's text key: 2024-05-06 (days and weeks), 2024-05, 2024-Q2 or 2024."""
    start = period_start(number, grain)
    if grain in ("day", "week"):
        return F.date_format(start, "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format(start, "yyyy"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, "yyyy")


def ordinal_of(day: date, grain: str) -> int:
    n = (day - _EPOCH).days
    if grain == "day":
        return n
    if grain == "week":
        return (n + 3) // 7
    if grain == "month":
        return day.year * 12 + day.month - 1
    if grain == "quarter":
        return day.year * 4 + (day.month - 1) // 3
    if grain == "year":
        return day.year
    raise ValueError(f"unknown grain {grain!r}")


def start_of(number: int, grain: str) -> date:
    if grain == "day":
        return _EPOCH + timedelta(days=number)
    if grain == "week":
        return _EPOCH + timedelta(days=number * 7 - 3)
    if grain == "month":
        return date(number // 12, number % 12 + 1, 1)
    if grain == "quarter":
        return date(number // 4, number % 4 * 3 + 1, 1)
    return date(number, 1, 1)


def end_of(number: int, grain: str) -> date:
    return start_of(number + 1, grain) - timedelta(days=1)


def length_of(number: int, grain: str) -> int:
    return (end_of(number, grain) - start_of(number, grain)).days + 1


def key_of(number: int, grain: str) -> str:
    start = start_of(number, grain)
    if grain in ("day", "week"):
        return start.isoformat()
    if grain == "month":
        return f"{start.year:04d}-{start.month:02d}"
    if grain == "quarter":
        return f"{start.year:04d}-Q{(start.month + 2) // 3}"
    return f"{start.year:04d}"


def label_of(number: int, grain: str) -> str:
    """The period as shown to people: 6 May 2024, Week of 6 May 2024, May 2024, Q2 2024, 2024."""
    start = start_of(number, grain)
    day = f"{start.day} {MONTHS[start.month - 1][:3]} {start.year}"
    if grain == "day":
        return day
    if grain == "week":
        return f"Week of {day}"
    if grain == "month":
        return f"{MONTHS[start.month - 1][:3]} {start.year}"
    if grain == "quarter":
        return f"Q{(start.month + 2) // 3} {start.year}"
    return str(start.year)


def pick_grain(first: date, last: date) -> str:
    """The grain that suits a span: 45 days daily, 200 weekly, 1200 monthly, quarterly beyond."""
    days = (last - first).days
    return "day" if days <= 45 else "week" if days <= 200 else "month" if days <= 1200 else "quarter"


_KEYS = (
    (re.compile(r"^(\d{4})-(\d{2})-(\d{2})$"), "day"),
    (re.compile(r"^(\d{4})-(\d{2})$"), "month"),
    (re.compile(r"^(\d{4})-Q([1-4])$", re.I), "quarter"),
    (re.compile(r"^(\d{4})$"), "year"),
)


def normalize_key(text: str) -> str:
    """A spoken period ("May 2026", "Q2 2026", "2026/05") as a key; other text unchanged."""
    t = text.strip()
    if m := re.match(r"^(\d{4})/(\d{1,2})$", t):
        return f"{m[1]}-{int(m[2]):02d}"
    if m := re.match(r"^q([1-4])[\s-]*(\d{4})$", t, re.I):
        return f"{m[2]}-Q{m[1]}"
    if m := re.match(r"^(\d{4})[\s-]*q([1-4])$", t, re.I):
        return f"{m[1]}-Q{m[2]}"
    if m := re.match(r"^([a-z]{3,9})\.?,?\s+(\d{4})$", t, re.I):
        for i, name in enumerate(MONTHS):
            if len(m[1]) >= 3 and name.lower().startswith(m[1].lower()):
                return f"{m[2]}-{i + 1:02d}"
    return t


def grain_of_key(key: str) -> str | None:
    return next((grain for pattern, grain in _KEYS if pattern.match(key.strip())), None)


def range_of_key(key: str, grain: str | None = None) -> tuple[date, date] | None:
    """First and last date of a period key; a date names its week where grain is week. None: not a key."""
    key = normalize_key(key)
    for pattern, kind in _KEYS:
        m = pattern.match(key)
        if not m:
            continue
        try:
            if kind == "day":
                day = date(int(m[1]), int(m[2]), int(m[3]))
                if grain == "week":
                    n = ordinal_of(day, "week")
                    return start_of(n, "week"), end_of(n, "week")
                return day, day
            if kind == "month":
                y, mth = int(m[1]), int(m[2])
                return date(y, mth, 1), date(y, mth, monthrange(y, mth)[1])
            if kind == "quarter":
                n = int(m[1]) * 4 + int(m[2]) - 1
                return start_of(n, "quarter"), end_of(n, "quarter")
            return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
        except ValueError:
            return None
    return None
