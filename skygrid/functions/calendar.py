"""Dates, and years and months cut by position in the series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(value: int | str | dt.date, end: bool = False) -> dt.date:
    """A year stands for its first (or last) day; a text is an ISO date."""
    if isinstance(value, bool):
        raise TypeError("a day is a year, an ISO date or a date")
    if isinstance(value, int):
        return dt.date(value, 12, 31) if end else dt.date(value, 1, 1)
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str):
        return dt.date.fromisoformat(value.strip()[:10])
    raise TypeError("a day is a year, an ISO date or a date")


def parse_range(start: int | str | dt.date, end: int | str | dt.date | None = None) -> tuple[dt.date, dt.date]:
    """First and last day; without an end, that of start (a year is then the whole year)."""
    a, b = parse_day(start), parse_day(start if end is None else end, end=True)
    if a > b:
        raise ValueError("the start lies after the end")
    return a, b


def is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def total_days(start: dt.date, end: dt.date) -> int:
    """Days from start to end, both included."""
    return (end - start).days + 1


def pseudo_date(pos: Column, year0: int) -> Column:
    """The day that cuts years and months by position: 1 January of the first year plus pos."""
    return F.date_add(F.lit(f"{year0}-01-01").cast("date"), pos)


def year_bucket(pos: Column, year0: int) -> Column:
    return F.year(pseudo_date(pos, year0)) - F.lit(year0)


def month_bucket(pos: Column, year0: int) -> Column:
    p = pseudo_date(pos, year0)
    return (F.year(p) - F.lit(year0)) * 12 + F.month(p) - 1


def year_ends(start: dt.date, end: dt.date) -> list[int]:
    """Days up to the end of each calendar year from that of start to that of end, counted by position."""
    out, total = [], 0
    for y in range(start.year, end.year + 1):
        total += 366 if is_leap(y) else 365
        out.append(total)
    return out


def month_ends(start: dt.date, end: dt.date) -> list[int]:
    """Days up to the end of each month of those years, counted by position."""
    out, total = [], 0
    for y in range(start.year, end.year + 1):
        for m in range(1, 13):
            total += total_days(dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)) - 1
            out.append(total)
    return out
