"""Calendar expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Month names as the expense files spell them, January first.
MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)


def month_number(name: Column) -> Column:
    """1..12 for a Spanish month name, NULL for anything else."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    position = F.array_position(names, F.lower(F.trim(name)))
    return F.nullif(position, F.lit(0)).cast("int")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def week_number(date: Column) -> Column:
    """Week of the year where week 1 holds January 1st and weeks start on Sunday (not ISO)."""
    new_year_weekday = F.dayofweek(F.trunc(date, "YEAR"))  # 1 = Sunday
    return (F.floor((F.dayofyear(date) + new_year_weekday - 2) / 7) + 1).cast("int")


def month_index(date: Column) -> Column:
    """Months counted from year 0, so that consecutive months differ by one."""
    return F.year(date) * 12 + F.month(date) - 1


def from_month_index(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def in_year(date: Column, year: int) -> Column:
    """A range on the bare column, so that file statistics can skip data."""
    return (date >= F.lit(dt.date(year, 1, 1))) & (date < F.lit(dt.date(year + 1, 1, 1)))


def month_end(period: dt.date) -> dt.date:
    return dt.date(period.year + period.month // 12, period.month % 12 + 1, 1) - dt.timedelta(days=1)
