"""Calendar: Jalali dates both ways, local days, lenient parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Tehran"
#: Days of a 33-year cycle and of four years; the first day of year -1595 of the
#: cycle's calendar lies so many days before the day count's zero.
CYCLE_DAYS, FOUR_YEARS, YEAR = 12053, 1461, 365
EPOCH_DAYS = 1_075_195  # days from the calendar's zero to 1970-01-01


def to_jalali(date: Column) -> Column:
    """struct(year, month, day) of a date, by integer arithmetic on its day number."""
    n = F.unix_date(date.cast("date")).cast("long") + EPOCH_DAYS
    cycles, rest = F.floor(n / CYCLE_DAYS), n % CYCLE_DAYS
    fours, rest = F.floor(rest / FOUR_YEARS), rest % FOUR_YEARS
    extra = F.when(rest > YEAR, F.floor((rest - 1) / YEAR)).otherwise(0)
    day = F.when(rest > YEAR, (rest - 1) % YEAR).otherwise(rest)
    year = cycles * 33 + fours * 4 + extra - 1595
    long_half = day < 186  # six months of 31 days, then of 30
    month = F.when(long_half, 1 + F.floor(day / 31)).otherwise(7 + F.floor((day - 186) / 30))
    dom = F.when(long_half, 1 + day % 31).otherwise(1 + (day - 186) % 30)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), dom.cast("int").alias("day"))


def from_jalali(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the three are no date: the way there must lead back."""
    y = year + 1595
    days = F.floor(y / 33) * CYCLE_DAYS + F.floor((y % 33 + 3) / 4) + YEAR * (y % 33)
    days = days + F.when(month < 7, (month - 1) * 31).otherwise((month - 7) * 30 + 186) + day - 1
    date = F.date_from_unix_date((days - EPOCH_DAYS).cast("int"))
    back = to_jalali(date)
    return F.when((back["year"] == year) & (back["month"] == month) & (back["day"] == day), date)


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_day_bounds(day: dt.date, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC bounds of a local day, half open."""
    start = F.lit(dt.datetime.combine(day, dt.time()))
    end = F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time()))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(end, zone)


def parse_date(text: Column) -> Column:
    """struct(year, month, day) from digits of any script parted by ``-``, ``.`` or
    ``/``, for years 1200 to 1600; null otherwise."""
    from .plates import ascii_digits

    shape = r"^\s*(\d{4})[-./](\d{1,2})[-./](\d{1,2})\s*$"
    v = ascii_digits(text)
    year, month, day = (F.regexp_extract(v, shape, i).try_cast("int") for i in (1, 2, 3))
    return F.when(v.rlike(shape) & year.between(1200, 1600), F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def time_of_day(ts: Column, offset_minutes: int) -> Column:
    """HH:mm:ss at a fixed offset; the offset is the current one, not the row's."""
    seconds = (F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) + offset_minutes * 60) % 86400
    part = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))
