"""Calendar keys and tolerant date parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORTNIGHTS = 26


def season_key(d: Column) -> Column:
    """month*31+day: deliberately gappy after short months and not wrapped at New Year."""
    return F.month(d) * 31 + F.dayofmonth(d)


def fortnight(d: Column) -> Column:
    return F.least(F.floor((F.dayofyear(d) - 1) / 14).cast("int"), F.lit(FORTNIGHTS - 1))


def same_day_in_year(d: Column, year: Column) -> Column:
    """Move a date to another year; 29 February becomes the 28th in every target year that lacks it."""
    feb29 = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    day = F.when(feb29 & ~leap, F.lit(28)).otherwise(F.dayofmonth(d))
    return F.make_date(year, F.month(d), day)


def epoch_ms_date(ms: Column) -> Column:
    """Epoch milliseconds to a UTC date; NULL outside 1900-2100."""
    ok = ms.between(-2208988800000, 4133980799999)
    return F.when(ok, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000.0).cast("int")))


def mixed_date(raw: Column, year: Column, doy: Column) -> Column:
    """ISO, US slash, Julian day number, else year plus day-of-year."""
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))
    us = F.when(raw.rlike(r"^\d{2}/\d{2}/\d{4}"), F.try_to_date(F.substring(raw, 1, 10), "MM/dd/yyyy"))
    jd = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double"))
    julian = F.when(
        jd > 2400000, F.date_add(F.lit("1858-11-17").cast("date"), F.floor(jd - 2400000.5).cast("int"))
    )
    fallback = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))
    return F.coalesce(iso, us, julian, fallback)
