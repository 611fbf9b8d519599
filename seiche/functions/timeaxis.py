"""Time axes as column expressions: fractional years, day numbers, rounded hours, GPS weeks, SINEX epochs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU_DAYS = math.log(2) * 365.25


def year_start(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def year_length(year: Column) -> Column:
    """Days of the year as a double, so that divisions by it are no decimals."""
    return F.datediff(year_start(year + 1), year_start(year)).cast("double")


def noon_year(day: Column) -> Column:
    """Fractional year at noon of a date."""
    return F.year(day).cast("double") + (F.dayofyear(day).cast("double") - 0.5) / year_length(F.year(day))


def fractional_year(t: Column) -> Column:
    """Fractional year of an instant; leap years are 366 days."""
    day = F.dayofyear(t).cast("double") - 1
    of_day = (F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")) / 86400.0
    return F.year(t).cast("double") + (day + of_day) / year_length(F.year(t))


def day_of(yearf: Column) -> Column:
    """The calendar day that holds a fractional year."""
    year = F.floor(yearf)
    return F.date_add(year_start(year), F.floor((yearf - year) * year_length(year) + 1e-9).cast("int"))


def instant_of(yearf: Column) -> Column:
    """The instant of a fractional year, to the nearest second."""
    year = F.floor(yearf)
    seconds = F.rint((yearf - year) * year_length(year) * 86400.0).cast("long")
    return year_start(year).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def nearest_hour(seconds: Column) -> Column:
    """Unix seconds rounded to the hour, halves to the even hour."""
    return (F.rint(seconds.cast("double") / 3600.0) * 3600).cast("long")


def day_key(yearf: Column) -> Column:
    """Whole days of 365.25 to a year, halves to even: epochs of one day share a key."""
    return F.rint(yearf * 365.25).cast("long")


def epoch_key(yearf: Column) -> Column:
    """Fractional year to five decimals as an integer."""
    return F.rint(yearf * 1e5).cast("long")


def sinex_epoch(text: Column) -> Column:
    """YY:DOY:SSSSS as an instant, years up to 50 in this century; 00:000:00000 is an open end and null."""
    year = F.regexp_extract(text, r"^(\d{2}):(\d{3}):(\d{5})$", 1).try_cast("int")
    full = F.when(year <= 50, year + 2000).otherwise(year + 1900)
    seconds = F.regexp_extract(text, r"^(\d{2}):(\d{3}):(\d{5})$", 3).try_cast("long")
    day = F.date_add(year_start(full), F.regexp_extract(text, r"^(\d{2}):(\d{3}):(\d{5})$", 2).try_cast("int") - 1)
    return F.when(text.rlike(r"^\d{2}:(?!000)\d{3}:\d{5}$"), day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


def gps_week_start(week: Column) -> Column:
    return F.date_add(F.lit("1980-01-06").cast("date"), (week * 7).cast("int"))


def date_of_week_and_day(week: Column, day_of_year: Column) -> Column:
    """The day with that day of the year from one day before the week's start to seven after; null if none."""
    start = gps_week_start(week)
    days = F.transform(F.sequence(F.lit(-1), F.lit(7)), lambda k: F.date_add(start, k))
    return F.try_element_at(F.filter(days, lambda d: F.dayofyear(d) == day_of_year), F.lit(1))


def parsed_date(text: Column) -> Column:
    """YYYYMMDD or ISO."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd"))


def half_life_days(tau_years: Column) -> Column:
    return tau_years * TAU_DAYS


def tau_years(half_life: Column) -> Column:
    return half_life / TAU_DAYS


def time_ns(whole: Column, seconds: Column) -> Column:
    """Nanoseconds since 1970: whole numbers are such, others are seconds, halves to even; NaN is no time."""
    exact = F.bround(seconds.cast("decimal(38,18)") * F.lit(1_000_000_000).cast("decimal(10,0)"), 0).cast("long")
    return F.coalesce(whole, F.when(~F.isnan(seconds), exact))


def ordinal(yearf: Column) -> Column:
    """Days from the first of January of year 1, which is day 1, with their fraction."""
    year = F.floor(yearf)
    return F.datediff(year_start(year), F.lit("0001-01-01").cast("date")) + 1 + (yearf - year) * year_length(year)
